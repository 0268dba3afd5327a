"""All queries of the reconciliation and their SQL, from the modules that define them."""

from __future__ import annotations

from . import investigations, queries, records, states, workspaces
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "investigations", "queries", "records", "states", "workspaces"]
