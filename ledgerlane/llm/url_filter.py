"""URL filters: a trie over reversed host labels and path segments decides between allow and block rules.

The rules are a stated list; they are sent to the tasks, at most ``max_rules`` at once. Every url is judged on its own, so nothing is shuffled and no key can become hot.

Cases: a null url, or one without ``://``, has an empty host and path and fits no rule; an empty rule list
gives the default verdict everywhere; repeated rows are judged alike; other columns are passed by.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, map_batches

SCHEMA = "page_id long, host string, path string, rule string, verdict string"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_PARTS = re.compile(r"([^/?#]*)([^?#]*)", re.DOTALL)


@dataclass(frozen=True)
class Rule:
    """``verdict`` is allow or block; ``path`` is a prefix of the url's path and starts with a slash."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass
class _Node:
    below: dict[str, _Node] = field(default_factory=dict)
    paths: _Node | None = None
    ends: list[tuple[str, Rule]] = field(default_factory=list)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path as the contract defines them."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host, path = _PARTS.match(rest).groups()
    return host.translate(_LOWER), path


class RuleTrie:
    """Host labels from the right, then whole path segments; the rest after a rule's last slash is a prefix of one segment."""

    def __init__(self, rules: list[Rule]):
        self.root = _Node()
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.below.setdefault(label, _Node())
            node.paths = at = node.paths or _Node()
            *whole, rest = rule.path.split("/")
            for segment in whole:
                at = at.below.setdefault(segment, _Node())
            at.ends.append((rest, rule))

    def longest(self, host: str, path: str) -> Rule | None:
        """Of the rules that fit, the one with the longest text; at equal length the longer host, then block before allow."""
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                break
            at = node.paths
            if at is None:
                continue
            for segment in path.split("/"):
                for rest, rule in at.ends:
                    if segment.startswith(rest) and (best is None or self._rank(rule) > self._rank(best)):
                        best = rule
                at = at.below.get(segment)
                if at is None:
                    break
        return best

    @staticmethod
    def _rank(rule: Rule) -> tuple:
        return len(rule.text), len(rule.host), rule.verdict == "block", rule.text


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url", max_rules: int = 1_000_000) -> DataFrame:
    """One row per page: id, host, path, the text of the rule that decides (or null) and the verdict.

    At most ``max_rules`` rules (some 200 MB) are broadcast at once; a longer list is applied in several passes, each of which
    hands the best rule so far to the next.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), *[F.lit(None).cast("string").alias(c) for c in ("by", "rule_host", "rule_path")])
    cuts = list(range(0, len(rules), max_rules)) or [0]
    for k in cuts:
        rows = _one_pass(rows, list(rules[k : k + max_rules]), default, k == cuts[-1])
    return rows


def _one_pass(rows: DataFrame, rules: list[Rule], default: str, last: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(rules)

    def make():
        trie = RuleTrie(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            known = [Rule(*r) if r[0] else None for r in zip(*(batch.column(c).to_pylist() for c in ("by", "rule_host", "rule_path")), strict=True)]
            found = [max((r for r in (old, trie.longest(*p)) if r), key=RuleTrie._rank, default=None) for old, p in zip(known, parts, strict=True)]
            if not last:
                kept = {c: pa.array([r and getattr(r, n) for r in found], pa.string()) for c, n in (("by", "verdict"), ("rule_host", "host"), ("rule_path", "path"))}
                return columns(page_id=batch.column("page_id"), url=batch.column("url"), **kept)
            return columns(
                page_id=batch.column("page_id"),
                host=pa.array([p[0] for p in parts], pa.string()),
                path=pa.array([p[1] for p in parts], pa.string()),
                rule=pa.array([r and r.text for r in found], pa.string()),
                verdict=pa.array([r.verdict if r else default for r in found], pa.string()),
            )

        return step

    return map_batches(rows, make, SCHEMA if last else "page_id long, url string, by string, rule_host string, rule_path string")
