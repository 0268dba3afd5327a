"""Verifiers of ambiguous pairs: an interface over DataFrames, the offline heuristic, and a wrapper for external callers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

VERDICT = "verdict string, confidence double, backend string"


class Verifier(Protocol):
    """Adds verdict (SAME, DIFFERENT, AMBIGUOUS or ERROR), confidence and backend to scored pairs."""

    def annotate(self, pairs: DataFrame) -> DataFrame: ...


class HeuristicVerifier:
    """Token overlap, amounts and dates; never confident enough to reconcile by itself."""

    def annotate(self, pairs: DataFrame) -> DataFrame:
        c = F.col
        similarity = text.jaccard(c("l_tokens"), c("s_tokens"))
        close = c("amount_exact") | (F.abs("amount_delta") <= F.greatest(F.lit(2), F.floor(c("l_amount_minor") * 0.02)))
        same = (similarity >= 0.6) & close & (c("days_apart") <= 21)
        core = c("shared_core") & close
        different = (similarity < 0.15) | ~close
        verdict = F.when(same | core, "SAME").when(different, "DIFFERENT").otherwise("AMBIGUOUS")
        confidence = F.when(same, F.bround(F.least(F.lit(0.75), similarity), 2)).when(core, F.lit(0.7)).when(different, F.bround(1 - similarity, 2)).otherwise(F.bround(similarity, 2))
        return pairs.withColumns({"verdict": verdict, "confidence": confidence, "backend": F.lit("heuristic-fallback")})


class CallableVerifier:
    """Pairs judged by a function of a pandas frame, partition by partition; its failure is the verdict ERROR, not the job's."""

    def __init__(self, judge: Callable[[pd.DataFrame], pd.DataFrame], backend: str):
        self.judge, self.backend = judge, backend

    def annotate(self, pairs: DataFrame) -> DataFrame:
        judge, backend = self.judge, self.backend

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                try:
                    found = judge(frame)
                    yield frame.assign(verdict=found["verdict"].to_numpy(), confidence=found["confidence"].to_numpy(), backend=backend)
                except Exception as error:  # noqa: BLE001  any failure of an outside caller degrades alike
                    yield frame.assign(verdict="ERROR", confidence=float("nan"), backend=f"{backend}: {type(error).__name__}")

        plain = pairs.drop("l_weights")
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
        return plain.mapInPandas(run, f"{fields}, {VERDICT}")
