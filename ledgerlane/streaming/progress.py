"""Progress by observation: counters that a job computes while it runs, instead of counts that are polled.

``watched`` adds named counters to a plan; they cost no pass of their own. Of a batch job they are there when it ends, of a stream
after each micro-batch, where ``Totals`` listens and adds them up for as long as it is registered.
"""

from __future__ import annotations

import threading
import time
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def decision_counters() -> dict[str, Column]:
    """Counters over decided records: all, by outcome, and those that the verifier was asked about."""
    outcome = F.col("outcome")
    counts = {"decided": F.count(F.lit(1)), "semantic_tier_invoked": F.count_if("ai_invoked")}
    return counts | {o.lower(): F.count_if(outcome == o) for o in ("RECONCILED", "EXCEPTION", "HUMAN_REVIEW")}


def watched(rows: DataFrame, counters: dict[str, Column], name: str = "progress") -> tuple[DataFrame, Observation]:
    """The rows, and an observation whose ``get`` has the counters once an action on them has ended."""
    seen = Observation(name)
    return rows.observe(seen, *[c.alias(k) for k, c in counters.items()]), seen


def watched_stream(rows: DataFrame, counters: dict[str, Column], name: str = "progress") -> DataFrame:
    return rows.observe(name, *[c.alias(k) for k, c in counters.items()])


class Totals(StreamingQueryListener):
    """Sums of a stream's observed counters over its micro-batches, by the query's run id.

    It hears of the streams of one session only: ``spark``, or the active one.
    """

    def __init__(self, name: str = "progress", spark: SparkSession | None = None) -> None:
        self.name = name
        self.spark = spark
        self.sums: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(int))
        self.batches: dict[str, int] = defaultdict(int)
        self.ended: set[str] = set()
        # By run: the first and last micro-batch heard of, the last one counted, and whether one between was missed.
        self.heard: dict[str, tuple[int, int]] = {}
        self.counted: dict[str, int] = {}
        self.missed: set[str] = set()
        self.lock = threading.Lock()

    def add(self, progress) -> None:
        """Count a micro-batch, once, whether it is heard of as an event or read from its query."""
        run, batch = str(progress.runId), progress.batchId
        row = progress.observedMetrics.get(self.name)
        with self.lock:
            first, last = self.heard.get(run, (batch, batch))
            if batch > last + 1:
                self.missed.add(run)
            self.heard[run] = (first, max(last, batch))
            if row is not None and batch > self.counted.get(run, -1):
                self.counted[run] = batch
                self.batches[run] += 1
                for k, v in row.asDict().items():
                    self.sums[run][k] += v if isinstance(v, int) else float(v or 0)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.add(event.progress)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.add(str(event.runId))

    def wait(self, run_id: str, seconds: float = 60) -> None:
        """Until a run's end has been heard of: events come a little after the query itself has ended."""
        until = time.monotonic() + seconds
        while run_id not in self.ended:
            if time.monotonic() > until:
                raise TimeoutError(f"the end of run {run_id} wasn't heard of in {seconds} s: its counters may lack micro-batches")
            time.sleep(0.05)

    def of(self, run: StreamingQuery, seconds: float = 20) -> dict[str, float]:
        """The sums over all micro-batches of a run that has ended; an error if one wasn't heard of.

        Micro-batches whose events are lost or late are read from the progress that the query itself keeps, as far back
        as it does (``spark.sql.streaming.numRecentProgressUpdates``).
        """
        run_id, recent = str(run.runId), run.recentProgress
        try:
            self.wait(run_id, seconds)
        except TimeoutError:
            if recent and recent[0].batchId > self.heard.get(run_id, (0, -1))[1] + 1:
                raise
        for progress in recent:
            self.add(progress)
        if run_id in self.missed or (recent and self.heard[run_id][0] > recent[0].batchId):
            raise RuntimeError(f"micro-batches of run {run_id} were not heard of")
        return dict(self.sums[run_id])

    def __enter__(self) -> Totals:
        self.spark = self.spark or SparkSession.getActiveSession()
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.streams.removeListener(self)
