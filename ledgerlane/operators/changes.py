"""Decisions as a change feed: two stored versions of a batch, told apart by a hash of each row, become audit events.

Only keys, states and hashes of both versions are joined. A record that is new is RECORD_DECIDED, one whose decision is
another RECORD_REVISED, and one whose review state is another HUMAN_REVIEW_ACTION; a record can have both of the latter.
Records that are as they were, and those that are gone, give no event. The feed's rows are those that ``audit.append`` takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sinks import store

# The types of audit events.
EVENT_TYPES = (
    "RUN_CREATED", "SOURCE_UPLOADED", "PLAN_UPDATED", "BATCH_STARTED", "BATCH_COMPLETED", "BATCH_FAILED", "RECORD_DECIDED", "RECORD_REVISED", "HUMAN_REVIEW_ACTION", "AI_INVESTIGATION",
)
#: What a decision is; explanations and candidates may differ without being another decision.
DECISION = ("outcome", "classification", "exception_type", "severity", "matched_payment_id")


def event(event_type: str, prior: Column, new: Column, payload: Column) -> Column:
    if event_type not in EVENT_TYPES:
        raise ValueError(f"no event type {event_type}")
    return F.struct(F.lit(event_type).alias("event_type"), prior.cast("string").alias("prior_state"), new.cast("string").alias("new_state"), F.to_json(payload).alias("payload_json"))


def digest(columns: tuple[str, ...] = DECISION) -> Column:
    """A hash of the columns in which null is no empty text."""
    return F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in columns]), {"ignoreNullFields": "false"}), 256)


def decision_events(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """transaction_id, seq, event_type, prior_state, new_state, payload_json: what happened to a batch's records between two versions."""
    sides = lambda rows, mark: rows.select("record_id", *[x.alias(f"{mark}_{n}") for n, x in (("seq", F.col("seq")), ("outcome", F.col("outcome")), ("state", F.col("review_state")), ("type", F.col("exception_type")), ("digest", digest()))])
    after = sides(new, "new")
    none = {f"old_{n}": F.lit(None).cast(t) for n, t in (("seq", "bigint"), ("outcome", "string"), ("state", "string"), ("type", "string"), ("digest", "string"))}
    rows = after.withColumns(none) if old is None else after.join(sides(old, "old"), "record_id", "left")
    c = F.col
    decided = F.when(c("old_digest").isNull(), event("RECORD_DECIDED", F.lit(None), c("new_outcome"), F.struct(c("new_type").alias("exception_type"))))
    revised = F.when(c("old_digest") != c("new_digest"), event("RECORD_REVISED", c("old_outcome"), c("new_outcome"), F.struct(c("old_type").alias("was"), c("new_type").alias("exception_type"))))
    reviewed = F.when(c("old_digest").isNotNull() & ~c("old_state").eqNullSafe(c("new_state")), event("HUMAN_REVIEW_ACTION", c("old_state"), c("new_state"), F.struct(c("new_outcome").alias("outcome"))))
    found = F.filter(F.array(decided, revised, reviewed), lambda e: e.isNotNull())
    return rows.select(c("record_id").alias("transaction_id"), c("new_seq").alias("seq"), F.explode(found).alias("e")).select("transaction_id", "seq", "e.*")


def version_events(spark: SparkSession, path: str, batch_id: str, since: int = 0) -> DataFrame:
    """version and the events of each stored version of a batch after ``since``, oldest first; the versions are few."""
    last = store.version_of(spark, path, batch_id)
    out = None
    for version in range(since + 1, last + 1):
        before = store.read_records(spark, path, batch_id, version - 1) if version > 1 else None
        part = decision_events(before, store.read_records(spark, path, batch_id, version)).withColumn("version", F.lit(version).cast("long"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "transaction_id string, seq bigint, event_type string, prior_state string, new_state string, payload_json string, version bigint")
    return out


def source_events(files: DataFrame, run_id: str) -> DataFrame:
    """SOURCE_UPLOADED for each readable file of a workspace."""
    said = F.struct("source", "source_type", "role", F.col("n_rows").alias("rows"), F.col("missing").alias("unmapped_required"), F.round("confidence", 3).alias("detection_confidence"), "provider", "duplicate_of", F.col("content_key").alias("content_hash"))
    uploaded = event("SOURCE_UPLOADED", F.lit("DRAFT"), F.lit("DRAFT"), said)
    # One row for each file of a run.
    return files.select(F.lit(run_id).alias("transaction_id"), F.row_number().over(Window.orderBy("source")).cast("bigint").alias("seq"), uploaded.alias("e")).select("transaction_id", "seq", "e.*")


def batch_event(results: DataFrame, batch_id: str) -> DataFrame:
    """BATCH_COMPLETED with the counts by outcome, as one row."""
    counts = results.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "n")))).alias("m"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    done = event("BATCH_COMPLETED", F.lit("RUNNING"), F.lit("COMPLETED"), F.struct(F.col("m").alias("outcomes"), F.col("total").alias("records")))
    return counts.select(F.lit(batch_id).alias("transaction_id"), F.lit(0).cast("bigint").alias("seq"), done.alias("e")).select("transaction_id", "seq", "e.*")


def as_log_rows(events: DataFrame, at: Column) -> DataFrame:
    """Events as ``audit.append`` takes them, in the order of version (where there is one), record and type."""
    order = F.struct(*([F.col("version")] if "version" in events.columns else []), "seq", "transaction_id", "event_type")
    return events.select(
        order.alias("order"), at.cast("string").alias("timestamp"), "transaction_id", "event_type", F.coalesce("prior_state", F.lit("")).alias("prior_state"), F.coalesce("new_state", F.lit("")).alias("new_state"),
        F.lit("").alias("evidence_ref"), "payload_json",
    )
