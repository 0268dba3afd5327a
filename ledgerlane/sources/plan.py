"""A workspace of sources: stages, what links files of neighbouring stages, coverage, and what stands against a run.

``sources`` has one row per file: source_id, filename, stage, source_type, role, n_rows, needs_confirmation, missing
(a list of unmapped required fields), content_hash and identifiers (a bounded sample of identifiers).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STAGES = ("ORDERS", "GATEWAY", "SETTLEMENT", "BANK", "ACCOUNTING")
MAX_RELATIONSHIPS = 60


def identifier_sample(rows: DataFrame, columns: list[str], scan: int = 2_000, keep: int = 200) -> DataFrame:
    """One row: up to ``keep`` distinct upper-case identifiers of the first ``scan`` rows (a sample by definition)."""
    every = rows.limit(scan).select(F.explode(F.array(*[F.upper(F.trim(F.col(f"`{c}`").cast("string"))) for c in columns])).alias("v")).filter("v <> ''").distinct()
    return every.orderBy("v").limit(keep).agg(F.array_sort(F.collect_list("v")).alias("identifiers"))


def _order(stage: str = "stage"):
    return F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col(stage))


def relationships(sources: DataFrame) -> DataFrame:
    """left_id, right_id, shared: files of one stage and of the next stage that has files, with the identifiers they share."""
    staged = sources.filter(F.col("stage").isin(*STAGES)).withColumn("at", _order())
    have = staged.select("at").distinct()
    ahead = have.withColumn("next_at", F.lead("at").over(Window.orderBy("at"))).filter("next_at IS NOT NULL")  # at most five rows
    left = staged.join(F.broadcast(ahead), "at").select(F.col("source_id").alias("left_id"), F.col("identifiers").alias("a"), "next_at")
    right = staged.select(F.col("source_id").alias("right_id"), F.col("identifiers").alias("b"), F.col("at").alias("next_at"))
    pairs = left.join(right, "next_at").select("left_id", "right_id", F.size(F.array_intersect("a", "b")).alias("shared"))
    return pairs.orderBy("left_id", "right_id").limit(MAX_RELATIONSHIPS)


def exact_relationships(identifiers: DataFrame) -> DataFrame:
    """left_id, right_id, shared: as ``relationships``, over all identifiers (source_id, stage, id) instead of a sample; pairs that share none are left out.

    Each source has an identifier once, so a common one meets itself only in as many rows as there are sources.
    """
    own = identifiers.filter(F.col("stage").isin(*STAGES)).select("source_id", _order().alias("at"), F.upper(F.trim("id")).alias("id")).filter("id <> ''").distinct()
    ahead = own.select("at").distinct().withColumn("next_at", F.lead("at").over(Window.orderBy("at"))).filter("next_at IS NOT NULL")  # at most five rows
    left = own.join(F.broadcast(ahead), "at").select(F.col("source_id").alias("left_id"), "id", "next_at")
    right = own.select(F.col("source_id").alias("right_id"), "id", F.col("at").alias("next_at"))
    return left.join(right, ["id", "next_at"]).groupBy("left_id", "right_id").agg(F.count(F.lit(1)).alias("shared"))


def stage_coverage(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Per stage: its files, and the decided records that come from them or are matched to them."""
    files = sources.groupBy("stage").agg(F.count(F.lit(1)).alias("files"), F.sum("n_rows").alias("n_rows"))
    own = records.join(sources.select("source_id", "stage"), "source_id").groupBy("stage").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("outcome") == "RECONCILED").alias("reconciled"))
    return files.join(own, "stage", "left").select("stage", "files", "n_rows", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("reconciled", F.lit(0)).alias("reconciled"))


def blockers(sources: DataFrame) -> DataFrame:
    """code and subject of everything that keeps a run from starting; no rows means it can."""
    per_file = sources.filter("size(missing) > 0").select(F.lit("UNMAPPED_REQUIRED").alias("code"), F.col("filename").alias("subject")).unionByName(
        sources.filter("needs_confirmation").select(F.lit("UNCONFIRMED_ROLE").alias("code"), F.col("filename").alias("subject"))
    )
    sides = sources.agg(F.count_if(F.col("role") == "LEDGER").alias("l"), F.count_if(F.col("role") == "SETTLEMENT").alias("s"))
    gone = sides.select(F.explode(F.filter(F.array(F.when(F.col("l") == 0, F.lit("NO_LEDGER_SIDE")), F.when(F.col("s") == 0, F.lit("NO_SETTLEMENT_SIDE"))), lambda x: x.isNotNull())).alias("code"))
    return per_file.unionByName(gone.withColumn("subject", F.lit("run")))


def counts(sources: DataFrame) -> DataFrame:
    """Files and rows by type and role."""
    return sources.groupBy("source_type", "role").agg(F.count(F.lit(1)).alias("files"), F.sum("n_rows").alias("n_rows"))


def duplicates(sources: DataFrame) -> DataFrame:
    """source_id and the earliest source with the same bytes."""
    first = F.min("source_id").over(Window.partitionBy("content_hash"))
    return sources.withColumn("duplicate_of", first).filter("source_id <> duplicate_of").select("source_id", "duplicate_of")
