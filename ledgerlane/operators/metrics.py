"""Scores of decided records against known truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize

OUTCOMES = ("RECONCILED", "EXCEPTION", "HUMAN_REVIEW")


def _share(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0)), 6)


def evaluation(rows: DataFrame) -> DataFrame:
    """One row of metrics over outcome and expected (and ai_invoked, ai_calls, classification)."""
    c = F.col
    right, n = F.count_if(c("outcome") == c("expected")), F.count(F.lit(1))
    said = lambda o: F.count_if(c("outcome") == o)
    true = lambda o: F.count_if(c("expected") == o)
    both = lambda o: F.count_if((c("outcome") == o) & (c("expected") == o))
    asked = F.count_if(c("ai_invoked"))
    return rows.agg(
        n.alias("record_count"), _share(right, n).alias("accuracy"), _share(both("EXCEPTION"), said("EXCEPTION")).alias("exception_precision"), _share(both("EXCEPTION"), true("EXCEPTION")).alias("exception_recall"),
        _share(F.count_if((c("outcome") == "RECONCILED") & (c("expected") != "RECONCILED")), said("RECONCILED")).alias("false_auto_reconciliation"),
        _share(F.count_if((c("outcome") == "EXCEPTION") & (c("expected") == "RECONCILED")), true("RECONCILED")).alias("false_exception"),
        *[_share(said(o), n).alias(f"share_{o.lower()}") for o in OUTCOMES], _share(asked, n).alias("semantic_rate"), F.sum("ai_calls").alias("ai_calls_total"),
        _share(F.sum("ai_calls") * 1000, n).alias("ai_calls_per_1000"), F.count_if(c("classification") == "PROVIDER_ERROR").alias("provider_errors"),
    )


def confusion_by_case(rows: DataFrame, case: str = "case_name") -> DataFrame:
    """Outcomes per case, as columns."""
    wide = rows.groupBy(case).pivot("outcome", list(OUTCOMES)).agg(F.count(F.lit(1)))
    return wide.select(case, *[F.coalesce(o, F.lit(0)).alias(o.lower()) for o in OUTCOMES])


def percentiles(rows: DataFrame, value: str, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact percentiles with linear interpolation, and the maximum; nulls are no values, and without values all are null.

    The values are sorted in ranges, in parallel, and ranked by the ranges' sizes; only the two neighbours of each percentile leave
    their range, so no task holds all different values.
    """
    own = rows.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    ordered = materialize(own.repartitionByRange("v").sortWithinPartitions("v").withColumns({"_range": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}), "percentiles")
    sizes = ordered.groupBy("_range").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # A row for each range.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumns({"_before": before, "_all": F.sum("_n").over(Window.partitionBy())}).drop("_n")
    ranked = ordered.join(F.broadcast(sizes), "_range").withColumn("rank", F.col("_id") - F.col("_first") + F.col("_before"))
    place = {p: (F.col("_all") - 1) * F.lit(p) for p in at}
    near = F.lit(False)
    for x in place.values():
        near = near | (F.col("rank") == F.floor(x)) | (F.col("rank") == F.ceil(x))
    picked = ranked.filter(near | (F.col("rank") == F.col("_all") - 1))
    sides = {p: (F.max(F.when(F.col("rank") == F.floor(x), F.col("v"))), F.max(F.when(F.col("rank") == F.ceil(x), F.col("v"))), F.max(x - F.floor(x))) for p, x in place.items()}
    return picked.agg(*[F.round(low + (high - low) * part, 6).alias(f"p{round(p * 100)}") for p, (low, high, part) in sides.items()], F.max("v").alias("max"))


def tier_ablation(runs: dict[str, DataFrame]) -> DataFrame:
    """The evaluation of the same records under several policies, one row each."""
    out = None
    for name, rows in runs.items():
        row = evaluation(rows).withColumn("tier", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def by_variation(rows: DataFrame, *by: str) -> DataFrame:
    """Per policy and variation (the columns ``by``): records, recall (of those to be reconciled), correct rejection (of the others), wrong matches, and records sent to a person."""
    c = F.col
    wanted, matched = c("expected") == "RECONCILED", c("outcome") == "RECONCILED"
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), _share(F.count_if(wanted & matched), F.count_if(wanted)).alias("recall"), _share(F.count_if(~wanted & ~matched), F.count_if(~wanted)).alias("correct_rejection"),
        F.count_if(~wanted & matched).alias("wrong_matches"), F.count_if(c("outcome") == "HUMAN_REVIEW").alias("to_person"),
    )


def presence(rows: DataFrame, by: str) -> DataFrame:
    """Per value of ``by``: records, share judged well, matches to a wrong settlement, and outcomes, over truth and true_payment_id.

    Present ones are to be reconciled with their own settlement, absent ones reported missing, pending ones sent to a person
    or reported as pending, ambiguous ones sent to a person.
    """
    c = F.col
    typed = lambda kind: (c("outcome") == "EXCEPTION") & c("exception_type").eqNullSafe(kind)
    fits = (
        F.when(c("truth") == "present", c("outcome") == "RECONCILED").when(c("truth") == "absent", typed("MISSING_SETTLEMENT"))
        .when(c("truth") == "pending", (c("outcome") == "HUMAN_REVIEW") | typed("PENDING_SETTLEMENT")).when(c("truth") == "ambiguous", c("outcome") == "HUMAN_REVIEW").otherwise(F.lit(False))
    )
    wrong = F.when(c("truth") == "present", fits & ~c("matched_payment_id").eqNullSafe(c("true_payment_id"))).when(c("truth").isin("absent", "pending"), c("matched_payment_id").isNotNull()).otherwise(F.lit(False))
    well = fits & ~wrong
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), _share(F.count_if(well), F.count(F.lit(1))).alias("accuracy"), F.count_if(wrong).alias("wrong_matches"), *[F.count_if(c("outcome") == o).alias(o.lower()) for o in OUTCOMES]
    )
