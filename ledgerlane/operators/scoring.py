"""Evidence of a pair, its score, admissibility and the shortlist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, values
from ..schemas import Policy

#: Scores are compared at this grain, so that sums in another order can't change a ranking.
GRAIN = 1_000_000_000
#: What wording can add to a score.
WORDING = 0.20


def pair_signals(pairs: DataFrame, policy: Policy) -> DataFrame:
    """Signals of joined pairs; ledger columns carry l_, settlement columns s_."""
    c = F.col
    delta = c("s_gross_amount_minor") - c("l_amount_minor")
    exact = F.abs(delta) <= policy.amount_tolerance_minor
    comparable = text.references_comparable(c("l_ref_cores"), c("s_ref_cores"))
    days = values.days_between(c("l_order_date"), c("s_order_date"))
    out = pairs.withColumns(
        {
            "amount_delta": delta,
            "amount_exact": exact,
            "amount_ratio": F.when(c("l_amount_minor") != 0, c("s_gross_amount_minor") / c("l_amount_minor")).otherwise(F.lit(0.0)),
            "shared_core": F.arrays_overlap(c("l_cores"), c("s_cores")),
            "comparable": comparable,
            "contradiction": comparable & ~F.arrays_overlap(c("l_ref_cores"), c("s_ref_cores")),
            "days_apart": days,
            "similarity": text.weighted_jaccard(c("l_tokens"), c("l_weights"), c("l_total"), c("s_tokens"), c("s_total")),
        }
    )
    score = base_score(c("amount_exact"), c("shared_core"), c("days_apart"), policy) + 0.20 * c("similarity")
    out = out.withColumns({"in_window": c("days_apart") <= policy.candidate_search_window_days, "score": F.rint(score * GRAIN) / GRAIN})
    return out.withColumn("admitted", admissibility(policy)).withColumns({"admissible": c("admitted.admissible"), "admissibility_reason": c("admitted.reason")}).drop("admitted")


def base_score(amount_exact: Column, shared_core: Column, days_apart: Column, policy: Policy) -> Column:
    """The score without its wording part (which adds 0.2 at most)."""
    return base_of(amount_exact, shared_core, days_apart, F.col("l_amount_minor"), F.col("s_gross_amount_minor"), policy)


def base_of(amount_exact: Column, shared_core: Column, days_apart: Column, amount: Column, gross: Column, policy: Policy) -> Column:
    agreed = F.when(amount_exact, F.lit(1.0)).when(amount > 0, F.greatest(F.lit(0.0), 1.0 - F.least(F.abs(gross - amount) / amount, F.lit(1.0)) * 2.0)).otherwise(F.lit(0.0))
    date = F.greatest(F.lit(0.0), 1.0 - days_apart / max(policy.candidate_search_window_days, 1))
    return 0.45 * agreed + 0.25 * shared_core.cast("double") + 0.10 * date


def admissibility(policy: Policy) -> Column:
    """Whether a pair is evidence of identity at all: the first rule that applies."""
    c = F.col
    rule = lambda ok, reason: F.struct(F.lit(ok).alias("admissible"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    if not policy.require_identity_evidence:
        return rule(True, "policy asks for no identity evidence")
    out = F.when(~c("in_window"), rule(False, "dated outside the settlement window"))
    if policy.treat_reference_contradiction_as_negative:
        out = F.when(c("contradiction"), rule(False, "the references name different transactions")).when(~c("in_window"), rule(False, "dated outside the settlement window"))
    return (
        out.when(c("shared_core"), rule(True, "an identifier is shared"))
        .when(c("similarity") >= policy.admissible_text_similarity, rule(True, F.format_string("the wording agrees (%.2f)", c("similarity"))))
        .when(c("amount_exact") & ~c("comparable"), rule(True, "amount and date agree, and no identifier speaks against it"))
        .when(c("amount_exact"), rule(False, "only the amount agrees, which identifies nothing"))
        .otherwise(rule(False, "nothing identifies it"))
    )


def corroborating_count() -> Column:
    """How many of exact amount, shared identifier and dates within three days agree."""
    return F.col("amount_exact").cast("int") + F.col("shared_core").cast("int") + (F.col("days_apart") <= 3).cast("int")


def supporting_signals() -> Column:
    c = F.col
    near = (F.abs(c("amount_ratio") - 1.0) < 0.02) & ~c("amount_exact")
    found = F.array(
        F.when(c("amount_exact"), F.lit("exact amount")),
        F.when(near, F.lit("amount within 2%")),
        F.when(c("shared_core"), F.lit("shared identifier")),
        F.when(c("days_apart") <= 3, F.format_string("%d days apart", c("days_apart"))),
        F.when(c("similarity") >= 0.5, F.format_string("similar wording (%.2f)", c("similarity"))),
    )
    return F.filter(found, lambda x: x.isNotNull())


def contradicting_signals() -> Column:
    c = F.col
    found = F.array(
        F.when(c("contradiction"), F.lit("references name different transactions")),
        F.when(~c("amount_exact"), F.format_string("amount off by %d minor units", F.abs("amount_delta"))),
        F.when(~c("in_window"), F.format_string("%d days apart, outside the window", c("days_apart"))),
        F.when(c("similarity") < 0.2, F.format_string("unrelated wording (%.2f)", c("similarity"))),
    )
    return F.filter(found, lambda x: x.isNotNull())


def join_pairs(pool: DataFrame, ledger: DataFrame, settlements: DataFrame) -> DataFrame:
    """Pool rows with the columns that signals need."""
    left = ledger.select("seq", *[F.col(x).alias(f"l_{x}") for x in ("amount_minor", "order_date", "cores", "ref_cores", "tokens", "weights", "total")])
    right = settlements.select("pop_seq", *[F.col(x).alias(f"s_{x}") for x in ("gross_amount_minor", "order_date", "cores", "ref_cores", "tokens", "total")])
    return pool.join(left, "seq").join(right, "pop_seq")


def promising_pool(pool: DataFrame, ledger: DataFrame, settlements: DataFrame, policy: Policy) -> DataFrame:
    """The pool less what can't be listed, from amounts and dates alone.

    Implausible amounts go, unless a record would be left without any candidate. Then a pair stays only if its score
    without wording, plus all that wording can add, reaches the last place of the shortlist without wording.
    """
    left = ledger.select("seq", F.col("amount_minor").alias("l_amount_minor"), F.col("order_date").alias("l_order_date"))
    right = settlements.select("pop_seq", F.col("gross_amount_minor").alias("s_gross_amount_minor"), F.col("order_date").alias("s_order_date"))
    rows = pool.join(left, "seq").join(right, "pop_seq")
    exact = values.amounts_match(F.col("l_amount_minor"), F.col("s_gross_amount_minor"), policy.amount_tolerance_minor)
    rows = rows.withColumns(
        {
            "plausible": values.amount_plausible(F.col("l_amount_minor"), F.col("s_gross_amount_minor")),
            "base": base_score(exact, F.col("has_core"), values.days_between(F.col("l_order_date"), F.col("s_order_date")), policy),
        }
    )
    own = Window.partitionBy("seq")
    rows = rows.withColumn("some", F.max("plausible").over(own)).filter("plausible OR NOT some")
    rank = F.row_number().over(own.orderBy(F.desc("base")))
    last = F.min(F.when(F.col("rank") <= policy.candidate_shortlist_size, F.col("base"))).over(own)
    return rows.withColumn("rank", rank).withColumn("last", last).filter(F.col("base") + WORDING + 1e-6 >= F.col("last")).select("seq", "pop_seq", "source", "place", "has_core", "base")


def rank_by_score(pool: DataFrame, ledger: DataFrame, settlements: DataFrame, policy: Policy) -> DataFrame:
    """The shortlist: the best few of each record by score, ``position`` from 1; ties go by source, place and population order."""
    left = ledger.select("seq", F.col("tokens").alias("l_tokens"), F.col("weights").alias("l_weights"), F.col("total").alias("l_total"))
    right = settlements.select("pop_seq", F.col("tokens").alias("s_tokens"), F.col("total").alias("s_total"))
    rows = pool.join(right, "pop_seq").join(left, "seq")
    similarity = text.weighted_jaccard(F.col("l_tokens"), F.col("l_weights"), F.col("l_total"), F.col("s_tokens"), F.col("s_total"))
    rows = rows.select("seq", "pop_seq", "source", "place", (F.rint((F.col("base") + 0.20 * similarity) * GRAIN) / GRAIN).alias("rank_score"))
    order = Window.partitionBy("seq").orderBy(F.desc("rank_score"), "source", "place", "pop_seq")
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= policy.candidate_shortlist_size).select("seq", "pop_seq", "source", "place", "position")
