"""Passes over a whole batch: competing claims on one payment, and settlements that sum up several records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values
from ..schemas import EVIDENCE_TIER, Policy
from ..scratch import materialize
from .decisions import check


#: Rival claims that a reason names.
NAMED = 20


def duplicate_claims(results: DataFrame) -> DataFrame:
    """payment_id, n, record_ids of payments matched more than once, whatever the outcome."""
    claimed = results.filter("matched_payment_id IS NOT NULL").groupBy(F.col("matched_payment_id").alias("payment_id"))
    return claimed.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("record_id")), ",").alias("record_ids")).filter("n > 1")


def _tier() -> Column:
    pairs = F.create_map(*[F.lit(x) for item in EVIDENCE_TIER.items() for x in item])
    return F.coalesce(F.try_element_at(pairs, F.col("classification")), F.lit(0))


def resolve_claims(results: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """Of records that claim one payment, the strictly best supported keeps it; the others, or all in a tie, go to review.

    The claims of a payment are counted by aggregation before they are joined back, and only contested ones are.
    """
    claims = results.filter("matched_payment_id IS NOT NULL AND outcome <> 'EXCEPTION'").select("matched_payment_id", "record_id", _tier().alias("tier"))
    best = claims.groupBy("matched_payment_id").agg(F.count(F.lit(1)).alias("n_claims"), F.max("tier").alias("best")).filter("n_claims > 1")
    # Of a payment that very many records claim, a few are named; no list grows with them.
    first = F.row_number().over(Window.partitionBy("matched_payment_id").orderBy("record_id"))
    named = claims.withColumn("_n", first).filter(F.col("_n") <= NAMED + 1).groupBy("matched_payment_id").agg(F.array_sort(F.collect_list("record_id")).alias("claimants"))
    best = best.join(named, "matched_payment_id")
    at_best = claims.join(best.select("matched_payment_id", "best"), "matched_payment_id").filter("tier = best").groupBy("matched_payment_id").agg(F.count(F.lit(1)).alias("n_best"))
    # The contested payments are few, and known to be so once they are a table: then the decisions needn't be shuffled to meet them.
    contested = keep(best.join(at_best, "matched_payment_id"), "contested")
    joined = results.join(contested, "matched_payment_id", "left")
    kept = (F.col("n_best") == 1) & (_tier() == F.col("best"))
    lost = F.col("n_claims").isNotNull() & (F.col("outcome") != "EXCEPTION") & ~kept
    few = F.slice(F.array_except("claimants", F.array("record_id")), 1, NAMED)
    rest = F.col("n_claims") - 1 - F.size(few)
    others = F.concat(F.array_join(few, ", "), F.when(rest > 0, F.concat(F.lit(" and "), rest.cast("string"), F.lit(" more"))).otherwise(""))
    verdict = F.when(F.col("n_best") == 1, "a stronger claim exists").otherwise("no claim is better supported")
    reason = F.concat(F.lit("settlement "), F.col("matched_payment_id"), F.lit(" is also matched to "), others, F.lit("; "), verdict)
    more = check("claim_uniqueness", F.lit(False), F.lit("1 record per payment"), F.concat(F.col("n_claims").cast("string"), F.lit(" records")), "", F.concat(F.lit("also claimed by "), others), warn=True)
    return _revised(joined, results.columns, lost, {
        "outcome": F.lit("HUMAN_REVIEW"), "exception_type": F.lit("DUPLICATE_CLAIM"), "severity": F.lit("HIGH"), "reason": reason,
        "explanation": F.concat(F.lit("This payment is claimed by "), F.col("n_claims").cast("string"), F.lit(" records; counting it twice is held back.")),
        "recommended_action": F.lit("Confirm which record the payment belongs to."), "checks": F.concat("checks", F.array(more)),
    })


def _revised(rows: DataFrame, columns: list[str], when: Column, new: dict[str, Column]) -> DataFrame:
    return rows.select(*[F.when(F.coalesce(when, F.lit(False)), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in columns])


def unmatched(results: DataFrame) -> DataFrame:
    return results.filter("matched_payment_id IS NULL AND outcome <> 'RECONCILED'")


def unclaimed(settlements: DataFrame, results: DataFrame) -> DataFrame:
    """Settlements that no record is matched to."""
    taken = results.filter("matched_payment_id IS NOT NULL").select(F.col("matched_payment_id").alias("payment_id"))
    return settlements.join(taken, "payment_id", "left_anti")


def aggregated_settlements(results: DataFrame, settlements: DataFrame, policy: Policy, batch: str | None = None) -> DataFrame:
    """payment_id, pop_seq, record_ids of unclaimed settlements that are the sum of one pair or triple of unmatched records only.

    Meaningful, and done, only where 2 to ``max_aggregation_candidates`` records are unmatched in all; the guard is a count in
    the plan, so the combinations are of a list of bounded size. With ``batch``, a column of both tables, each batch is apart.
    """
    cap = policy.max_aggregation_candidates
    of = F.col(batch) if batch else F.lit(0)
    left = unmatched(results).select(of.alias("batch"), "seq", "record_id", "amount_minor", "order_date")
    # Only batches within the guard are collected to lists.
    size = left.groupBy("batch").agg(F.count(F.lit(1)).alias("n_unmatched")).filter((F.col("n_unmatched") >= 2) & (F.col("n_unmatched") <= cap)).select("batch")
    members = left.join(size, "batch").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("seq", "record_id", "amount_minor", "order_date"))).alias("pool"))
    rows = unclaimed(settlements, results).select(of.alias("batch"), "pop_seq", "payment_id", "gross_amount_minor", F.col("order_date").alias("s_date")).join(members, "batch").drop("batch")
    fits = F.filter("pool", lambda r: (r.amount_minor < F.col("gross_amount_minor")) & (values.days_between(r.order_date, F.col("s_date")) <= policy.candidate_search_window_days))
    rows = rows.withColumn("pool", fits).filter(F.size("pool") >= 2)
    one = rows.select("pop_seq", "payment_id", "gross_amount_minor", F.posexplode("pool").alias("i", "a"), "pool")
    two = one.select("*", F.posexplode("pool").alias("j", "b")).filter("j > i")
    pair = two.select("pop_seq", "payment_id", "gross_amount_minor", (F.col("a.amount_minor") + F.col("b.amount_minor")).alias("total"), F.array("a.record_id", "b.record_id").alias("members"))
    near = F.col("a.amount_minor") + F.col("b.amount_minor") < F.col("gross_amount_minor") + policy.amount_tolerance_minor
    three = two.filter(near).select("*", F.posexplode("pool").alias("k", "c")).filter("k > j")
    triple = three.select("pop_seq", "payment_id", "gross_amount_minor", (F.col("a.amount_minor") + F.col("b.amount_minor") + F.col("c.amount_minor")).alias("total"), F.array("a.record_id", "b.record_id", "c.record_id").alias("members"))
    found = pair.unionByName(triple).filter(values.amounts_match(F.col("total"), F.col("gross_amount_minor"), policy.amount_tolerance_minor))
    return found.groupBy("pop_seq", "payment_id").agg(F.count(F.lit(1)).alias("n"), F.first("members").alias("members")).filter("n = 1").drop("n")


def apply_aggregations(results: DataFrame, found: DataFrame) -> DataFrame:
    """Members of a sum go to review; a record in two sums takes that of the later settlement."""
    last = found.select("pop_seq", F.col("payment_id").alias("bundle_id"), "members", F.explode("members").alias("record_id"))
    last = last.groupBy("record_id").agg(F.max_by(F.struct("bundle_id", "members"), "pop_seq").alias("b")).select("record_id", "b.*")
    joined = results.join(last, "record_id", "left")
    hit = F.col("bundle_id").isNotNull()
    siblings = F.array_join(F.array_except("members", F.array("record_id")), ", ")
    count = F.size("members").cast("string")
    more = check("aggregated_settlement", F.lit(False), F.lit("1 settlement per record"), F.concat(count, F.lit(" records sum up to "), F.col("bundle_id")), "", "proposed, not applied: a sum can be made up in several ways", warn=True)
    return _revised(joined, results.columns, hit, {
        "outcome": F.lit("HUMAN_REVIEW"), "exception_type": F.lit("AGGREGATED_SETTLEMENT"), "severity": F.lit("MEDIUM"),
        "reason": F.concat(F.lit("settlement "), F.col("bundle_id"), F.lit(" is the sum of this record and "), siblings),
        "explanation": F.concat(F.lit("One settlement equals the sum of "), count, F.lit(" unmatched records with this one.")),
        "recommended_action": F.concat(F.lit("Confirm that settlement "), F.col("bundle_id"), F.lit(" covers them together.")), "checks": F.concat("checks", F.array(more)),
    })


def process_batch(results: DataFrame, settlements: DataFrame, policy: Policy, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Decided records after both passes: sums first, then claims.

    Each pass reads the decisions several times, so they are a table first. With ``keep``, which makes a table of what it is given
    or finds it, they are one already. The passes only add small tables, so what they revise needn't be written.
    """
    results = results if keep else materialize(results, "decisions")
    keep = keep or materialize
    sums = keep(aggregated_settlements(results, settlements, policy), "sums")
    return resolve_claims(apply_aggregations(results, sums), keep)
