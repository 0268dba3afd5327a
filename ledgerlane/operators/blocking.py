"""Candidate search: exact references, and the blocked pool of amount, identifier and date-window candidates.

Each block is an equi-join on a derived column. The date window is answered per calendar day: of any day no more than
``cap`` settlements can ever be taken, so days are cut to their first ``cap`` before anything is joined, and how far a
day has to look is known from the days' counts. Both day tables are bounded by the calendar, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, values
from ..schemas import Policy
from ..scratch import materialize
from .promising import promising_pairs

#: Order of the sources of a candidate, which breaks ties of score.
AMOUNT, CORE, WINDOW = 0, 1, 2


def prepare_ledger(ledger: DataFrame) -> DataFrame:
    """Ledger rows (with record_id and seq) and their derived columns."""
    return ledger.withColumns(
        {
            "ref_norm": text.normalize_reference(F.col("reference_id")),
            "cores": text.reference_cores(F.col("reference_id"), F.col("description")),
            "ref_cores": text.reference_cores(F.col("reference_id")),
            "order_day": values.local_day(F.col("order_date")),
            "tokens": text.token_set(F.col("description")),
        }
    )


def prepare_settlements(settlements: DataFrame) -> DataFrame:
    """Settlement rows (with pop_seq, their place in the population) and their derived columns."""
    return settlements.withColumns(
        {
            "ref_norm": text.normalize_reference(F.col("order_reference")),
            "cores": text.reference_cores(F.col("order_reference"), F.col("description")),
            "ref_cores": text.reference_cores(F.col("order_reference")),
            "order_day": values.local_day(F.col("order_date")),
            "tokens": text.token_set(F.col("description")),
        }
    )


def exact_hits(ledger: DataFrame, settlements: DataFrame) -> DataFrame:
    """seq, pop_seq of every settlement with the same normalised reference; an empty reference meets none."""
    left = ledger.filter("ref_norm <> ''").select("seq", "ref_norm")
    return left.join(settlements.select("pop_seq", "ref_norm"), "ref_norm").select("seq", "pop_seq")


def exact_summary(ledger: DataFrame, settlements: DataFrame, policy: Policy) -> DataFrame:
    """Per record: n_exact, n_within (hits within the amount tolerance) and the hit that a lone or disambiguated match takes."""
    left = ledger.filter("ref_norm <> ''").select("seq", "ref_norm", "amount_minor")
    joined = left.join(settlements.select("pop_seq", "ref_norm", "gross_amount_minor"), "ref_norm")
    within = values.amounts_match(F.col("amount_minor"), F.col("gross_amount_minor"), policy.amount_tolerance_minor)
    found = joined.groupBy("seq").agg(
        F.count(F.lit(1)).alias("n_exact"), F.count_if(within).alias("n_within"), F.min("pop_seq").alias("only_hit"), F.min(F.when(within, F.col("pop_seq"))).alias("within_hit")
    )
    return found.select("seq", "n_exact", "n_within", F.when(F.col("n_exact") == 1, F.col("only_hit")).when(F.col("n_within") == 1, F.col("within_hit")).alias("exact_pop_seq"))


def amount_candidates(ledger: DataFrame, settlements: DataFrame) -> DataFrame:
    """Settlements whose gross amount is the ledger amount."""
    right = settlements.select("pop_seq", F.col("gross_amount_minor").alias("amount_minor"))
    return ledger.select("seq", "amount_minor").join(right, "amount_minor").select("seq", "pop_seq")


def core_candidates(ledger: DataFrame, settlements: DataFrame) -> DataFrame:
    """Settlements that share a run of four or more digits with the record's reference or description."""
    left = ledger.select("seq", F.explode("cores").alias("core"))
    right = settlements.select("pop_seq", F.explode("cores").alias("core"))
    return left.join(right, "core").select("seq", "pop_seq").distinct()


def day_windows(days: DataFrame, settlements: DataFrame, window_days: int, cap: int, more: tuple[str, ...] = ()) -> DataFrame:
    """day, pop_seq, place (and ``more`` columns): for each of ``days``, its nearest ``cap`` settlements (earlier day first at one distance, then by pop_seq)."""
    in_day = Window.partitionBy("order_day").orderBy("pop_seq")
    first = settlements.select("order_day", "pop_seq", *more).withColumn("rank", F.row_number().over(in_day)).filter(F.col("rank") <= cap)
    counts = first.groupBy("order_day").agg(F.max("rank").alias("n"))
    offsets = F.explode(F.sequence(F.lit(-window_days), F.lit(window_days))).alias("offset")
    looks = days.select(F.col("order_day").alias("day"), offsets).withColumn("order_day", F.date_add("day", F.col("offset")))
    looks = looks.join(counts, "order_day").withColumn("far", F.abs("offset"))
    nearer = Window.partitionBy("day").orderBy("far").rangeBetween(Window.unboundedPreceding, -1)
    looks = looks.withColumn("before", F.coalesce(F.sum("n").over(nearer), F.lit(0))).filter(F.col("before") < cap)
    joined = looks.select("day", "order_day", "far", "offset").join(first, "order_day")
    place = F.row_number().over(Window.partitionBy("day").orderBy("far", "offset", "pop_seq"))
    return joined.withColumn("place", place).filter(F.col("place") <= cap).select("day", "pop_seq", "place", *more)


def window_candidates(ledger: DataFrame, settlements: DataFrame, policy: Policy) -> DataFrame:
    """seq, pop_seq, place of the settlements nearest in time."""
    near = day_windows(ledger.select("order_day").distinct(), settlements, policy.candidate_search_window_days, policy.max_window_scan_candidates)
    return ledger.select("seq", F.col("order_day").alias("day")).join(near, "day").select("seq", "pop_seq", "place")


def shared_payments(settlements: DataFrame) -> DataFrame:
    """payment_id, pop_seq of the settlements whose payment_id others have too."""
    repeated = settlements.groupBy("payment_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("payment_id")
    return settlements.select("payment_id", "pop_seq").join(repeated, "payment_id")


def _marked(settlements: DataFrame, doubled: DataFrame | None) -> DataFrame:
    """Settlements with ``doubled``: whether their payment_id is that of others too."""
    shared = (shared_payments(settlements) if doubled is None else doubled).select("pop_seq", F.lit(True).alias("doubled"))
    return settlements.join(shared, "pop_seq", "left").withColumn("doubled", F.coalesce("doubled", F.lit(False)))


def promising_window_candidates(ledger: DataFrame, settlements: DataFrame, policy: Policy, doubled: DataFrame | None = None) -> DataFrame:
    """The window candidates that may still be listed: seq, pop_seq, place.

    A record meets its day's nearest settlements in blocks, where they are scored, and only those within reach of the last place
    of a shortlist leave them, instead of up to ``max_window_scan_candidates`` rows a record (see ``promising``). A candidate
    that another source finds as well keeps that source.
    """
    near = day_windows(ledger.select("order_day").distinct(), settlements, policy.candidate_search_window_days, policy.max_window_scan_candidates)
    of_day = near.join(_marked(settlements, doubled), "pop_seq").withColumn("grp", F.unix_date("day").cast("bigint"))
    return promising_pairs(ledger.filter("order_day IS NOT NULL"), of_day, F.unix_date("order_day").cast("bigint"), policy)


def promising_amount_candidates(ledger: DataFrame, settlements: DataFrame, policy: Policy, doubled: DataFrame | None = None) -> DataFrame:
    """The amount candidates that may still be listed: of an amount that very many settlements have, a record keeps a few."""
    priced = _marked(settlements.filter("gross_amount_minor IS NOT NULL"), doubled).withColumns({"grp": F.col("gross_amount_minor"), "place": F.lit(0)})
    return promising_pairs(ledger.filter("amount_minor IS NOT NULL"), priced, F.col("amount_minor"), policy).select("seq", "pop_seq")


def candidate_pool(ledger: DataFrame, settlements: DataFrame, policy: Policy, promising: bool = False) -> DataFrame:
    """seq, pop_seq, source (amount, core, window), place and has_core: each candidate once, by its first source.

    Settlements that share a payment_id are one candidate: of amount hits the last, of others the first. With ``promising``,
    amount and window candidates that can't be listed are left out.
    """
    shared = materialize(shared_payments(settlements), "shared-payments") if promising else shared_payments(settlements)
    by_amount = promising_amount_candidates(ledger, settlements, policy, shared) if promising else amount_candidates(ledger, settlements)
    in_window = promising_window_candidates(ledger, settlements, policy, shared) if promising else window_candidates(ledger, settlements, policy)
    hits = (
        by_amount.withColumns({"source": F.lit(AMOUNT), "place": F.lit(0)})
        .unionByName(core_candidates(ledger, settlements).withColumns({"source": F.lit(CORE), "place": F.lit(0)}))
        .unionByName(in_window.withColumn("source", F.lit(WINDOW)))
    )
    # One exchange by record serves both groupings, and what ranks candidates later.
    hits = hits.repartition("seq").groupBy("seq", "pop_seq").agg(F.min(F.struct("source", "place")).alias("first"), F.max(F.col("source") == CORE).alias("has_core"))
    hits = hits.select("seq", "pop_seq", "first.*", "has_core").join(shared, "pop_seq", "left")
    order = F.struct("source", F.when(F.col("source") == WINDOW, F.col("place")).otherwise(-F.col("pop_seq")))
    one = F.min_by(F.struct("pop_seq", "source", "place", "has_core"), order)
    return hits.groupBy("seq", F.coalesce("payment_id", F.col("pop_seq").cast("string")).alias("key")).agg(one.alias("kept")).select("seq", "kept.*")
