import random

import pytest
from ledgerlane.operators import blocking, decisions, promising, scoring, similarity
from ledgerlane.schemas import Policy
from pyspark.sql import functions as F


def populations(spark, seed, records=60, settled=260):
    rng = random.Random(seed)
    day = lambda: f"2026-03-{rng.randrange(1, 12):02d} {rng.randrange(24):02d}:00:00"
    amounts = [1000, 1001, 1010, 1500, 5000, 90_000, 0]
    word = lambda: " ".join(rng.choice(["red", "blue", "tall", "late", "old"]) for _ in range(rng.randrange(4)))
    left = [(k, f"r{k}", f"ORD-{rng.randrange(5000, 5040)}", rng.choice(amounts), day(), word()) for k in range(records)]
    right = [(k, f"p{rng.randrange(200)}", f"X-{rng.randrange(5000, 5040)}", rng.choice(amounts), day(), word()) for k in range(settled)]
    dated = lambda rows, names: spark.createDataFrame(rows, names).withColumn("order_date", F.to_timestamp("d")).drop("d")
    ledger = blocking.prepare_ledger(dated(left, "seq bigint, record_id string, reference_id string, amount_minor bigint, d string, description string"))
    settlements = blocking.prepare_settlements(dated(right, "pop_seq bigint, payment_id string, order_reference string, gross_amount_minor bigint, d string, description string"))
    return ledger, settlements


@pytest.mark.parametrize("seed", [1, 2])
def test_pruned_search_lists_what_the_whole_pool_lists_from_fewer_pairs(spark, seed):
    ledger, settlements = populations(spark, seed)
    data = decisions.Prepared(ledger, settlements, similarity.token_frequencies(settlements), settlements.count())
    left, right = similarity.attach(ledger, "seq", data.frequencies, data.documents), similarity.attach(settlements, "pop_seq", data.frequencies, data.documents)
    for policy in (Policy(), Policy(max_window_scan_candidates=30, candidate_shortlist_size=2, candidate_search_window_days=4)):
        whole = scoring.rank_by_score(scoring.promising_pool(blocking.candidate_pool(left, right, policy), left, right, policy), left, right, policy)
        want = {(r.seq, r.position, r.pop_seq, r.source, r.place) for r in whole.collect()}
        got = {(r.seq, r.position, r.pop_seq, r.source, r.place) for r in decisions.scored_shortlist(data, ledger, policy).collect()}
        assert got == want and len(want) > 60
        assert blocking.promising_amount_candidates(left, right, policy).count() < blocking.amount_candidates(left, right).count()
        assert blocking.promising_window_candidates(left, right, policy).count() < blocking.promising_window_candidates(ledger, settlements, policy).count()


def test_groups_of_very_many_rows_are_dealt_and_all_their_pairs_meet(spark):
    left = spark.range(100).select(F.col("id").alias("seq"), F.when(F.col("id") < 90, 1).otherwise(F.col("id")).alias("grp"))
    right = spark.range(300).select(F.col("id").alias("pop_seq"), F.when(F.col("id") < 250, 1).otherwise(F.col("id") % 100).alias("grp"))
    ours, theirs = promising.deal(left, right, "grp", 3, records=20, settlements=40)
    keys = ["call", "l_part", "r_part", "grp"]
    met = sorted((r.seq, r.pop_seq) for r in ours.join(theirs, keys).select("seq", "pop_seq").collect())
    assert met == sorted((r.seq, r.pop_seq) for r in left.join(right, "grp").select("seq", "pop_seq").collect())
    assert max(r["count"] for r in ours.groupBy(*keys).count().collect()) < 60 and max(r["count"] for r in theirs.groupBy(*keys).count().collect()) < 90
