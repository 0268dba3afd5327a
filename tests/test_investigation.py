"""The investigator's searches against plain Python, and rules on single planted rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlane.operators import investigation, metrics, review, trace
from ledgerlane.plans import investigations
from ledgerlane.schemas import CANDIDATE, CHECK, Policy

START = datetime(2026, 1, 1)
ROW = f"seq bigint, record_id string, batch string, amount_minor bigint, order_date timestamp, matched_payment_id string, outcome string, classification string, exception_type string, refund_amount_minor bigint, considered_candidates array<{CANDIDATE}>, checks array<{CHECK}>, description string, reference_id string"
SETTLED = "pop_seq bigint, payment_id string, batch string, gross_amount_minor bigint, fee_minor bigint, tax_minor bigint, order_date timestamp, description string"


def records(spark, *rows):
    base = {"batch": "a", "amount_minor": 1000, "order_date": START, "matched_payment_id": None, "outcome": "EXCEPTION", "classification": "NO_ADMISSIBLE_CANDIDATE", "exception_type": "MISSING_SETTLEMENT", "refund_amount_minor": 0, "considered_candidates": [], "checks": [], "description": "", "reference_id": ""}
    return spark.createDataFrame([{"seq": k, "record_id": f"R{k}"} | base | r for k, r in enumerate(rows)], ROW)


def settled(spark, *rows):
    base = {"batch": "a", "fee_minor": 0, "tax_minor": 0, "order_date": START, "description": None}
    return spark.createDataFrame([{"pop_seq": k, "payment_id": f"p{k}"} | base | r for k, r in enumerate(rows)], SETTLED)


@pytest.mark.parametrize("seed", range(3))
def test_first_in_window_equals_a_scan(spark, seed):
    rng = random.Random(seed)
    when = lambda: None if rng.random() < 0.05 else START + timedelta(seconds=rng.choice([0, 1, 3600, 43200, 86399]) + 86400 * rng.randrange(60))
    asked = [(rng.choice("ab"), k, when()) for k in range(40)]
    rows = [(rng.choice("ab"), when(), k) for k in rng.sample(range(1000), 300)]
    got = investigation.first_in_window(spark.createDataFrame(asked, "batch string, seq bigint, at timestamp"), spark.createDataFrame(rows, "batch string, at timestamp, n bigint"), 5, 7, ["n"])
    have = {(r.batch, r.seq): [x.n for x in r.near] for r in got.collect()}
    want = {(b, k): sorted(n for c, s, n in rows if c == b and s is not None and abs((s - t).days) <= 7)[:5] for b, k, t in asked if t is not None}
    assert have == want


def test_sums_splits_and_crowds(spark):
    left = records(spark, {"amount_minor": 1000}, {"amount_minor": 2500}, {"amount_minor": 400, "batch": "b"}, {"amount_minor": 7000, "batch": "c"}, {"amount_minor": 5, "matched_payment_id": "p9", "outcome": "RECONCILED"}, {"amount_minor": 900, "order_date": None})
    right = settled(spark, {"gross_amount_minor": 3410, "fee_minor": 75, "tax_minor": 15}, {"gross_amount_minor": 250, "batch": "b"}, {"gross_amount_minor": 150, "batch": "b"}, *[{"gross_amount_minor": 10 + k, "batch": "c"} for k in range(61)])
    got = {r.seq: r for r in investigation.with_grouping(left, right, Policy(), "batch").collect()}
    assert (got[0].aggregation.payment_id, got[0].aggregation.kind, got[0].aggregation.members, got[0].aggregation.only) == ("p0", "NET_OF_FEES", ["R0", "R1"], True)
    assert got[1].aggregation.members == ["R1", "R0"] and got[2].split == ["p1", "p2"] and got[2].aggregation is None
    assert got[3].too_many and got[3].split is None and not got[0].too_many
    assert got[4].aggregation is None and got[5].aggregation is None and len(got) == 6


def test_no_settlements_and_no_records(spark):
    rows = records(spark, {})
    assert investigation.with_grouping(rows, settled(spark), Policy()).filter("aggregation IS NULL AND split IS NULL AND NOT too_many").count() == 1
    assert investigation.with_grouping(rows.limit(0), settled(spark, {"gross_amount_minor": 1}), Policy()).count() == 0


def test_fee_gap_and_refund_gap(spark):
    check = {"name": "gross_amount_match", "status": "FAIL"}
    check = {"expected": None, "observed": None, "detail": None, "confidence": None} | check
    matched = {"matched_payment_id": "p0", "checks": [check], "classification": "EXACT_REFERENCE", "exception_type": "AMOUNT_MISMATCH"}
    rows = records(spark, {"amount_minor": 1000} | matched, {"amount_minor": 1000, "refund_amount_minor": 60} | matched)
    other = investigation.with_counterparty(rows, settled(spark, {"gross_amount_minor": 940, "fee_minor": 50, "tax_minor": 10}))
    got = {r.seq: [(h.label, h.confidence) for h in r.hypotheses] for r in trace.with_hypotheses(other).collect()}
    assert got == {0: [("GATEWAY_FEE_DEDUCTION", 0.85)], 1: [("REFUND_OFFSET", 0.8)]}
    assert trace.with_hypotheses(rows).filter(F.size("hypotheses") > 0).count() == 0


def test_model_gate_and_explanation(spark):
    seen = {"payment_id": "p1", "order_reference": None, "gross_amount_minor": 1, "settlement_date": None, "supporting_signals": [], "contradicting_signals": [], "evidence_score": 0.1, "admissible": False, "admissibility_reason": "", "semantic_verdict": None, "semantic_confidence": None}
    rows = records(spark, {"considered_candidates": [seen], "description": "plan"}, {"considered_candidates": [seen]}, {"description": "plan"}, {"classification": "PENDING_SETTLEMENT_WINDOW", "considered_candidates": [seen], "description": "plan"})
    made = trace.investigate(rows)
    assert [r.ask for r in made.orderBy("seq").select(investigation.should_consult_model().alias("ask")).collect()] == [True, False, False, False]
    said = [r.said for r in made.orderBy("seq").select(investigation.explanation().alias("said")).collect()]
    assert said[0] == "The money can be followed up to the payment stage, which is missing. Best explanation: missing settlement." and "pending settlement" in said[3]


def test_negative_amounts_and_search(spark):
    rows = spark.createDataFrame([("a", 1, 2), ("b", -1, 2), ("c", None, -5)], "record_id string, x bigint, y bigint")
    good, bad = review.reject_negative(rows, ["x", "y"])
    assert [r.record_id for r in good.collect()] == ["a"] and {r.record_id: r.negative for r in bad.collect()} == {"b": ["x"], "c": ["y"]}
    assert [r.record_id for r in review.search(rows, "B", ["record_id"]).collect()] == ["b"]


def test_review_export_has_all_columns(spark):
    queue = review.export_queue(records(spark, {"classification": None}).withColumns({"severity": F.lit("HIGH"), "review_state": F.lit("OPEN"), "currency": F.lit("INR"), "reason": F.lit(None).cast("string"), "explanation": F.lit(""), "recommended_action": F.lit(""), "ai_invoked": F.lit(False)}))
    row = queue.first()
    assert len(queue.columns) == 20 and row.reason == "" and row.candidates_considered == 0 and row.available_actions == "MARK_MISSING; DEFER; ESCALATE"


def test_presence_by_truth(spark):
    rows = spark.createDataFrame(
        [("present", "p", "p", "RECONCILED", None), ("present", "q", "p", "RECONCILED", None), ("absent", None, None, "EXCEPTION", "PENDING_SETTLEMENT"), ("pending", None, None, "EXCEPTION", "PENDING_SETTLEMENT"), ("ambiguous", None, None, "HUMAN_REVIEW", None)],
        "truth string, matched_payment_id string, true_payment_id string, outcome string, exception_type string",
    )
    got = {r.truth: (r.accuracy, r.wrong_matches) for r in metrics.presence(rows, "truth").collect()}
    assert got == {"present": (0.5, 1), "absent": (0.0, 0), "pending": (1.0, 0), "ambiguous": (1.0, 0)}


def test_population_of_the_sums_has_every_case(spark):
    rows = investigations._grouping(spark, "/root/testdata/sf0.01").agg(F.count_if("too_many").alias("crowded"), F.count_if(~F.col("aggregation.only")).alias("two_ways"), F.count("split").alias("split"), F.count_if(F.col("aggregation.kind") == "NET_OF_FEES").alias("net"), F.count_if(F.size("aggregation.members") == 3).alias("three")).first()
    assert min(rows) > 0, rows
