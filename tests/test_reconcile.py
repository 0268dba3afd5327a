"""Outcomes of small planted populations, and properties of the whole batch."""

from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlane.operators import audit, claims, decisions, metrics, review, trace
from ledgerlane.operators.verdicts import CallableVerifier
from ledgerlane.plans.catalogue import ORACLES, QUERIES
from ledgerlane.plans.population import populations
from ledgerlane.schemas import LEDGER, SETTLEMENT, Policy
from ledgerlane.sinks import store
from ledgerlane.sources import classify, readers
from ledgerlane.sources.detect import detect
from ledgerlane.sources.mapping import combine, map_rows
from ledgerlane.streaming import streams

DAY = pd.Timestamp("2026-03-01")


def ledger(spark, *rows):
    base = {"reference_id": "ORD-100001", "amount_minor": 100_000, "currency": "INR", "order_date": DAY, "status": "captured", "refund_amount_minor": 0, "description": "Order premium plan"}
    made = [{"order_id": f"O{k}", "record_id": f"O{k}", "seq": k} | base | r for k, r in enumerate(rows)]
    return spark.createDataFrame(pd.DataFrame(made), "order_id string, record_id string, seq bigint, " + LEDGER.split(", ", 1)[1])


def settlements(spark, *rows):
    base = {
        "order_reference": "ORD-100001", "settlement_id": "s", "gross_amount_minor": 100_000, "fee_minor": 2_000, "tax_minor": 360, "refund_amount_minor": 0, "net_amount_minor": 97_640,
        "order_date": DAY, "settlement_date": DAY + pd.Timedelta(days=2), "currency": "INR", "status": "settled", "description": "Settlement premium plan",
    }
    made = [{"payment_id": f"p{k}", "pop_seq": k} | base | r for k, r in enumerate(rows)]
    return spark.createDataFrame(pd.DataFrame(made), "payment_id string, pop_seq bigint, " + SETTLEMENT.split(", ", 1)[1])


def decided(spark, left, right, policy=Policy(), **more):  # noqa: B008
    return decisions.decide(decisions.prepare(ledger(spark, *left), settlements(spark, *right)), policy, **more)


def first(spark, left, right, **more):
    r = decided(spark, [left], right, **more).first()
    return r.outcome, r.classification, r.exception_type


def test_exact_checks(spark):
    cases = [
        ({}, ("RECONCILED", "EXACT_REFERENCE", None)), ({"gross_amount_minor": 105_000, "net_amount_minor": 102_640}, ("EXCEPTION", "EXACT_REFERENCE", "AMOUNT_MISMATCH")), ({"net_amount_minor": 90_000}, ("EXCEPTION", "EXACT_REFERENCE", "FEE_TAX_INCONSISTENT")),
        ({"currency": "USD"}, ("EXCEPTION", "EXACT_REFERENCE", "CURRENCY_MISMATCH")), ({"settlement_date": DAY + pd.Timedelta(days=40)}, ("EXCEPTION", "EXACT_REFERENCE", "SETTLEMENT_DELAYED")),
        ({"refund_amount_minor": 500, "net_amount_minor": 97_140}, ("EXCEPTION", "EXACT_REFERENCE", "REFUND_MISMATCH")), ({"gross_amount_minor": 100_002, "net_amount_minor": 97_642}, ("RECONCILED", "EXACT_REFERENCE", None)),
    ]
    left = [{"reference_id": f"REF-{k}A{1000 + k}"} for k in range(len(cases))]
    right = [{"order_reference": f"ref {k}a {1000 + k}"} | c for k, (c, _) in enumerate(cases)]
    rows = {r.seq: (r.outcome, r.classification, r.exception_type) for r in decided(spark, left, right).collect()}
    assert [rows[k] for k in range(len(cases))] == [e for _, e in cases]


def test_duplicates_go_by_amount_or_to_review(spark):
    other = {"gross_amount_minor": 50_000, "net_amount_minor": 47_640}
    assert first(spark, {}, [other, {}]) == ("RECONCILED", "DISAMBIGUATED_BY_AMOUNT", None)
    assert first(spark, {}, [{}, {}]) == ("HUMAN_REVIEW", "AMBIGUOUS_MULTIPLE", "AMBIGUOUS_MATCH")


def test_fuzzy_tiers(spark):
    assert first(spark, {}, [{"order_reference": "RZP/100001/SETL", "description": "Order premium plan"}]) == ("RECONCILED", "CORROBORATED", None)
    assert first(spark, {}, [{"order_reference": "ORD-900009", "description": "Order premium plan"}])[1] == "NO_ADMISSIBLE_CANDIDATE"
    assert first(spark, {"reference_id": None, "description": "order gift card"}, [{"order_reference": "UTR7000001", "description": "order gift card", "order_date": DAY + pd.Timedelta(days=9), "settlement_date": DAY + pd.Timedelta(days=11)}]) == ("HUMAN_REVIEW", "SEMANTIC_CONFIRMED", "LOW_CONFIDENCE_MATCH")
    assert first(spark, {"reference_id": ""}, [{"order_reference": "", "order_date": DAY + pd.Timedelta(days=300), "settlement_date": DAY + pd.Timedelta(days=300), "gross_amount_minor": 5}])[1] == "NO_CANDIDATES"


def test_nothing_is_missing_before_it_is_due(spark):
    late = {"order_reference": "X", "order_date": DAY - pd.Timedelta(days=90), "settlement_date": DAY + pd.Timedelta(days=1), "gross_amount_minor": 7, "net_amount_minor": 7, "fee_minor": 0, "tax_minor": 0}
    assert first(spark, {"reference_id": "Y", "description": "z"}, [late]) == ("EXCEPTION", "PENDING_SETTLEMENT_WINDOW", "PENDING_SETTLEMENT")
    assert first(spark, {"reference_id": "Y", "description": "z"}, [late], as_of="2026-04-01")[2] == "MISSING_SETTLEMENT"


def test_verifier_failure_is_a_review(spark):
    def broken(frame):
        raise TimeoutError

    pair = {"reference_id": None, "description": "order gift card"}, [{"order_reference": "UTR7000001", "description": "order gift card", "order_date": DAY + pd.Timedelta(days=9), "settlement_date": DAY + pd.Timedelta(days=11)}]
    assert first(spark, *pair, verifier=CallableVerifier(broken, "remote")) == ("HUMAN_REVIEW", "PROVIDER_ERROR", "PROVIDER_ERROR")
    sure = CallableVerifier(lambda f: pd.DataFrame({"verdict": ["SAME"] * len(f), "confidence": [0.95] * len(f)}), "remote")
    assert first(spark, *pair, verifier=sure) == ("RECONCILED", "SEMANTIC_CONFIRMED", None)


def test_claims_keep_the_stronger_and_demote_ties_in_any_order(spark):
    left = [{"reference_id": "ORD-100001"}, {"reference_id": "ORD/100001"}, {"reference_id": "ORD-100009"}]
    right = [{}, {"order_reference": "ORD-100009", "description": "x"}]
    rows = decided(spark, left, right)
    done = claims.process_batch(rows, settlements(spark, *right), Policy())
    again = claims.process_batch(rows.orderBy(F.desc("seq")), settlements(spark, *right), Policy())
    state = lambda d: {r.record_id: (r.outcome, r.exception_type) for r in d.collect()}
    assert state(done) == state(again) == {"O0": ("HUMAN_REVIEW", "DUPLICATE_CLAIM"), "O1": ("HUMAN_REVIEW", "DUPLICATE_CLAIM"), "O2": ("RECONCILED", None)}
    assert claims.duplicate_claims(rows).first().record_ids == "O0,O1"


def test_sums_are_proposed_only_when_unique(spark):
    left = [{"reference_id": f"A-{k}", "amount_minor": a, "description": f"word{k}"} for k, a in enumerate((30_000, 45_000, 61_000))]
    right = [{"order_reference": "BULK", "gross_amount_minor": 75_000, "fee_minor": 0, "tax_minor": 0, "net_amount_minor": 75_000, "description": "bulk", "order_date": DAY, "settlement_date": DAY + pd.Timedelta(days=3)}]
    done = claims.process_batch(decided(spark, left, right), settlements(spark, *right), Policy())
    assert {r.record_id: r.exception_type for r in done.collect()} == {"O0": "AGGREGATED_SETTLEMENT", "O1": "AGGREGATED_SETTLEMENT", "O2": "MISSING_SETTLEMENT"}


@pytest.mark.parametrize("name", ["aggregated_batches", "pending_all", "aggregated_settlements", "pending"])
def test_whole_table_queries_agree_with_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{sf}/orders.parquet'")
    want = Counter(db.execute(ORACLES[name]).fetchall())
    got = Counter(tuple(bool(x) if k == "pending" else x for k, x in r.asDict().items()) for r in QUERIES[name](spark, sf).collect())
    assert got == want and want
    if name == "aggregated_batches":
        n = db.execute("SELECT count(DISTINCT o_orderkey // 30) FROM orders").fetchone()[0]
        assert n > 10 and len(want) > n
    if name == "pending_all":
        assert sum(want.values()) == db.execute("SELECT count(*) FROM orders").fetchone()[0] and len({p for _, p in want}) == 2


def test_sums_of_batches_are_guarded_apart(spark):
    day = DAY.to_pydatetime()
    rows = [(k, b, f"R{k}", 1000 + k * k * 7, day, "EXCEPTION", None) for k, b in [(1, 1), (2, 1), (4, 1), *[(100 + k, 2) for k in range(41)], (300, 3)]]
    left = spark.createDataFrame(rows, "seq long, batch long, record_id string, amount_minor long, order_date timestamp, outcome string, matched_payment_id string")
    total = lambda *of: sum(r[3] for r in rows if r[0] in of)
    right = spark.createDataFrame([(1, 1, "s1", total(1, 4), day), (2, 2, "s2", total(100, 140), day), (3, 3, "s3", total(1, 4), day)], "pop_seq long, batch long, payment_id string, gross_amount_minor long, order_date timestamp")
    found = claims.aggregated_settlements(left, right, Policy(), batch="batch").collect()
    assert [(r.payment_id, r.members) for r in found] == [("s1", ["R1", "R4"])]
    assert claims.aggregated_settlements(left, right, Policy()).count() == 0


def test_empty_sides(spark):
    none = settlements(spark, {}).limit(0)
    rows = decisions.decide(decisions.prepare(ledger(spark, {}), none))
    assert (rows.first().classification, rows.first().exception_type) == ("NO_CANDIDATES", "MISSING_SETTLEMENT")
    assert decisions.decide(decisions.prepare(ledger(spark, {}).limit(0), settlements(spark, {}))).count() == 0


def test_trace_stops_at_the_break(spark):
    rows = trace.investigate(decided(spark, [{}, {"reference_id": "ZZ-1", "description": "q", "amount_minor": 5}], [{}]))
    found = {r.record_id: ([s.status for s in r.trace], r.break_stage, r.break_kind, r.action) for r in rows.collect()}
    assert found["O0"] == (["FOUND", "FOUND", "FOUND", "NOT_EVALUATED", "NOT_EVALUATED"], None, "NONE", "RECONCILE")
    assert found["O1"][0][1:] == ["MISSING"] + ["NOT_EVALUATED"] * 3 and found["O1"][3] == "EXCEPTION"
    assert trace.Roles.of(["BANK_STATEMENT"]) == trace.Roles(False, True, False, False)


def test_grounding(spark):
    rows = spark.createDataFrame([("Order 1,234 and ORD-777", ["total 1234"])], "claim string, known array<string>")
    assert "ORD-777" in rows.select(trace.ungrounded_claims(F.col("claim"), F.col("known")).alias("x")).first().x


def test_review_actions_and_rerun(spark, tmp_path):
    rows = decided(spark, [{}, {"reference_id": "ORD-100002"}], [{}, {"order_reference": "ORD-100002", "gross_amount_minor": 1, "net_amount_minor": 1, "fee_minor": 0, "tax_minor": 0}])
    path = str(tmp_path / "records")
    store.save_records(rows, path, "b1")
    saved = store.read_records(spark, path, "b1")
    after, verdicts = review.apply_actions(saved, spark.createDataFrame([("O1", "REJECT_MATCH"), ("O0", "APPROVE"), ("X", "DEFER")], "record_id string, action string"))
    assert {r.record_id: r.status for r in verdicts.collect()} == {"O1": 200, "O0": 400, "X": 404}
    assert {r.record_id: r.review_state for r in after.collect()} == {"O0": "OPEN", "O1": "REJECTED"}
    assert "APPROVE_MATCH" not in saved.filter("record_id = 'O1'").select(review.available_actions().alias("a")).first().a
    store.save_review_states(after, path, "b1")
    store.save_records(rows, path, "b1")
    assert {r.record_id: r.review_state for r in store.read_records(spark, path, "b1").collect()} == {"O0": "OPEN", "O1": "REJECTED"}
    assert [r.record_id for r in review.review_queue(saved).collect()] == ["O1"]


def test_audit_chain_shows_tampering(spark):
    events = spark.range(20).select(F.col("id").alias("order"), *[F.lit(f"{f}é").alias(f) for f in audit.FIELDS], F.format_string('{"n":%d}', "id").alias("payload_json"))
    log = audit.append(events).cache()
    assert audit.verify(log).count() == 0 and audit.head(log).first().head_seq == 20
    more = audit.append(events, 20, audit.head(log).first().head_hash)
    assert audit.verify(log.unionByName(more)).count() == 0
    bad = log.withColumn("payload_json", F.when(F.col("seq") == 7, '{"n":0}').otherwise(F.col("payload_json")))
    assert [(r.seq, r.reason) for r in audit.verify(bad).collect()] == [(7, "content was changed")]
    assert audit.verify(log.filter("seq <> 9")).first().reason == "doesn't follow its predecessor"
    assert audit.page(log, 5, 3).count() == 3


def test_files_map_to_both_sides(spark, tmp_path):
    (tmp_path / "orders.csv").write_text("order_id,invoice_ref,amount,order_date,status\nO1,INV-1,100.50,2026-03-01,paid\nO2,INV-2,n/a,2026-03-01,paid\n")
    rows, notes = readers.read_table(spark, str(tmp_path / "orders.csv"))
    found = detect([c for c in rows.columns if c != "_row"], [r.asDict() for r in rows.limit(50).collect()])
    mapped = map_rows(rows, found, "ORDERS", "s1", "orders.csv")
    good, bad = mapped.records.collect(), mapped.rejected.collect()
    assert (good[0].order_id, good[0].reference_id, good[0].amount_minor, good[0].provenance.file_row) == ("O1", "INV-1", 10050, 2)
    assert (bad[0].row, bad[0].error) == (2, "amount is missing or not a number") and notes == []
    bank = spark.createDataFrame([("2026-03-01", "NEFT x", "", "250.00", "U1", 1), ("2026-03-02", "fee", "10.00", "", "U2", 2)], "`Value Date` string, Narration string, Withdrawal string, Deposit string, `Ref No` string, _row bigint")
    side = map_rows(bank, detect(bank.columns[:-1], [r.asDict() for r in bank.collect()]), "BANK_STATEMENT", "s2")
    got = {r.payment_id: (r.gross_amount_minor, r.refund_amount_minor, r.status) for r in side.records.collect()}
    assert got == {"U1": (25000, 0, "settled"), "U2": (1000, 1000, "refunded")}
    assert combine([mapped, side], "SETTLEMENT").count() == 2


def test_encodings_are_those_of_whole_files(spark, tmp_path):
    head, row = "order_id,amount,note\n", "A{0},{0}.50,plain\n"
    body = head + "".join(row.format(k) for k in range(3000))
    cut = body.encode()[: 65_535 - 7]
    across = cut[: cut.rindex(b"\n") + 1]
    across += b"X1,1.00," + b"n" * (65_535 - len(across) - 8) + "é\n".encode() + b"X2,2.00,after\n"
    assert across[65_535:65_537] == "é".encode()
    late = body.encode() + "L1,3.00,caf\u00e9\n".encode("latin-1")
    quoted = (head + 'Q1,1.00,"two\nlines, one cell"\nQ2,2.00,""\n').encode()
    for name, raw in (("a.csv", across), ("b.csv", late), ("c.csv", quoted)):
        (tmp_path / name).write_bytes(raw)
    rows, notes = readers.read_delimited(spark, str(tmp_path))
    got = {r.order_id: r for r in rows.filter("order_id RLIKE '^[XLQ]'").collect()}
    assert got["X1"].note.endswith("né") and got["X2"].note == "after" and got["L1"].note == "caf\u00e9" and got["Q1"].note == "two\nlines, one cell"
    assert (got["Q1"]._row, got["Q2"]._row, got["L1"]._row) == (1, 2, 3001) and notes == ["read as Latin-1: b.csv"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows, _ = readers.read_delimited(spark, str(tmp_path / "b.csv"))
        assert rows.rdd.getNumPartitions() > 1
        assert [r._row for r in rows.filter("order_id LIKE 'A%'").orderBy(rows._row).collect()] == list(range(1, 3001))
        assert all(int(r.order_id[1:]) == r._row - 1 for r in rows.filter("order_id LIKE 'A%'").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_file_names_name_banks_and_providers():
    found = classify.filename_evidence("HDFC_statement_jan.csv")
    assert ("BANK_STATEMENT", "HDFC Bank") in {(t, who) for _, _, t, who, _ in found} and any(t == "BANK_STATEMENT" and who is None for _, _, t, who, _ in found)
    assert [who for _, _, _, who, _ in classify.filename_evidence("my-shop_ify.csv")] == ["Shopify"] and classify.filename_evidence("x.csv") == []


def test_a_reader_opened_before_a_rewrite_still_works(spark, tmp_path):
    rows = decided(spark, [{}], [{}])
    path = str(tmp_path / "records")
    store.save_records(rows, path, "7")
    before = store.read_records(spark, path)
    store.save_records(rows, path, "7")
    store.save_records(rows, path, "8")
    assert before.count() == 1 and before.first().batch_id == "7" and store.read_records(spark, path).count() == 2


def test_workbooks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("2026-03-01", "a<b", "10.50"), ("2026-03-02", "c", "7")], "Date string, Note string, Amount string")
    path = str(tmp_path / "out.xlsx")
    assert store.write_workbook(rows, path) == 2
    back, _ = readers.read_table(spark, path)
    assert [tuple(r)[:3] for r in back.orderBy("_row").collect()] == [("2026-03-01", "a<b", "10.50"), ("2026-03-02", "c", "7")]


def test_json_lines_and_folders(spark, tmp_path):
    (tmp_path / "rows.json").write_text('{"a": 1}\nnot json\n{"a": 3}\n')
    good, bad = readers.read_json_lines(spark, str(tmp_path / "rows.json"), "a int")
    assert good.count() == 2 and bad.count() == 1
    folder = tmp_path / "files"
    folder.mkdir()
    for name in ("b.csv", "a.csv", "_x.csv", "c.png"):
        (folder / name).write_text("same" if name != "c.png" else "other")
    assert [r.path.rsplit("/", 1)[1] for r in readers.tabular_files(spark, str(folder)).collect()] == ["a.csv", "b.csv"]
    assert readers.upload_guard(spark, str(folder)).first().ok
    assert readers.by_content(spark, str(folder)).filter("duplicate_of IS NOT NULL").count() == 1


def test_metrics(spark):
    rows = spark.createDataFrame([("RECONCILED", "RECONCILED"), ("RECONCILED", "EXCEPTION"), ("EXCEPTION", "EXCEPTION"), ("HUMAN_REVIEW", "EXCEPTION")], "outcome string, expected string").selectExpr("*", "false AS ai_invoked", "0 AS ai_calls", "'x' AS classification", "'c' AS case_name")
    m = metrics.evaluation(rows).first()
    assert (m.accuracy, m.exception_precision, m.exception_recall, m.false_auto_reconciliation) == (0.5, 1.0, 0.333333, 0.5)
    assert metrics.confusion_by_case(rows).first().asDict() == {"case_name": "c", "reconciled": 2, "exception": 1, "human_review": 1}


def test_streamed_upsert_is_idempotent(spark, tmp_path):
    rows = decided(spark, [{}, {"reference_id": "none", "description": "q"}], [{}]).drop("checks", "considered_candidates")
    rows.write.parquet(str(tmp_path / "in"))
    for n in (1, 2):
        stream = streams.tail(spark, str(tmp_path / "in"), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))
        run = streams.upsert_decisions(stream, str(tmp_path / "out"), "b1", str(tmp_path / f"log{n}"))
        run.awaitTermination()
        assert run.exception() is None
    assert store.read_records(spark, str(tmp_path / "out"), "b1").count() == 2


@pytest.mark.parametrize("case, outcome", [("clean", "RECONCILED"), ("net_off", "EXCEPTION"), ("claimed_twice", "HUMAN_REVIEW"), ("bank_full_text", "HUMAN_REVIEW")])
def test_planted_population(spark, case, outcome):
    if not hasattr(test_planted_population, "rows"):
        left, right = populations(spark, "/root/testdata/sf0.001")
        done = claims.process_batch(decisions.decide(decisions.prepare(left, right)), right, Policy())
        test_planted_population.rows = {(r.case_name, r.outcome): r["count"] for r in done.groupBy("case_name", "outcome").count().collect()}
    assert {o for c, o in test_planted_population.rows if c == case} == {outcome}
