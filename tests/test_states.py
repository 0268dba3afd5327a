"""Change feeds, broken records, and run state from patches."""

import random
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerlane.operators import audit, blocking, changes, claims, decisions, evidence, isolation, metrics, scoring, similarity
from ledgerlane.plans import states
from ledgerlane.schemas import CHECK, LEDGER, SETTLEMENT, Policy
from ledgerlane.sinks import reuse, run_state, store
from ledgerlane.streaming import progress

VERSION = "record_id string, seq bigint, outcome string, classification string, exception_type string, severity string, matched_payment_id string, review_state string, reason string"


def versions(spark, *rows):
    return spark.createDataFrame([(r[0], k, *r[1:], "why") for k, r in enumerate(rows)], VERSION)


def test_decision_events(spark):
    old = versions(spark, ("a", "EXCEPTION", "C", None, "HIGH", None, "OPEN"), ("b", "RECONCILED", "C", None, None, "p1", "OPEN"), ("c", "EXCEPTION", "C", "X", "LOW", None, "OPEN"), ("gone", "EXCEPTION", "C", None, None, None, "OPEN"))
    new = versions(spark, ("a", "EXCEPTION", "C", "", "HIGH", None, "OPEN"), ("b", "RECONCILED", "C", None, None, "p1", "OPEN"), ("c", "RECONCILED", "D", None, None, "p2", "APPROVED"), ("d", "HUMAN_REVIEW", "C", None, None, None, "OPEN")).withColumn("reason", F.lit("other words"))
    got = {(r.transaction_id, r.event_type, r.prior_state, r.new_state) for r in changes.decision_events(old, new).collect()}
    # A null that becomes empty text is another decision; other words aren't.
    assert got == {("a", "RECORD_REVISED", "EXCEPTION", "EXCEPTION"), ("c", "RECORD_REVISED", "EXCEPTION", "RECONCILED"), ("c", "HUMAN_REVIEW_ACTION", "OPEN", "APPROVED"), ("d", "RECORD_DECIDED", None, "HUMAN_REVIEW")}
    assert changes.decision_events(new, new).count() == 0 and changes.decision_events(None, new).count() == 4
    with pytest.raises(ValueError, match="no event type"):
        changes.event("SOMETHING", F.lit(1), F.lit(1), F.lit(1))


def test_broken_records_have_results(spark):
    day = "timestamp'2026-03-01'"
    good = f"'ORD{{0}}', 'ORD-{{0}}', 1000L, 'INR', {day}, 'captured', 0L, 'Order {{0}}'"
    rows = {
        "fine": good.format(1), "no amount": good.format(2).replace("1000L", "cast(null AS bigint)"), "least": good.format(3).replace("1000L", "-9223372036854775807L - 1L"), "no day": good.format(4).replace(day, "cast(null AS timestamp)"),
        "far day": good.format(5).replace(day, "timestamp'+10500-01-01'"), "no status": good.format(6).replace("'captured'", "cast(null AS string)"), "less": good.format(7).replace("1000L", "-1L"),
    }
    names = [c.split()[0] for c in LEDGER.split(", ")]
    ledger = None
    for k, (record, values) in enumerate(rows.items()):
        one = spark.sql(f"SELECT {values}").toDF(*names).withColumns({"record_id": F.lit(record), "seq": F.lit(k).cast("bigint")})
        ledger = one if ledger is None else ledger.union(one)
    settlement = f"SELECT 'pay_{{0}}', 'ORD-{{0}}', 's', 1000L, 20L, 4L, 0L, {{1}}, {day}, {day} + INTERVAL 2 DAYS, 'INR', 'settled', 'Settlement for {{0}}'"
    settlements = spark.sql(settlement.format(1, "976L") + " UNION ALL " + settlement.format(9, "cast(null AS bigint)")).toDF(*[c.split()[0] for c in SETTLEMENT.split(", ")]).withColumn("pop_seq", F.monotonically_increasing_id())
    found, unusable = isolation.decide_all(ledger, settlements, Policy(enable_fuzzy_matching=False), also=lambda: F.when(F.col("record_id") == "less", F.lit("said so")))
    got = {r.record_id: r for r in found.drop("order_date").collect()}
    assert set(got) == set(rows) and got["fine"].outcome == "RECONCILED"
    assert {r.outcome for k, r in got.items() if k != "fine"} == {"HUMAN_REVIEW"} and {r.exception_type for k, r in got.items() if k != "fine"} == {"PROCESSING_ERROR"}
    assert {k: r.checks[0].detail for k, r in got.items() if k != "fine"} == {
        "no amount": "amount_minor is missing", "least": "amount_minor is out of range: -9223372036854775808", "no day": "order_date is missing", "far day": "order_date is out of range", "no status": "status is missing", "less": "amount_minor is negative: -1",
    }
    assert [(r.payment_id, r.error) for r in unusable.collect()] == [("pay_9", "net_amount_minor is missing")]


def plain_fold(patches):
    """One key after the other, one patch after the other."""
    out = {}
    for key in {p[0] for p in patches}:
        own = sorted((p for p in patches if p[0] == key), key=lambda p: (p[1], p[2]))
        first = {}
        for p in own:
            if p[3] is not None:
                first.setdefault(p[3], p[2])
        version = 0
        while version in first:
            version += 1
        fields, counters, phases, lost = {}, Counter(), {}, []
        for _, _, number, base, sets, adds, nested in own:
            if base is not None and not (base < version and first[base] == number):
                lost.append(number)
                continue
            for k, v in (sets or {}).items():
                fields[k] = v
            for k, n in (adds or {}).items():
                counters[k] += n
            for phase, more in (nested or {}).items():
                phases.setdefault(phase, {}).update(more)
        fields = {k: v for k, v in fields.items() if v is not None}
        phases = {p: kept for p, m in phases.items() if (kept := {k: v for k, v in m.items() if v is not None})}
        out[key] = (version, fields, dict(counters), phases, sorted(lost))
    return out


def test_states_equal_folding_one_by_one(spark, tmp_path):
    rng = random.Random(1)
    at = lambda: f"2026-03-01 00:00:{rng.randrange(40):02d}"
    import datetime

    patches = []
    for number in range(400):
        text = lambda: rng.choice(["x", "y", "", None])
        sets = {k: text() for k in rng.sample(["status", "label", "total"], rng.randrange(3))} or None
        adds = {"done": rng.randrange(5)} if rng.random() < 0.4 else None
        phases = {rng.choice(["read", "match"]): {rng.choice(["state", "n"]): text()}} if rng.random() < 0.5 else None
        patches.append((rng.choice(["hot", "hot", "hot", "a", "b", "c"]), datetime.datetime.fromisoformat(at()), number, rng.choice([None, None, 0, 1, 2, 3, 5]), sets, adds, phases))
    path = str(tmp_path / "log")
    for k in range(0, 400, 100):
        run_state.append(spark.createDataFrame(patches[k : k + 100], run_state.PATCH), path)
    log = run_state.read(spark, path)
    want = plain_fold(patches)
    unpack = lambda rows: {r.key: (r.version, r.fields, r.counters, r.phases) for r in rows.collect()}
    assert unpack(run_state.states(log)) == {k: v[:4] for k, v in want.items()}
    lost = run_state.conflicts(log).collect()
    assert sorted((r.key, r.patch_id) for r in lost) == sorted((k, n) for k, v in want.items() for n in v[4]) and all(r.version == want[r.key][0] for r in lost)
    assert unpack(run_state.states(run_state.compacted(log))) == {k: v[:4] for k, v in want.items()}


def test_a_run_from_its_writes(spark):
    keys = spark.createDataFrame([("r1",), ("r2",)], "key string")
    at = lambda n: F.lit(f"2026-03-01 00:00:0{n}")
    n = lambda k: F.lit(k)
    log = run_state.create_run(keys, at(0), n(1), F.lit("March"), F.lit("upload")).union(run_state.set_total(keys, at(1), n(2), F.lit(10), F.lit(1)))
    log = log.union(run_state.add_progress(keys, at(2), n(3), F.lit(4))).union(run_state.add_progress(keys, at(3), n(4), F.lit(6))).union(run_state.complete(keys.filter("key = 'r1'"), at(4), n(5), F.lit(2)))
    # Written by someone who had read version 1 only.
    log = log.union(run_state.set_total(keys, at(5), n(6), F.lit(99), F.lit(1))).union(run_state.delete(keys.filter("key = 'r2'"), at(6), n(7)))
    rows = {r.key: r for r in run_state.present(run_state.states(log)).collect()}
    assert set(rows) == {"r1"} and rows["r1"].fields == {"status": "COMPLETED", "label": "March", "source": "upload", "total_records": "10"} and rows["r1"].counters == {"processed": 10} and rows["r1"].version == 3
    assert {(r.key, r.patch_id, r.version) for r in run_state.conflicts(log).collect()} == {("r1", 6, 3), ("r2", 6, 2)}
    assert run_state.states(log.limit(0)).count() == 0


def plain_keys(items):
    out = []
    for key, text in items:
        if any(k == key for k, _ in out):
            key = f"{key}_{sum(k == key or k.startswith(key + '_') for k, _ in out) + 1}"
        out.append((key, text))
    return out


def test_repeated_keys_are_numbered_in_order(spark):
    rng = random.Random(4)
    lists = [[(rng.choice(["A", "A_1", "A_2", "B", "B_X"]), str(k)) for k in range(rng.randrange(9))] for _ in range(60)]
    rows = spark.createDataFrame([(k, items) for k, items in enumerate(lists)], f"k int, items array<{evidence.ITEM}>").repartition(3)
    got = {r.k: [(e.key, e.text) for e in r.e] for r in rows.select("k", evidence.numbered_keys(F.col("items")).alias("e")).collect()}
    assert got == {k: plain_keys(items) for k, items in enumerate(lists)}


def test_answers_are_held_against_evidence(spark):
    import json

    base = {"evidence": [("ORDER_AMOUNT", "order O1 is over ₹1,234.56 of 2026-03-01"), ("ORDER_REFERENCE", "its reference is INV-20417")], "hypotheses": [("REFERENCE_MISMATCH", 0.5)]}
    offer = lambda **more: {"label": "MERCHANT_ALIAS", "confidence": 0.4, "rationale": "The same payer.", "evidence_keys": ["ORDER_AMOUNT"]} | more
    cases = {
        "fine": (offer(rationale="1234.56 of INV-20417, and 12 more"), "MERCHANT_ALIAS", 0.4), "low": (offer(confidence=-3), "MERCHANT_ALIAS", 0.0), "word": (offer(confidence="high"), "MERCHANT_ALIAS", 0.5), "none": (offer(confidence=None), "MERCHANT_ALIAS", 0.5),
        "number": (offer(rationale="It was 777.00"), None, None), "identifier": (offer(rationale="See INV-20418"), None, None), "label": (offer(label="SOMETHING"), None, None), "ruled": (offer(label="reference_mismatch"), None, None),
        "no keys": (offer(evidence_keys=[]), None, None), "keys of another type": (offer(evidence_keys=7), None, None), "no object": ([1, 2], None, None), "text": ("x", None, None), "no rationale": (offer(rationale=None), None, None),
    }
    texts = [json.dumps({"hypotheses": [c[0]], "explanation": "All of 1,234.56." if k % 2 else "It was 9999."}) for k, c in enumerate(cases.values())] + ["not json", None, json.dumps({"hypotheses": [offer()] * 9})]
    rows = spark.createDataFrame([(k, t, base["evidence"], base["hypotheses"]) for k, t in enumerate(texts)], f"k int, p string, evidence array<{evidence.ITEM}>, hypotheses array<struct<label:string,confidence:double>>")
    got = {r.k: r for r in evidence.with_answer(rows, F.col("p")).collect()}
    for k, (name, (_, label, sure)) in enumerate(cases.items()):
        kept = [(a.label, a.confidence) for a in got[k].answer]
        assert kept == ([(label, sure)] if label else []), name
        assert got[k].answer_explanation == ("All of 1,234.56." if k % 2 else None) and got[k].dropped == (label is None) + (k % 2 == 0), name
    n = len(cases)
    assert [(len(got[k].answer), got[k].dropped) for k in (n, n + 1, n + 2)] == [(0, 0), (0, 0), (6, 0)]


def test_tables_follow_the_content_of_their_sources(spark, tmp_path):
    made = []
    rows = spark.createDataFrame([(k, str(k), None if k % 3 else 1.5) for k in range(50)], "a int, b string, c double")

    def make(source):
        return reuse.table("t", [source], lambda: made.append(1) or source, folder=str(tmp_path))

    assert make(rows).count() == 50 and make(rows.repartition(4).orderBy("b")).count() == 50 and made == [1]
    assert make(rows.filter("a <> 7")).count() == 49 and made == [1, 1]
    assert make(rows.union(rows.filter("a = 7"))).count() == 51 and len(made) == 3
    assert make(rows.withColumnRenamed("c", "d")).columns == ["a", "b", "d"] and len(made) == 4
    assert reuse.table_key("t", "1", [rows, rows.limit(3)]) == reuse.table_key("t", "1", [rows.limit(3), rows]) != reuse.table_key("t", "2", [rows, rows.limit(3)])
    # A write that was cut off doesn't count.
    path = tmp_path / f"t-{reuse.table_key('t', '1', [rows])}"
    (path / "_SUCCESS").unlink()
    assert make(rows).count() == 50 and len(made) == 5


def test_observed_counters_are_the_final_counts(spark, tmp_path):
    rows = spark.createDataFrame([("RECONCILED", True), ("EXCEPTION", False), ("EXCEPTION", True)], "outcome string, ai_invoked boolean")
    watched, seen = progress.watched(rows, progress.decision_counters())
    watched.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"decided": 3, "semantic_tier_invoked": 2, "reconciled": 1, "exception": 2, "human_review": 0}
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with progress.Totals("p") as totals:
        run = progress.watched_stream(stream, {"n": F.count(F.lit(1)), "ids": F.sum("id")}, "p").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        run.awaitTermination()
        totals.wait(str(run.runId))
    assert dict(totals.sums[str(run.runId)]) == {"n": 30, "ids": 435} and totals.batches[str(run.runId)] == 3


def test_streams_of_a_session_that_is_not_the_active_one_are_counted(spark, tmp_path):
    other = spark.newSession()
    events = spark.createDataFrame([(k, None if k == 3 else k, "click") for k in range(20)], "event_id bigint, user_id bigint, event_type string")
    (tmp_path / "events.parquet").mkdir()
    for part in range(10):
        events.filter(F.col("event_id") % 10 == part).coalesce(1).write.parquet(str(tmp_path / "events.parquet"), mode="append")
    # Ten files are two micro-batches. Creating rows made the first session the active one; a new thread has none.
    assert [tuple(r) for r in states.observed_stream(other, str(tmp_path)).collect()] == [(20, True, 187)]
    spark.createDataFrame([(1,)], "a int")
    with ThreadPoolExecutor(1) as pool:
        assert [tuple(r) for r in pool.submit(lambda: states.observed_stream(other, str(tmp_path)).collect()).result()] == [(20, True, 187)]
    events.limit(2).select("event_id", F.lit(None).cast("bigint").alias("user_id"), F.lit(None).cast("string").alias("event_type")).write.parquet(str(tmp_path / "nulls" / "events.parquet"))
    assert [tuple(r) for r in states.observed_stream(spark, str(tmp_path / "nulls")).collect()] == [(2, False, None)]


def test_missed_batches_are_an_error():
    step = lambda batch, **m: SimpleNamespace(runId="r", batchId=batch, observedMetrics={"progress": Row(**m)} if m else {})
    query = lambda *steps: SimpleNamespace(runId="r", recentProgress=list(steps))
    totals = progress.Totals()
    for p in (step(0, n=1), step(1, n=2), step(1, n=2), step(2)):
        totals.add(p)
    # What was heard of isn't counted again, what wasn't yet is taken from the query; idle progress has no counters.
    assert totals.of(query(step(1, n=2), step(2), step(2, n=4), step(3, n=8)), seconds=0.1) == {"n": 15} and totals.batches["r"] == 4
    with pytest.raises(TimeoutError):
        totals.of(query(step(6, n=16)), seconds=0.1)
    totals.add(step(6, n=16))
    totals.ended.add("r")
    with pytest.raises(RuntimeError, match="not heard"):
        totals.of(query(step(6, n=16)))
    late = progress.Totals()
    late.add(step(1, n=2))
    with pytest.raises(RuntimeError, match="not heard"):
        late.of(query(step(0, n=1), step(1, n=2)), seconds=0.1)


def test_policies_with_other_searches_are_refused(spark):
    with pytest.raises(ValueError, match="search"):
        decisions.decide_under(None, {"a": Policy(), "b": Policy(candidate_search_window_days=3)})


def stored(spark, *rows):
    return spark.createDataFrame([(k, i, o) for k, i, o in rows], "seq bigint, record_id string, outcome string").withColumns({n: F.lit(None).cast("string") for n in ("classification", "exception_type", "severity", "matched_payment_id")})


def test_upserts_write_changed_rows_only(spark, tmp_path):
    path = str(tmp_path / "records")
    state = lambda: {(r.record_id, r.outcome, r.review_state) for r in store.read_records(spark, path, "b").collect()}
    store.upsert_records(stored(spark, (1, "a", "EXCEPTION"), (2, "b", "EXCEPTION"), (3, "c", "RECONCILED")), path, "b")
    store.save_review_states(store.read_records(spark, path, "b").withColumn("review_state", F.when(F.col("record_id") == "a", "APPROVED").otherwise(F.col("review_state"))), path, "b")
    store.upsert_records(stored(spark, (1, "a", "RECONCILED"), (4, "d", "EXCEPTION")), path, "b")
    want = {("a", "RECONCILED", "APPROVED"), ("b", "EXCEPTION", "OPEN"), ("c", "RECONCILED", "OPEN"), ("d", "EXCEPTION", "OPEN")}
    assert state() == want and spark.read.parquet(f"{path}/rows").filter("version = 3").count() == 2
    store.save_records(stored(spark, (1, "z", "EXCEPTION")), path, "other")
    assert store.read_records(spark, path).count() == 5
    events = {(r.version, r.event_type, r.transaction_id) for r in changes.version_events(spark, path, "b", 1).collect()}
    assert events == {(2, "HUMAN_REVIEW_ACTION", "a"), (3, "RECORD_REVISED", "a"), (3, "RECORD_DECIDED", "d")}
    store.compact(spark, path, "b")
    store.upsert_records(stored(spark, (2, "b", "RECONCILED")), path, "b")
    assert state() == want - {("b", "EXCEPTION", "OPEN")} | {("b", "RECONCILED", "OPEN")} and store.version_of(spark, path, "b") == 5
    assert {r.record_id for r in store.read_records(spark, path, "b", as_of=1).collect()} == {"a", "b", "c"}


def test_a_payment_that_very_many_claim(spark):
    rows = spark.range(600).select(
        F.col("id").alias("seq"), F.format_string("r%04d", "id").alias("record_id"), F.lit("p").alias("matched_payment_id"), F.lit("RECONCILED").alias("outcome"), F.lit("EXACT_REFERENCE").alias("classification"), F.lit(None).cast("string").alias("exception_type"),
        F.lit(None).cast("string").alias("severity"), F.lit("").alias("reason"), F.lit("").alias("explanation"), F.lit("").alias("recommended_action"), F.array().cast(f"array<{CHECK}>").alias("checks"),
    )
    done = claims.resolve_claims(rows).collect()
    assert {(r.outcome, r.exception_type) for r in done} == {("HUMAN_REVIEW", "DUPLICATE_CLAIM")} and len(done) == 600
    by_id = {r.record_id: r for r in done}
    assert "r0001, r0002" in by_id["r0000"].reason and "and 579 more" in by_id["r0000"].reason and "r0599" not in by_id["r0599"].reason
    assert max(len(r.checks[0].detail) for r in done) < 250


def test_frequent_tokens_are_found_like_others(spark):
    spread = spark.createDataFrame([(k, t) for k in range(40) for t in ("the", "order", f"w{k % 7}", f"only{k}", "unknown")], "k int, token string")
    frequencies = spread.filter("token <> 'unknown'").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    want = sorted((r.k, r.token, r.df) for r in spread.join(frequencies, "token", "left").fillna(-1).collect())
    for n in (0, 2, 1000):
        assert sorted((r.k, r.token, r.df) for r in similarity.with_frequency(spread, frequencies, n).fillna(-1).collect()) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_window_candidates_pruned_in_their_row_change_no_shortlist(spark, seed):
    rng = random.Random(seed)
    day = lambda: f"2026-03-{rng.randrange(1, 29):02d} {rng.randrange(24):02d}:00:00"
    amounts = [1000, 1010, 1500, 5000, 90_000, 0]
    left = spark.createDataFrame([(k, f"r{k}", f"ORD-{rng.randrange(5000, 5040)}", rng.choice(amounts), day(), f"order {rng.choice('abc')}") for k in range(40)], "seq bigint, record_id string, reference_id string, amount_minor bigint, d string, description string")
    right = spark.createDataFrame([(k, f"p{rng.randrange(150)}", f"X-{rng.randrange(5000, 5040)}", rng.choice(amounts), day(), f"pay {rng.choice('abc')}") for k in range(200)], "pop_seq bigint, payment_id string, order_reference string, gross_amount_minor bigint, d string, description string")
    dated = lambda rows: rows.withColumn("order_date", F.to_timestamp("d")).drop("d")
    ledger, settlements = blocking.prepare_ledger(dated(left)), blocking.prepare_settlements(dated(right))
    for policy in (Policy(), Policy(max_window_scan_candidates=30, candidate_shortlist_size=2, candidate_search_window_days=4)):
        pools = [scoring.promising_pool(blocking.candidate_pool(ledger, settlements, policy, promising), ledger, settlements, policy) for promising in (False, True)]
        plain, pruned = ({(r.seq, r.pop_seq, r.source, r.place, r.has_core, round(r.base, 9)) for r in p.collect()} for p in pools)
        assert plain == pruned and len(plain) > 60
        assert blocking.promising_window_candidates(ledger, settlements, policy).count() < blocking.window_candidates(ledger, settlements, policy).count()


def test_percentiles_are_exact_over_ranges(spark):
    rng = random.Random(3)
    for values in ([rng.gauss(0, 100) for _ in range(501)], [5.0] * 300 + [None, None, 7.0], [1.0], [], [None]):
        row = metrics.percentiles(spark.createDataFrame([(v,) for v in values], "x double").repartition(7), "x").first()
        real = sorted(v for v in values if v is not None)
        for p, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
            at = p * (len(real) - 1)
            want = real[int(at)] + (real[min(int(at) + 1, len(real) - 1)] - real[int(at)]) * (at - int(at)) if real else None
            assert row[name] == (pytest.approx(want, abs=2e-6) if real else None)
        assert row["max"] == (max(real) if real else None)


def test_segments_are_chained_and_linked(spark):
    events = spark.range(250).select(F.col("id").alias("order"), F.lit("t").alias("timestamp"), F.col("id").cast("string").alias("transaction_id"), *[F.lit("x").alias(n) for n in ("event_type", "prior_state", "new_state", "evidence_ref")], F.to_json(F.struct("id")).alias("payload_json")).repartition(5)
    log, links = audit.append_segments(events, size=100)
    assert [(r.segment, r.first_seq, r.last_seq) for r in links.orderBy("segment").collect()] == [(0, 1, 100), (1, 101, 200), (2, 201, 250)]
    assert [(r.seq, int(r.transaction_id)) for r in log.orderBy("seq").collect()] == [(k + 1, k) for k in range(250)] and audit.verify_segments(log, links).count() == 0
    breaks = lambda rows, of: {(r.seq, r.reason) for r in audit.verify_segments(rows, of).collect()}
    assert (151, "doesn't follow its predecessor") in breaks(log.filter("seq <> 150"), links)
    assert breaks(log.filter("segment <> 1"), links.filter("segment <> 1")) == {(201, "the segment doesn't follow the one before")}
    assert {s for s, _ in breaks(log, links.withColumn("tail", F.when(F.col("segment") == 1, F.lit("0")).otherwise(F.col("tail"))))} == {101}
    # More events later: the heads are all that is needed.
    head = links.orderBy(F.desc("segment")).first()
    more, more_links = audit.append_segments(events, head.last_seq, head.segment, head.link, size=100)
    assert audit.verify_segments(log.unionByName(more), links.unionByName(more_links)).count() == 0 and more_links.agg(F.max("last_seq")).first()[0] == 500
    assert audit.append_segments(events.limit(0))[1].count() == 0
