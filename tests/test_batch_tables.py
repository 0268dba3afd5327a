from ledgerlane.operators import claims
from ledgerlane.plans import queries, records, states


def test_a_batch_keeps_its_decisions_once_and_two_small_tables(spark, monkeypatch):
    made, copied = [], []
    table = queries.reuse.table
    monkeypatch.setattr(queries.reuse, "table", lambda name, *a, **k: made.append(name) or table(name, *a, **k))
    monkeypatch.setattr(claims, "materialize", lambda rows, name: copied.append(name) or rows)
    rows = queries.results(spark, "/root/testdata/sf0.001")
    assert rows.count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert made == ["decided", "sums", "contested"] and copied == []


def test_traces_and_evidence_are_no_tables_of_their_own(spark, monkeypatch):
    made = []
    table = queries.reuse.table
    monkeypatch.setattr(queries.reuse, "table", lambda name, *a, **k: made.append(name) or table(name, *a, **k))
    for rows, column in ((records._investigated(spark, "/root/testdata/sf0.001"), "trace"), (states._with_evidence(spark, "/root/testdata/sf0.001"), "evidence")):
        assert column in rows.columns
    assert made == ["decided", "sums", "contested"] * 2
