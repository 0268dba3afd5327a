import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlane.functions import text, values
from ledgerlane.operators import audit
from ledgerlane.sources import readers
from ledgerlane.sources.detect import amount_of, date_of, detect, scale_of


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "shown, expected",
    [("87.5", 87.5), ("9,870.01", 9870.01), ("₹ 60,500", 60500.0), ("(7.25)", -7.25), ("-310", -310.0), ("0.00", 0.0), (" ", None), ("n/a", None), (None, None), ("3,125.00 Cr", 3125.0), ("1e5", 15.0), ("12-5", None)],
)
def test_parse_amount(spark, shown, expected):
    assert one(spark, values.parse_amount(F.lit(shown).cast("string"))) == expected
    assert amount_of(shown) == expected


@pytest.mark.parametrize("shown", ["2026-03-01", "2026/03/01", "01-03-2026", "01/03/2026", "1/3/2026", "01-Mar-2026", "Mar 1, 2026", "2026-03-01T00:00:00Z", "2026-03-01 00:00:00", "20260301", "1772323200"])
def test_parse_date(spark, shown):
    assert str(one(spark, values.parse_date(F.lit(shown)))) == "2026-03-01 00:00:00"
    assert date_of(shown).isoformat() == "2026-03-01T00:00:00+00:00"


@pytest.mark.parametrize("shown", ["last tuesday", "", None])
def test_unreadable_dates_are_null(spark, shown):
    assert one(spark, values.parse_date(F.lit(shown).cast("string"))) is None


def test_days_between_floors_before_the_sign_goes(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, values.days_between(at("2026-03-02 12:00:00"), at("2026-03-02 11:00:00"))) == 1
    assert one(spark, values.days_between(at("2026-03-02 12:00:00"), at("2026-03-02 13:00:00"))) == 0


def test_half_to_even(spark):
    assert one(spark, values.to_minor(F.lit(2.675))) == 268
    assert one(spark, values.to_minor(F.lit(0.025))) == 2


def test_references(spark):
    assert one(spark, text.normalize_reference(F.lit(" ord_58-291 "))) == "ORD58291"
    assert one(spark, text.reference_cores(F.lit("RZP/200427/S12"), F.lit("paid 200427 and 9999"))) == ["200427", "9999"]
    assert one(spark, text.reference_cores(F.lit("٢٠٢٦"))) == ["٢٠٢٦"]
    comparable = lambda a, b: one(spark, text.references_comparable(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    assert comparable(["2057"], ["2058"]) and not comparable(["2057"], ["774120"])


def test_jaccard_of_nothing_is_one(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, text.jaccard(empty, empty)) == 1.0
    assert one(spark, text.jaccard(F.array(F.lit("a")), empty)) == 0.0


def test_idf(spark):
    assert one(spark, text.idf(F.lit(None).cast("int"), F.lit(9))) == pytest.approx(math.log(10) + 1)
    assert one(spark, text.idf(F.lit(3), F.lit(0))) == 1.0


def test_money_and_words(spark):
    assert one(spark, values.money(F.lit(123456), F.lit("INR"))) == "₹1,234.56"
    assert one(spark, values.money(F.lit(-1200), F.lit("usd"))) == "-USD 12.00"
    assert one(spark, text.join_words(F.array(F.lit("a"), F.lit("b"), F.lit("c")), ", and ")) == "a, b, and c"


def test_scrub(spark):
    found = one(spark, text.scrub_secrets(F.lit("key=sk-longsecret1 and Bearer abcdefghijklmnop"), ["sk-longsecret1", "short"]))
    assert "longsecret" not in found and "abcdefgh" not in found


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.text(max_size=5), st.one_of(st.integers(), st.text(max_size=5), st.none())))
def test_canonical_json_ignores_order(payload):
    assert audit.canonical_json(payload) == audit.canonical_json(dict(reversed(list(payload.items()))))


def test_scale():
    assert scale_of(["100", "2500"]) == "minor" and scale_of(["100", "25.00"]) == "major" and scale_of([]) == "major"


def test_detect_contests_and_rescue():
    found = detect(["order_id", "invoice_ref", "amount", "order_date"], [{"order_id": "1", "invoice_ref": "I1", "amount": "10.00", "order_date": "2026-03-01"}])
    assert found.mapping == {"transaction_id": "order_id", "reference": "invoice_ref", "amount": "amount", "date": "order_date"} and not found.missing
    paired = detect(["Value Date", "Narration", "Withdrawal", "Deposit", "Ref No"], [{"Withdrawal": "", "Deposit": "10.00"}])
    assert (paired.debit, paired.credit, paired.mapping["date"]) == ("Withdrawal", "Deposit", "Value Date")
    rescued = detect(["when it was", "how much"], [{"when it was": "2026-03-01", "how much": "12.50"}] * 5)
    assert set(rescued.mapping) == {"amount", "date"}


def test_readers_on_the_driver():
    assert readers.detect_format("a.csv", b"PK\x03\x04rest") == ("xlsx", ["named like csv but holds xlsx"])
    with pytest.raises(readers.UnreadableFile):
        readers.detect_format("a.xls", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1")
    assert readers.decode(b"\xef\xbb\xbfa") == "a" and readers.decode(b"\xe9") == "é"
    assert readers.sniff_delimiter("a;b;c\n1;2;3\n4;5;6\n") == ";"
    assert readers.header_names(["Date", "", "date"]) == ["Date", "column_2", "date_2"]
    assert readers.find_header_row([["Statement of account"], [], ["Date", "Narration", "Amount"], ["2026-03-01", "x", "10.00"]]) == 2


def test_resume_point():
    assert audit.resume_point(-5, None, 9) == 0 and audit.resume_point(None, "7", 9) == 7 and audit.resume_point(None, "x", 9) == 9
