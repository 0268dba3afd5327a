"""Ledger and settlement populations derived from the orders table by integer arithmetic, with a known case per record.

The bucket of an order (its key modulo 100) decides how its settlement deviates; see ``CASES``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRODUCTS = ("annual plan", "gift voucher", "team license", "cloud storage", "mobile recharge", "travel pass", "book bundle", "music lessons", "garden tools", "kitchen set", "sports shoes", "desk lamp")

# Buckets of the case table, from and to.
CASES = (
    (0, 49, "clean"), (50, 57, "reformatted"), (58, 61, "duplicate_one_amount"), (62, 64, "duplicate_same_amount"), (65, 68, "amount_mismatch"), (69, 71, "net_off"),
    (72, 74, "late"), (75, 77, "refund_both"), (78, 79, "refund_one_side"), (80, 81, "currency"), (82, 86, "missing"), (87, 88, "bank_short_text"), (89, 90, "bank_full_text"),
    (91, 91, "bank_close_text"), (92, 94, "other_reference"), (95, 95, "neighbour_reference"), (96, 97, "clean"), (98, 98, "claimed_twice"), (99, 99, "second_claim"),
)

PRODUCT_SQL = "CASE k % 12 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PRODUCTS)) + " END"
CASE_SQL = "CASE " + " ".join(f"WHEN k % 100 BETWEEN {a} AND {b} THEN '{name}'" for a, b, name in CASES) + " END"

#: The same text serves Spark and DuckDB but for integer division, hence the two placeholders.
_LEDGER = """
SELECT o.k AS seq, 'ORD' || CAST(o.k AS {string}) AS record_id, 'ORD' || CAST(o.k AS {string}) AS order_id,
       'ORD-' || CAST(100000 + CASE WHEN o.k % 100 = 99 THEN o.k - 1 ELSE o.k END AS {string}) AS reference_id,
       CASE WHEN o.k % 100 = 99 THEN coalesce(p.amount, o.amount) ELSE o.amount END AS amount_minor, 'INR' AS currency,
       CASE WHEN o.k % 100 = 99 THEN coalesce(p.day, o.day) ELSE o.day END AS order_date,
       CASE WHEN o.k % 100 BETWEEN 75 AND 79 THEN 'partially_refunded' ELSE 'captured' END AS status,
       CASE WHEN o.k % 100 BETWEEN 75 AND 79 THEN o.amount {div} 4 ELSE 0 END AS refund_amount_minor,
       'Order ' || CAST(100000 + o.k AS {string}) || ' ' || o.product AS description, o.kind AS case_name
FROM base o LEFT JOIN base p ON p.k = o.k - 1
"""
_SETTLED = """
SELECT k * 2 + copy AS pop_seq, 'pay_' || CAST(k AS {string}) || CASE copy WHEN 1 THEN '_b' ELSE '_a' END AS payment_id,
       CASE WHEN b BETWEEN 50 AND 57 THEN 'RZP/' || CAST(100000 + k AS {string}) || '/SETL'
            WHEN b BETWEEN 87 AND 91 THEN 'UTR' || CAST(7000000 + k AS {string})
            WHEN b BETWEEN 92 AND 94 THEN 'ORD-' || CAST(900000 + k % 100000 AS {string})
            WHEN b = 95 THEN 'ORD-' || CAST(100001 + k AS {string})
            ELSE 'ORD-' || CAST(100000 + k AS {string}) END AS order_reference,
       'setl_' || CAST(k {div} 50 AS {string}) AS settlement_id, gross AS gross_amount_minor, gross * 2 {div} 100 AS fee_minor,
       (gross * 2 {div} 100) * 18 {div} 100 AS tax_minor, refund AS refund_amount_minor,
       gross - gross * 2 {div} 100 - (gross * 2 {div} 100) * 18 {div} 100 - refund - CASE WHEN b BETWEEN 69 AND 71 THEN 1234 ELSE 0 END AS net_amount_minor,
       day + CASE WHEN b BETWEEN 87 AND 91 THEN INTERVAL '1' DAY ELSE INTERVAL '0' DAY END AS order_date,
       day + CASE WHEN b BETWEEN 72 AND 74 THEN INTERVAL '30' DAY WHEN b BETWEEN 87 AND 91 THEN INTERVAL '3' DAY ELSE INTERVAL '2' DAY END AS settlement_date,
       CASE WHEN b BETWEEN 80 AND 81 THEN 'USD' ELSE 'INR' END AS currency, CASE WHEN refund > 0 THEN 'partially_refunded' ELSE 'settled' END AS status,
       CASE WHEN b BETWEEN 87 AND 88 THEN 'NEFT INWARD ' || substring(product, 1, 3)
            WHEN b BETWEEN 89 AND 90 THEN 'NEFT INWARD ' || product
            WHEN b = 91 THEN 'order ' || product
            WHEN b BETWEEN 92 AND 94 THEN 'Settlement batch ' || CAST(k % 7 AS {string})
            ELSE 'Settlement for ' || CAST(100000 + k AS {string}) || ' ' || product END AS description
FROM (
  SELECT k, k % 100 AS b, copy, day, product,
         amount + CASE WHEN k % 100 BETWEEN 65 AND 68 THEN 5000 WHEN k % 100 BETWEEN 58 AND 61 AND copy = 1 THEN 7777 ELSE 0 END AS gross,
         CASE WHEN k % 100 BETWEEN 75 AND 77 THEN amount {div} 4 ELSE 0 END AS refund
  FROM base CROSS JOIN (SELECT 0 AS copy UNION ALL SELECT 1) copies
  WHERE (copy = 0 AND k % 100 NOT BETWEEN 82 AND 86 AND k % 100 <> 99) OR (copy = 1 AND k % 100 BETWEEN 58 AND 64)
) rows
"""
_BASE = f"SELECT k, amount, day, {PRODUCT_SQL} AS product, {CASE_SQL} AS kind FROM (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS amount, CAST(o_orderdate AS TIMESTAMP) AS day FROM orders) o"


def base_sql() -> str:
    return _BASE


def ledger_sql(dialect: str) -> str:
    return _LEDGER.format(**_DIALECTS[dialect])


def settlements_sql(dialect: str) -> str:
    return _SETTLED.format(**_DIALECTS[dialect])


_DIALECTS = {"spark": {"string": "STRING", "div": "div"}, "duckdb": {"string": "VARCHAR", "div": "//"}}


def populations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ledger (with seq, record_id and case_name) and settlements (with pop_seq)."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderdate")
    base = spark.sql(_BASE.replace("FROM orders", "FROM {orders}"), orders=orders)
    ledger = spark.sql(ledger_sql("spark").replace("base o", "{base} o").replace("base p", "{base} p"), base=base)
    settlements = spark.sql(settlements_sql("spark").replace("FROM base", "FROM {base}"), base=base)
    return ledger, settlements.withColumn("refund_amount_minor", F.col("refund_amount_minor").cast("bigint"))
