"""Queries over a workspace of exports with different layouts, rendered from the orders table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_dir
from ..sources import plan, workspace
from .queries import query

# The layouts, by an order's key modulo 8: file name, delimiter, header and cells. Ten-digit seconds begin in 2001, hence the 4000 days.
_K = "CAST(o_orderkey AS STRING)"
_MAJOR = "format_string('%.2f', o_totalprice)"
_MINOR = "CAST(CAST(rint(o_totalprice * 100) AS BIGINT) AS STRING)"
_DAY = "date_format(o_orderdate, '{}')"
_LAYOUTS = (
    ("web_orders.csv", ",", {"order_id": f"'O-' || {_K}", "invoice_ref": f"'INV/' || {_K}", "amount": _MAJOR, "currency": "'usd'", "order_date": _DAY.format("dd/MM/yyyy"), "status": "'Paid'", "quantity": "'1'", "sku": "'S1'"}),
    ("invoices.csv", ";", {"Invoice No": f"'IN' || {_K}", "Customer Name": "'Ann; \"A\" & Co'", "Invoice Date": _DAY.format("dd-MM-yyyy"), "Amount": f"'₹' || {_MAJOR}", "Currency": "'INR'", "Status": "CASE WHEN o_orderkey % 3 = 0 THEN 'Returned' ELSE 'odd' END"}),
    ("sales_register.csv", ",", {"Date": _DAY.format("yyyy/MM/dd"), "Voucher No": f"'V' || {_K}", "Voucher Type": "'Sales'", "Bill Ref No": f"'B-' || {_K}", "Particulars": "'goods'", "Debit": f"CASE WHEN o_orderkey % 3 = 0 THEN {_MAJOR} ELSE '' END", "Credit": f"CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE {_MAJOR} END"}),
    ("payouts.csv", ",", {"payment_id": f"'pay_' || {_K}", "order_id": "'O-' || CAST(o_orderkey - 3 AS STRING)", "settlement_id": "'setl_1'", "amount": _MINOR, "fee": "'200'", "tax": "'36'", "currency": "'INR'", "created_at": "CAST(unix_timestamp(o_orderdate) + 4000 * 86400 AS STRING)", "settlement_date": _DAY.format("yyyy-MM-dd"), "status": "'processed'"}),
    ("bank_statement.tsv", "\t", {"Txn Date": _DAY.format("dd-MMM-yyyy"), "Value Date": _DAY.format("dd-MMM-yyyy"), "Narration": f"'NEFT/' || {_K}", "Ref No": f"'N' || {_K}", "Withdrawal": "''", "Deposit": _MAJOR, "Closing Balance": "'1,000.00'"}),
    ("advice.txt", "|", {"Payout Id": f"'P' || {_K}", "Merchant Ref No": f"'O-' || {_K}", "Gross Amount": f"'(' || {_MAJOR} || ')'", "Charges": "'1.50'", "GST": "'0.27'", "Payout Amount": "'5.00'", "Currency": "'INR'", "Payment Date": _DAY.format("yyyy-MM-dd HH:mm:ss"), "Payout Date": _DAY.format("yyyy-MM-dd")}),
    ("shop_orders.csv", ",", {"Order Number": f"'S-' || {_K}", "Order Date": _DAY.format("MMM d, yyyy"), "Product Name": "'tea \"green\", loose'", "Total": _MAJOR, "Quantity": "'2'", "SKU": "'T1'"}),
    ("ledger_export.csv", ",", {"Entry No": f"'L' || {_K}", "Ledger Name": "'Fußgänger'", "Posting Date": _DAY.format("yyyy-MM-dd"), "Amount": f"CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE {_MAJOR} END", "Remarks": "'first' || chr(10) || 'second line'"}),
)


def render(spark: SparkSession, sf_dir: str) -> str:
    """The orders as eight exports, and two files that can't be read; the folder's path."""
    folder = f"{shared_dir(spark)}/ledgerlane/workspace-{uuid.uuid4().hex}"
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderdate")
    for k, (name, delimiter, cells) in enumerate(_LAYOUTS):
        rows = orders.filter(F.col("o_orderkey") % 8 == k).select(*[F.expr(e).alias(c) for c, e in cells.items()])
        # Read back in any session, so that all quoted line breaks are kept as they are.
        rows.write.csv(f"{folder}/{name}", header=True, sep=delimiter, escape='"', emptyValue="", encoding="ISO-8859-1" if k == 7 else "UTF-8")
    one = spark.range(1)
    one.select(F.lit("order_id,amount,order_date")).write.text(f"{folder}/empty.csv")
    one.select(F.concat(F.unhex(F.lit("D0CF11E0A1B11AE1")), F.lit("rest").cast("binary")).cast("string")).write.text(f"{folder}/old.xls")
    return folder


_SQL_MINOR = "CAST(round_even(o_totalprice * 100, 0) AS BIGINT)"


def _expected(k: int, key: str, reference: str, *, role: str = "LEDGER", amount: str = "m", fee: str = "NULL", tax: str = "NULL", net: str = "NULL", refund: str = "0", currency: str = "'INR'", status: str = "'captured'", text: str = "''", rows: str = "true", day: str = "CAST(o_orderdate AS DATE)") -> str:
    return (
        f"SELECT '{_LAYOUTS[k][0]}' AS source, '{role}' AS role, {key} AS key, {reference} AS reference, {amount} AS amount_minor, CAST({fee} AS BIGINT) AS fee_minor, CAST({tax} AS BIGINT) AS tax_minor, CAST({net} AS BIGINT) AS net_amount_minor,"
        f" CAST({refund} AS BIGINT) AS refund_amount_minor, {currency} AS currency, {day} AS day, {status} AS status, {text} AS description FROM o WHERE o_orderkey % 8 = {k} AND {rows}"
    )


_O = f"WITH o AS (SELECT o_orderkey, o_orderdate, CAST(o_orderkey AS VARCHAR) AS k, {_SQL_MINOR} AS m FROM orders) "
_RECORDS = _O + " UNION ALL ".join(
    [
        _expected(0, "'O-' || k", "'INV/' || k", currency="'USD'"),
        _expected(1, "'IN' || k", "'IN' || k", status="CASE WHEN o_orderkey % 3 = 0 THEN 'refunded' ELSE 'captured' END", text="'Ann; \"A\" & Co'"),
        _expected(2, "'B-' || k", "'B-' || k", refund="CASE WHEN o_orderkey % 3 = 0 THEN m ELSE 0 END", status="CASE WHEN o_orderkey % 3 = 0 THEN 'refunded' ELSE 'captured' END", text="'goods'"),
        _expected(3, "'pay_' || k", "'O-' || CAST(o_orderkey - 3 AS VARCHAR)", role="SETTLEMENT", fee="200", tax="36", net="m - 236", status="'settled'", day="CAST(o_orderdate AS DATE) + 4000"),
        _expected(4, "'N' || k", "'N' || k", role="SETTLEMENT", fee="0", tax="0", net="m", status="'settled'", text="'NEFT/' || k"),
        _expected(5, "'P' || k", "'O-' || k", role="SETTLEMENT", fee="150", tax="27", net="500", refund="m", status="'refunded'"),
        _expected(6, "'S-' || k", "'S-' || k"),
        _expected(7, "'L' || k", "'L' || k", text="'first' || chr(10) || 'second line'", rows="o_orderkey % 5 <> 0"),
    ]
)


def _common(records: DataFrame, role: str) -> DataFrame:
    ledger = role == "LEDGER"
    pick = lambda ours, theirs: F.col(ours if ledger else theirs)
    none = F.lit(None).cast("bigint")
    return records.select(
        "provenance.source_id", F.lit(role).alias("role"), pick("order_id", "payment_id").alias("key"), pick("reference_id", "order_reference").alias("reference"), pick("amount_minor", "gross_amount_minor").alias("amount_minor"),
        *[(none if ledger else F.col(c)).alias(c) for c in ("fee_minor", "tax_minor", "net_amount_minor")], "refund_amount_minor", "currency", F.to_date("order_date").alias("day"), "status", "description",
    ).withColumnRenamed("source_id", "source")


@query(_RECORDS)
def workspace_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as eight exports with different headers, delimiters, encodings and layouts of dates and amounts, mapped in one plan."""
    found = workspace.ingest(spark, render(spark, sf_dir))
    return _common(found.ledger, "LEDGER").unionByName(_common(found.settlements, "SETTLEMENT"))


@query(_O + "SELECT * FROM (VALUES ('empty.csv', 'a header without rows', 1::BIGINT), ('old.xls', 'legacy .xls workbook: save it as .xlsx or .csv', 1)) t(source, error, n) UNION ALL SELECT 'ledger_export.csv', 'amount is missing or not a number', count(*) FROM o WHERE o_orderkey % 40 IN (15, 55) OR (o_orderkey % 8 = 7 AND o_orderkey % 5 = 0) HAVING count(*) > 0")
def workspace_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that can't be read, and the rows that can't be mapped, by source and reason; the rest of the job goes on."""
    found = workspace.ingest(spark, render(spark, sf_dir))
    rows = found.rejected.groupBy(F.col("source_id").alias("source"), "error").agg(F.count(F.lit(1)).alias("n"))
    return found.errors.select("source", "error", F.lit(1).cast("bigint").alias("n")).unionByName(rows)


_KINDS = ("ORDERS", "ORDERS", "ACCOUNTING", "PAYMENT_GATEWAY", "BANK_STATEMENT", "PAYMENT_GATEWAY", "ORDERS", "ACCOUNTING")


@query(
    "WITH n AS (SELECT o_orderkey % 8 AS k, count(*) AS n FROM orders GROUP BY 1) SELECT source, source_type, scale, delimiter, n::BIGINT AS n_rows FROM n JOIN (VALUES "
    + ", ".join(f"({k}, '{name}', '{kind}', '{'minor' if k == 3 else 'major'}', '{sep if sep != chr(9) else 'tab'}')" for k, ((name, sep, _), kind) in enumerate(zip(_LAYOUTS, _KINDS, strict=True)))
    + ") t(k, source, source_type, scale, delimiter) USING (k)"
)
def workspace_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each readable file is taken for."""
    found = workspace.ingest(spark, render(spark, sf_dir)).files
    return found.select("source", "source_type", "scale", F.when(F.col("delimiter") == "\t", "tab").otherwise(F.col("delimiter")).alias("delimiter"), "n_rows")


@query("SELECT 'web_orders.csv' AS left_id, 'payouts.csv' AS right_id, count(*) AS shared FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey - 3 WHERE a.o_orderkey % 8 = 0 HAVING count(*) > 0")
def workspace_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files of neighbouring stages name the same payments, over all rows of all files."""
    found = workspace.ingest(spark, render(spark, sf_dir))
    ids = [(found.ledger, ("order_id", "reference_id")), (found.settlements, ("payment_id", "order_reference"))]
    rows = None
    for records, columns in ids:
        part = records.select(F.col("provenance.source_id").alias("source_id"), F.explode(F.array(*columns)).alias("id"))
        rows = part if rows is None else rows.unionByName(part)
    return plan.exact_relationships(rows.join(found.files.select(F.col("source").alias("source_id"), "stage"), "source_id"))


@query("SELECT code, subject FROM (SELECT count(*) AS n FROM orders WHERE o_orderkey % 8 = 1) CROSS JOIN (VALUES ('UNCONFIRMED_ROLE', 'invoices.csv')) t(code, subject) WHERE n > 0")
def workspace_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands against a run over the rendered files: the one whose type isn't sure enough."""
    files = workspace.ingest(spark, render(spark, sf_dir)).files
    return plan.blockers(files.select(F.col("source").alias("source_id"), F.col("source").alias("filename"), "needs_confirmation", "missing", "role"))
