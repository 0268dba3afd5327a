"""Queries over stored decisions, traces, sources, the audit log and metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import audit, claims, decisions, metrics, review, trace
from ..schemas import Policy
from ..scratch import shared_dir
from ..sinks.store import export_rows
from ..sources import classify, plan
from ..sources.detect import Detected, detect
from ..sources.mapping import map_rows
from ..streaming import streams
from . import chain
from .queries import decided, once, prepared, query, results

# Stored decisions: every seventh was answered by a person already, batches of a thousand.
_STORED_SQL = "SELECT *, CASE WHEN seq % 7 = 0 THEN 'APPROVED' ELSE 'OPEN' END AS review_state, 'batch_' || CAST(seq % 3 AS VARCHAR) AS batch_id, TIMESTAMP '2026-01-01 00:00:00' + INTERVAL 1 MINUTE * CAST(seq % 977 AS INTEGER) AS processed_at FROM final"


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir)
    return rows.withColumns(
        {
            "review_state": F.when(F.col("seq") % 7 == 0, "APPROVED").otherwise("OPEN"), "batch_id": F.concat(F.lit("batch_"), (F.col("seq") % 3).cast("string")),
            "processed_at": F.timestamp_seconds(F.unix_seconds(F.lit("2026-01-01 00:00:00").cast("timestamp")) + F.col("seq") % 977 * 60),
        }
    )


def _final(select: str, **more: str) -> str:
    return chain.sql("final", select, stored=_STORED_SQL, **more)


@query(_final("SELECT outcome, count(*) AS n FROM final GROUP BY outcome"))
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.outcome_counts(results(spark, sf_dir))


@query(_final("SELECT count(*) AS decided, count(*) FILTER (ai_calls > 0) AS semantic_tier_invoked, 0::BIGINT AS ai_consulted, count(*) FILTER (ai_calls > 0) AS heuristic_consulted, count(*) FILTER (outcome = 'HUMAN_REVIEW') AS unresolved FROM final"))
def progress_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.progress_counts(results(spark, sf_dir))


@query(_final("SELECT record_id, severity, amount_minor FROM stored WHERE outcome IN ('HUMAN_REVIEW', 'EXCEPTION') AND review_state = 'OPEN' ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, amount_minor DESC, record_id LIMIT 100"))
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_queue(stored(spark, sf_dir)).select("record_id", "severity", "amount_minor")


@query(_final("SELECT coalesce(exception_type, 'UNCLASSIFIED') AS exception_type, count(*) AS n, sum(amount_minor)::BIGINT AS amount_minor, arg_min(severity, CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END) AS severity, count(*) FILTER (review_state = 'OPEN') AS open_n, coalesce(sum(amount_minor) FILTER (review_state = 'OPEN'), 0)::BIGINT AS open_amount_minor FROM stored WHERE outcome IN ('HUMAN_REVIEW', 'EXCEPTION') GROUP BY 1"))
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_summary(stored(spark, sf_dir))


_CANDIDATE = "(payment_id IS NOT NULL OR seq IN (SELECT seq FROM listed))"
_DISPUTED = "(exception_type IS NULL OR exception_type IN ('AMBIGUOUS_MATCH', 'LOW_CONFIDENCE_MATCH', 'DUPLICATE_REFERENCE', 'DUPLICATE_CLAIM', 'MISSING_SETTLEMENT', 'PENDING_SETTLEMENT'))"


@query(_final(f"SELECT record_id, CASE WHEN review_state <> 'OPEN' THEN '' ELSE concat_ws(',', CASE WHEN {_CANDIDATE} AND {_DISPUTED} THEN 'APPROVE_MATCH' END, CASE WHEN {_CANDIDATE} THEN 'REJECT_MATCH' END, 'MARK_MISSING', 'DEFER', 'ESCALATE') END AS actions FROM stored"))
def review_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).select("record_id", F.array_join(review.available_actions(), ",").alias("actions"))


_RUNS = "SELECT user_id AS run_id, CASE WHEN user_id % 5 = 0 THEN 'COMPLETED' ELSE 'RUNNING' END AS status, CAST(count(*) * (user_id % 2) AS BIGINT) AS total_records, max(CAST(ts AS TIMESTAMP)) AS started_at FROM {0} GROUP BY user_id"


@query(f"WITH runs AS ({_RUNS.format('events')}) SELECT run_id, CASE WHEN status = 'COMPLETED' THEN 'COMPLETED' WHEN total_records = 0 THEN 'DRAFT' WHEN epoch(TIMESTAMP '2024-01-31 23:00:00')::BIGINT - floor(epoch(started_at))::BIGINT > 180 THEN 'INTERRUPTED' ELSE 'RUNNING' END AS state FROM runs")
def derived_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spark.sql(_RUNS.format("{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return runs.select("run_id", review.derived_status(F.lit("2024-01-31 23:00:00").cast("timestamp")).alias("state"))


@query(_final("SELECT record_id, outcome, exception_type, severity, payment_id AS matched_payment_id, amount_minor FROM final"))
def export_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export_rows(results(spark, sf_dir)).select("record_id", "outcome", "exception_type", "severity", "matched_payment_id", "amount_minor")


@query(_final("SELECT case_name, batch_id, record_id FROM (SELECT *, row_number() OVER (PARTITION BY case_name ORDER BY processed_at DESC, batch_id DESC, record_id) AS n FROM stored) WHERE n = 1"))
def latest_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = stored(spark, sf_dir).withColumn("key", F.col("record_id"))
    newest = Window.partitionBy("case_name").orderBy(F.desc("processed_at"), F.desc("batch_id"), "key")
    return own.withColumn("n", F.row_number().over(newest)).filter("n = 1").select("case_name", "batch_id", "record_id")


@query(_final("SELECT 'p' || CAST(seq % 4 AS VARCHAR) AS provider, max(processed_at) AS last_at FROM stored WHERE ai_calls > 0 AND seq % 4 <> 3 GROUP BY 1"))
def last_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    backend = F.when(F.col("seq") % 4 == 3, "heuristic-fallback").otherwise(F.concat(F.lit("P"), (F.col("seq") % 4).cast("string"), F.lit(":model")))
    return review.last_success(stored(spark, sf_dir).withColumn("ai_backend", backend))


# Money trace.

_MATCH = "CASE WHEN exception_type = 'DUPLICATE_CLAIM' THEN 'AMBIGUOUS' WHEN payment_id IS NOT NULL THEN 'FOUND' WHEN classification = 'PENDING_SETTLEMENT_WINDOW' THEN 'PENDING' WHEN classification IN ('AMBIGUOUS_MULTIPLE', 'SEMANTIC_UNRESOLVED') THEN 'AMBIGUOUS' WHEN seq IN (SELECT seq FROM seen WHERE contradiction) THEN 'CONTRADICTORY' ELSE 'MISSING' END"
# The candidates that a decision keeps: all of a shortlist without an admissible one, else those judged or the settled one's rivals.
_SEEN = "SELECT seq, pop_seq, contradiction, admissible, exact FROM listed WHERE seq NOT IN (SELECT seq FROM good) UNION ALL SELECT seq, pop_seq, contradiction, admissible, exact FROM good"
_TRACED = f"SELECT *, CASE WHEN payment_status <> 'FOUND' THEN 'NOT_EVALUATED' WHEN NOT (currency_ok AND amount_ok AND net_ok AND timing_ok AND refund_ok) THEN 'CONTRADICTORY' ELSE 'FOUND' END AS settlement_status FROM (SELECT *, {_MATCH} AS payment_status FROM final)"
_BROKEN = "SELECT *, CASE WHEN payment_status <> 'FOUND' THEN 'PAYMENT' WHEN settlement_status <> 'FOUND' THEN 'SETTLEMENT' END AS break_stage, CASE WHEN payment_status <> 'FOUND' THEN payment_status WHEN settlement_status <> 'FOUND' THEN settlement_status ELSE 'NONE' END AS break_kind FROM traced"


def _investigated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-wise over the decisions, so a query makes only the columns it asks for, and no wide table of all of them is kept."""
    return trace.investigate(results(spark, sf_dir))


@query(_final("SELECT record_id, 'ORDER:FOUND,PAYMENT:' || payment_status || ',SETTLEMENT:' || settlement_status || ',BANK:NOT_EVALUATED,BOOKS:NOT_EVALUATED' AS trace FROM traced", seen=_SEEN, traced=_TRACED))
def money_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _investigated(spark, sf_dir).select("record_id", F.array_join(F.transform("trace", lambda s: F.concat(s.stage, F.lit(":"), s.status)), ",").alias("trace"))


_AT_BANK = "'ORDER:FOUND,PAYMENT:NOT_EVALUATED,SETTLEMENT:NOT_EVALUATED,BANK:' || payment_status || ',BOOKS:' || CASE WHEN payment_status = 'FOUND' THEN 'FOUND' ELSE 'NOT_EVALUATED' END"
_AT_GATEWAY = "'ORDER:FOUND,PAYMENT:' || payment_status || ',SETTLEMENT:' || settlement_status || ',BANK:NOT_EVALUATED,BOOKS:' || CASE WHEN payment_status = 'FOUND' AND settlement_status = 'FOUND' THEN 'FOUND' ELSE 'NOT_EVALUATED' END"


@query(_final(f"SELECT record_id, CASE WHEN seq % 2 = 1 THEN {_AT_BANK} ELSE {_AT_GATEWAY} END AS trace FROM traced", seen=_SEEN, traced=_TRACED))
def money_trace_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of accounting exports against both gateway and bank files: each record is traced where its counterpart comes from."""
    rows = results(spark, sf_dir).withColumn("origin", F.when(F.col("seq") % 2 == 1, "BANK_STATEMENT").otherwise("PAYMENT_GATEWAY"))
    traced = trace.with_trace(rows, trace.Roles(gateway=True, bank=True, orders=False, books=True), "origin")
    return traced.select("record_id", F.array_join(F.transform("trace", lambda s: F.concat(s.stage, F.lit(":"), s.status)), ",").alias("trace"))


@query(_final("SELECT record_id, break_stage, break_kind FROM broken", seen=_SEEN, traced=_TRACED, broken=_BROKEN))
def breakpoint(spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: A001
    return _investigated(spark, sf_dir).select("record_id", "break_stage", "break_kind")


@query(_final("SELECT coalesce(break_stage, '-') AS stage, break_kind AS kind, count(*) AS n FROM broken GROUP BY GROUPING SETS ((coalesce(break_stage, '-')), (break_kind), (coalesce(break_stage, '-'), break_kind))", seen=_SEEN, traced=_TRACED, broken=_BROKEN))
def breakpoint_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.breakpoint_summary(_investigated(spark, sf_dir))


_ACTION = """CASE WHEN payment_id IS NOT NULL AND NOT (currency_ok AND amount_ok AND net_ok AND refund_ok) THEN 'EXCEPTION' WHEN outcome = 'RECONCILED' THEN 'RECONCILE' WHEN break_kind = 'PENDING' THEN 'INVESTIGATE'
    WHEN break_kind IN ('AMBIGUOUS', 'CONTRADICTORY') THEN 'HUMAN_REVIEW' WHEN exception_type = 'DUPLICATE_CLAIM' THEN 'HUMAN_REVIEW'
    WHEN payment_id IS NULL AND seq IN (SELECT seq FROM seen WHERE NOT admissible AND exact) AND seq NOT IN (SELECT seq FROM seen WHERE contradiction) AND seq IN (SELECT seq FROM amount_only) THEN 'HUMAN_REVIEW'
    WHEN payment_id IS NULL AND classification IN ('NO_CANDIDATES', 'NO_ADMISSIBLE_CANDIDATE', 'ALL_CANDIDATES_REJECTED') THEN 'EXCEPTION' WHEN payment_id IS NOT NULL AND NOT timing_ok THEN 'EXCEPTION' ELSE 'INVESTIGATE' END"""
_AMOUNT_ONLY = "SELECT seq FROM listed WHERE seq NOT IN (SELECT seq FROM good) AND NOT contradiction AND in_window AND NOT shared_core AND similarity < 0.20 AND exact AND comparable"


@query(_final(f"SELECT record_id, {_ACTION} AS action FROM broken", seen=_SEEN, traced=_TRACED, broken=_BROKEN, amount_only=_AMOUNT_ONLY))
def decide_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _investigated(spark, sf_dir).select("record_id", "action")


_CONTRADICTED = "seq IN (SELECT seq FROM seen WHERE contradiction)"
# In the order of their confidence, then of the rules.
_HYPOTHESES = f"""concat_ws(',', CASE WHEN classification = 'PENDING_SETTLEMENT_WINDOW' THEN 'PENDING_SETTLEMENT=0.95' END, CASE WHEN exception_type IN ('DUPLICATE_CLAIM', 'DUPLICATE_REFERENCE') THEN 'DUPLICATE_TRANSACTION=0.85' END,
    CASE WHEN {_CONTRADICTED} AND classification <> 'PENDING_SETTLEMENT_WINDOW' THEN 'CONFLICTING_IDENTITY=0.85' END, CASE WHEN payment_id IS NOT NULL AND NOT refund_ok THEN 'REFUND_OFFSET=0.7' END,
    CASE WHEN payment_id IS NULL AND classification = 'NO_CANDIDATES' THEN 'GENUINELY_MISSING=0.7' END, CASE WHEN payment_id IS NOT NULL AND NOT net_ok THEN 'GATEWAY_FEE_DEDUCTION=0.65' END,
    CASE WHEN payment_id IS NULL AND classification IN ('NO_ADMISSIBLE_CANDIDATE', 'ALL_CANDIDATES_REJECTED') THEN 'MISSING_SETTLEMENT=0.65' END, CASE WHEN seq IN (SELECT seq FROM amount_only) AND NOT {_CONTRADICTED} THEN 'REFERENCE_MISMATCH=0.55' END)"""


@query(_final(f"SELECT record_id, {_HYPOTHESES} AS hypotheses FROM broken", seen=_SEEN, traced=_TRACED, broken=_BROKEN, amount_only=_AMOUNT_ONLY))
def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _investigated(spark, sf_dir).select("record_id", F.array_join(F.transform("hypotheses", lambda h: F.concat(h.label, F.lit("="), h.confidence.cast("string"))), ",").alias("hypotheses"))


# A small batch in which three settlements are sums of unmatched records.

_SMALL = "SELECT o_orderkey AS seq, 'R' || CAST(o_orderkey AS VARCHAR) AS record_id, (1000 + o_orderkey * 137 + o_orderkey * o_orderkey * 7) AS amount_minor FROM orders WHERE o_orderkey < 30"
_SUMS = "SELECT 0 AS pop_seq, 'sum_0' AS payment_id, (SELECT sum(amount_minor) FROM small WHERE seq IN (3, 11)) AS gross UNION ALL SELECT 1, 'sum_1', (SELECT sum(amount_minor) FROM small WHERE seq IN (5, 17, 23)) UNION ALL SELECT 2, 'sum_2', (SELECT sum(amount_minor) + 1 FROM small WHERE seq IN (20, 29))"


@query(
    f"""WITH small AS ({_SMALL}), sums AS ({_SUMS}), combos AS (
        SELECT a.record_id || ',' || b.record_id AS members, a.amount_minor + b.amount_minor AS total, greatest(a.amount_minor, b.amount_minor) AS top FROM small a JOIN small b ON a.seq < b.seq
        UNION ALL SELECT a.record_id || ',' || b.record_id || ',' || c.record_id, a.amount_minor + b.amount_minor + c.amount_minor, greatest(a.amount_minor, b.amount_minor, c.amount_minor) FROM small a JOIN small b ON a.seq < b.seq JOIN small c ON b.seq < c.seq)
        SELECT payment_id, min(members) AS members FROM sums JOIN combos ON abs(total - gross) <= 2 AND top < gross GROUP BY payment_id HAVING count(*) = 1"""
)
def aggregated_settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    day = F.lit("2026-03-01").cast("timestamp")
    small = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderkey < 30").select(
        k.alias("seq"), F.concat(F.lit("R"), k.cast("string")).alias("record_id"), (1000 + k * 137 + k * k * 7).alias("amount_minor"), day.alias("order_date"), F.lit("EXCEPTION").alias("outcome"), F.lit(None).cast("string").alias("matched_payment_id")
    )
    groups = [(0, (3, 11), 0), (1, (5, 17, 23), 0), (2, (20, 29), 1)]
    total = lambda members: F.sum(F.when(F.col("seq").isin(*members), F.col("amount_minor")))
    sums = small.agg(F.array(*[F.struct(F.lit(n).cast("bigint").alias("pop_seq"), F.lit(f"sum_{n}").alias("payment_id"), (total(m) + extra).alias("gross_amount_minor")) for n, m, extra in groups]).alias("s")).select(F.explode("s").alias("s")).select("s.*", day.alias("order_date"))
    return claims.aggregated_settlements(small, sums, Policy()).select("payment_id", F.array_join("members", ",").alias("members"))


# All orders, dealt into batches of thirty keys; each batch has three such settlements.

_DEALT = "SELECT o_orderkey AS seq, o_orderkey // 30 AS batch, o_orderkey % 30 AS place, 'R' || CAST(o_orderkey AS VARCHAR) AS record_id, CAST(round(o_totalprice * 100) AS BIGINT) AS amount_minor FROM orders"
_DEALT_SUMS = """SELECT batch * 3 + n AS pop_seq, batch, 'sum_' || CAST(batch * 3 + n AS VARCHAR) AS payment_id, sum(amount_minor) + CASE n WHEN 2 THEN 1 ELSE 0 END AS gross
    FROM (SELECT *, CASE WHEN place IN (3, 11) THEN 0 WHEN place IN (5, 17, 23) THEN 1 WHEN place IN (20, 29) THEN 2 END AS n FROM small) WHERE n IS NOT NULL GROUP BY batch, n"""


@query(
    f"""WITH small AS ({_DEALT}), sums AS ({_DEALT_SUMS}), combos AS (
        SELECT a.batch, a.record_id || ',' || b.record_id AS members, a.amount_minor + b.amount_minor AS total, greatest(a.amount_minor, b.amount_minor) AS top FROM small a JOIN small b ON a.batch = b.batch AND a.seq < b.seq
        UNION ALL SELECT a.batch, a.record_id || ',' || b.record_id || ',' || c.record_id, a.amount_minor + b.amount_minor + c.amount_minor, greatest(a.amount_minor, b.amount_minor, c.amount_minor)
        FROM small a JOIN small b ON a.batch = b.batch AND a.seq < b.seq JOIN small c ON b.batch = c.batch AND b.seq < c.seq)
        SELECT payment_id, min(members) AS members FROM sums s JOIN combos c ON s.batch = c.batch AND abs(total - gross) <= 2 AND top < gross GROUP BY payment_id HAVING count(*) = 1"""
)
def aggregated_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    day = F.lit("2026-03-01").cast("timestamp")
    small = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k.alias("seq"), F.floor(k / 30).alias("batch"), (k % 30).alias("place"), F.concat(F.lit("R"), k.cast("string")).alias("record_id"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("amount_minor"),
        day.alias("order_date"), F.lit("EXCEPTION").alias("outcome"), F.lit(None).cast("string").alias("matched_payment_id"),
    )
    n = F.when(F.col("place").isin(3, 11), 0).when(F.col("place").isin(5, 17, 23), 1).when(F.col("place").isin(20, 29), 2)
    sums = small.withColumn("n", n).filter("n IS NOT NULL").groupBy("batch", "n").agg((F.sum("amount_minor") + F.when(F.col("n") == 2, 1).otherwise(0)).alias("gross_amount_minor"))
    sums = sums.withColumn("pop_seq", F.col("batch") * 3 + F.col("n")).select("batch", "pop_seq", F.concat(F.lit("sum_"), F.col("pop_seq").cast("string")).alias("payment_id"), "gross_amount_minor", day.alias("order_date"))
    return claims.aggregated_settlements(small, sums, Policy(), batch="batch").select("payment_id", F.array_join("members", ",").alias("members"))


# Reading and mapping exports.

_AMOUNT_TEXT = "CASE o_orderkey % 6 WHEN 0 THEN CAST(CAST(o_totalprice AS BIGINT) AS {0}) || '.50' WHEN 1 THEN '₹' || CAST(CAST(o_totalprice AS BIGINT) AS {0}) WHEN 2 THEN '(' || CAST(CAST(o_totalprice AS BIGINT) AS {0}) || '.25)' WHEN 3 THEN '-' || CAST(CAST(o_totalprice AS BIGINT) AS {0}) WHEN 4 THEN 'n/a' ELSE CAST(o_orderkey AS {0}) || ',000.75 Cr' END"


@query(f"SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(o_totalprice AS BIGINT) + 0.5::DOUBLE WHEN 1 THEN CAST(o_totalprice AS BIGINT)::DOUBLE WHEN 2 THEN -(CAST(o_totalprice AS BIGINT) + 0.25::DOUBLE) WHEN 3 THEN -(CAST(o_totalprice AS BIGINT)::DOUBLE) WHEN 4 THEN NULL ELSE o_orderkey * 1000 + 0.75::DOUBLE END AS amount FROM orders")
def parse_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Spark casts doubles to integers by cutting off, DuckDB by rounding, so the whole part is rounded in both.
    shown = _AMOUNT_TEXT.format("STRING").replace("CAST(o_totalprice AS BIGINT)", "CAST(rint(o_totalprice) AS BIGINT)")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    return orders.select("o_orderkey", values.parse_amount(F.expr(shown)).alias("amount"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 7 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS parsed FROM orders")
def parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    layouts = ["yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "d/M/yyyy", "dd-MMM-yyyy", "MMM dd, yyyy", "yyyy-MM-dd HH:mm:ss"]
    shown = F.when(F.col("o_orderkey") % 8 == 7, F.lit("last tuesday"))
    for k, layout in enumerate(layouts):
        shown = shown.when(F.col("o_orderkey") % 8 == k, F.date_format("o_orderdate", layout))
    # The text is made once, by a generator, instead of inside each of the layouts' tries.
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.inline(F.array(F.struct(shown.alias("shown")))))
    return orders.select("o_orderkey", values.parse_date(F.col("shown")).alias("parsed"))


_ORDERS_FILE = Detected(
    ["order_id", "invoice_ref", "amount", "currency", "order_date", "description", "status", "refund_amount"],
    {"transaction_id": "order_id", "reference": "invoice_ref", "amount": "amount", "currency": "currency", "date": "order_date", "description": "description", "status": "status", "refund_amount": "refund_amount"}, {}, {}, "major",
)


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a raw export: all text, some rows broken."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.concat(F.lit("O-"), k.cast("string")).alias("order_id"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("INV/"), k.cast("string"))).alias("invoice_ref"),
        F.when(k % 11 == 0, "n/a").otherwise(F.format_string("%.2f", price)).alias("amount"), F.when(k % 3 == 0, "usd").otherwise("").alias("currency"), F.when(k % 13 == 0, "soon").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("order_date"),
        F.lower("o_orderpriority").alias("description"), F.when(k % 7 == 0, "Reversed").when(k % 7 == 1, "PAID").otherwise("odd").alias("status"), F.when(k % 17 == 0, "10.00").otherwise("").alias("refund_amount"), (k + 1).alias("_row"),
    )


_MAPPED = """SELECT 'O-' || CAST(o_orderkey AS VARCHAR) AS order_id, CASE WHEN o_orderkey % 5 = 0 THEN 'O-' || CAST(o_orderkey AS VARCHAR) ELSE 'INV/' || CAST(o_orderkey AS VARCHAR) END AS reference_id, CAST(round_even(o_totalprice * 100, 0) AS BIGINT) AS amount_minor,
    CASE WHEN o_orderkey % 3 = 0 THEN 'USD' ELSE 'INR' END AS currency, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS order_date, CASE WHEN o_orderkey % 7 = 0 THEN 'refunded' WHEN o_orderkey % 17 = 0 THEN 'partially_refunded' ELSE 'captured' END AS status,
    CASE WHEN o_orderkey % 17 = 0 THEN 1000 ELSE 0 END::BIGINT AS refund_amount_minor, lower(o_orderpriority) AS description FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0"""


@query(_MAPPED)
def map_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_rows(_rendered(spark, sf_dir), _ORDERS_FILE, "ORDERS", "src").records.drop("provenance")


@query("SELECT o_orderkey + 1 AS row, o_orderkey + 2 AS file_row, CASE WHEN o_orderkey % 11 = 0 THEN 'amount is missing or not a number' ELSE 'date is missing or not readable' END AS error FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0")
def map_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_rows(_rendered(spark, sf_dir), _ORDERS_FILE, "ORDERS", "src").rejected.select("row", "file_row", "error")


@query(f"WITH m AS ({_MAPPED}) SELECT order_id AS payment_id, reference_id AS order_reference, amount_minor AS gross_amount_minor, refund_amount_minor, amount_minor - refund_amount_minor AS net_amount_minor, CASE status WHEN 'captured' THEN 'settled' ELSE status END AS status, order_date AS settlement_date FROM m")
def map_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_rows(_rendered(spark, sf_dir), _ORDERS_FILE, "PAYMENT_GATEWAY", "src").records.select("payment_id", "order_reference", "gross_amount_minor", "refund_amount_minor", "net_amount_minor", "status", "settlement_date")


@query("SELECT count(*) AS n_rows, CAST(min(CAST(o_orderdate AS DATE)) FILTER (o_orderkey % 13 <> 0) AS VARCHAR) AS first_day, CAST(max(CAST(o_orderdate AS DATE)) FILTER (o_orderkey % 13 <> 0) AS VARCHAR) AS last_day, round(min(o_totalprice) FILTER (o_orderkey % 11 <> 0), 2) AS least, round(max(o_totalprice) FILTER (o_orderkey % 11 <> 0), 2) AS greatest, 'USD' AS currencies FROM orders")
def range_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.ranges(_rendered(spark, sf_dir), _ORDERS_FILE).withColumns({"first_day": F.col("first_day").cast("string"), "last_day": F.col("last_day").cast("string"), "least": F.round("least", 2), "greatest": F.round("greatest", 2)})


@query()
def header_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical field and column of the rendered export, detected from its head (the first 50 rows of the file are the feature)."""
    rows = _rendered(spark, sf_dir)
    found = detect(rows.drop("_row").columns, classify.first_rows(rows, 50))
    return spark.createDataFrame([(k, v, float(found.confidence[v])) for k, v in sorted(found.mapping.items())], "canonical string, column string, confidence double")


@query()
def classify_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rendered(spark, sf_dir)
    sample = classify.first_rows(rows, classify.VALUE_ROWS)
    found = classify.classify("web_orders.csv", detect(rows.drop("_row").columns, sample), sample)
    return spark.createDataFrame([(k, round(v, 6), found.source_type, round(found.confidence, 6), found.stage) for k, v in found.scores.items()], "type string, score double, source_type string, confidence double, stage string")


# Source plans, over five planted sources.

_SOURCES = [
    ("s1", "orders.csv", "ORDERS", "ORDERS", "LEDGER", 15000, False, [], "h1", ["A1", "A2", "A3"]), ("s2", "payouts.csv", "SETTLEMENT", "PAYMENT_GATEWAY", "SETTLEMENT", 14000, False, [], "h2", ["A2", "A3", "P9"]),
    ("s3", "bank.csv", "BANK", "BANK_STATEMENT", "SETTLEMENT", 900, True, ["date"], "h3", ["P9", "U1"]), ("s4", "bank_copy.xlsx", "BANK", "BANK_STATEMENT", "SETTLEMENT", 900, False, [], "h3", ["P9", "U1"]),
    ("s5", "books.csv", "ACCOUNTING", "ACCOUNTING", "LEDGER", 15000, False, [], "h5", ["U1"]),
]


def _sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_SOURCES, "source_id string, filename string, stage string, source_type string, role string, n_rows bigint, needs_confirmation boolean, missing array<string>, content_hash string, identifiers array<string>")


@query("SELECT * FROM (VALUES ('s1', 's2', 2), ('s2', 's3', 1), ('s2', 's4', 1), ('s3', 's5', 1), ('s4', 's5', 1)) t(left_id, right_id, shared)")
def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.relationships(_sources(spark))


@query("SELECT * FROM (VALUES ('UNMAPPED_REQUIRED', 'bank.csv'), ('UNCONFIRMED_ROLE', 'bank.csv')) t(code, subject)")
def plan_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.blockers(_sources(spark))


@query(_final("SELECT s.stage, s.files, s.n_rows, coalesce(r.records, 0) AS records, coalesce(r.reconciled, 0) AS reconciled FROM (VALUES ('ORDERS', 1::BIGINT, 15000::BIGINT), ('SETTLEMENT', 1, 14000), ('BANK', 2, 1800), ('ACCOUNTING', 1, 15000)) s(stage, files, n_rows) LEFT JOIN (SELECT CASE WHEN seq % 4 = 0 THEN 'ACCOUNTING' ELSE 'ORDERS' END AS stage, count(*) AS records, count(*) FILTER (outcome = 'RECONCILED') AS reconciled FROM final GROUP BY 1) r USING (stage)"))
def stage_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir).withColumn("source_id", F.when(F.col("seq") % 4 == 0, "s5").otherwise("s1"))
    return plan.stage_coverage(rows, _sources(spark))


# Audit log over the events.


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("order"), F.col("ts").cast("string").alias("timestamp"), F.col("user_id").cast("string").alias("transaction_id"), F.upper("event_type").alias("event_type"), F.lit("").alias("prior_state"),
        F.lit("").alias("new_state"), F.lit("").alias("evidence_ref"), F.to_json(F.struct(F.col("value").cast("string").alias("value"))).alias("payload_json"),
    )
    return once("audit", spark, sf_dir, lambda: audit.append(events), "events")


@query("SELECT CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS reason WHERE false")
def audit_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The untouched log has no break."""
    return audit.verify(_log(spark, sf_dir))


@query("SELECT * FROM (VALUES (100::BIGINT, 'content was changed')) t(seq, reason)")
def audit_tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One changed payload is one break, at its own row."""
    log = _log(spark, sf_dir)
    return audit.verify(log.withColumn("payload_json", F.when(F.col("seq") == 100, '{"value":"0"}').otherwise(F.col("payload_json"))))


@query("SELECT CAST(event_id + 1 AS BIGINT) AS seq, CAST(user_id AS VARCHAR) AS transaction_id, upper(event_type) AS event_type FROM events WHERE event_id + 1 > 1000 ORDER BY event_id LIMIT 500")
def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.page(_log(spark, sf_dir), 1000).select("seq", "transaction_id", "event_type")


@query("SELECT count(*) AS head_seq, count(*) AS total_events FROM events")
def audit_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.head(_log(spark, sf_dir)).select("head_seq", "total_events")


# Metrics: what each planted case should come to.

_EXPECTED = "CASE WHEN case_name IN ('clean', 'reformatted', 'duplicate_one_amount', 'refund_both') THEN 'RECONCILED' WHEN case_name IN ('duplicate_same_amount', 'bank_full_text', 'bank_close_text', 'claimed_twice', 'second_claim') THEN 'HUMAN_REVIEW' ELSE 'EXCEPTION' END"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).withColumn("expected", F.expr(_EXPECTED))


_R = "round(coalesce({0}::DOUBLE / nullif({1}, 0), 0), 6)"
_N = "count(*)"


def _share(part: str, whole: str = _N) -> str:
    return _R.format(part, whole)


_EVALUATION = (
        "count(*) AS record_count, " + _share("count(*) FILTER (outcome = expected)") + " AS accuracy, " + _share("count(*) FILTER (outcome = 'EXCEPTION' AND expected = 'EXCEPTION')", "count(*) FILTER (outcome = 'EXCEPTION')") + " AS exception_precision, "
        + _share("count(*) FILTER (outcome = 'EXCEPTION' AND expected = 'EXCEPTION')", "count(*) FILTER (expected = 'EXCEPTION')") + " AS exception_recall, " + _share("count(*) FILTER (outcome = 'RECONCILED' AND expected <> 'RECONCILED')", "count(*) FILTER (outcome = 'RECONCILED')") + " AS false_auto_reconciliation, "
        + _share("count(*) FILTER (outcome = 'EXCEPTION' AND expected = 'RECONCILED')", "count(*) FILTER (expected = 'RECONCILED')") + " AS false_exception, " + ", ".join(_share(f"count(*) FILTER (outcome = '{o}')") + f" AS share_{o.lower()}" for o in metrics.OUTCOMES)
        + ", " + _share("count(*) FILTER (ai_calls > 0)") + " AS semantic_rate, sum(ai_calls)::BIGINT AS ai_calls_total, " + _share("sum(ai_calls) * 1000") + " AS ai_calls_per_1000, 0::BIGINT AS provider_errors"
)


@query(_final(f"SELECT {_EVALUATION} FROM labelled", labelled=f"SELECT *, {_EXPECTED} AS expected FROM final"))
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.evaluation(_labelled(spark, sf_dir))


@query(_final("SELECT case_name, count(*) FILTER (outcome = 'RECONCILED') AS reconciled, count(*) FILTER (outcome = 'EXCEPTION') AS exception, count(*) FILTER (outcome = 'HUMAN_REVIEW') AS human_review FROM final GROUP BY case_name"))
def confusion_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_by_case(results(spark, sf_dir))


@query("SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max FROM events")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.percentiles(spark.read.parquet(f"{sf_dir}/events.parquet"), "value")


TIERS = {"exact": Policy(enable_fuzzy_matching=False), "corroborated": Policy(enable_semantic_matching=False), "all": Policy()}
#: What the verifier settles goes unmatched without it; what the search settles, without the search.
_UNDER_TIERS = """SELECT 'all' AS policy, record_id, case_name, ai_calls, outcome FROM decided
    UNION ALL SELECT 'corroborated', record_id, case_name, 0, CASE WHEN classification IN ('SEMANTIC_CONFIRMED', 'SEMANTIC_UNRESOLVED', 'PROVIDER_ERROR') THEN 'EXCEPTION' ELSE outcome END FROM decided
    UNION ALL SELECT 'exact', record_id, case_name, 0, CASE WHEN n_exact = 0 THEN 'EXCEPTION' ELSE outcome END FROM decided"""


@query(
    chain.sql(
        "decided",
        "SELECT policy, case_name, count(*) AS n, " + _R.format("count(*) FILTER (expected = 'RECONCILED' AND outcome = 'RECONCILED')", "count(*) FILTER (expected = 'RECONCILED')") + " AS recall, "
        + _R.format("count(*) FILTER (expected <> 'RECONCILED' AND outcome <> 'RECONCILED')", "count(*) FILTER (expected <> 'RECONCILED')") + " AS correct_rejection, count(*) FILTER (expected <> 'RECONCILED' AND outcome = 'RECONCILED') AS wrong_matches,"
        " count(*) FILTER (outcome = 'HUMAN_REVIEW') AS to_person FROM labelled GROUP BY policy, case_name",
        under=_UNDER_TIERS, labelled=f"SELECT *, {_EXPECTED} AS expected FROM under",
    )
)
def policy_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, rejections and wrong matches of three policies, by the case that each record was made for."""
    rows = once("under_tiers", spark, sf_dir, lambda: decisions.decide_under(prepared(spark, sf_dir), TIERS)).withColumn("expected", F.expr(_EXPECTED))
    return metrics.by_variation(rows, "policy", "case_name")


@query(chain.sql("decided", f"SELECT policy AS tier, {_EVALUATION} FROM labelled GROUP BY policy", under=_UNDER_TIERS, labelled=f"SELECT *, {_EXPECTED} AS expected FROM under"))
def tier_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact tier alone, without the verifier, and all tiers, over the same records, whose candidates are searched for once."""
    rows = once("under_tiers", spark, sf_dir, lambda: decisions.decide_under(prepared(spark, sf_dir), TIERS)).withColumn("expected", F.expr(_EXPECTED))
    return metrics.tier_ablation({name: rows.filter(F.col("policy") == name).drop("policy") for name in TIERS})


# Text functions on the corpus tables.


_SCRUBBED = "text"
for _pattern in text.CREDENTIALS:
    _SCRUBBED = f"regexp_replace({_SCRUBBED}, '{_pattern}', '<redacted>', 'g')"


@query(f"SELECT conv_id, turn, md5({_SCRUBBED}) AS scrubbed_md5 FROM conversations")
def scrub_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select("conv_id", "turn", F.md5(text.scrub_secrets(F.col("text"))).alias("scrubbed_md5"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '-' ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN '₹' ELSE 'USD ' END || format('{:,}', CAST(round(o_totalprice * 100) AS BIGINT) // 100) || '.' || lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS shown FROM orders")
def money_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    minor = F.round(F.col("o_totalprice") * 100).cast("bigint") * F.when(k % 4 == 0, -1).otherwise(1)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", values.money(minor, F.when(k % 2 == 0, "INR").otherwise("usd")).alias("shown"))


# Streams, run to their end over the events.


@query("SELECT date_trunc('day', CAST(ts AS TIMESTAMP)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by type of the events, read as a stream, the last day included."""
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = streams.tail(spark, f"{sf_dir}/events.parquet*", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in batch.schema)).withColumn("ts", F.col("ts").cast("timestamp"))
    folder = f"{shared_dir(spark)}/ledgerlane/stream-{uuid.uuid4().hex}"
    streams.write_changes(streams.event_counts(events), f"{folder}/out", f"{folder}/log").awaitTermination()
    groups = streams.current_groups(spark, f"{folder}/out", ["start", "event_type"], "start timestamp, event_type string, n bigint, total double")
    return groups.withColumn("total", F.round("total", 4))

