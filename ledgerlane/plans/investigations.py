"""Queries of the investigator's searches, of stored pages and exports, and of single functions on whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import investigation, metrics, review, trace
from ..schemas import CANDIDATE, CHECK
from ..scratch import shared_dir
from ..sinks import store
from ..sources import mapping
from ..streaming import streams
from . import chain
from .population import populations
from .queries import POLICY, once, query, results
from .records import _RUNS, _final, stored

# Every order as a record, in batches of 200, of which one in five is matched to nothing. Of twenty records the 18th pays
# into a lump with the 19th (gross, or with fee and tax off, or with the 20th too), and the 20th is mostly paid out in
# parts. In some batches the 17th has the 19th's amount, so that a lump has two readings, and some have more unclaimed
# settlements than a search may look at. The same text serves Spark and DuckDB but for integer division and type names.
_G_BASE = """
SELECT k, k {div} 200 AS batch, k % 20 AS place, k {div} 20 AS turn, amount, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST((k * 37) % 977 AS INTEGER) AS moment
FROM (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS amount FROM orders) o
"""
_G_RECORDS = """
SELECT b.k AS seq, 'R' || CAST(b.k AS {string}) AS record_id, b.batch AS batch, CASE WHEN b.place = 16 AND b.turn % 9 = 3 THEN coalesce(t.amount, b.amount) ELSE b.amount END AS amount_minor, b.moment AS order_date,
       CASE WHEN b.place < 16 THEN 'own_' || CAST(b.k AS {string}) END AS matched_payment_id, CASE WHEN b.place < 16 THEN 'RECONCILED' ELSE 'EXCEPTION' END AS outcome
FROM base b LEFT JOIN base t ON t.k = b.k + 2
"""
_G_SETTLED = """
SELECT k * 10 + 5 AS pop_seq, 'own_' || CAST(k AS {string}) AS payment_id, batch, amount AS gross_amount_minor, 0 AS fee_minor, 0 AS tax_minor, moment AS order_date FROM base WHERE place < 16
UNION ALL
SELECT a.k * 10, 'lump_' || CAST(a.k AS {string}), a.batch, a.amount + b.amount + CASE a.turn % 3 WHEN 1 THEN -590 WHEN 2 THEN c.amount ELSE 0 END, CASE a.turn % 3 WHEN 1 THEN 500 ELSE 0 END, CASE a.turn % 3 WHEN 1 THEN 90 ELSE 0 END, a.moment + INTERVAL '30' HOUR
FROM base a JOIN base b ON b.k = a.k + 1 JOIN base c ON c.k = a.k + 2 WHERE a.place = 17
UNION ALL
SELECT k * 10 + part, 'part_' || CAST(k AS {string}) || '_' || CAST(part AS {string}), batch,
       CASE part WHEN 1 THEN amount {div} 3 WHEN 2 THEN CASE turn % 3 WHEN 1 THEN amount {div} 5 ELSE amount - amount {div} 3 END ELSE amount - amount {div} 3 - amount {div} 5 END, 0, 0, moment + INTERVAL '6' HOUR
FROM base CROSS JOIN (SELECT 1 AS part UNION ALL SELECT 2 UNION ALL SELECT 3) parts WHERE place = 19 AND turn % 3 < 2 AND (part < 3 OR turn % 3 = 1)
UNION ALL
SELECT k * 10 + 6, 'extra_' || CAST(k AS {string}), batch, amount + 17, 0, 0, moment FROM base WHERE place < 10 AND batch % 7 = 5
"""
_SPARK = {"string": "STRING", "div": "div"}
_DUCK = {"string": "VARCHAR", "div": "//"}


def _grouped_population(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    base = spark.sql(_G_BASE.format(**_SPARK).replace("FROM orders", "FROM {orders}"), orders=orders)
    records = spark.sql(_G_RECORDS.format(**_SPARK).replace("base b", "{base} b").replace("base t", "{base} t"), base=base)
    made = _G_SETTLED.format(**_SPARK)
    for name in ("a", "b", "c"):
        made = made.replace(f"base {name} ", f"{{base}} {name} ")
    settled = spark.sql(made.replace("FROM base WHERE", "FROM {base} WHERE").replace("FROM base CROSS", "FROM {base} CROSS"), base=base)
    settled = settled.withColumns({c: F.col(c).cast("bigint") for c in ("fee_minor", "tax_minor", "gross_amount_minor")})
    more = {
        "classification": F.when(F.col("matched_payment_id").isNull(), "NO_ADMISSIBLE_CANDIDATE").otherwise("EXACT_REFERENCE"), "exception_type": F.when(F.col("matched_payment_id").isNull(), "MISSING_SETTLEMENT"),
        "considered_candidates": F.array().cast(f"array<{CANDIDATE}>"), "checks": F.array().cast(f"array<{CHECK}>"), "refund_amount_minor": F.lit(0).cast("bigint"),
    }
    return records.withColumns(more), settled


_near = chain.days("r.order_date", "{0}.order_date") + f" <= {POLICY.candidate_search_window_days}"
_FITS = f"<= {POLICY.amount_tolerance_minor}"
_STEPS = {
    "base": _G_BASE.format(**_DUCK), "res": _G_RECORDS.format(**_DUCK), "setl": _G_SETTLED.format(**_DUCK),
    "rec": "SELECT * FROM res WHERE matched_payment_id IS NULL",
    "free": "SELECT * FROM setl s WHERE NOT EXISTS (SELECT 1 FROM res c WHERE c.batch = s.batch AND c.matched_payment_id = s.payment_id)",
    "near": f"SELECT r.seq, r.amount_minor, s.pop_seq, s.payment_id, s.gross_amount_minor AS gross, s.fee_minor AS fee, s.tax_minor AS tax, count(*) OVER (PARTITION BY r.seq) AS n, r.record_id FROM rec r JOIN free s ON s.batch = r.batch AND {_near.format('s')}",
    "un": f"SELECT * FROM near WHERE n <= {investigation.MAX_UNCLAIMED}",
    "pool": f"SELECT * FROM (SELECT r.seq, q.record_id, q.amount_minor AS amount, row_number() OVER (PARTITION BY r.seq ORDER BY q.seq) AS i FROM rec r JOIN rec q ON q.batch = r.batch AND q.seq <> r.seq AND q.amount_minor > 0 AND {_near.format('q')}) WHERE i <= {investigation.MAX_POOL}",
    "sums": "SELECT seq, 1 AS size, i, 0 AS j, amount AS total, record_id AS others FROM pool UNION ALL SELECT a.seq, 2, a.i, b.i, a.amount + b.amount, a.record_id || ',' || b.record_id FROM pool a JOIN pool b ON a.seq = b.seq AND a.i < b.i",
    "targets": "SELECT *, 'GROSS' AS kind, gross AS target FROM un UNION ALL SELECT *, 'NET_OF_FEES', gross + fee + tax FROM un WHERE fee <> 0 OR tax <> 0",
    "hits": f"SELECT t.seq, t.record_id, t.pop_seq, t.payment_id, t.kind, s.size, s.i, s.j, s.others, t.amount_minor + s.total AS member_total, count(*) OVER (PARTITION BY t.seq, t.pop_seq, t.kind) AS ways FROM targets t JOIN sums s ON s.seq = t.seq AND abs(t.amount_minor + s.total - t.target) {_FITS}",
    "grouped": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY pop_seq, kind, size, i, j) AS place FROM hits) WHERE place = 1",
    "parts": f"SELECT * FROM (SELECT seq, amount_minor, payment_id, gross, row_number() OVER (PARTITION BY seq ORDER BY pop_seq) AS i FROM un WHERE gross < amount_minor) WHERE i <= {investigation.MAX_POOL}",
    "splits": f"SELECT a.seq, a.payment_id || ',' || b.payment_id AS ids FROM parts a JOIN parts b ON a.seq = b.seq AND a.i < b.i WHERE abs(a.gross + b.gross - a.amount_minor) {_FITS} UNION ALL SELECT a.seq, a.payment_id || ',' || b.payment_id || ',' || c.payment_id FROM parts a JOIN parts b ON a.seq = b.seq AND a.i < b.i JOIN parts c ON b.seq = c.seq AND b.i < c.i WHERE abs(a.gross + b.gross + c.gross - a.amount_minor) {_FITS}",
    "split": "SELECT seq, min(ids) AS ids FROM splits GROUP BY seq HAVING count(*) = 1",
}


def _with_steps(select: str) -> str:
    return "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in _STEPS.items()) + " " + select


def _grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once("grouping", spark, sf_dir, lambda: investigation.with_grouping(*_grouped_population(spark, sf_dir), POLICY, "batch"))


@query(_with_steps(f"SELECT r.seq, CASE WHEN count(n.pop_seq) > {investigation.MAX_UNCLAIMED} THEN 0 ELSE count(n.pop_seq) END AS n_unclaimed, count(n.pop_seq) > {investigation.MAX_UNCLAIMED} AS too_many FROM rec r LEFT JOIN near n USING (seq) GROUP BY r.seq"))
def unclaimed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = investigation.unclaimed_in_window(*_grouped_population(spark, sf_dir), POLICY, "batch")
    return found.select("seq", F.size("unclaimed").cast("bigint").alias("n_unclaimed"), "too_many")


@query(_with_steps("SELECT seq, payment_id, kind, record_id || ',' || others AS members, member_total::BIGINT AS member_total_minor, ways = 1 AS only_way FROM grouped"))
def sibling_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _grouping(spark, sf_dir).filter("aggregation IS NOT NULL")
    return found.select("seq", "aggregation.payment_id", "aggregation.kind", F.array_join("aggregation.members", ",").alias("members"), "aggregation.member_total_minor", F.col("aggregation.only").alias("only_way"))


@query(_with_steps("SELECT seq, ids FROM split"))
def split_settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouping(spark, sf_dir).filter("split IS NOT NULL").select("seq", F.array_join("split", ",").alias("ids"))


_LABELS = """concat_ws(',', CASE WHEN g.ways = 1 THEN 'AGGREGATED_SETTLEMENT=0.9' END, CASE WHEN g.kind = 'NET_OF_FEES' THEN 'GATEWAY_FEE_DEDUCTION=0.88,TAX_DEDUCTION=0.85' END, CASE WHEN s.seq IS NOT NULL THEN 'SPLIT_SETTLEMENT=0.75' END,
    CASE WHEN r.matched_payment_id IS NULL AND g.seq IS NULL THEN 'MISSING_SETTLEMENT=0.65' END, CASE WHEN g.ways > 1 THEN 'AGGREGATED_SETTLEMENT=0.45' END)"""


@query(_with_steps(f"SELECT r.seq, {_LABELS} AS hypotheses FROM res r LEFT JOIN grouped g USING (seq) LEFT JOIN split s USING (seq)"))
def hypotheses_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hypotheses of every record with its population at hand."""
    made = trace.with_hypotheses(_grouping(spark, sf_dir))
    return made.select("seq", F.array_join(F.transform("hypotheses", lambda h: F.concat(h.label, F.lit("="), h.confidence.cast("string"))), ",").alias("hypotheses"))


@query(_final("SELECT record_id, count(*) OVER (PARTITION BY batch_id, amount_minor) - 1 AS twins FROM stored"))
def amount_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return investigation.with_twins(stored(spark, sf_dir), "batch_id").select("record_id", "twins")


@query(_final("SELECT f.record_id, s.gross_amount_minor, s.fee_minor, s.tax_minor, s.description FROM final f JOIN settlements s ON s.payment_id = f.payment_id"))
def counterparty(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = investigation.with_counterparty(results(spark, sf_dir).filter("matched_payment_id IS NOT NULL"), populations(spark, sf_dir)[1])
    return made.select("record_id", *[f"counterparty.{c}" for c in ("gross_amount_minor", "fee_minor", "tax_minor", "description")])


# Pages, exports and tallies of stored records.

_WORST = "CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END"
_WAITING = "outcome IN ('HUMAN_REVIEW', 'EXCEPTION') AND review_state = 'OPEN'"
_NOW = "2024-01-31 23:00:00"


@query(_final("SELECT seq, record_id, outcome FROM stored WHERE batch_id = 'batch_1' ORDER BY seq LIMIT 200 OFFSET 400"))
def record_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.record_page(stored(spark, sf_dir), "batch_1", 200, 400).select("seq", "record_id", "outcome")


@query(_final(f"SELECT record_id, coalesce(severity, '') AS severity, coalesce(exception_type, '') AS exception_type, outcome, amount_minor, coalesce(payment_id, '') AS matched_payment_id, CASE WHEN ai_calls > 0 THEN 'yes' ELSE 'no' END AS ai_invoked FROM stored WHERE {_WAITING}"))
def review_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.export_queue(stored(spark, sf_dir)).select("record_id", "severity", "exception_type", "outcome", "amount_minor", "matched_payment_id", "ai_invoked")


@query(_final(f"SELECT coalesce(exception_type, 'UNCLASSIFIED') AS exception_type, count(*) AS n, sum(amount_minor)::BIGINT AS amount_minor FROM stored WHERE {_WAITING} GROUP BY 1 ORDER BY n DESC, exception_type LIMIT 3"))
def top_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.top_exceptions(stored(spark, sf_dir))


@query(_final("SELECT record_id FROM stored WHERE contains(lower(concat_ws(' ', record_id, payment_id, exception_type)), 'claim')"))
def record_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.search(stored(spark, sf_dir), "CLAIM", ["record_id", "matched_payment_id", "exception_type"]).select("record_id")


@query(_final("SELECT batch_id, record_id, outcome, payment_id AS matched_payment_id FROM stored"))
def record_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.record_origins(stored(spark, sf_dir))


_BATCHES = f"SELECT *, CASE WHEN status = 'COMPLETED' THEN 'COMPLETED' WHEN total_records = 0 THEN 'DRAFT' WHEN epoch(TIMESTAMP '{_NOW}')::BIGINT - floor(epoch(started_at))::BIGINT > 180 THEN 'INTERRUPTED' ELSE 'RUNNING' END AS state FROM (SELECT run_id AS batch_id, status, total_records, started_at FROM ({_RUNS.format('events')}))"


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_RUNS.format("{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet")).withColumnRenamed("run_id", "batch_id")


@query(f"SELECT batch_id, state FROM (SELECT * FROM ({_BATCHES}) ORDER BY started_at DESC, batch_id LIMIT 20) WHERE state <> 'DRAFT'")
def recent_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.recent_batches(_batches(spark, sf_dir), F.lit(_NOW).cast("timestamp"), drafts=False).select("batch_id", "state")


@query(f"SELECT batch_id, state FROM (SELECT * FROM ({_BATCHES}) ORDER BY started_at DESC, batch_id LIMIT 25) ORDER BY CASE WHEN state <> 'DRAFT' AND total_records > 0 THEN 0 ELSE 1 END, started_at DESC, batch_id LIMIT 1")
def default_review_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.default_review_batch(_batches(spark, sf_dir), F.lit(_NOW).cast("timestamp")).select("batch_id", "state")


# Known truth of the populations' cases.

_TRUTH = "CASE WHEN case_name = 'missing' THEN 'absent' WHEN case_name IN ('duplicate_same_amount', 'claimed_twice', 'second_claim') THEN 'ambiguous' ELSE 'present' END"


@query(_final("SELECT case_name AS category, count(*) AS n FROM final GROUP BY case_name"))
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).groupBy(F.col("case_name").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(
    _final(
        "SELECT truth, count(*) AS n, round(count(*) FILTER (well)::DOUBLE / count(*), 6) AS accuracy, count(*) FILTER (wrong) AS wrong_matches, count(*) FILTER (outcome = 'RECONCILED') AS reconciled, count(*) FILTER (outcome = 'EXCEPTION') AS exception, count(*) FILTER (outcome = 'HUMAN_REVIEW') AS human_review"
        " FROM (SELECT *, CASE truth WHEN 'present' THEN outcome = 'RECONCILED' AND own WHEN 'absent' THEN outcome = 'EXCEPTION' AND coalesce(exception_type, '') = 'MISSING_SETTLEMENT' AND payment_id IS NULL ELSE outcome = 'HUMAN_REVIEW' END AS well,"
        " CASE truth WHEN 'present' THEN outcome = 'RECONCILED' AND NOT own WHEN 'absent' THEN payment_id IS NOT NULL ELSE false END AS wrong FROM truths) GROUP BY truth",
        truths=f"SELECT *, {_TRUTH} AS truth, coalesce(payment_id, '') = 'pay_' || CAST(seq AS VARCHAR) || '_a' AS own FROM final",
    )
)
def presence_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.concat(F.lit("pay_"), F.col("seq").cast("string"), F.lit("_a"))
    return metrics.presence(results(spark, sf_dir).withColumns({"truth": F.expr(_TRUTH), "true_payment_id": own}), "truth")


# Single functions on whole tables.


@query(f"SELECT a.doc_id, round(CASE WHEN len(list_distinct(list_concat(a.t, b.t))) = 0 THEN 1.0 ELSE len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) END, 6) AS similarity FROM (SELECT doc_id, {chain.tokens('text')} AS t FROM documents) a JOIN (SELECT doc_id, {chain.tokens('text')} AS t FROM documents) b ON b.doc_id = a.doc_id + 1")
def jaccard_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token Jaccard of each document with the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.token_set(F.col("text")).alias("t"))
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    return docs.join(following, "doc_id").select("doc_id", F.round(text.jaccard(F.col("t"), F.col("u")), 6).alias("similarity"))


@query("SELECT source, CASE WHEN source % 4 IN (0, 3) THEN 'major' ELSE 'minor' END AS scale FROM (SELECT DISTINCT o_orderkey % 8 AS source FROM orders)")
def amount_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scale of eight exports: amounts with points, whole ones, ones with points after the first fifty only, and words."""
    k, whole = F.col("o_orderkey"), F.floor("o_totalprice").cast("string")
    shown = F.when(k % 4 == 0, F.concat(whole, F.lit(".50"))).when(k % 4 == 1, whole).when(k % 4 == 2, F.when(k < 400, whole).otherwise(F.concat(whole, F.lit(".50")))).otherwise("on request")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select((k % 8).alias("source"), k.alias("row"), shown.alias("amount"))
    return mapping.amount_scales(rows, "source", "row", "amount")


_WORDS = ("Paid", " SUCCESS ", "reversed", "Partial_Refund", "settled", "credited", "authorized", "unheard of", "")
_SAID = "CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_WORDS)) + " END"


@query(
    "SELECT o_orderkey, CASE o_orderkey % 10 WHEN 2 THEN 'refunded' WHEN 3 THEN 'partially_refunded' ELSE 'captured' END AS ledger_status, CASE o_orderkey % 10 WHEN 2 THEN 'refunded' WHEN 3 THEN 'partially_refunded' ELSE 'settled' END AS settlement_status FROM orders"
)
def status_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr(_SAID)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", mapping.normalize_status(said, "LEDGER").alias("ledger_status"), mapping.normalize_status(said, "SETTLEMENT").alias("settlement_status"))


@query(_final("SELECT record_id, outcome, 'OPEN' AS review_state FROM final"))
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions streamed into a store twice over: the second run changes nothing."""
    folder = f"{shared_dir(spark)}/ledgerlane/upsert-{uuid.uuid4().hex}"
    results(spark, sf_dir).write.parquet(f"{folder}/in")
    schema = spark.read.parquet(f"{folder}/in").schema
    for turn in range(2):
        rows = spark.readStream.schema(schema).parquet(f"{folder}/in")
        streams.upsert_decisions(rows, f"{folder}/store", "b1", f"{folder}/log{turn}").awaitTermination()
    return store.read_records(spark, f"{folder}/store", "b1").select("record_id", "outcome", "review_state")
