"""The queries of the reconciliation, by operator, and the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, values
from ..operators import blocking, claims, decisions, scoring, similarity
from ..operators.verdicts import HeuristicVerifier
from ..schemas import Policy
from ..sinks import reuse
from . import chain
from .population import populations

Query = Callable[[SparkSession, str], DataFrame]
POLICY = Policy()
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def once(name: str, spark: SparkSession, sf_dir: str, make: Callable[[], DataFrame], source: str = "orders") -> DataFrame:
    """A table that several queries start from: written once per application and content of the source table."""
    return reuse.table(name, [spark.read.parquet(f"{sf_dir}/{source}.parquet")], make, spark.sparkContext.applicationId)


def prepared(spark: SparkSession, sf_dir: str) -> decisions.Prepared:
    return decisions.prepare(*populations(spark, sf_dir))


def unresolved(data: decisions.Prepared) -> DataFrame:
    """Ledger rows without any exact hit: only they are searched for."""
    return data.ledger.join(blocking.exact_hits(data.ledger, data.settlements).select("seq").distinct(), "seq", "left_anti")


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = prepared(spark, sf_dir)
    return once("listed", spark, sf_dir, lambda: decisions.scored_shortlist(data, unresolved(data), POLICY))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once("decided", spark, sf_dir, lambda: decisions.decide(prepared(spark, sf_dir), POLICY))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions after the batch's passes: a table and two small ones that it is joined to, so a query only reads what it needs."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    keys = [reuse.content_key(orders)]
    keep = lambda rows, name: reuse.table(name, [orders], rows if callable(rows) else lambda: rows, spark.sparkContext.applicationId, keys=keys)
    settled = populations(spark, sf_dir)[1]
    return claims.process_batch(keep(lambda: decisions.decide(prepared(spark, sf_dir), POLICY), "decided"), settled, POLICY, keep)


# Exact tier, end to end without the search.


@query(
    chain.sql(
        "exact",
        "SELECT classification, outcome, count(*) AS n FROM (SELECT CASE WHEN x.seq IS NULL THEN 'NO_CANDIDATES' WHEN n_exact = 1 THEN 'EXACT_REFERENCE' WHEN n_within = 1 THEN 'DISAMBIGUATED_BY_AMOUNT' ELSE 'AMBIGUOUS_MULTIPLE' END AS classification,"
        " CASE WHEN x.seq IS NULL THEN 'EXCEPTION' WHEN n_exact > 1 AND n_within <> 1 THEN 'HUMAN_REVIEW' WHEN upper(l.currency) = upper(s.currency) AND abs(l.amount_minor - s.gross_amount_minor) <= 2 AND abs(s.net_amount_minor - (s.gross_amount_minor - s.fee_minor - s.tax_minor - s.refund_amount_minor)) <= 2"
        f" AND {chain.days('s.order_date', 's.settlement_date')} <= 21 AND (l.status IN ('refunded', 'partially_refunded')) = (s.refund_amount_minor > 0) AND abs(l.refund_amount_minor - s.refund_amount_minor) <= 2 THEN 'RECONCILED' ELSE 'EXCEPTION' END AS outcome"
        " FROM ledger l LEFT JOIN exact x USING (seq) LEFT JOIN settlements s ON s.pop_seq = CASE WHEN n_exact = 1 THEN only_hit WHEN n_within = 1 THEN within_hit END) GROUP BY classification, outcome",
    )
)
def flagship_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders reconcile by reference alone, and what becomes of the rest (the search switched off; nothing pending)."""
    exact_only = Policy(enable_fuzzy_matching=False, settlement_expected_days=-100_000)
    found = decisions.decide(prepared(spark, sf_dir), exact_only)
    return found.groupBy("classification", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query(chain.sql("exact", "SELECT seq, n_exact, n_within, CASE WHEN n_exact = 1 THEN only_hit WHEN n_within = 1 THEN within_hit END AS exact_pop_seq FROM exact"))
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = prepared(spark, sf_dir)
    return blocking.exact_summary(data.ledger, data.settlements, POLICY)


@query(chain.sql("exact", "SELECT seq, within_hit AS exact_pop_seq FROM exact WHERE n_exact > 1 AND n_within = 1"))
def disambiguate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_match(spark, sf_dir).filter("n_exact > 1 AND n_within = 1").select("seq", "exact_pop_seq")


# Functions, over the populations.


@query(chain.sql("lp", "SELECT seq, ref_norm, array_to_string(list_sort(cores), ',') AS cores, array_to_string(list_sort(tokens), ',') AS tokens FROM lp"))
def normalize_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    join = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return prepared(spark, sf_dir).ledger.select("seq", "ref_norm", join("cores"), join("tokens"))


@query(chain.sql("sp", "SELECT pop_seq, ref_norm, array_to_string(list_sort(cores), ',') AS cores, array_to_string(list_sort(ref_cores), ',') AS ref_cores FROM sp"))
def reference_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    join = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return prepared(spark, sf_dir).settlements.select("pop_seq", "ref_norm", join("cores"), join("ref_cores"))


@query(f"SELECT doc_id, len({chain.tokens('text')}) AS n_tokens, md5(array_to_string(list_sort({chain.tokens('text')}), ' ')) AS tokens_md5 FROM documents")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.token_set(F.col("text"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.size(found).cast("bigint").alias("n_tokens"), F.md5(F.array_join(F.array_sort(found), " ")).alias("tokens_md5"))


@query(f"SELECT event_id, {chain.days('ts', chr(39) + '2024-01-15 12:00:00' + chr(39) + '::TIMESTAMP')} AS days_apart FROM events")
def days_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", values.days_between(F.col("ts").cast("timestamp"), F.lit("2024-01-15 12:00:00").cast("timestamp")).alias("days_apart"))


@query(chain.sql("sp", "SELECT l.seq, bool_and(l.amount_minor <= 0 OR s.gross_amount_minor / l.amount_minor::DOUBLE BETWEEN 0.5 AND 2.0) AS plausible FROM lp l JOIN sp s ON s.pop_seq = (l.seq + 7) * 2 GROUP BY l.seq"))
def amount_plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = prepared(spark, sf_dir)
    pairs = data.ledger.select("seq", "amount_minor", ((F.col("seq") + 7) * 2).alias("pop_seq")).join(data.settlements.select("pop_seq", "gross_amount_minor"), "pop_seq")
    return pairs.select("seq", values.amount_plausible(F.col("amount_minor"), F.col("gross_amount_minor")).alias("plausible"))


# Candidate search.


def _hits(make: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = prepared(spark, sf_dir)
        return make(unresolved(data), data.settlements)

    return run


@query(chain.sql("amount_hits", "SELECT seq, pop_seq FROM amount_hits"))
def block_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(blocking.amount_candidates)(spark, sf_dir)


@query(chain.sql("core_hits", "SELECT seq, pop_seq FROM core_hits"))
def block_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(blocking.core_candidates)(spark, sf_dir)


@query(chain.sql("window_hits", "SELECT seq, pop_seq, place::INTEGER AS place FROM window_hits"))
def block_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(lambda a, b: blocking.window_candidates(a, b, POLICY))(spark, sf_dir)


@query(chain.sql("pool", "SELECT source::INTEGER AS source, has_core, count(*) AS n, sum(pop_seq)::BIGINT AS pop_sum, sum(place)::BIGINT AS place_sum FROM pool GROUP BY source, has_core"))
def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _hits(lambda a, b: blocking.candidate_pool(a, b, POLICY))(spark, sf_dir)
    return pool.groupBy("source", "has_core").agg(F.count(F.lit(1)).alias("n"), F.sum("pop_seq").alias("pop_sum"), F.sum("place").alias("place_sum"))


@query(chain.sql("df", "SELECT token, df FROM df"))
def token_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).frequencies


@query(chain.sql("idf", "SELECT token, round(w, 6) AS idf FROM idf"))
def token_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = prepared(spark, sf_dir)
    return data.frequencies.select("token", F.round(text.idf(F.col("df"), F.lit(data.documents)), 6).alias("idf"))


@query(chain.sql("listed", "SELECT seq, pop_seq, round(similarity, 4) AS similarity FROM listed"))
def weighted_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir).select("seq", "pop_seq", F.round("similarity", 4).alias("similarity"))


@query(chain.sql("listed", "SELECT seq, position::INTEGER AS position, pop_seq, round(score, 4) AS score FROM listed"))
def shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir).select("seq", "position", "pop_seq", F.round("score", 4).alias("score"))


@query(chain.sql("listed", "SELECT seq, pop_seq, gross - amount_minor AS amount_delta, exact AS amount_exact, shared_core, contradiction, apart AS days_apart, in_window FROM listed"))
def score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir).select("seq", "pop_seq", "amount_delta", "amount_exact", "shared_core", "contradiction", "days_apart", "in_window")


@query(chain.sql("listed", "SELECT seq, pop_seq, admissible FROM listed"))
def admissibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir).select("seq", "pop_seq", "admissible")


@query(chain.sql("settled", "SELECT seq, pop_seq FROM settled"))
def corroborated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).filter("classification = 'CORROBORATED'").select("seq", "pop_seq")


def _judgeable(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = prepared(spark, sf_dir)
    more = data.settlements.select("pop_seq", *[F.col(n).alias(f"s_{n}") for n in ("payment_id", "order_reference", "settlement_date")])
    return listed(spark, sf_dir).join(more, "pop_seq")


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.resolve_shortlist(_judgeable(spark, sf_dir), POLICY, HeuristicVerifier())


_ALL_VERDICTS = chain.STEPS["judged"].replace("WHERE nth <= 3 AND seq NOT IN (SELECT seq FROM settled)", "").replace("FROM good", "FROM listed")


@query(chain.sql("listed", "SELECT seq, pop_seq, verdict, confidence FROM verdicts", verdicts=_ALL_VERDICTS))
def heuristic_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return HeuristicVerifier().annotate(listed(spark, sf_dir)).select("seq", "pop_seq", "verdict", "confidence")


@query(chain.sql("walk", "SELECT seq, calls::INTEGER AS ai_calls, confidence AS ai_confidence, CASE WHEN verdict = 'SAME' THEN pop_seq END AS pop_seq FROM walk"))
def semantic_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).filter("ai_calls > 0").select("seq", "ai_calls", "ai_confidence", "pop_seq")


# Decisions.


@query(chain.sql("checked", "SELECT record_id, classification, payment_id AS matched_payment_id, n_exact::INTEGER AS candidate_count FROM checked"))
def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select("record_id", "classification", "matched_payment_id", "candidate_count")


_STATUS = "CASE WHEN {0} THEN 'PASS' ELSE 'FAIL' END"


@query(
    chain.sql(
        "checked",
        "SELECT record_id, concat_ws(',', 'currency_match:' || " + _STATUS.format("currency_ok") + ", 'gross_amount_match:' || " + _STATUS.format("amount_ok") + ", 'fee_tax_arithmetic:' || " + _STATUS.format("net_ok")
        + ", 'settlement_timing:' || " + _STATUS.format("timing_ok") + ", 'refund_consistency:' || " + _STATUS.format("refund_ok") + ") AS checks FROM checked WHERE pop_seq IS NOT NULL",
    )
)
def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decided(spark, sf_dir).filter("matched_payment_id IS NOT NULL")
    listed_checks = F.transform(F.slice("checks", 2, 5), lambda x: F.concat(x["name"], F.lit(":"), x.status))
    return rows.select("record_id", F.array_join(listed_checks, ",").alias("checks"))


@query(chain.sql("decided", "SELECT record_id, outcome, exception_type, severity FROM decided"))
def exception_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select("record_id", "outcome", "exception_type", "severity")


@query(chain.sql("lp", "SELECT record_id, TIMESTAMP '2001-06-01' < order_date + INTERVAL 2 DAY AS pending FROM lp WHERE seq % 100 BETWEEN 82 AND 86"))
def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without any settlement, seen from an earlier day: those not due yet are pending instead of missing."""
    data = prepared(spark, sf_dir)
    gone = decisions.Prepared(data.ledger.filter("seq % 100 BETWEEN 82 AND 86"), data.settlements.filter("pop_seq < 0"), data.frequencies.filter("df < 0"), 0)
    found = decisions.decide(gone, POLICY, as_of="2001-06-01 00:00:00")
    return found.select("record_id", F.col("exception_type").eqNullSafe("PENDING_SETTLEMENT").alias("pending"))


@query(chain.sql("resolved", "SELECT record_id, v.pop_seq IS NULL AND v.classification IN ('NO_CANDIDATES', 'NO_ADMISSIBLE_CANDIDATE', 'ALL_CANDIDATES_REJECTED') AND TIMESTAMP '2001-06-01' < l.order_date + INTERVAL 2 DAY AS pending FROM ledger l JOIN resolved v USING (seq)"))
def pending_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records against all settlements, seen from an earlier day: those without one and not due yet are pending."""
    found = decisions.decide(prepared(spark, sf_dir), POLICY, as_of="2001-06-01 00:00:00")
    return found.select("record_id", F.col("exception_type").eqNullSafe("PENDING_SETTLEMENT").alias("pending"))


@query(chain.sql("decided", "SELECT payment_id, count(*) AS n, string_agg(record_id, ',' ORDER BY record_id) AS record_ids FROM decided WHERE payment_id IS NOT NULL GROUP BY payment_id HAVING count(*) > 1"))
def duplicate_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.duplicate_claims(decided(spark, sf_dir))


@query(chain.sql("final", "SELECT record_id, outcome, exception_type, severity FROM final WHERE exception_type = 'DUPLICATE_CLAIM'"))
def claim_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).filter("exception_type = 'DUPLICATE_CLAIM'").select("record_id", "outcome", "exception_type", "severity")


@query(chain.sql("final", "SELECT record_id, classification, outcome, exception_type, severity, payment_id AS matched_payment_id FROM final"))
def process_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("record_id", "classification", "outcome", "exception_type", "severity", "matched_payment_id")
