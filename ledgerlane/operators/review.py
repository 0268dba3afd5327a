"""Stored decisions: the review queue, its actions, progress and run states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Action, state that it leads to, and whether it needs a candidate.
ACTIONS = (("APPROVE_MATCH", "APPROVED", True), ("REJECT_MATCH", "REJECTED", True), ("MARK_MISSING", "CONFIRMED_MISSING", False), ("DEFER", "DEFERRED", False), ("ESCALATE", "ESCALATED", False))
DISPUTES = ("AMBIGUOUS_MATCH", "LOW_CONFIDENCE_MATCH", "DUPLICATE_REFERENCE", "DUPLICATE_CLAIM", "MISSING_SETTLEMENT", "PENDING_SETTLEMENT")
OPEN_OUTCOMES = ("HUMAN_REVIEW", "EXCEPTION")
STALE_SECONDS = 180


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "HIGH", 0).when(severity == "MEDIUM", 1).otherwise(2)


def review_queue(records: DataFrame, state: str = "OPEN", limit: int | None = 100, offset: int = 0) -> DataFrame:
    """What waits for a person, worst and largest first (then by record_id)."""
    rows = records.filter(F.col("outcome").isin(*OPEN_OUTCOMES) & (F.col("review_state") == state))
    rows = rows.orderBy(severity_rank(F.col("severity")), F.desc("amount_minor"), "record_id")
    return rows.offset(offset).limit(limit) if limit is not None else rows.offset(offset)


def review_summary(records: DataFrame) -> DataFrame:
    """Per exception type: count, amount, the worst severity, and how much of it is open."""
    rows = records.filter(F.col("outcome").isin(*OPEN_OUTCOMES))
    waiting = F.col("review_state") == "OPEN"
    return rows.groupBy(F.coalesce("exception_type", F.lit("UNCLASSIFIED")).alias("exception_type")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount_minor").alias("amount_minor"), F.min_by("severity", severity_rank(F.col("severity"))).alias("severity"),
        F.count_if(waiting).alias("open_n"), F.coalesce(F.sum(F.when(waiting, F.col("amount_minor"))), F.lit(0)).alias("open_amount_minor"),
    )


def available_actions() -> Column:
    """The actions a record allows: none once it is closed, and no approval where the money, not the match, is in dispute."""
    candidate = F.col("matched_payment_id").isNotNull() | (F.coalesce(F.size("considered_candidates"), F.lit(0)) > 0)
    disputed = F.col("exception_type").isNull() | F.col("exception_type").isin(*DISPUTES)
    waiting = F.coalesce(F.col("review_state"), F.lit("OPEN")) == "OPEN"
    offers = [F.when((candidate if needs else F.lit(True)) & (disputed if name == "APPROVE_MATCH" else F.lit(True)), F.lit(name)) for name, _, needs in ACTIONS]
    return F.when(waiting, F.filter(F.array(*offers), lambda a: a.isNotNull())).otherwise(F.array().cast("array<string>"))


def apply_actions(records: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records after (record_id, action) pairs, and the verdict on each pair; the outcome itself never changes."""
    states = F.create_map(*[F.lit(x) for name, state, _ in ACTIONS for x in (name, state)])
    asked = actions.groupBy("record_id").agg(F.min("action").alias("action"))
    joined = records.join(asked, "record_id", "left")
    known = F.try_element_at(states, F.col("action"))
    allowed = F.array_contains(available_actions(), F.col("action"))
    after = joined.withColumn("review_state", F.when(F.coalesce(allowed, F.lit(False)), known).otherwise(F.col("review_state"))).select(*records.columns)
    judged = asked.join(records, "record_id", "left")
    status = (
        F.when(F.try_element_at(states, F.col("action")).isNull(), 400).when(F.col("outcome").isNull(), 404).when(F.col("review_state") != "OPEN", 409)
        .when(~F.array_contains(available_actions(), F.col("action")), 400).otherwise(200)
    )
    return after, judged.select("record_id", "action", status.alias("status"))


def outcome_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def progress_counts(records: DataFrame) -> DataFrame:
    """Decided, asked, answered by a model, answered by the heuristic, and unresolved, in one pass."""
    asked, backend = F.col("ai_invoked"), F.lower(F.coalesce("ai_backend", F.lit("")))
    return records.agg(
        F.count(F.lit(1)).alias("decided"), F.count_if(asked).alias("semantic_tier_invoked"), F.count_if(asked & (backend != "") & ~backend.contains("heuristic")).alias("ai_consulted"),
        F.count_if(asked & backend.contains("heuristic")).alias("heuristic_consulted"), F.count_if(F.col("outcome") == "HUMAN_REVIEW").alias("unresolved"),
    )


def last_success(records: DataFrame) -> DataFrame:
    """When each provider last answered; the offline heuristic is none."""
    backend = F.lower(F.trim(F.substring_index("ai_backend", ":", 1)))
    rows = records.filter(F.col("ai_invoked") & F.col("ai_backend").isNotNull() & (F.col("ai_backend") != "") & ~F.lower("ai_backend").contains("heuristic"))
    return rows.groupBy(backend.alias("provider")).agg(F.max("processed_at").alias("last_at"))


def derived_status(now: Column) -> Column:
    """COMPLETED, DRAFT (no total yet), INTERRUPTED (no progress for three minutes) or RUNNING."""
    stale = F.unix_seconds(now) - F.unix_seconds("started_at") > STALE_SECONDS
    return F.when(F.col("status") == "COMPLETED", "COMPLETED").when(F.coalesce("total_records", F.lit(0)) == 0, "DRAFT").when(stale, "INTERRUPTED").otherwise("RUNNING")


def latest_decisions(records: DataFrame) -> DataFrame:
    """The newest row of each record over all batches."""
    newest = Window.partitionBy("record_id").orderBy(F.desc("processed_at"), F.desc("batch_id"))
    return records.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def carry_review_state(new: DataFrame, old: DataFrame) -> DataFrame:
    """New decisions of a batch with the review states that people have set; the last row of a record_id wins."""
    last = new.groupBy("batch_id", "record_id").agg(F.max_by(F.struct(*[c for c in new.columns if c not in ("batch_id", "record_id")]), "seq").alias("r")).select("batch_id", "record_id", "r.*")
    kept = old.select("batch_id", "record_id", F.col("review_state").alias("_state"))
    joined = last.join(kept, ["batch_id", "record_id"], "left")
    return joined.withColumn("review_state", F.coalesce("_state", F.lit("OPEN"))).drop("_state")


def record_page(records: DataFrame, batch_id: str, limit: int = 200, offset: int = 0, outcome: str | None = None) -> DataFrame:
    """A page of a batch's records in their order."""
    rows = records.filter(F.col("batch_id") == batch_id)
    return (rows.filter(F.col("outcome") == outcome) if outcome else rows).orderBy("seq").offset(offset).limit(limit)


def recent_batches(batches: DataFrame, now: Column, limit: int = 20, drafts: bool = True) -> DataFrame:
    """The newest runs with their derived state (by batch_id at one time); drafts are left out after the limit, not before."""
    rows = batches.withColumn("state", derived_status(now)).orderBy(F.desc("started_at"), "batch_id").limit(limit)
    return rows if drafts else rows.filter("state <> 'DRAFT'")


def default_review_batch(batches: DataFrame, now: Column) -> DataFrame:
    """The newest of the last 25 runs that has records, else the newest run: one row, or none without runs."""
    last = recent_batches(batches, now, 25)
    executed = (F.col("state") != "DRAFT") & (F.coalesce("total_records", F.lit(0)) > 0)
    return last.orderBy(F.when(executed, 0).otherwise(1), F.desc("started_at"), "batch_id").limit(1)


def search(records: DataFrame, said: str, columns: list[str]) -> DataFrame:
    """Records whose columns, joined by spaces, hold the text in either case."""
    return records.filter(F.lower(F.concat_ws(" ", *columns)).contains(said.lower()))


def reject_negative(rows: DataFrame, amounts: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows without a negative amount, and the others with the columns at fault."""
    bad = F.filter(F.array(*[F.when(F.col(a) < 0, F.lit(a)) for a in amounts]), lambda a: a.isNotNull())
    marked = rows.withColumn("_bad", bad)
    return marked.filter(F.size("_bad") == 0).drop("_bad"), marked.filter(F.size("_bad") > 0).withColumnRenamed("_bad", "negative")


def top_exceptions(records: DataFrame, n: int = 3) -> DataFrame:
    """The most frequent exception types of what waits for a person, with their amounts."""
    rows = records.filter(F.col("outcome").isin(*OPEN_OUTCOMES) & (F.col("review_state") == "OPEN"))
    counts = rows.groupBy(F.coalesce("exception_type", F.lit("UNCLASSIFIED")).alias("exception_type")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount_minor").alias("amount_minor"))
    return counts.orderBy(F.desc("n"), "exception_type").limit(n)


def export_queue(records: DataFrame, state: str = "OPEN") -> DataFrame:
    """The whole review queue as an operator's worklist: 20 columns, in the queue's order; nulls are empty text."""
    rows = review_queue(records, state, None)
    origin = lambda side, name: F.coalesce(F.col(f"provenance.{side}.{name}").cast("string"), F.lit("")) if "provenance" in records.columns else F.lit("")
    text = lambda name: F.coalesce(name, F.lit("")).alias(name)
    refused = F.transform(F.filter("considered_candidates", lambda c: ~c.admissible), lambda c: F.concat(c.payment_id, F.lit(" ("), F.coalesce(c.admissibility_reason, F.lit("")), F.lit(")")))
    return rows.select(
        "record_id", text("severity"), text("exception_type"), text("outcome"), F.coalesce("review_state", F.lit("OPEN")).alias("review_state"), "amount_minor", "currency", F.coalesce("reference_id", F.lit("")).alias("reference"), text("matched_payment_id"),
        text("reason"), text("explanation"), text("recommended_action"), F.when(F.col("ai_invoked"), "yes").otherwise("no").alias("ai_invoked"), F.coalesce(F.size("considered_candidates"), F.lit(0)).alias("candidates_considered"),
        F.coalesce(F.array_join(refused, "; "), F.lit("")).alias("candidates_refused"), origin("ledger", "filename").alias("ledger_source_file"), origin("ledger", "file_row").alias("ledger_source_row"),
        origin("settlement", "filename").alias("settlement_source_file"), origin("settlement", "file_row").alias("settlement_source_row"), F.array_join(available_actions(), "; ").alias("available_actions"),
    )


def record_origins(records: DataFrame) -> DataFrame:
    """What the map of sources needs of each record, so that the scan reads no other column."""
    return records.select("batch_id", "record_id", "outcome", "matched_payment_id", *[c for c in ("provenance",) if c in records.columns])
