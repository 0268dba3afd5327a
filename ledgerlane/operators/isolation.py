"""A batch in which single records can't be processed: they become results of their own, and the others go on.

An expression that fails ends a Spark job, not a row. So what would fail is found first, by expressions that can't (``try_``
arithmetic and casts), as a text in a column: rows without it are decided as ever, rows with it become HUMAN_REVIEW with a
failed ``processing`` check. Unusable settlements are set apart the same way, or they would fail the records near them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import Policy
from .decisions import Prepared, check, decide, prepare
from .verdicts import Verifier

#: Sums and products of amounts below this, and days around dates between these, stay within 64 bits.
LARGEST_AMOUNT = 10**15
FIRST_DAY, LAST_DAY = "0001-01-01", "9999-01-01"


def amount_error(name: str, required: bool = True, negative: bool = False) -> Column:
    value = F.col(name)
    missing = value.isNull() if required else F.lit(False)
    low = F.lit(False) if negative else value < 0
    # try_ arithmetic, as the absolute value of the least number doesn't fit.
    large = (value > LARGEST_AMOUNT) | (value < -LARGEST_AMOUNT)
    return F.when(missing, F.lit(f"{name} is missing")).when(large, F.concat(F.lit(f"{name} is out of range: "), value.cast("string"))).when(low, F.concat(F.lit(f"{name} is negative: "), value.cast("string")))


def date_error(name: str) -> Column:
    value = F.col(name)
    return F.when(value.isNull(), F.lit(f"{name} is missing")).when((value < F.lit(FIRST_DAY).cast("timestamp")) | (value > F.lit(LAST_DAY).cast("timestamp")), F.lit(f"{name} is out of range"))


def text_error(name: str) -> Column:
    return F.when(F.col(name).isNull(), F.lit(f"{name} is missing"))


def ledger_error() -> Column:
    """Why a ledger record can't be processed, or null: the first reason in the order of the columns."""
    return F.coalesce(amount_error("amount_minor"), text_error("currency"), date_error("order_date"), text_error("status"), amount_error("refund_amount_minor"))


def settlement_error() -> Column:
    amounts = [amount_error(n) for n in ("gross_amount_minor", "fee_minor", "tax_minor", "refund_amount_minor")]
    return F.coalesce(text_error("payment_id"), *amounts, amount_error("net_amount_minor", negative=True), date_error("order_date"), date_error("settlement_date"), text_error("currency"))


def split(rows: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """The rows without an error, and the others with it in ``error``."""
    marked = rows.withColumn("error", error)
    return marked.filter("error IS NULL").drop("error"), marked.filter("error IS NOT NULL")


def error_results(bad: DataFrame, like: DataFrame, policy: Policy) -> DataFrame:
    """Results with the columns of ``like`` for records that can't be processed."""
    failed = check("processing", F.lit(False), F.lit("a processed record"), F.lit("an error"), "", F.col("error"))
    values = {
        "outcome": F.lit("HUMAN_REVIEW"), "exception_type": F.lit("PROCESSING_ERROR"), "severity": F.lit("HIGH"), "checks": F.array(failed), "candidate_count": F.lit(0), "ai_invoked": F.lit(False), "ai_calls": F.lit(0),
        "reason": F.concat(F.lit("this record could not be processed ("), F.col("error"), F.lit("); it goes to review instead of being reconciled silently")),
        "explanation": F.lit("This record could not be processed."), "recommended_action": F.lit("Mend the record and run again."), "policy_threshold": F.lit(policy.ai_confidence_threshold),
    }
    own = set(bad.columns)
    return bad.select(*[(values[f.name] if f.name in values else F.col(f.name) if f.name in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields])


def decide_all(
    ledger: DataFrame, settlements: DataFrame, policy: Policy = Policy(), verifier: Verifier | None = None, as_of: object = None, also: Callable[[], Column] | None = None  # noqa: B008
) -> tuple[DataFrame, DataFrame]:
    """A result for every record, and the settlements that were set apart with their error. ``also`` may add an error of the caller's."""
    error = F.coalesce(ledger_error(), also()) if also else ledger_error()
    good, bad = split(ledger, error)
    usable, unusable = split(settlements, settlement_error())
    data: Prepared = prepare(good, usable)
    decided = decide(data, policy, verifier, as_of)
    return decided.unionByName(error_results(bad, decided, policy)), unusable
