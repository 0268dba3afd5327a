"""Raw string rows to canonical records: one projection per source; what can't be read is set apart with its reason."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values
from ..operators.decisions import lookup
from .detect import Detected

# Status words of exports.
LEDGER_STATUS = {
    "captured": "captured", "paid": "captured", "success": "captured", "successful": "captured", "completed": "captured", "settled": "captured", "authorized": "captured", "complete": "captured",
    "refunded": "refunded", "reversed": "refunded", "returned": "refunded", "partially_refunded": "partially_refunded", "partial_refund": "partially_refunded",
}
SETTLEMENT_STATUS = {
    "settled": "settled", "paid": "settled", "processed": "settled", "credited": "settled", "success": "settled", "completed": "settled", "captured": "settled",
    "refunded": "refunded", "reversed": "refunded", "returned": "refunded", "partially_refunded": "partially_refunded", "partial_refund": "partially_refunded",
}
SETTLEMENT_TYPES = ("PAYMENT_GATEWAY", "BANK_STATEMENT")


def role_of(source_type: str) -> str:
    return "SETTLEMENT" if source_type in SETTLEMENT_TYPES else "LEDGER"


@dataclass
class Mapped:
    """Accepted records with their ``provenance``, and rejected rows with ``error`` and the first raw values."""

    role: str
    records: DataFrame
    rejected: DataFrame


@dataclass
class Reading:
    """How the raw rows of one or many files are read, as expressions on them: a field's text (null where empty), the amount with its sign, its minor units, and where a row comes from."""

    field: Callable[[str], Column]
    signed: Column
    minor: Callable[[Column], Column]
    number: Column
    file_row: Column
    source_id: Column
    filename: Column
    source_type: Column
    raw: Column


def signed_amount(credit: Column, debit: Column) -> Column:
    """Money in is positive, money out negative; nothing where both are empty or nothing."""
    return F.when(credit != 0, credit).when(debit != 0, -debit)


def read_amounts(rows: DataFrame, how: Reading) -> DataFrame:
    """The rows with _signed, _when, _amount, _refund and _error.

    They come out of a generator, which filters aren't pushed through: else each date would be parsed for the filter on _error and again for its column.
    """
    refund = F.coalesce(how.minor(values.parse_amount(how.field("refund_amount"))), F.lit(0))
    parsed = F.struct(how.signed.alias("_signed"), values.parse_date(how.field("date")).alias("_when"), refund.alias("_stated"))
    base = rows.select("*", F.inline(F.array(parsed)))
    error = F.when(F.col("_signed").isNull(), "amount is missing or not a number").when(F.col("_when").isNull(), "date is missing or not readable")
    base = base.withColumns({"_amount": how.minor(F.abs("_signed")), "_error": error})
    stated = F.when((F.col("_signed") < 0) & (F.col("_stated") == 0), F.col("_amount")).otherwise(F.col("_stated"))
    return base.withColumn("_refund", F.least(stated, F.col("_amount"))).drop("_stated")


def canonical(base: DataFrame, how: Reading, role: str) -> DataFrame:
    """The canonical records of the readable rows of ``read_amounts``, all of one side, with their provenance."""
    c, field = F.col, how.field
    reference = F.coalesce(field("reference"), field("transaction_id"))
    key = F.coalesce(field("transaction_id"), reference, F.concat(how.source_id, F.lit("-"), how.number.cast("string")))
    text = F.coalesce(field("description"), F.lit(""))
    description = F.when(field("counterparty").isNotNull(), F.trim(F.concat_ws(" ", text, field("counterparty")))).otherwise(text)
    currency = F.substring(F.upper(F.coalesce(field("currency"), F.lit("INR"))), 1, 8)
    said = F.lower(F.trim(F.coalesce(field("status"), F.lit(""))))
    provenance = F.struct(
        how.source_id.alias("source_id"), how.filename.alias("filename"), how.source_type.alias("source_type"), F.lit(role).alias("role"), how.number.alias("row"), how.file_row.alias("file_row")
    ).alias("provenance")
    good = base.filter("_error IS NULL")
    if role == "LEDGER":
        return good.select(
            key.alias("order_id"), reference.alias("reference_id"), c("_amount").alias("amount_minor"), currency.alias("currency"), c("_when").alias("order_date"),
            _status(LEDGER_STATUS, said, "captured").alias("status"), c("_refund").alias("refund_amount_minor"), description.alias("description"), provenance,
        )
    fee, tax = (F.coalesce(how.minor(values.parse_amount(field(n))), F.lit(0)) for n in ("fee", "tax"))
    net = F.coalesce(how.minor(values.parse_amount(field("net_amount"))), c("_amount") - fee - tax - c("_refund"))
    return good.select(
        key.alias("payment_id"), F.coalesce(reference, F.lit("")).alias("order_reference"), key.alias("settlement_id"), c("_amount").alias("gross_amount_minor"), fee.alias("fee_minor"), tax.alias("tax_minor"),
        c("_refund").alias("refund_amount_minor"), net.alias("net_amount_minor"), c("_when").alias("order_date"), F.coalesce(values.parse_date(field("settlement_date")), c("_when")).alias("settlement_date"),
        currency.alias("currency"), _status(SETTLEMENT_STATUS, said, "settled").alias("status"), description.alias("description"), provenance,
    )


def rejected_rows(base: DataFrame, how: Reading) -> DataFrame:
    """The unreadable rows of ``read_amounts`` with the reason and their first raw values."""
    return base.filter("_error IS NOT NULL").select(how.number.alias("row"), how.file_row.alias("file_row"), how.source_id.alias("source_id"), how.filename.alias("filename"), F.col("_error").alias("error"), how.raw.alias("raw"))


def map_rows(rows: DataFrame, found: Detected, source_type: str, source_id: str, filename: str = "", row_number: str = "_row", header_offset: int = 1) -> Mapped:
    """``rows`` are all strings, with their number in the file (from 1) in ``row_number``."""
    role = role_of(source_type)
    raw = lambda column: F.nullif(F.col(f"`{column}`").cast("string"), F.lit(""))
    field = lambda name: raw(found.mapping[name]) if name in found.mapping else F.lit(None).cast("string")
    if found.debit and found.credit:
        signed = signed_amount(values.parse_amount(raw(found.credit)), values.parse_amount(raw(found.debit)))
    else:
        signed = values.parse_amount(field("amount"))
    number = F.col(row_number).cast("bigint")
    how = Reading(
        field, signed, (lambda amount: F.rint(amount).cast("bigint")) if found.scale == "minor" else values.to_minor, number, number + header_offset, F.lit(source_id), F.lit(filename), F.lit(source_type),
        F.create_map(*[x for column in found.columns[:6] for x in (F.lit(column), F.col(f"`{column}`").cast("string"))]),
    )
    base = read_amounts(rows, how)
    return Mapped(role, canonical(base, how, role), rejected_rows(base, how))


def _status(table: dict[str, str], said: Column, plain: str) -> Column:
    """The known word, else the plain state; a refund turns the plain state into a refunded one."""
    known = lookup(table, said, plain)
    refunded = F.when(F.col("_refund") < F.col("_amount"), "partially_refunded").otherwise("refunded")
    return F.when((known == plain) & (F.col("_refund") != 0), refunded).otherwise(known)


def combine(sources: list[Mapped], role: str) -> DataFrame | None:
    """All records of a side, in source order, with their place in it; nothing is deduplicated."""
    parts = [s.records.withColumn("_source", F.lit(k)) for k, s in enumerate(sources) if s.role == role]
    if not parts:
        return None
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def amount_scales(rows: DataFrame, source: str, number: str, amount: str, sample: int = 50) -> DataFrame:
    """source, scale of each source's amount column, from its first ``sample`` filled values: ``minor`` only where all that can be read are whole and none has a point."""
    filled = rows.filter(F.coalesce(amount, F.lit("")) != "").select(source, number, amount)
    first = filled.withColumn("_n", F.row_number().over(Window.partitionBy(source).orderBy(number))).filter(F.col("_n") <= sample)
    value = values.parse_amount(F.col(amount))
    whole = F.bool_and(F.when(value.isNotNull(), value == F.floor(value)))
    judged = first.groupBy(source).agg((~F.bool_or(F.col(amount).contains(".")) & F.coalesce(whole, F.lit(False))).alias("minor"))
    every = rows.select(source).distinct().join(judged, source, "left")
    return every.select(source, F.when(F.coalesce("minor", F.lit(False)), "minor").otherwise("major").alias("scale"))


def normalize_status(said: Column, role: str) -> Column:
    """The canonical state of a status word of one side; an unknown or missing word is the side's plain state."""
    table, plain = (LEDGER_STATUS, "captured") if role == "LEDGER" else (SETTLEMENT_STATUS, "settled")
    return lookup(table, F.lower(F.trim(F.coalesce(said, F.lit("")))), plain)
