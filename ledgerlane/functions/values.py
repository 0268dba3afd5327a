"""Amount, date and tolerance functions on columns. Edge input never raises: what can't be read becomes null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000

# Date layouts in the order in which they are tried.
DATE_LAYOUTS = (
    "yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "M/d/yyyy", "yyyy/M/d", "d MMM yyyy", "d-MMM-yyyy", "MMM d, yyyy", "d/M/yyyy H:mm", "yyyy-M-d H:mm:ss",
)
ISO_LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm", "yyyyMMdd")


def days_between(first: Column, second: Column) -> Column:
    """Whole days from first to second, floored, then without sign: an hour back is one day, an hour on is none."""
    return F.abs(F.floor((F.unix_micros(second) - F.unix_micros(first)) / DAY_MICROS)).cast("int")


def amounts_match(a: Column, b: Column, tolerance: int) -> Column:
    return F.abs(a - b) <= tolerance


def amount_plausible(ledger: Column, candidate: Column) -> Column:
    """Between half and twice the ledger amount; anything goes for amounts of zero or less."""
    return (ledger <= 0) | F.coalesce(F.try_divide(candidate, ledger).between(0.5, 2.0), F.lit(False))


def to_minor(major: Column) -> Column:
    """Minor units of an amount in major units, half to even."""
    return F.rint(major * 100).cast("bigint")


def parse_amount(text: Column) -> Column:
    """The number in a formatted amount: parentheses or a minus sign negate, anything but digits, dot and minus goes first."""
    raw = F.trim(text)
    digits = F.regexp_replace(raw, r"[^0-9.\-]", "")
    number = digits.try_cast("double")
    bracketed = raw.startswith("(") & raw.endswith(")")
    return F.when(F.regexp_count(digits, F.lit("[0-9]")) == 0, F.lit(None)).when(bracketed, -F.abs(number)).otherwise(number)


#: What the letters of a layout stand for, longest first.
_LETTERS = (("yyyy", "[0-9]{4}"), ("SSS", "[0-9]{3}"), ("MMM", "[A-Za-z]+"), ("XXX", "(Z|[+-][0-9]{2}:[0-9]{2})"), ("MM", "[0-9]{2}"), ("dd", "[0-9]{2}"), ("HH", "[0-9]{2}"), ("mm", "[0-9]{2}"), ("ss", "[0-9]{2}"), ("M", "[0-9]{1,2}"), ("d", "[0-9]{1,2}"), ("H", "[0-9]{1,2}"))


def shape_of(layout: str) -> str:
    """A pattern that all texts of a date layout match, so that a layout is only tried on texts that look like it."""
    out, rest = "", layout.replace("'", "")
    while rest:
        letters, pattern = next(((k, p) for k, p in _LETTERS if rest.startswith(k)), (rest[0], re.escape(rest[0])))
        out, rest = out + pattern, rest[len(letters) :]
    return f"^{out}$"


def parse_date(text: Column) -> Column:
    """A timestamp (UTC where no offset is given) from ISO forms, then the listed layouts, then ten-digit epoch seconds."""
    raw = F.nullif(F.trim(text), F.lit(""))
    tries = [F.when(raw.rlike(shape_of(p)), F.try_to_timestamp(raw, F.lit(p))) for p in (*ISO_LAYOUTS, *DATE_LAYOUTS)]
    epoch = F.when(raw.rlike("^[0-9]{10}$"), F.timestamp_seconds(raw.try_cast("bigint")))
    return F.coalesce(epoch, *tries)


def money(minor: Column, currency: Column) -> Column:
    """Like ``₹1,234.56`` or ``-USD 12.00``; built from integers only."""
    size = F.abs(minor)
    whole = F.format_number((size - size % 100) / 100, 0)
    text = F.concat(whole, F.lit("."), F.lpad((size % 100).cast("string"), 2, "0"))
    mark = F.when(F.upper(currency) == "INR", F.lit("₹")).otherwise(F.concat(F.upper(currency), F.lit(" ")))
    return F.concat(F.when(minor < 0, F.lit("-")).otherwise(F.lit("")), mark, text)


def local_day(value: Column) -> Column:
    return F.to_date(value)
