"""Reference, token and similarity functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_reference(ref: Column) -> Column:
    """Upper case without anything but A-Z and 0-9; null becomes empty."""
    return F.regexp_replace(F.upper(F.coalesce(ref, F.lit(""))), "[^A-Z0-9]", "")


def normalize_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def token_set(text: Column) -> Column:
    """Distinct tokens of a text, as an array."""
    return F.array_distinct(F.filter(F.split(normalize_text(text), " "), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays; 1 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def reference_cores(*values: Column) -> Column:
    """Distinct runs of four or more digits in any of the values."""
    found = [F.regexp_extract_all(F.coalesce(v, F.lit("")), F.lit(r"(\p{Nd}{4,})"), F.lit(1)) for v in values]
    return F.array_distinct(F.flatten(F.array(*found)))


def references_comparable(a: Column, b: Column) -> Column:
    """Whether two core arrays have runs of a common width: only then can they contradict each other."""
    width = lambda cores: F.transform(cores, F.length)
    return (F.size(a) > 0) & (F.size(b) > 0) & F.arrays_overlap(width(a), width(b))


def idf(df: Column, documents: Column) -> Column:
    """Smoothed inverse document frequency of a token met in ``df`` of ``documents`` texts."""
    return F.when(documents <= 0, F.lit(1.0)).otherwise(F.log((documents + 1) / (F.coalesce(df, F.lit(0)) + 1)) + 1.0)


def weighted_jaccard(a_tokens: Column, a_weights: Column, a_total: Column, b_tokens: Column, b_total: Column) -> Column:
    """IDF-weighted Jaccard from token arrays, the weights of a's tokens (a map) and both totals."""
    both = F.array_intersect(a_tokens, b_tokens)
    shared = F.aggregate(both, F.lit(0.0), lambda acc, t: acc + F.element_at(a_weights, t))
    union = a_total + b_total - shared
    return F.when((F.size(a_tokens) == 0) & (F.size(b_tokens) == 0), F.lit(1.0)).when(union <= 0, F.lit(0.0)).otherwise(shared / union)


# Shapes of credentials that never belong in a log.
CREDENTIALS = (r"AIza[0-9A-Za-z_-]{20,}", r"gsk_[0-9A-Za-z]{16,}", r"(?i)bearer\s+[0-9a-z._-]{12,}", r"(?i)([?&](?:key|api_key|token)=)[^&\s]+")


def scrub_secrets(text: Column, known: list[str] = []) -> Column:  # noqa: B006
    """Replace known secrets of eight characters or more, and credential shapes, by a mark."""
    for secret in sorted((s for s in known if len(s) >= 8), key=len, reverse=True):
        text = F.replace(text, F.lit(secret), F.lit("<redacted>"))
    for pattern in CREDENTIALS:
        text = F.regexp_replace(text, pattern, "<redacted>")
    return text


def join_words(items: Column, last: str) -> Column:
    """``a``, ``a<last>b``, ``a, b<last>c`` for an array of strings."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, F.lit("")).when(n == 1, F.element_at(items, 1)).otherwise(F.concat(head, F.lit(last), F.element_at(items, -1)))
