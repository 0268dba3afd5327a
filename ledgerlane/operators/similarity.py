"""Token statistics of the settlement descriptions, and IDF weights attached to records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def token_frequencies(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """token, df: in how many rows each token occurs."""
    return rows.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


#: Tokens whose frequencies every task has: the few that are in very many rows would else meet in one task.
FREQUENT = 10_000


def with_frequency(spread: DataFrame, frequencies: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Rows with a token, and its df: frequent tokens from a table of bounded size, the others by a join."""
    known = frequencies.orderBy(F.desc("df"), "token").limit(frequent)
    first = spread.join(F.broadcast(known), "token", "left")
    rest = first.filter("df IS NULL").drop("df").join(frequencies, "token", "left")
    return first.filter("df IS NOT NULL").unionByName(rest)


def with_weights(rows: DataFrame, key: str, frequencies: DataFrame, documents: int, tokens: str = "tokens") -> DataFrame:
    """key, weights (token to IDF) and total weight of each row that has tokens."""
    spread = with_frequency(rows.select(key, F.explode(tokens).alias("token")), frequencies)
    weighed = spread.withColumn("idf", text.idf(F.col("df"), F.lit(documents)))
    return weighed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "idf"))).alias("weights"), F.sum("idf").alias("total"))


def attach(rows: DataFrame, key: str, frequencies: DataFrame, documents: int) -> DataFrame:
    """``rows`` with weights and total; rows without tokens have an empty map and 0."""
    found = with_weights(rows, key, frequencies, documents)
    out = rows.join(found, key, "left")
    return out.withColumns({"weights": F.coalesce("weights", F.expr("map_from_arrays(array(), array())").cast("map<string,double>")), "total": F.coalesce("total", F.lit(0.0))})
