"""Tables that are made once for the content of their sources: a changed source gives a new table, the same content the old one.

The key of a table is a hash of its name and version and of its sources' keys, in any order; a source's key is made of its rows,
whatever their order and files. A table is found by its folder, in the shared folder or a given one, so sessions share it; nothing is
kept in the process. It counts once it is finished: Spark's mark of a complete write is looked for by reading it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import shared_dir


def content_key(rows: DataFrame) -> str:
    """A hash of a table's columns and rows: their number, and the sum and parity of two hashes of each."""
    one, other = F.xxhash64(*rows.columns), F.xxhash64(F.lit(1), *rows.columns)
    wide = lambda h: F.sum(h.cast("decimal(38,0)"))
    found = rows.select(one.alias("a"), other.alias("b")).agg(F.count(F.lit(1)), wide(F.col("a")), F.bit_xor("a"), wide(F.col("b")), F.bit_xor("b")).first()
    return hashlib.sha256(repr((rows.dtypes, *map(str, found))).encode()).hexdigest()


def table_key(name: str, version: str, sources: list[DataFrame], keys: list[str] | None = None) -> str:
    return hashlib.sha256("\n".join([name, version, *sorted(keys or map(content_key, sources))]).encode()).hexdigest()


def table(name: str, sources: list[DataFrame], make: Callable[[], DataFrame], version: str = "1", folder: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """The table of ``make``, which depends on nothing but ``sources`` and what ``version`` stands for; made only where it isn't there.

    ``keys`` are the sources' content keys where the caller has just taken them for another table of these.
    """
    spark = sources[0].sparkSession
    path = f"{folder or shared_dir(spark) + '/ledgerlane/reuse'}/{name}-{table_key(name, version, sources, keys)}"
    found = _finished(spark, path)
    if found is None:
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)
        found = _finished(spark, path)
    return found


def _finished(spark, path: str) -> DataFrame | None:
    try:
        # The mark is a file of no bytes, which readers of tables leave out; its schema-less listing fails where it isn't there.
        spark.read.format("binaryFile").option("pathGlobFilter", "_SUCCESS").load(f"{path}/_SUCCESS").schema  # noqa: B018
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None
