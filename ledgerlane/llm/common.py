"""Shared helpers of the corpus operators: Arrow map passes and scalable row ranks; scratch tables come from the library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize, shared_dir


#: Rows that a map step holds as Python objects at once.
SLICE = 1024


def sliced(batch: pa.RecordBatch, rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """A record batch in parts of at most ``rows`` rows, without copying."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def weighed(batch: pa.RecordBatch, name: str, most: int = 1 << 22, rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """A record batch in parts of at most ``rows`` rows whose values of ``name`` (strings, bytes or lists) hold some ``most`` bytes or elements; a longer value is a part of its own."""
    column = batch.column(name)
    measure = pc.list_value_length if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else pc.binary_length
    ends = np.cumsum(pc.fill_null(measure(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = min(max(int(np.searchsorted(ends, before + most, side="right")), at + 1), at + rows)
        yield batch.slice(at, stop - at)
        at = stop


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function built once per task: ``make()`` gives the function from batch to batch of some rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in sliced(batch):
                yield step(part)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A string column as Python strings; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def columns(**arrays: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for k, v in arrays.items()})


def slots(df: DataFrame, keys: list[str], order: list[Column], name: str, rows_per_bucket: int = 20_000, weight: Column | None = None) -> DataFrame:
    """Add ``name``: a running position (from 0, gapless) inside each group of ``keys``, without sorting a group in one task.

    Rows are dealt into buckets by a hash of ``order``; bucket totals are summed up over the small table of
    (keys, bucket), and only the rows of one bucket are numbered together. With ``weight`` the position counts
    the weight of the rows before instead of the rows. The position follows the order of (bucket, order), so
    equal input gives equal positions as long as ``order`` tells rows apart; rows that it doesn't tell apart
    are interchangeable.
    """
    total = df.count()
    buckets = max(1, -(-total // rows_per_bucket))
    one = weight if weight is not None else F.lit(1)
    rows = df.withColumn("_one", one.cast("long")).withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    by_bucket = rows.groupBy(*keys, "_bucket").agg(F.sum("_one").alias("_sum"))
    # Second level: buckets are grouped again so that no window spans all of them.
    wide = max(1, int(buckets**0.5))
    by_bucket = by_bucket.withColumn("_wide", (F.col("_bucket") / wide).cast("long"))
    by_wide = by_bucket.groupBy(*keys, "_wide").agg(F.sum("_sum").alias("_wide_sum"))
    by_wide = by_wide.withColumn("_wide_base", F.coalesce(F.sum("_wide_sum").over(Window.partitionBy(*keys).orderBy("_wide").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = by_wide.select(*[F.col(k).alias(f"_w_{k}") for k in keys], F.col("_wide").alias("_w_wide"), "_wide_base")
    base = by_bucket.join(w, [F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in keys] + [F.col("_wide") == F.col("_w_wide")])
    base = base.withColumn(
        "_base",
        F.col("_wide_base") + F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys, "_wide").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    base = base.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.col("_bucket").alias("_b_bucket"), "_base")
    inside = F.coalesce(F.sum("_one").over(Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("_inside", inside)
    out = out.join(base, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys] + [F.col("_bucket") == F.col("_b_bucket")])
    return out.withColumn(name, F.col("_base") + F.col("_inside")).select(*df.columns, name)


__all__ = ["columns", "map_batches", "materialize", "shared_dir", "sliced", "slots", "texts", "utf8", "weighed"]
