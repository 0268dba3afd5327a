"""The hash-chained audit log: canonical JSON, parallel verification, and appending.

Verification is parallel: each row's hash is recomputed from its own columns, and its predecessor's hash is looked up by a
join on the sequence number instead of one ordered pass. Appending to one chain is sequential by definition (``append``: new
events are hashed in order by one task that holds one event at a time). Where there are many, ``append_segments`` makes a chain
of each segment of ``SEGMENT`` events, in parallel, and a second chain of the segments' last hashes, one link a segment: a change
anywhere breaks its segment's chain, and a segment that is left out, replaced or moved breaks the links.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize

GENESIS = "0" * 64
FIELDS = ("timestamp", "transaction_id", "event_type", "prior_state", "new_state", "evidence_ref")
SCHEMA = "seq bigint, timestamp string, transaction_id string, event_type string, prior_state string, new_state string, evidence_ref string, payload_json string, prev_hash string, hash string"


def canonical_json(value: object) -> bytes:
    """Sorted keys, no white space, ASCII only: equal values give equal bytes."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, default=str).encode()


def chain_hash(previous: str, event: dict) -> str:
    return hashlib.sha256(canonical_json({"prev_hash": previous, "event": event})).hexdigest()


def event_hash(prev_hash: Column, payload_json: Column, *fields: Column) -> Column:
    """The chain hash of each row, batch by batch."""

    @F.pandas_udf("string")
    def run(prev: pd.Series, payload: pd.Series, *own: pd.Series) -> pd.Series:
        out = []
        for row in zip(prev, payload, *own, strict=True):
            event = dict(zip(FIELDS, row[2:], strict=True)) | {"payload": json.loads(row[1]) if row[1] else None}
            out.append(chain_hash(row[0], event))
        return pd.Series(out)

    return run(prev_hash, payload_json, *fields)


def verify(log: DataFrame) -> DataFrame:
    """seq and reason of every break: a row that doesn't follow its predecessor, or whose content isn't what was hashed."""
    before = log.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("before"))
    first = log.agg(F.min("seq").alias("first"))
    rows = log.join(before, "seq", "left").join(F.broadcast(first), how="cross")
    expected = F.when(F.col("seq") == F.col("first"), F.lit(GENESIS)).otherwise(F.col("before"))
    own = event_hash(F.col("prev_hash"), F.col("payload_json"), *[F.col(f) for f in FIELDS])
    found = F.array(F.when(~F.col("prev_hash").eqNullSafe(expected), F.lit("doesn't follow its predecessor")), F.when(own != F.col("hash"), F.lit("content was changed")))
    return rows.select("seq", F.explode(F.filter(found, lambda r: r.isNotNull())).alias("reason"))


def append(events: DataFrame, head_seq: int = 0, head_hash: str = GENESIS) -> DataFrame:
    """Chain rows of new events, in the order of their ``order`` column, after the given head. One writer at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, previous = head_seq, head_hash
        for frame in frames:
            prev, own, numbers = [], [], []
            for row in frame.itertuples(index=False):
                event = {f: getattr(row, f) for f in FIELDS} | {"payload": json.loads(row.payload_json) if row.payload_json else None}
                seq += 1
                prev.append(previous)
                previous = chain_hash(previous, event)
                own.append(previous)
                numbers.append(seq)
            yield frame.drop(columns="order").assign(seq=numbers, prev_hash=prev, hash=own)[[c.split()[0] for c in SCHEMA.split(", ")]]

    ordered = events.select("order", *FIELDS, "payload_json").coalesce(1).sortWithinPartitions("order")
    return ordered.mapInPandas(run, SCHEMA)


#: Events of a segment.
SEGMENT = 100_000
LINKS = "segment bigint, first_seq bigint, last_seq bigint, tail string, prev_link string, link string"


def segment_seed(segment: int) -> str:
    """What stands before a segment's first event."""
    return hashlib.sha256(f"segment {segment}".encode()).hexdigest()


def link_hash(previous: str, segment: int, tail: str) -> str:
    return hashlib.sha256(canonical_json({"link": previous, "segment": segment, "tail": tail})).hexdigest()


def numbered(events: DataFrame, head_seq: int) -> DataFrame:
    """Events with ``seq`` in the order of ``order``, from ``head_seq`` + 1: ranges are sorted in parallel, and only their sizes are summed up in order."""
    sorted_rows = events.select("order", *FIELDS, "payload_json").repartitionByRange("order").sortWithinPartitions("order")
    rows = materialize(sorted_rows.withColumns({"_range": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}), "audit-ranges")
    sizes = rows.groupBy("_range").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # A row for each range.
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return rows.join(F.broadcast(before), "_range").withColumn("seq", F.col("_id") - F.col("_first") + F.col("_before") + 1 + head_seq).drop("_range", "_id", "_first", "_before", "order")


def append_segments(events: DataFrame, head_seq: int = 0, head_segment: int = -1, head_link: str = GENESIS, size: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """The log's new rows (SCHEMA and segment), in segments of ``size``, and their LINKS, after the given heads. One writer at a time."""
    spark = events.sparkSession
    rows = numbered(events, head_seq).withColumn("segment", F.floor((F.col("seq") - 1 - head_seq) / size) + head_segment + 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment, previous = None, ""
        for frame in frames:
            prev, own = [], []
            for row in frame.itertuples(index=False):
                if row.segment != segment:
                    segment, previous = row.segment, segment_seed(int(row.segment))
                event = {f: getattr(row, f) for f in FIELDS} | {"payload": json.loads(row.payload_json) if row.payload_json else None}
                prev.append(previous)
                previous = chain_hash(previous, event)
                own.append(previous)
            yield frame.assign(prev_hash=prev, hash=own)[[c.split()[0] for c in f"{SCHEMA}, segment bigint".split(", ")]]

    # Whole segments, each within one task and in order.
    log = materialize(rows.repartition("segment").sortWithinPartitions("segment", "seq").mapInPandas(run, f"{SCHEMA}, segment bigint"), "audit-segments")
    tails = log.groupBy("segment").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max_by("hash", "seq").alias("tail")).orderBy("segment")
    links, link = [], head_link
    # A row for each segment.
    for r in tails.toLocalIterator():
        before, link = link, link_hash(link, r.segment, r.tail)
        links.append((r.segment, r.first_seq, r.last_seq, r.tail, before, link))
    return log, spark.createDataFrame(links, LINKS)


def verify_segments(log: DataFrame, links: DataFrame) -> DataFrame:
    """seq and reason of every break in the segments (seq is an event's), and in their links (seq is a segment's first)."""
    before = log.select("segment", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("before"))
    rows = log.join(before, ["segment", "seq"], "left").join(links.select("segment", "first_seq"), "segment", "left")
    seed = F.sha2(F.concat(F.lit("segment "), F.col("segment").cast("string")), 256)
    expected = F.when(F.col("seq") == F.col("first_seq"), seed).otherwise(F.col("before"))
    own = event_hash(F.col("prev_hash"), F.col("payload_json"), *[F.col(f) for f in FIELDS])
    found = F.array(F.when(~F.col("prev_hash").eqNullSafe(expected), F.lit("doesn't follow its predecessor")), F.when(own != F.col("hash"), F.lit("content was changed")))
    events = rows.select("seq", F.explode(F.filter(found, lambda r: r.isNotNull())).alias("reason"))
    tails = log.groupBy("segment").agg(F.max_by("hash", "seq").alias("_tail"), F.min("seq").alias("_from"), F.max("seq").alias("_to"))
    in_order = Window.orderBy("segment")  # a row for each segment
    linked = links.withColumns({"_before": F.lag("link").over(in_order), "_last": F.lag("last_seq").over(in_order), "_n": F.row_number().over(in_order)}).join(tails, "segment", "left")
    text = F.concat(F.lit('{"link":"'), F.col("prev_link"), F.lit('","segment":'), F.col("segment").cast("string"), F.lit(',"tail":"'), F.col("tail"), F.lit('"}'))
    wrong = F.array(
        F.when((F.col("_n") > 1) & ~(F.col("prev_link").eqNullSafe(F.col("_before")) & (F.col("first_seq") == F.col("_last") + 1)), F.lit("the segment doesn't follow the one before")),
        F.when(F.sha2(text, 256) != F.col("link"), F.lit("the link was changed")),
        F.when(~(F.col("_tail").eqNullSafe(F.col("tail")) & F.col("_from").eqNullSafe(F.col("first_seq")) & F.col("_to").eqNullSafe(F.col("last_seq"))), F.lit("the segment isn't the one that was linked")),
    )
    return events.unionByName(linked.select(F.col("first_seq").alias("seq"), F.explode(F.filter(wrong, lambda r: r.isNotNull())).alias("reason")))


def page(log: DataFrame, after: int = 0, limit: int = 500) -> DataFrame:
    return log.filter(F.col("seq") > after).orderBy("seq").limit(limit)


def head(log: DataFrame) -> DataFrame:
    """head_seq (0 of an empty log), head_hash and the number of events."""
    return log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("head_seq"), F.coalesce(F.max_by("hash", "seq"), F.lit(GENESIS)).alias("head_hash"), F.count(F.lit(1)).alias("total_events"))


def resume_point(since: int | None, last_event_id: str | None, head_seq: int) -> int:
    """Where a reader goes on: a given number, a numeric last id, or the head."""
    if since is not None:
        return max(0, since)
    return int(last_event_id) if last_event_id and last_event_id.isdigit() else head_seq
