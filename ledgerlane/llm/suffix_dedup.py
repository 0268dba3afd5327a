"""Suffix-array deduplication: every string of ``length`` bytes that starts at two places anywhere is found, exactly.

1. Sharding. Each window of ``length`` bytes gets a key from its content alone: the least hash of its ``gram``-byte
   substrings. Equal windows have equal keys wherever they are, so shards by key can be searched apart. Runs of windows
   with one key are one segment of text; a key met by a single segment that doesn't repeat it inside is done.
2. Equal segments are collapsed, before anything is shuffled by key, to one representative that knows whether it
   stands for several places. A key with one representative needs no order: its windows repeat if it has a weight.
3. The other representatives are joined per shard (some ``shard_bytes`` of them), windows whose hash no other window
   has are left out, and a suffix array of the rest is built; permuted common prefixes of ``length`` or more join
   neighbours into groups of equal windows, which repeat if the group has two places.
4. A key whose representatives alone would overfill a shard (a passage in very many different contexts) is split
   before: windows whose two hashes are met once go, the runs of the others are cut anew by shorter substrings, and equal
   parts are sent once. Parts whose shorter substring is the same make a sub-shard, which is searched as above. Where even
   one of these would overfill a shard, its windows stand as repeated by their two hashes.
5. The windows found go back to every place of their representative, and per document to byte ranges.

Only totals reach the driver. Hashes only tell windows apart, and bring equal ones together; that two windows are equal
is decided on bytes, in a suffix array, but in the sub-shards that step 4 leaves too large. That two whole segments or
parts are equal is taken from two 64-bit hashes and their length.

Cases: null text counts as empty; texts shorter than ``length`` have no windows; repeated rows are places of their
own; null ids are kept; empty tables give empty results; other columns are passed by; long texts are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytehash import fold, prefix_sums, range_hash
from .common import columns, map_batches, materialize, utf8
from .suffix_array import common_prefixes, suffix_array

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
SEGMENTS = "doc_id long, row_key long, key long, seg_hash long, a int, b int, self boolean"
FOUND = "key long, seg_hash long, starts array<int>, ends array<int>, often_starts array<int>, often_ends array<int>"

#: Bytes of whole shards that one suffix array is built of: arrays over some more than this stay in a CPU's caches.
SEARCH_BYTES = 1 << 20


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[: len(values) - step], values[step:])
        have += step
    return values


def segments(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """key, hash, first window, end window (exclusive) and whether a window may repeat inside, of each segment."""
    n = len(data) - length + 1
    if n < 1:
        return (np.zeros(0, dtype=np.int64),) * 4 + (np.zeros(0, dtype=bool),)
    sums = prefix_sums(data)
    at = np.arange(len(data) - gram + 1)
    grams = range_hash(sums, at, at + gram)
    width = length - gram + 1
    low = least(grams, width)
    start = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
    end = np.append(start[1:], n)
    # A window repeats inside a segment only past the first place of the segment's least substring.
    first = start + width - 1
    search = np.flatnonzero((start == 0) | (low[start] > low[np.maximum(start - 1, 0)]))
    search = search[end[search] - start[search] > 1]
    for k in search.tolist():
        first[k] = start[k] + int(grams[start[k] : start[k] + width].argmin())
    return low[start].view(np.int64), range_hash(sums, start, end - 1 + length).view(np.int64), start, end, end - 1 > first


def find_segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """All segments of all documents (doc_id, row_key, text)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts: list[list[np.ndarray]] = [[] for _ in range(5)]
            sizes = []
            for data in utf8(batch):
                found = segments(np.frombuffer(data, dtype=np.uint8), length, gram)
                sizes.append(len(found[0]))
                for part, values in zip(parts, found, strict=True):
                    part.append(values)
            rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            key, seg_hash, a, b, own = (np.concatenate(p) for p in parts)
            return columns(doc_id=batch.column("doc_id").take(rows), row_key=batch.column("row_key").take(rows), key=key, seg_hash=seg_hash, a=pa.array(a.astype(np.int32)), b=pa.array(b.astype(np.int32)), self=own)

        return step

    return map_batches(docs.select("doc_id", "row_key", "text"), make, SEGMENTS)


def runs_of(mask: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True values; no run goes past a place where ``first`` is True."""
    begin = mask.copy()
    begin[1:] &= first[1:] | ~mask[:-1]
    stop = mask.copy()
    stop[:-1] &= first[1:] | ~mask[1:]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def ranges_of(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The integers of the ranges start, start + 1, ..., start + size - 1, one range after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def supports(group: np.ndarray, tag: np.ndarray, owner: np.ndarray, weight: np.ndarray, n_groups: int) -> np.ndarray:
    """For each group number from 0, the documents of its members: each single one once, and each class's once."""

    def total(chosen: np.ndarray, by: np.ndarray, weights: np.ndarray) -> np.ndarray:
        if not chosen.any():
            return np.zeros(n_groups, dtype=np.int64)
        order = np.lexsort((by[chosen], group[chosen]))
        g, names = group[chosen][order], by[chosen][order]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (names[1:] != names[:-1])))
        return np.bincount(g[new], weights=weights[chosen][order][new].astype(np.float64), minlength=n_groups).astype(np.int64)

    single = tag != 0
    return total(single, tag, np.ones(len(tag))) + total(~single, owner, weight)


def repeats_in_shard(
    pieces: list[bytes], tags: list[int], length: int, apart: bool, shards: list[int] | None = None, owners: list[int] | None = None, weights: list[int] | None = None, needs: list[int] | None = None,
) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """The maximal ranges (piece, first window, end window) of windows that repeat, and of those that do so often.

    ``tags``: 0 for a piece with several places, else the id of its document; with ``apart`` the places must be in
    different documents. Pieces of different ``shards`` aren't compared. ``owners`` and ``weights``: a piece's class, and how many documents have it (no document may have
    two classes, but as single places); a window is frequent if ``needs`` documents (0: none is) have it.
    """
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    counts = np.array([len(p) - length + 1 for p in pieces], dtype=np.int64)
    base = np.cumsum(counts) - counts
    tag = np.array(tags, dtype=np.int64)
    owner = np.array(owners if owners is not None else range(len(pieces)), dtype=np.int64)
    weight = np.array(weights if weights is not None else [1] * len(pieces), dtype=np.int64)
    need = np.array(needs if needs is not None else [0] * len(pieces), dtype=np.int64)
    # Window w of piece k has number base[k] + w, and starts at that number plus k * (length - 1) in the data.
    piece = np.repeat(np.arange(len(pieces)), counts)
    at = np.arange(len(piece)) + piece * (length - 1)
    hashes = range_hash(prefix_sums(data), at, at + length)
    first = np.zeros(len(piece), dtype=bool)
    first[base] = True
    order = np.argsort(hashes)
    equal = hashes[order[1:]] == hashes[order[:-1]]
    twin = np.zeros(len(piece), dtype=bool)
    twin[order[1:][equal]] = True
    twin[order[:-1][equal]] = True
    out = np.repeat(tag == 0, counts)
    often = np.repeat((need > 0) & (weight >= need), counts)
    # The suffix array is of the strings of windows that have a twin.
    starts, ends = runs_of(twin, first)
    if len(starts):
        sizes = ends - starts
        bytes_each = sizes + length - 1
        text = data[ranges_of(at[starts], bytes_each)]
        number = ranges_of(starts, sizes)
        window = np.full(len(text), -1, dtype=np.int64)
        window[ranges_of(np.cumsum(bytes_each) - bytes_each, sizes)] = number
        sa = suffix_array(text)
        prefix = common_prefixes(text, sa)
        # Neighbours with a common prefix of a window's length form groups; places across string ends drop out.
        group = np.cumsum(prefix[sa] < length)
        number = window[sa]
        group, number = group[number >= 0], number[number >= 0]
        if shards is not None:
            apart_by = np.unique(np.array(shards, dtype=np.int64), return_inverse=True)[1][piece[number]]
            order = np.lexsort((apart_by, group))
            group, number = group[order] * np.int64(len(pieces)) + apart_by[order], number[order]
        head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sizes = np.diff(np.append(head, len(group)))
        own = tag[piece[number]]
        several = np.logical_or.reduceat(own == 0, head)
        if apart:
            several |= np.minimum.reduceat(own, head) != np.maximum.reduceat(own, head)
        else:
            several |= sizes > 1
        out[number[np.repeat(several, sizes)]] = True
        if need.any():
            total = supports(np.repeat(np.arange(len(head)), sizes), own, owner[piece[number]], weight[piece[number]], len(head))
            needed = need[piece[number[head]]]
            often[number[np.repeat((needed > 0) & (total >= needed), sizes)]] = True

    def ranges(mask: np.ndarray) -> tuple[np.ndarray, ...]:
        begin, stop = runs_of(mask, first)
        k = piece[begin]
        return k, begin - base[k], stop - base[k]

    return ranges(out), ranges(often)


def search_shards(pieces: DataFrame, length: int, apart: bool, shard_bytes: int, total: int) -> DataFrame:
    """key, seg_hash and the ranges of repeating and of frequent windows of pieces (shard, key, seg_hash, base, tag, weight, need, piece).

    ``base`` is the piece's first window in its segment; some ``total`` bytes are expected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            shards, keys, hashes, bases, tags, weights, needs, own = zip(*held, strict=True)
            base = np.array(bases, dtype=np.int64)
            lists = []
            for piece, starts, ends in repeats_in_shard(list(own), list(tags), length, apart, list(shards), list(hashes), list(weights), list(needs)):
                offsets = pa.array(np.searchsorted(piece, np.arange(len(held) + 1)).astype(np.int32))
                lists += [pa.ListArray.from_arrays(offsets, pa.array((x + base[piece]).astype(np.int32))) for x in (starts, ends)]
            return columns(key=pa.array(keys, pa.int64()), seg_hash=pa.array(hashes, pa.int64()), starts=lists[0], ends=lists[1], often_starts=lists[2], often_ends=lists[3])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "seg_hash", "base", "tag", "weight", "need", "piece")), strict=True):
                if size >= min(shard_bytes, SEARCH_BYTES) and row[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
        if held:
            yield flush()

    parts = max(1, -(-total // shard_bytes))
    return pieces.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(run, FOUND)


def hot_windows(reps: DataFrame, length: int, apart: bool) -> DataFrame:
    """key, seg_hash and, as w, the windows (at, often) of the pieces of hot keys that others have too, by two hashes of each window."""

    def explode(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, other, ats, once, sizes = [], [], [], [], []
        for piece in batch.column("piece").to_pylist():
            data = np.frombuffer(piece, dtype=np.uint8)
            at, sums = np.arange(len(data) - length + 1), prefix_sums(data)
            hashes = range_hash(sums, at, at + length)
            first = np.zeros(len(at), dtype=bool)
            first[np.unique(hashes, return_index=True)[1]] = True
            for part, values in ((own, hashes), (other, fold([range_hash(sums, at, at + length // 2), range_hash(sums, at + length // 2, at + length)])), (ats, at), (once, first)):
                part.append(values)
            sizes.append(len(at))
        rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        kept = {c: batch.column(c).take(rows) for c in ("key", "seg_hash", "tag", "weight", "need")}
        return columns(**kept, own=np.concatenate(own).view(np.int64), other=np.concatenate(other).view(np.int64), at=pa.array(np.concatenate(ats).astype(np.int32)), once=np.concatenate(once))

    windows = map_batches(reps.select("key", "seg_hash", "tag", "weight", "need", "piece"), lambda: explode, "key long, seg_hash long, tag long, weight long, need long, own long, other long, at int, once boolean")
    documents = F.sum(F.when(F.col("once"), F.greatest("weight", F.lit(1))).otherwise(0))
    shared = windows.groupBy("key", "own", "other").agg(F.count(F.lit(1)).alias("n"), ((F.max("need") > 0) & (documents >= F.max("need"))).alias("often"), (F.min("tag") != F.max("tag")).alias("differ"), F.min(F.abs("tag")).alias("least"))
    shared = shared.filter("differ OR least = 0 OR often" if apart else "n > 1").select("key", "own", "other", "often")
    return windows.join(shared, ["key", "own", "other"]).groupBy("key", "seg_hash").agg(F.collect_list(F.struct("at", "often")).alias("w"))


def hot_parts(reps: DataFrame, length: int, apart: bool) -> DataFrame:
    """The runs of shared windows of hot keys, cut where the least hash of shorter substrings changes: equal windows are in parts with the same ``sub``."""
    gram = max(1, min(32, length // 4))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for k, (key, piece, windows) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "piece", "w")), strict=True)):
            at, often = np.array([w["at"] for w in windows], dtype=np.int64), np.array([w["often"] for w in windows], dtype=bool)
            order = np.argsort(at)
            at, often = at[order], often[order]
            for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1):
                start = int(at[run[0]])
                text = piece[start : start + len(run) - 1 + length]
                subs, _, begins, ends, _ = segments(np.frombuffer(text, dtype=np.uint8), length, gram)
                for sub, a, b in zip(fold([subs.view(np.uint64), np.full(len(subs), key, dtype=np.int64).view(np.uint64)]).view(np.int64).tolist(), begins.tolist(), ends.tolist(), strict=True):
                    part = text[a : b - 1 + length]
                    digest = hashlib.blake2b(part, digest_size=16).digest()
                    first, last = runs_of(often[run[a:b]], np.arange(b - a) == 0)
                    out.append((k, sub, start + a, b - a, part, *(int.from_bytes(digest[i : i + 8], "little", signed=True) for i in (0, 8)), first.tolist(), last.tolist()))
        types = {"sub": pa.int64(), "base": pa.int32(), "n": pa.int32(), "piece": pa.binary(), "d1": pa.int64(), "d2": pa.int64(), "often_starts": pa.list_(pa.int32()), "often_ends": pa.list_(pa.int32())}
        take = pa.array([r[0] for r in out], pa.int64())
        kept = {c: batch.column(c).take(take) for c in ("key", "seg_hash", "tag", "weight", "need")}
        return columns(**{c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(types.items(), start=1)}, **kept)

    asked = reps.join(hot_windows(reps, length, apart), ["key", "seg_hash"]).select("key", "seg_hash", "tag", "weight", "need", "piece", "w")
    return map_batches(asked, lambda: cut, "sub long, base int, n int, piece binary, d1 long, d2 long, often_starts array<int>, often_ends array<int>, key long, seg_hash long, tag long, weight long, need long")


def hot_shards(parts: DataFrame, apart: bool, shard_bytes: int) -> tuple[DataFrame, DataFrame]:
    """One piece for each different part of the sub-shards that are within ``shard_bytes``, and the ``sub`` of the others."""
    of_class = parts.groupBy("sub", "d1", "d2", "seg_hash").agg(F.count(F.lit(1)).alias("n"), F.min("tag").alias("low"), F.max("tag").alias("high"), F.max("weight").alias("weight"), F.max("need").alias("need"), F.min("piece").alias("piece"))
    once = of_class.groupBy("sub", "d1", "d2").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min(F.abs("low")).alias("least"), F.sum("weight").alias("weight"), F.max("need").alias("need"), F.min("piece").alias("piece"))
    sizes = once.groupBy("sub").agg(F.sum(F.octet_length("piece")).alias("n_bytes"))
    several = ((F.col("low") != F.col("high")) | (F.col("least") == 0)) if apart else (F.col("n") > 1) | (F.col("least") == 0)
    small = once.join(sizes.filter(F.col("n_bytes") <= shard_bytes).select("sub"), "sub", "left_semi")
    pieces = small.select(F.col("sub").alias("shard"), F.col("d1").alias("key"), F.col("d2").alias("seg_hash"), F.lit(0).alias("base"), F.when(several, 0).otherwise(F.col("low")).alias("tag"), "weight", "need", "piece")
    return pieces, sizes.filter(F.col("n_bytes") > shard_bytes).select("sub")


def search_hot(reps: DataFrame, length: int, apart: bool, shard_bytes: int) -> DataFrame:
    """FOUND for the pieces of hot keys: sub-shards are searched like others; one that is still too large has only windows that two hashes call equal to others', and they stand."""
    parts = materialize(hot_parts(reps, length, apart), "hot-parts")
    pieces, large = hot_shards(parts, apart, shard_bytes)
    pieces = materialize(pieces, "hot-pieces")
    total = pieces.agg(F.coalesce(F.sum(F.octet_length("piece")), F.lit(0))).first()[0]
    searched = search_shards(pieces, length, apart, shard_bytes, total).select(F.col("key").alias("d1"), F.col("seg_hash").alias("d2"), "starts", "ends", "often_starts", "often_ends")
    moved = lambda c: F.transform(c, lambda x: x + F.col("base")).alias(c)
    lists = [moved(c) for c in ("starts", "ends", "often_starts", "often_ends")]
    back = parts.select("key", "seg_hash", "base", "d1", "d2").join(searched, ["d1", "d2"]).select("key", "seg_hash", *lists)
    rest = parts.join(large, "sub", "left_semi").withColumns({"starts": F.array(F.lit(0)), "ends": F.array("n")}).select("key", "seg_hash", *lists)
    return back.unionByName(rest)


def classes_of(rows: DataFrame, length: int) -> DataFrame:
    """Equal segments as classes: those of keys that are met again, or repeat inside.

    ``rows`` are segments, with a ``need`` and their bytes as ``piece`` where documents are counted; then a class has a
    weight, the number of its documents, and is ``several`` only if it has two.
    """
    if "need" not in rows.columns:
        place = F.min(F.struct("doc_id", "row_key", "a", "b")).alias("place")
        grouped = rows.groupBy("key", "seg_hash").agg(F.count(F.lit(1)).alias("n"), place, F.max("self").alias("self"), F.lit(0).cast("long").alias("weight"), F.lit(0).cast("long").alias("need"))
        grouped = grouped.withColumn("several", F.col("n") > 1)
    else:
        once = rows.groupBy("key", "seg_hash", "doc_id", "row_key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("a", "b", "piece")).alias("at"), F.max("self").alias("self"), F.max("need").alias("need"))
        place = F.min(F.struct("doc_id", "row_key", F.col("at.a").alias("a"), F.col("at.b").alias("b"), F.col("at.piece").alias("piece"))).alias("place")
        grouped = once.groupBy("key", "seg_hash").agg(F.sum("n").alias("n"), place, F.max("self").alias("self"), F.count(F.lit(1)).alias("weight"), F.max("need").alias("need"))
        grouped = grouped.withColumn("several", F.col("weight") > 1)
    size = F.col("place.b") - F.col("place.a") - 1 + length
    keys = grouped.groupBy("key").agg((F.count(F.lit(1)) > 1).alias("mixed"), F.max("self").alias("inside"), F.sum("n").alias("n_key"), F.sum(size).alias("n_bytes")).filter("n_key > 1 OR inside")
    return materialize(grouped.drop("self").join(keys, "key").filter("mixed OR inside OR several"), "classes")


def _tag() -> Column:
    return F.when(F.col("several"), F.lit(0)).otherwise(F.xxhash64("doc_id", "row_key"))


def ranges_in(rows: DataFrame, classes: DataFrame, reps: DataFrame, length: int, apart: bool, shard_bytes: int) -> DataFrame:
    """doc_id, row_key and the ranges r (a, b, often) of repeating windows, of segments ``rows``.

    ``reps`` has a piece for each class whose key is mixed or repeats inside (key, seg_hash, tag, weight, need, n_bytes, piece).
    """
    hot = reps.filter(F.col("n_bytes") > shard_bytes)
    cool = reps.filter(F.col("n_bytes") <= shard_bytes).select("*", F.col("key").alias("shard"), F.lit(0).alias("base"))
    total = reps.agg(F.coalesce(F.sum(F.octet_length("piece")), F.lit(0))).first()[0]
    searched = search_shards(cool.drop("n_bytes"), length, apart, shard_bytes, total).unionByName(search_hot(hot, length, apart, shard_bytes))
    # Segments that repeat as a whole, of keys that are not searched or were split.
    none = F.array().cast("array<int>")
    whole = classes.filter("NOT mixed AND NOT inside").select("key", "seg_hash", "several", "weight", "need", (F.col("place.b") - F.col("place.a")).alias("n"))
    whole = whole.unionByName(hot.select("key", "seg_hash", (F.col("tag") == 0).alias("several"), "weight", "need", (F.octet_length("piece") - length + 1).alias("n"))).filter("several")
    frequent = (F.col("need") > 0) & (F.col("weight") >= F.col("need"))
    every = F.array(F.col("n").cast("int"))
    zero = F.array(F.lit(0))
    whole = whole.select("key", "seg_hash", zero.alias("starts"), every.alias("ends"), F.when(frequent, zero).otherwise(none).alias("often_starts"), F.when(frequent, every).otherwise(none).alias("often_ends"))
    found = materialize(searched.unionByName(whole).filter(F.size("starts") > 0), "found")
    moved = lambda c: F.transform(c, lambda x: x + F.col("a"))
    listed = lambda a, b, often: F.transform(F.arrays_zip(moved(a).alias("a"), moved(b).alias("b")), lambda r: F.struct(r.a.alias("a"), r.b.alias("b"), F.lit(often).alias("often")))
    own = rows.select("doc_id", "row_key", "key", "seg_hash", "a")
    return own.join(found, ["key", "seg_hash"]).select("doc_id", "row_key", F.explode(F.concat(listed("starts", "ends", False), listed("often_starts", "often_ends", True))).alias("r"))


def repeated_ranges(docs: DataFrame, length: int, gram: int, shard_bytes: int = 4_000_000) -> tuple[DataFrame, DataFrame]:
    """Two tables by (doc_id, row_key): the documents that may hold repeats, with text; and their repeating window ranges.

    ``docs`` has doc_id, row_key (which tells texts apart) and text. Range (a, b) means windows a to b - 1.
    """
    rows = materialize(find_segments(docs, length, gram), "segments")
    # Equal segments only: no search is needed. Else each class sends one representative to its key's shard.
    classes = classes_of(rows, length)
    wanted = classes.filter("mixed OR inside").select("key", "seg_hash", "several", "n_bytes", "place.*").withColumn("tag", _tag())
    per_doc = wanted.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("key", "seg_hash", "tag", "a", "b", "n_bytes")).alias("wanted"))
    affected = rows.join(classes.select("key").distinct(), "key", "left_semi").select("doc_id", "row_key").distinct()
    same = [F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")), F.col("l.row_key") == F.col("r.row_key")]
    marks = affected.alias("l").join(per_doc.alias("r"), same, "left").select("l.*", "r.wanted")
    held = docs.select("doc_id", "row_key", "text").alias("l").join(marks.alias("r"), same).select("l.*", "r.wanted")
    held = materialize(held, "held")

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for data, own in zip(utf8(batch), batch.column("wanted").to_pylist(), strict=True):
            out += [(w["key"], w["seg_hash"], w["tag"], 0, 0, w["n_bytes"], data[w["a"] : w["b"] - 1 + length]) for w in own or ()]
        types = {"key": pa.int64(), "seg_hash": pa.int64(), "tag": pa.int64(), "weight": pa.int64(), "need": pa.int64(), "n_bytes": pa.int64(), "piece": pa.binary()}
        return columns(**{c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(types.items())})

    # A repeated row would give its representatives twice; one of each is kept.
    once = held.filter("wanted IS NOT NULL").dropDuplicates(["doc_id", "row_key"])
    reps = materialize(map_batches(once, lambda: extract, "key long, seg_hash long, tag long, weight long, need long, n_bytes long, piece binary"), "pieces")
    return held, ranges_in(rows, classes, reps, length, False, shard_bytes)


def counted_ranges(rows: DataFrame, length: int, shard_bytes: int = 4_000_000) -> DataFrame:
    """The ranges of segments (with need and piece) that repeat in different documents, and of those that do so often: windows in ``need`` documents.

    Segments of one document with one key must have a ``seg_hash`` of the document's own where they differ, so that no
    document is counted twice.
    """
    classes = classes_of(rows, length)
    reps = classes.filter("mixed OR inside").select("key", "seg_hash", "several", "weight", "need", "n_bytes", "place.doc_id", "place.row_key", "place.piece")
    reps = reps.select("key", "seg_hash", _tag().alias("tag"), "weight", "need", "n_bytes", "piece")
    return ranges_in(rows, classes, reps, length, True, shard_bytes)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 128, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """One row per document: bytes, bytes removed, removed runs and a digest of the bytes left (``with_kept`` adds those bytes)."""
    own = keyed(docs, id_col, text_col)
    held, ranges = repeated_ranges(own, length, gram)
    ranges = ranges.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("r.a", "r.b")).alias("ranges"))
    same = [F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")), F.col("l.row_key") == F.col("r.row_key")]
    rows = held.select("doc_id", "row_key", "text").alias("l").join(ranges.alias("r"), same, "left").select("l.*", "r.ranges")
    rest = own.alias("l").join(held.select("doc_id", "row_key").distinct().alias("r"), same, "left_anti").select("l.*", F.lit(None).cast("array<struct<a:int,b:int>>").alias("ranges"))
    schema = SCHEMA + (", kept binary" if with_kept else "")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, removed, runs, digests, kept = [], [], [], [], []
            for data, own in zip(utf8(batch), batch.column("ranges").to_pylist(), strict=True):
                out, at, count, gone = [], 0, 0, -1
                for a, b in sorted((r["a"], r["b"] - 1 + length) for r in own or ()):
                    if a > gone:
                        out.append(data[max(at, 0) : a])
                        count += 1
                    gone = at = max(gone, b)
                out.append(data[at:])
                left = b"".join(out)
                for column, value in ((n, len(data)), (removed, len(data) - len(left)), (runs, count), (digests, hashlib.sha256(left).hexdigest()), (kept, left)):
                    column.append(value)
            more = {"kept": pa.array(kept, pa.binary())} if with_kept else {}
            return columns(doc_id=batch.column("doc_id"), n_bytes=pa.array(n, pa.int64()), n_removed=pa.array(removed, pa.int64()), n_spans=pa.array(runs, pa.int64()), kept_sha256=pa.array(digests, pa.string()), **more)

        return step

    return map_batches(rows.unionByName(rest), make, schema)


