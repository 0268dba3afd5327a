"""Benchmark decontamination: a prefix-filtered set join of document shingles with benchmark windows.

A window (``window`` consecutive item words) is a set of ``shingle``-word shingles. Shingles are ordered by rarity:
a first pass counts, over all documents, in how many of them each benchmark shingle occurs. Containment of a whole
window needs every one of its shingles, so one prefix token - its rarest - is necessary; windows whose rarest shingle
occurs nowhere can't match at all. The second pass joins document shingles with the prefix tokens, bounds each
candidate by position and length (the window must lie inside the document), and verifies it word by word.

The benchmark is taken in blocks of at most ``block_bytes`` of text, each broadcast by itself, with all documents
against each block; the usual benchmark is one block. Documents are never shuffled then.

Cases: null or empty texts (of documents or items) have no words and match nothing; items with fewer words than a
window are one window of all their words; an item that is repeated counts once by its id, null ids sort as ``null``;
repeated documents are reported alike; long texts are taken whole; empty tables give no hits or no rows; other columns
are passed by.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import fold
from .common import columns, map_batches, materialize, utf8

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
# Everything but digits, letters and bytes from 0x80 on separates words; A-Z become a-z.
_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_WORDS).split()


class Windows:
    """One block of the benchmark: vocabulary, distinct windows, the items of each, and the distinct shingles."""

    def __init__(self, items: list[tuple[str, bytes]], window: int, shingle: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for key, data in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(data)]
            for k in range(max(1, len(ids) - window + 1)) if ids else ():
                found[tuple(ids[k : k + window])].add(key)
        self.windows = [np.array(w, dtype=np.int64) for w in found]
        self.items = [sorted(k) for k in found.values()]
        self.shingle = shingle
        names: dict[tuple[int, int], int] = {}
        self.parts: list[np.ndarray] = []  # of each window, the numbers of its shingles in order
        for w in self.windows:
            size = min(shingle, len(w))
            self.parts.append(np.array([names.setdefault((size, int(h)), len(names)) for h in shingle_hashes(w, size)], dtype=np.int64))
        self.sizes = sorted({size for size, _ in names})
        self.lookup = {}
        for size in self.sizes:
            own = sorted((h, n) for (s, h), n in names.items() if s == size)
            self.lookup[size] = np.array([h for h, _ in own], dtype=np.uint64), np.array([n for _, n in own], dtype=np.int64)
        self.n_shingles = len(names)

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words], dtype=np.int64)

    def shingles_in(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each shingle size: positions in the document and the numbers of the benchmark shingles there."""
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        for size in self.sizes:
            starts = np.flatnonzero(known[size:] - known[:-size] == size) if len(ids) >= size else ()
            if len(starts):
                hashes = fold([ids[starts + k] for k in range(size)])
                have, numbers = self.lookup[size]
                at = np.minimum(np.searchsorted(have, hashes), len(have) - 1)
                same = have[at] == hashes
                yield size, starts[same], numbers[at[same]]

    def choose(self, frequency: np.ndarray) -> None:
        """Index the windows by their prefix token: the rarest shingle, if it occurs in any document."""
        self.prefix: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, part in enumerate(self.parts):
            rarest = int(np.argmin(frequency[part]))
            if frequency[part[rarest]] > 0:
                self.prefix[int(part[rarest])].append((k, rarest))
        self.is_prefix = np.zeros(self.n_shingles, dtype=bool)
        self.is_prefix[list(self.prefix)] = True

    def matches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, window number) of every occurrence of a window."""
        for _, starts, numbers in self.shingles_in(ids):
            chosen = self.is_prefix[numbers]
            for at, number in zip(starts[chosen].tolist(), numbers[chosen].tolist(), strict=True):
                for k, offset in self.prefix[number]:
                    start, w = at - offset, self.windows[k]
                    if start >= 0 and start + len(w) <= len(ids) and np.array_equal(ids[start : start + len(w)], w):
                        yield start, k


def shingle_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    n = len(ids) - size + 1
    return fold([ids[k : k + n] for k in range(size)])


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of about ``block_bytes``, one at a time on the driver."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for k in range(n):
        yield [(r.item_id, r.text.encode()) for r in items.filter(F.col("block") == k).select("item_id", "text").collect()]


def fit_prefix(docs: DataFrame, block: Windows, text_col: str) -> Broadcast:
    """Count each benchmark shingle over all documents, choose the prefix tokens, and broadcast the block."""
    context = docs.sparkSession.sparkContext
    plain = context.broadcast(block)

    def count(batches):
        own = plain.value
        total = np.zeros(own.n_shingles, dtype=np.int64)
        for batch in batches:
            for data in utf8(batch):
                for _, _, numbers in own.shingles_in(own.ids(words_of(data))):
                    total[np.unique(numbers)] += 1
        seen = np.flatnonzero(total)
        yield columns(shingle=seen, n=total[seen])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(block.n_shingles, dtype=np.int64)
    for r in found:
        frequency[r.shingle] = r.n
    block.choose(frequency)
    return context.broadcast(block)


def find_windows(docs: DataFrame, shared: Broadcast, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key, n_words, starts and ends of the hit runs, and the items found, for one block."""
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))

    def make():
        own: Windows = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_words, starts, ends, items = [], [], [], []
            for data in utf8(batch):
                words = words_of(data)
                found = list(own.matches(own.ids(words)))
                n_words.append(len(words))
                hit = sorted({(s, s + len(own.windows[k])) for s, k in found})
                starts.append([s for s, _ in hit])
                ends.append([e for _, e in hit])
                items.append(sorted({i for k in {k for _, k in found} for i in own.items[k]}))
            return columns(
                doc_id=batch.column("doc_id"), key=batch.column("key"), n_words=pa.array(n_words, pa.int64()),
                starts=pa.array(starts, pa.list_(pa.int64())), ends=pa.array(ends, pa.list_(pa.int64())), items=pa.array(items, pa.list_(pa.string())),
            )

        return step

    return map_batches(chosen, make, "doc_id long, key long, n_words long, starts array<long>, ends array<long>, items array<string>")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 8_000_000,
) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark window; one filter for each block."""
    schema = docs.schema
    for items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        shared = fit_prefix(docs, Windows(items, window, shingle), text_col)

        def make(shared=shared):
            own: Windows = shared.value

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                return batch.filter(pa.array([next(own.matches(own.ids(words_of(data))), None) is None for data in utf8(batch, text_col)], pa.bool_()))

            return step

        docs = map_batches(docs, make, schema)
    return docs


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 8_000_000,
) -> DataFrame:
    """One row per document: words, hit words, items found, their digest, and whether any word is hit."""
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    found = [find_windows(docs, fit_prefix(docs, Windows(items, window, shingle), text_col), id_col, text_col) for items in blocks]
    if len(found) == 1:
        merged = found[0]
    else:
        # Rows with the same id and text are alike in each block: merge by them, then give back as many as there were.
        parts = [materialize(f, "windows") for f in found]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        merged = (
            rows.withColumn("runs", F.arrays_zip("starts", "ends"))
            .groupBy("doc_id", "key", "n_words")
            .agg(F.array_distinct(F.flatten(F.collect_set("runs"))).alias("runs"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.count(F.lit(1)).alias("copies"))
            .withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("copies") / len(found)).cast("int"))))
            .select("doc_id", "key", "n_words", F.col("runs.starts").alias("starts"), F.col("runs.ends").alias("ends"), "items")
        )

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            hit, items, digests = [], [], []
            for starts, ends, own in zip(*(batch.column(c).to_pylist() for c in ("starts", "ends", "items")), strict=True):
                covered, at = 0, 0
                for s, e in sorted(zip(starts, ends, strict=True)):
                    covered += max(0, e - max(s, at))
                    at = max(at, e)
                hit.append(covered)
                items.append(len(own))
                digests.append(hashlib.sha256(",".join(sorted(own)).encode()).hexdigest())
            return columns(
                doc_id=batch.column("doc_id"), n_words=batch.column("n_words"), n_hit=pa.array(hit, pa.int64()), n_items=pa.array(items, pa.int64()),
                items_sha256=pa.array(digests, pa.string()), contaminated=pa.array([h > 0 for h in hit], pa.bool_()),
            )

        return step

    return map_batches(merged, make, SCHEMA)
