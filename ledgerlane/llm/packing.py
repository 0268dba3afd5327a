"""Best-fit packing: exact complements by hashed length sums first, then best fit for what is left.

Lengths are at most ``capacity``, so the histogram of lengths has at most ``capacity`` rows whatever the input;
only it goes to the driver. There the plan is made on counts: for the longest length left, its gap is looked up
among single lengths, pair sums and triple sums, and each combination found is consumed as often as the counts
allow at once. What no combination fills exactly is placed by best fit (longest first, into the smallest gap that
holds it), again in whole groups. Plans with fewer kinds of exact fills are made too, down to plain best fit, and the one with
the fewest sequences is kept. A plan step empties a length or a group of equal sequences, so the plan has
O(capacity) steps. The pieces are then ranked within their length in a distributed way, and a piece's rank gives its
sequence and offset from the plan; no sequence is ever assembled in one task.

Cases: null text counts as empty, which is one end token; empty tables give empty results; long texts are cut whole
into pieces; repeated rows and repeated or null ids are packed as documents of their own; other columns are passed by.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, map_batches, materialize, slots, texts
from .tokens import crc, fast_encoder

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole pieces from the end, so only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """The pieces of every document, with a checksum of their ids, and the ids themselves on demand."""

    def make():
        encode = fast_encoder(tokenizer)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = defaultdict(list)
            for key, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                ids = np.append(encode(text), np.uint32(end_id))
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    for name, value in (("doc_id", key), ("piece", k), ("start", start), ("length", length), ("ids_crc32", crc(part))):
                        out[name].append(value)
                    if with_ids:
                        out["ids"].append(part.astype(np.int32))
            types = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.list_(pa.int32())}
            return columns(**{k: pa.array(v, types[k]) for k, v in out.items()})

        return step

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(chosen, make, PIECE_SCHEMA + (", ids array<int>" if with_ids else ""))


@dataclass
class Plan:
    """Groups of equal sequences: (how many, the lengths in each)."""

    groups: list[tuple[int, tuple[int, ...]]] = field(default_factory=list)

    def sequences(self) -> int:
        return sum(n for n, _ in self.groups)

    def segments(self) -> tuple[np.ndarray, ...]:
        """length, first rank, first sequence id and offset of every place in every group, by length and rank."""
        used: dict[int, int] = defaultdict(int)
        rows, sequence = [], 0
        for count, lengths in self.groups:
            at = 0
            for length in lengths:
                rows.append((length, used[length], sequence, at))
                used[length] += count
                at += length
            sequence += count
        return tuple(np.array(sorted(rows), dtype=np.int64).reshape(-1, 4).T)


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    """The plan for a histogram of lengths (1 to capacity): the best of those that look for exact fills of up to three, two, one or no further lengths.

    Exact fills use up short pieces that others would need, so that fewer of them, or none (plain best fit), may come out ahead.
    """
    least = -(-sum(length * n for length, n in counts.items()) // capacity)
    best: Plan | None = None
    for depth in (3, 2, 1, 0):
        plan = filled_plan(counts, capacity, depth)
        if best is None or plan.sequences() < best.sequences():
            best = plan
        if best.sequences() == least:
            break
    return best


def filled_plan(counts: dict[int, int], capacity: int, depth: int) -> Plan:
    """Exact fills of up to ``depth`` further lengths, then best fit."""
    have = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        have[length] = n
    plan = Plan()

    def consume(lengths: tuple[int, ...]) -> None:
        need = defaultdict(int)
        for x in lengths:
            need[x] += 1
        times = int(min(have[x] // k for x, k in need.items()))
        for x, k in need.items():
            have[x] -= times * k
        plan.groups.append((times, lengths))

    def one(gap: int) -> tuple[int, ...] | None:
        return (gap,) if gap >= 1 and have[gap] > 0 else None

    def two(gap: int) -> tuple[int, ...] | None:
        """The pair with sum ``gap`` whose longer part is longest."""
        longer = np.arange(gap - 1, (gap - 1) // 2, -1)
        ok = (have[longer] > 0) & (have[gap - longer] > (longer * 2 == gap))
        return (int(longer[first]), int(gap - longer[first])) if len(ok) and ok[first := int(ok.argmax())] else None

    def three(gap: int) -> tuple[int, ...] | None:
        for a in range(gap - 2, (gap - 1) // 3, -1):
            if have[a] > 0:
                have[a] -= 1
                pair = two(gap - a)
                have[a] += 1
                if pair and pair[0] <= a:
                    return (a, *pair)
        return None

    for length in range(capacity, 0, -1) if depth else ():
        while have[length] > 0:
            gap = capacity - length
            if gap == 0:
                consume((length,))
                continue
            have[length] -= 1
            found = (one(gap) if depth >= 1 else None) or (two(gap) if depth >= 2 else None) or (three(gap) if depth >= 3 else None)
            have[length] += 1
            if not found:
                break
            consume((length, *found))

    # Best fit: sequences that are still open, by their gap.
    open_by_gap: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    gaps = np.zeros(capacity + 1, dtype=bool)
    for length in range(capacity, 0, -1):
        left = int(have[length])
        while left > 0:
            fitting = np.flatnonzero(gaps[length:])
            if len(fitting):
                gap = length + int(fitting[0])
                n, inside = open_by_gap[gap].pop()
                gaps[gap] = bool(open_by_gap[gap])
                times, each = min(n, left), 1
                if n > times:
                    open_by_gap[gap].append((n - times, inside))
                    gaps[gap] = True
            else:
                gap, inside = capacity, ()
                each = min(capacity // length, left)
                times = left // each
            left -= times * each
            rest = gap - length * each
            open_by_gap[rest].append((times, inside + (length,) * each))
            gaps[rest] = True
    plan.groups += [group for groups in open_by_gap.values() for group in groups]
    return plan


def pack_documents(
    docs: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """One row per piece with its sequence and its offset there; ``with_ids`` adds the token ids themselves."""
    pieces = materialize(token_pieces(docs, capacity, tokenizer, end_id, id_col, text_col, with_ids), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    segments = plan_packing(counts, capacity).segments()
    shared = pieces.sparkSession.sparkContext.broadcast(segments)
    ranked = slots(pieces, ["length"], [F.col("doc_id"), F.col("piece"), F.col("start"), F.col("ids_crc32")], "rank")
    names = [c for c in ranked.columns if c != "rank"]

    def make():
        length, rank, sequence, offset = shared.value
        wide = np.int64(1 << 40)
        keys = length * wide + rank

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = batch.column("length").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, own[0] * wide + own[1], side="right") - 1
            return columns(**{c: batch.column(c) for c in names}, sequence_id=sequence[at] + own[1] - rank[at], offset=offset[at])

        return step

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return map_batches(ranked, make, f"{schema}, sequence_id long, offset long")
