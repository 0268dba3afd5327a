"""N-gram Jaccard join under several global token orders, and the components of its links.

A document's set is its distinct word shingles. Equal sets are one class. For a threshold t a pair of sets can only
link if it shares a token among the first n - ceil(t * n) + 1 of each, in every global order of the tokens; so
candidates must share prefix tokens under each of ``orders`` orders, and the filters are intersected:

1. The tokens whose hash is below a fixed share come first in every order; only these are counted. Each batch of
   documents sends its distinct tokens of that kind, as blocks of numbers, to the task of their hash range and gets
   back how often they occur, where more than one class has them. No token is a row, and one that is in a third of
   all documents is one number a batch. A batch is as many documents as have ``BATCH_TOKENS``, as there is a block for
   each batch and range.
2. An order puts tokens by that count, rare ones first, and then by a hash of the order's own; tokens outside the
   counted share (needed by short texts only) follow by hash. Tokens met once have no partner, so a document whose
   prefix is full of them is done; all others send the prefix tokens that others have, too.
3. For every order, the classes with a prefix token in common have a hub, the one with the most such tokens. A group
   is the classes with the same hub under the first and the same hub under the second order (and so on): each linking
   pair is together in a group, and a chance hit under one order finds no partner under the other. A group is cut
   where its sets' sizes are too far apart to link, which most chance hits are, and equal groups are kept once.
4. One text of each class is sent, packed, to each of the class's groups; sets are made there and pairs verified exactly.
   A group beyond ``block`` classes or ``block_tokens`` tokens is dealt into blocks, each with the group's hub. First every
   block is searched by itself. What a block's members join to the hub is one component over all blocks, so only the
   members left out of it are then sent to the other blocks: a group of near copies is verified in linear time. A task
   returns links that join what its verified pairs join, not all pairs.
5. Components come from joins of labels along the links, with tables written in between.

Classes are told apart by 64-bit hashes of their sorted token hashes.

Cases: null or empty texts and texts without words have an empty set and link with nothing; with fewer words than a
shingle the whole sequence is the shingle; repeated rows are copies of one class; a null id is never the smallest
unless all ids of its component are null; empty tables give empty results; long texts are taken whole; other columns
are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytehash import U64, fold, prefix_sums, range_hash, spans, splitmix
from .common import SLICE, columns, map_batches, materialize, utf8, weighed

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


#: Counted tokens, and documents, after which a batch is sent.
BATCH_TOKENS, BATCH_DOCS = 1 << 19, 65_535


def joined_sets(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles, one text's after the other's, and how many each has."""
    text = np.frombuffer(b" ".join(texts).translate(_LOWER), dtype=np.uint8)
    start, end = spans(_IS_WORD[text]) if len(text) else (np.zeros(0, dtype=np.int64),) * 2
    if not len(start):
        return np.zeros(0, dtype=U64), np.zeros(len(texts), dtype=np.int64)
    words = range_hash(prefix_sums(text), start, end)
    last = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]) - 1)
    n_words = np.diff(last, prepend=0)
    short = (n_words > 0) & (n_words < shingle)
    counts = np.where(short, 1, np.maximum(n_words - shingle + 1, 0))
    ends = np.cumsum(counts)
    tokens, whole = np.empty(ends[-1], dtype=U64), np.ones(ends[-1], dtype=bool)
    for k in np.flatnonzero(short):
        whole[ends[k] - 1] = False
        tokens[ends[k] - 1] = fold([words[w : w + 1] for w in range(last[k] - n_words[k], last[k])])[0]
    if (n := len(words) - shingle + 1) > 0:
        inside = np.repeat(last, n_words)[:n] - np.arange(n) >= shingle
        tokens[whole] = fold([words[k : k + n] for k in range(shingle)])[inside]
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        tokens[a:b].sort()
    new = np.append(True, tokens[1:] != tokens[:-1])
    new[(ends - counts)[counts > 0]] = True
    upto = np.append(0, np.cumsum(new))
    return tokens[new], upto[ends] - upto[ends - counts]


def shingle_sets(texts: list[bytes], shingle: int, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """As ``joined_sets``, with some ``most`` bytes at once; a longer text is taken by itself."""
    found, at = [], 0
    while at < len(texts):
        stop, total = at + 1, len(texts[at])
        while stop < len(texts) and total + len(texts[stop]) < most:
            total += len(texts[stop]) + 1
            stop += 1
        found.append(joined_sets(texts[at:stop], shingle))
        at = stop
    return np.concatenate([np.zeros(0, dtype=U64), *(t for t, _ in found)]), np.concatenate([np.zeros(0, dtype=np.int64), *(n for _, n in found)])


def shingle_set(data: bytes, shingle: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    return joined_sets([data], shingle)[0]


def set_ids(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, from its sorted token hashes; 0 for an empty one."""
    out, some = np.zeros(len(sizes), dtype=U64), sizes > 0
    if some.any():
        first = (np.cumsum(sizes) - sizes)[some]
        mixed = splitmix(tokens + np.repeat(sizes, sizes).astype(U64))
        out[some] = splitmix(np.add.reduceat(mixed, first)) ^ np.bitwise_xor.reduceat(splitmix(mixed ^ U64(0x5851F42D4C957F2D)), first)
    return out.view(np.int64)


def prefix_size(n: int, percent: int) -> int:
    """n - ceil(percent / 100 * n) + 1."""
    return n - -(-percent * n // 100) + 1


def counted_share(percent: int) -> np.uint64:
    """Hashes below this are counted: 1.6 times the share of tokens that a prefix takes."""
    return U64(min(0.9, 1.6 * (1 - percent / 100)) * 2**64)


def place(tokens: np.ndarray) -> np.ndarray:
    """The hash by which tokens are in or out of the counted share."""
    return splitmix(tokens ^ U64(0x2545F4914F6CDD1D))


def token_blocks(docs: DataFrame, shingle: int, percent: int, ranges: int) -> DataFrame:
    """Two kinds of rows. A batch's documents (part -1): ids, keys, classes, set sizes, and their tokens in blocks.
    A batch's distinct counted tokens of a hash range (part 0 and up), with how many of its classes have each."""
    share = counted_share(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, keys, cids, sizes, held, counted, total = [], [], [], [], [], {}, 0
        for batch in (part for batch in batches for part in weighed(batch, "text")):
            tokens, lengths = shingle_sets(utf8(batch), shingle)
            at = place(tokens)
            inside = at < share
            end = 0
            for cid, n in zip(set_ids(tokens, lengths).tolist(), lengths.tolist(), strict=True):
                start, end = end, end + n
                cids.append(cid)
                sizes.append(n)
                if not n or cid in counted:
                    held.append(tokens[:0])
                    continue
                chosen = inside[start:end]
                own = counted[cid] = tokens[start:end][chosen]
                if (short := prefix_size(n, percent) - len(own)) > 0:
                    outside = np.flatnonzero(~chosen)
                    chosen[outside[np.argsort(at[start:end][outside], kind="stable")[:short]]] = True
                    own = tokens[start:end][chosen]
                held.append(own)
                total += len(own)
            ids += batch.column("doc_id").to_pylist()
            keys += batch.column("row_key").to_pylist()
            if total >= BATCH_TOKENS or len(cids) > BATCH_DOCS - SLICE:
                yield from sent(number, ids, keys, cids, sizes, held, counted)
                number += 1
                ids, keys, cids, sizes, held, counted, total = [], [], [], [], [], {}, 0
        if cids:
            yield from sent(number, ids, keys, cids, sizes, held, counted)

    def sent(number: int, ids: list, keys: list, cids: list, sizes: list, held: list, counted: dict) -> Iterator[pa.RecordBatch]:
        yield columns(
            batch=pa.array([number], pa.int64()), part=pa.array([-1], pa.int32()), doc_ids=pa.array([ids], pa.list_(pa.int64())),
            row_keys=pa.array([keys], pa.list_(pa.int64())), cids=pa.array([cids], pa.list_(pa.int64())), sizes=pa.array([sizes], pa.list_(pa.int64())),
            kept=pa.array([np.array([len(h) for h in held], dtype=np.int32).tobytes()], pa.binary()), tokens=pa.array([np.concatenate(held).tobytes()], pa.binary()),
        )
        every = np.concatenate([*counted.values(), np.zeros(0, dtype=U64)])
        if not len(every):
            return
        distinct, first, counts = np.unique(every, return_index=True, return_counts=True)
        # A token of one class is sent with a hash of the class: copies of it elsewhere don't make it shared.
        owner = np.repeat(np.array(list(counted), dtype=np.int64).view(U64) & U64(0xFFFFFFFE), [len(t) for t in counted.values()])[first].astype(np.uint32)
        owner[counts > 1] = 1
        of = (splitmix(distinct ^ U64(0x9E6C63D0876A9A35)) % U64(ranges)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        ends = np.cumsum(np.bincount(of, minlength=ranges))
        parts = [(r, order[(ends[r - 1] if r else 0) : ends[r]]) for r in range(ranges)]
        parts = [(r, p) for r, p in parts if len(p)]
        none = lambda kind: pa.array([None] * len(parts), kind)
        yield columns(
            batch=pa.array([number] * len(parts), pa.int64()), part=pa.array([r for r, _ in parts], pa.int32()), doc_ids=none(pa.list_(pa.int64())), row_keys=none(pa.list_(pa.int64())),
            cids=none(pa.list_(pa.int64())), sizes=none(pa.list_(pa.int64())), kept=pa.array([np.minimum(counts[p], 65_535).astype(np.uint16).tobytes() + owner[p].tobytes() for _, p in parts], pa.binary()),
            tokens=pa.array([distinct[p].tobytes() for _, p in parts], pa.binary()),
        )

    return docs.select("doc_id", "row_key", "text").mapInArrow(run, "batch long, part int, doc_ids array<long>, row_keys array<long>, cids array<long>, sizes array<long>, kept binary, tokens binary")


def shared_tokens(blocks: DataFrame, ranges: int) -> DataFrame:
    """batch, tokens and levels (the logarithm of the count) of tokens that occur more than once, for each batch that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("batch", "kept", "tokens")), strict=True)]
        if not rows:
            return
        tokens = np.concatenate([np.frombuffer(t, dtype=U64) for _, _, t in rows])
        counts = np.concatenate([np.frombuffer(c, dtype=np.uint16, count=len(t) // 8) for _, c, t in rows]).astype(np.int64)
        owners = np.concatenate([np.frombuffer(c, dtype=np.uint32, offset=len(t) // 4) for _, c, t in rows])
        order = np.argsort(tokens)
        ordered = tokens[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        totals = np.add.reduceat(counts[order], first)
        # Owner 1 stands for several classes in a batch; else two different owners make a token shared.
        low, high = np.minimum.reduceat(owners[order], first), np.maximum.reduceat(owners[order], first)
        levels = np.where((low == 1) | (low != high), np.maximum(np.ceil(np.log2(totals)), 1), 0).astype(np.uint8)
        level = np.empty(len(tokens), dtype=np.uint8)
        level[order] = np.repeat(levels, np.diff(np.append(first, len(tokens))))
        at, out, total = 0, [], 0
        for number, _, block in rows:
            end = at + len(block) // 8
            chosen = np.flatnonzero(level[at:end]) + at
            if len(chosen):
                out.append((number, tokens[chosen].tobytes(), level[chosen].tobytes()))
                total += len(chosen)
            if total >= BATCH_TOKENS:
                yield blocks_of(out)
                out, total = [], 0
            at = end
        if out:
            yield blocks_of(out)

    def blocks_of(out: list[tuple]) -> pa.RecordBatch:
        return columns(batch=pa.array([o[0] for o in out], pa.int64()), tokens=pa.array([o[1] for o in out], pa.binary()), levels=pa.array([o[2] for o in out], pa.binary()))

    return blocks.filter("part >= 0").select("batch", "part", "kept", "tokens").repartition(ranges, "part").mapInArrow(run, "batch long, tokens binary, levels binary")


def prefix_rows(blocks: DataFrame, shared: DataFrame, percent: int, orders: int) -> DataFrame:
    """cid, order, token, weight (the class's number of such tokens) and n (its set's size): prefix tokens that other documents have as well."""
    share = counted_share(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, known = None, []

        def finish(row: tuple) -> pa.RecordBatch | None:
            cids, sizes, kept, block = row
            have = np.concatenate([t for t, _ in known]) if known else np.zeros(0, dtype=U64)
            levels = np.concatenate([v for _, v in known]) if known else np.zeros(0, dtype=np.uint8)
            by = np.argsort(have)
            have, levels = have[by], levels[by]
            tokens = np.frombuffer(block, dtype=U64)
            level = np.zeros(len(tokens), dtype=np.uint8)
            if len(have):
                at = np.minimum(np.searchsorted(have, tokens), len(have) - 1)
                level = np.where(have[at] == tokens, levels[at], 0).astype(np.uint8)
            outside = place(tokens) >= share
            level[outside] = 64
            ranks = []
            for k in range(orders):
                mixed = splitmix(tokens ^ U64(0xA0761D6478BD642F * (k + 1) % (1 << 64)))
                ranks.append((np.where(outside, place(tokens), mixed) >> U64(8)) | (level.astype(U64) << U64(56)))
            ends = np.cumsum(np.frombuffer(kept, dtype=np.int32))
            out: list[tuple] = []
            for cid, n, end, count in zip(cids, sizes, ends.tolist(), np.frombuffer(kept, dtype=np.int32).tolist(), strict=True):
                if not count:
                    continue
                start, size = end - count, min(prefix_size(n, percent), count)
                found = []
                for rank in ranks:
                    own = rank[start:end]
                    chosen = np.argpartition(own, size - 1)[:size] + start if size < count else np.arange(start, end)
                    found.append(chosen[level[chosen] > 0])
                if all(len(f) for f in found):
                    out += [(cid, k, tokens[f].view(np.int64), len(found[0]), n) for k, f in enumerate(found)]
            if not out:
                return None
            sizes_out = [len(o[2]) for o in out]
            spread = lambda values, kind: np.repeat(np.array(values, dtype=kind), sizes_out)
            return columns(cid=spread([o[0] for o in out], np.int64), order=spread([o[1] for o in out], np.int32), token=np.concatenate([o[2] for o in out]), weight=spread([o[3] for o in out], np.int32), n=spread([o[4] for o in out], np.int64))

        # Within a batch the shared tokens come first and the documents' row last.
        for batch in batches:
            for number, last, cids, sizes, kept, tokens, levels in zip(*(batch.column(c).to_pylist() for c in ("batch", "last", "cids", "sizes", "kept", "tokens", "levels")), strict=True):
                if number != current:
                    current, known = number, []
                if not last:
                    known.append((np.frombuffer(tokens, dtype=U64), np.frombuffer(levels, dtype=np.uint8)))
                elif (found := finish((cids, sizes, kept, tokens))) is not None:
                    yield found

    none = F.lit(None)
    docs = blocks.filter("part < 0").select("batch", F.lit(True).alias("last"), "cids", "sizes", "kept", "tokens", none.cast("binary").alias("levels"))
    back = shared.select("batch", F.lit(False).alias("last"), none.cast("array<long>").alias("cids"), none.cast("array<long>").alias("sizes"), none.cast("binary").alias("kept"), "tokens", "levels")
    return docs.unionByName(back).repartition("batch").sortWithinPartitions("batch", "last").mapInArrow(run, "cid long, order int, token long, weight int, n long")


def hubs(rows: DataFrame, order: int, name: str) -> DataFrame:
    """cid and hub for one order: of each prefix token that several classes share, the class with the most such tokens.

    Tokens are aggregated before they are shuffled; the rows of a frequent one meet its hub in several tasks (a skewed join).
    """
    tokens = rows.filter(F.col("order") == order).select("token", "cid", "weight")
    rank = F.struct((-F.col("weight")).alias("less"), F.xxhash64("cid").alias("mixed"), F.col("cid").alias("cid"))
    shared = tokens.groupBy("token").agg(F.min(rank).alias("low"), F.max(rank).alias("high")).filter("low.cid != high.cid").select("token", F.col("low.cid").alias(name))
    return tokens.select("token", "cid").join(shared, "token").select("cid", name).distinct()


def candidate_groups(rows: DataFrame, percent: int, orders: int, block: int, block_tokens: int) -> DataFrame:
    """cid and the groups (k: key) where it meets its candidates: its block i of ``blocks``, and whether it is the group's hub.

    The hub is in each of its group's blocks.
    """
    found = hubs(rows, 0, "h0")
    for k in range(1, orders):
        found = found.join(hubs(rows, k, f"h{k}"), "cid")
    found = found.join(rows.filter("order = 0").groupBy("cid").agg(F.max("n").alias("n")), "cid")
    found = found.select(F.xxhash64(*[f"h{k}" for k in range(orders)]).alias("met"), "cid", "n", (F.col("cid") != F.col("h0")).alias("other"))
    found = by_size(materialize(found, "met"), percent)
    first = F.min(F.struct("other", "cid")).alias("first")
    same = [F.bit_xor(F.xxhash64("cid", F.lit(k))).alias(f"same{k}") for k in range(2)]
    sizes = found.groupBy("met", "low").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("tokens"), first, *same).filter("size > 1")
    # Equal groups, told by two 64-bit hashes of their members, are searched once.
    sizes = sizes.groupBy("size", "tokens", "same0", "same1").agg(F.min(F.struct("met", "low", "first.cid")).alias("one")).select("size", "tokens", "one.met", "one.low", F.col("one.cid").alias("first"))
    found = found.join(sizes, ["met", "low"]).withColumn("k", F.xxhash64("met", "low"))
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("tokens") / block_tokens)).cast("int")
    found = found.select("cid", "k", "n", blocks.alias("blocks"), (F.col("cid") == F.col("first")).alias("hub"))
    own = F.array(F.pmod(F.xxhash64("cid", "k"), F.col("blocks")).cast("int"))
    return found.select("cid", "k", "n", "blocks", "hub", F.explode(F.when(F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)).alias("i"))


def by_size(found: DataFrame, percent: int) -> DataFrame:
    """Members (met: key, n: size) with the least size of their part (low): a key's sizes are cut where the next is too large to link with the one before.

    Only distinct sizes are sorted, not members.
    """
    order = Window.partitionBy("met").orderBy("n")
    sizes = found.select("met", "n").distinct().withColumn("before", F.lag("n").over(order))
    begins = F.when(F.col("before").isNull() | (100 * F.col("before") < percent * F.col("n")), F.col("n"))
    sizes = sizes.select("met", "n", F.max(begins).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("low"))
    return found.join(sizes, ["met", "n"])


def merge(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels (the least member of each component) once the given pairs are joined too."""
    while True:
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            return label
        left, right = left[apart], right[apart]
        low, high = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
        root = np.arange(len(label))
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
        label = root[label]


def verified_labels(sets: list[np.ndarray], percent: int, asking: np.ndarray | None = None) -> np.ndarray:
    """The least member that each set of a group is joined to by its verified pairs; with ``asking`` only pairs with one of these sets count."""
    count = len(sets)
    if count == 2:
        both = np.sort(np.concatenate(sets))
        overlap = int((both[1:] == both[:-1]).sum())
        return np.array([0, 0 if 100 * overlap >= percent * (len(both) - overlap) else 1])
    sizes = np.array([len(s) for s in sets])
    label = np.arange(count)
    tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(count), sizes)
    common = np.bincount(at, minlength=len(tokens)) > 1
    keep = common[at]
    number = np.cumsum(common) - 1
    at, rows = number[at[keep]], rows[keep]
    n_common = int(common.sum())
    step, wide = 512, 8192
    tiles = [(a, min(count, a + step)) for a in range(0, count, step)]

    def dense(a: int, b: int, lo: int, hi: int) -> np.ndarray:
        out = np.zeros((b - a, hi - lo), dtype=np.float32)
        first, last = np.searchsorted(rows, (a, b))
        part = at[first:last]
        chosen = np.flatnonzero((part >= lo) & (part < hi)) + first
        out[rows[chosen] - a, at[chosen] - lo] = 1
        return out

    for p, (a, b) in enumerate(tiles):
        for c, d in tiles[p:]:
            if asking is not None and not (asking[a:b].any() or asking[c:d].any()):
                continue
            overlap = np.zeros((b - a, d - c), dtype=np.float64)
            for lo in range(0, n_common, wide):
                hi = min(n_common, lo + wide)
                left = dense(a, b, lo, hi)
                overlap += left @ (left if a == c else dense(c, d, lo, hi)).T
            union = sizes[a:b, None] + sizes[None, c:d] - overlap
            x, y = np.nonzero(100 * overlap >= percent * union)
            label = merge(label, x + a, y + c)
    return label


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, row_key and the text as compressed UTF-8: hashes of a set don't compress, the words do."""

    def make():
        pack = zstandard.ZstdCompressor(level=1).compress

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return columns(doc_id=batch.column("doc_id"), row_key=batch.column("row_key"), packed=pa.array([pack(d) for d in utf8(batch)], pa.binary()))

        return step

    return map_batches(docs.select("doc_id", "row_key", "text"), make, "doc_id long, row_key long, packed binary")


def links_in_groups(members: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) of the members of each (k, i, j); members have cid, hub, asks and a packed text.

    A row with b null is a member of a group of several blocks that its own block doesn't join to the hub. Where a
    member asks, only pairs with one that asks are verified.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        unpack = zstandard.ZstdDecompressor().decompress

        def flush() -> list[tuple]:
            if not held:
                return []
            cids = np.array(sorted(held), dtype=np.int64)
            own = [held[int(c)] for c in cids]
            asking = np.array([asks for _, _, asks, _ in own])
            label = verified_labels([s for s, _, _, _ in own], percent, asking if asking.any() else None) if len(own) > 1 else np.zeros(1, dtype=np.int64)
            out = [(key[0], key[1], int(cids[label[x]]), int(cids[x])) for x in np.flatnonzero(label != np.arange(len(label)))]
            top = [label[x] for x, (_, hub, _, _) in enumerate(own) if hub]
            if own[0][3] > 1 and top:
                out += [(key[0], key[1], int(cids[x]), None) for x in np.flatnonzero(label != top[0])]
            return out

        def send(out: list[tuple]) -> pa.RecordBatch:
            return columns(**{c: pa.array([r[x] for r in out], t) for x, (c, t) in enumerate({"k": pa.int64(), "i": pa.int32(), "a": pa.int64(), "b": pa.int64()}.items())})

        for batch in (part for batch in batches for part in weighed(batch, "packed", 1 << 20)):
            out: list[tuple] = []
            tokens, lengths = shingle_sets([unpack(p) for p in batch.column("packed").to_pylist()], shingle)
            sets = np.split(tokens, np.cumsum(lengths)[:-1])
            for *own, cid, hub, asks, blocks, held_set in zip(*(batch.column(c).to_pylist() for c in names[:-1]), sets, strict=True):
                if own != key:
                    out += flush()
                    key, held = own, {}
                held[cid] = held_set, hub, asks, blocks
            if out:
                yield send(out)
        if out := flush():
            yield send(out)

    names = ("k", "i", "j", "cid", "hub", "asks", "blocks", "packed")
    return members.select(*names).repartition("k", "i", "j").sortWithinPartitions("k", "i", "j").mapInArrow(run, "k long, i int, a long, b long")


def group_links(groups: DataFrame, classes: DataFrame, own: DataFrame, shingle: int, percent: int, block: int, block_tokens: int) -> DataFrame:
    """The links (a, b) of all groups, in two rounds: each block by itself, then what isn't joined to its hub against the other blocks."""
    same = [F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")), F.col("l.row_key") == F.col("r.row_key")]
    names = ("k", "i", "j", "blocks", "hub", "asks")

    def chosen(rows: DataFrame) -> DataFrame:
        met = rows.groupBy("cid").agg(F.collect_list(F.struct(*names)).alias("groups"))
        return classes.join(met, "cid").select(F.col("first.doc_id").alias("doc_id"), F.col("first.row_key").alias("row_key"), "cid", "groups")

    once = groups.withColumns({"j": F.lit(-1), "asks": F.lit(False)})
    texts_of = packed_texts(own).alias("l").join(chosen(once).alias("r"), same).select("r.cid", "l.packed", F.explode("r.groups").alias("g"))
    first = materialize(links_in_groups(texts_of.select("cid", "packed", "g.*"), shingle, percent), "block-links")
    links = first.filter("b IS NOT NULL").select("a", "b")
    left = first.filter("b IS NULL").select("k", F.col("i").alias("home"), F.col("a").alias("cid"))
    if not left.limit(1).count():
        return links
    # What is left of a group is dealt into parts of a block's size; each part meets each block but its members' own.
    left = materialize(left.join(groups.filter("NOT hub").select("k", "cid", "blocks", "n"), ["k", "cid"]), "left")
    parts = left.groupBy("k").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / block_tokens)).cast("int").alias("parts"))
    dealt = left.join(parts, "k").withColumn("j", F.pmod(F.xxhash64("cid", "k"), F.col("parts")).cast("int"))
    asking = dealt.select("cid", "k", "j", "blocks", "home", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")).filter("i <> home")
    met = asking.select("k", "i", "j").distinct()
    asked = groups.join(met, ["k", "i"]).select("cid", "k", "i", "j", "blocks", F.lit(False).alias("asks"))
    every = asking.select("cid", "k", "i", "j", "blocks", F.lit(True).alias("asks")).unionByName(asked).withColumn("hub", F.lit(False))
    again = materialize(chosen(every), "asking")
    texts_of = own.alias("l").join(again.alias("r"), same).select(F.col("r.cid").alias("doc_id"), F.lit(0).cast("long").alias("row_key"), "l.text", "r.groups")
    sets = packed_texts(texts_of.select("doc_id", "row_key", "text").dropDuplicates(["doc_id"])).select(F.col("doc_id").alias("cid"), "packed")
    spread = again.select("cid", F.explode("groups").alias("g")).select("cid", "g.*").join(sets, "cid")
    return links.unionByName(links_in_groups(spread, shingle, percent).filter("b IS NOT NULL").select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """node and label (the least node that it is joined to), by turns until nothing changes.

    A label is a node of the same component, none greater than the node. In a turn a node takes the least label of its
    neighbours, its label's node is hooked to the least label that its nodes met, and labels jump to their labels'
    labels, so that trees of labels merge and get flat together; turns grow with the logarithm of a component's size.
    """
    both = materialize(links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("l")).select("l.*").distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = materialize(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("near")), "met")
        hook = met.groupBy("label").agg(F.min("near").alias("hook")).withColumnRenamed("label", "node")
        hooked = met.join(hook, "node", "left").select("node", "label", F.least("near", F.coalesce("hook", "near")).alias("new"))
        hooked = materialize(hooked, "hooked")
        jump = hooked.select(F.col("node").alias("new"), F.col("new").alias("far"))
        new = materialize(hooked.join(jump, "new").select("node", F.least("new", "far").alias("new"), F.col("label").alias("old")), "labels")
        labels = new.select("node", F.col("new").alias("label"))
        if not new.filter("new != old").limit(1).count():
            return labels


def jaccard_components(
    docs: DataFrame, shingle: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text",
    orders: int = 2, ranges: int | None = None, block: int = 2048, block_tokens: int = 4_000_000,
) -> DataFrame:
    """One row per document: doc_id, row_key, n_shingles, cid (its class; 0 for an empty set) and component_id."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Hash ranges of some two million counted tokens at most: a token and its space have two bytes or more, mostly six.
    ranges = ranges or max(8, (own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 40_000_000)
    blocks = materialize(token_blocks(own, shingle, percent, ranges), "blocks")
    rows = blocks.filter("part < 0").select(F.explode(F.arrays_zip("doc_ids", "row_keys", "cids", "sizes")).alias("d"))
    rows = rows.select(F.col("d.doc_ids").alias("doc_id"), F.col("d.row_keys").alias("row_key"), F.col("d.cids").alias("cid"), F.col("d.sizes").alias("n"))
    classes = rows.filter("n > 0").groupBy("cid").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_key"))).alias("first"), F.min("doc_id").alias("least"))
    prefixes = materialize(prefix_rows(blocks, shared_tokens(blocks, ranges), percent, orders), "prefixes")
    groups = materialize(candidate_groups(prefixes, percent, orders, block, block_tokens), "groups")
    found = components(group_links(groups, classes, own, shingle, percent, block, block_tokens))
    labelled = classes.select("cid", "least").join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    by_class = labelled.join(least, "label").select("cid", "component_id")
    out = rows.select("doc_id", "row_key", "cid", "n").join(by_class, "cid", "left")
    return out.select("doc_id", "row_key", F.col("n").alias("n_shingles"), "cid", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **more: int) -> DataFrame:
    """The documents, with all their columns, of which each component keeps the one of least id (one row of it); empty sets all stay."""
    found = jaccard_components(docs, shingle, percent, id_col, text_col, **more)
    # Rows without an id are told apart by their text's key.
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("row_key").alias("row_key"))
    label = F.when(F.col("n_shingles") > 0, F.struct(F.col("component_id").isNull().alias("none"), F.coalesce("component_id", "cid").alias("label")))
    kept = found.filter("n_shingles > 0").groupBy(label.alias("label")).agg(F.min(rank).alias("kept")).select("kept.doc_id", "kept.row_key")
    empty = found.filter("n_shingles = 0").select("doc_id", "row_key").distinct().withColumn("every", F.lit(True))
    # Only rows that are there twice, by id and text, are shuffled to be told apart; the others' texts aren't.
    twice = found.filter("n_shingles > 0").groupBy("doc_id", "row_key").agg((F.count(F.lit(1)) > 1).alias("again")).alias("t")
    kept = kept.alias("k").join(twice, F.col("k.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("k.row_key") == F.col("t.row_key"))).select("k.doc_id", "k.row_key", "t.again")
    chosen = kept.withColumn("every", ~F.col("again")).drop("again").unionByName(empty).alias("r")
    # The row stays in one struct, so that no name of the caller's clashes with ours.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    keyed = docs.select(row, F.col(id_col).cast("long").alias("own_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("own_key"))
    out = keyed.join(chosen, [F.col("own_id").eqNullSafe(F.col("r.doc_id")), F.col("own_key") == F.col("r.row_key")]).select("doc", "own_id", "own_key", "every")
    once = out.filter("NOT every").dropDuplicates(["own_id", "own_key"])
    return out.filter("every").unionByName(once).select("doc.*")
