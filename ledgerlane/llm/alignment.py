"""Alignment of two tokenizers over the same bytes: groups of tokens between shared ends, and how often ids are linked.

``encode`` encodes each text twice (A: a byte-level vocabulary over a space and the text; B: a piece vocabulary over the
text, which adds the space itself) and cuts the bytes at the union of both tokenizers' ends. Each elementary interval
has one owner on either side, found by binary search; an end that both share closes a group. ``link_counts`` counts for
each pair of ids in how many documents the two are linked, that is, stand in one group; ``link_statistics`` gives each
document its links with their corpus-wide counts.

A task works on some megabytes of text at once, in numpy. Stretches between spaces are encoded once for a process, which
keeps a bounded number of them. The tokens go to a table in the shared folder, so that each text is encoded once; pairs are counted in the tasks before they are shuffled. The counts reach the documents in two
tiers: a broadcast table of the pairs with the highest counts, at most ``table_pairs`` of 13 bytes, and a join by pair
for the others; where the table holds all pairs of two documents and more, a pair that it lacks has the count 1.

A group of n and m tokens has n * m links; equal ids of a large group are put together first, and the links are made in
parts of bounded size, so that a long run without shared ends costs its distinct ids.

Cases: texts that are null or empty, and texts whose tokens' bytes don't join to the space and the text, have no tokens
and no links (null counts as empty); special strings inside a text are plain text; repeated rows are documents of their
own; nulls in the id pass through; empty tables give empty results; other columns are passed by.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, materialize, texts, weighed
from .tokens import tokenizer_path

#: Bits of an id inside a pair of ids.
BITS = 20
#: Links that a task makes at once, unless one id of one document has more.
LINKS = 1 << 21
#: Groups with more links than this put equal ids together before the links are made.
LARGE = 64
#: Distinct pairs that a task counts before it sends them on.
PAIRS = 1 << 21

TOKENS = "row_key long, doc_id long, a_ids binary, b_ids binary, a_sizes binary, b_sizes binary"
STATISTICS = "row_key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, rare array<struct<pair: long, times: long>>"
_LOADED: dict[str, object] = {}


class ByteSide:
    """The ids of a byte-level vocabulary over a space and each text; strings of special tokens are plain text."""

    def __init__(self, name: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(tokenizer_path(name.removesuffix(".json") + ".tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def encode(self, values: list[str]) -> list[list[int]]:
        return [self.coder.encode_ordinary(" " + t) for t in values]


class PieceSide:
    """The ids of a piece vocabulary with byte fallback over each text."""

    def __init__(self, name: str) -> None:
        import sentencepiece

        self.coder = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        self.space = self.coder.piece_to_id("▁")
        pieces = [self.coder.id_to_piece(k) for k in range(self.coder.vocab_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.coder.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]

    def encode(self, values: list[str]) -> list[list[int]]:
        """Each text's ids; an empty text still has the space that the library adds to all others."""
        return [ids or [self.space] for ids in self.coder.encode(values, num_threads=1)]


def side(name: str) -> ByteSide | PieceSide:
    """A tokenizer, loaded once per process."""
    if name not in _LOADED:
        _LOADED[name] = PieceSide(name) if name.endswith(".model") else ByteSide(name)
    return _LOADED[name]


def packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of small numbers as bytes: the width of a number, then the numbers; a third of the size of lists of integers."""
    ends = np.cumsum(sizes).tolist()
    out = []
    for end, n in zip(ends, sizes.tolist(), strict=True):
        own = values[end - n : end]
        most = own.max(initial=0)
        kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32
        out.append(bytes([np.dtype(kind).itemsize]) + own.astype(kind).tobytes())
    return pa.array(out, pa.binary())


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a packed column, and how many each row has."""
    rows = [np.frombuffer(raw, f"u{raw[0]}", offset=1) for raw in column.to_pylist()]
    return np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64), np.array([len(r) for r in rows], np.int64)


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of A and of B in each group, and the groups' ends. Both arrays rise and have their last end in common.

    Each elementary interval between neighbouring ends has one owner in A and one in B; a group is closed where the
    interval ends both its owners.
    """
    ends = np.union1d(ends_a, ends_b)
    owner_a, owner_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    closes = (ends_a[owner_a] == ends) & (ends_b[owner_b] == ends) if len(ends) else np.zeros(0, bool)
    return np.diff(owner_a[closes], prepend=-1), np.diff(owner_b[closes], prepend=-1), ends[closes]


class Units:
    """The tokens of short stretches of text, kept between texts: a stretch is some spaces and what follows up to the next.

    A byte-level vocabulary cuts texts before a space that follows something else, and a piece vocabulary of which no piece
    has a space after something else can't join over it, so both sides encode such stretches by themselves, and their ends
    are shared. Only a run of white space that goes on with two spaces or more isn't cut (the pattern takes it as one).
    Vocabularies that aren't so encode whole texts. What is kept is emptied beyond ``most`` stretches or 32 times as many characters.
    """

    STRETCH = re.compile(r" +[^ ]*(?:(?<=\s) {2,}[^ ]*)*")

    def __init__(self, name_a: str, name_b: str, most: int = 200_000) -> None:
        self.a, self.b, self.most = side(name_a), side(name_b), most
        self.cuts = isinstance(self.a, ByteSide) and isinstance(self.b, PieceSide) and not any(re.search(b"[^ ] ", t) for t in self.b.bytes_of)
        self.lengths = [np.array([len(t) for t in own.bytes_of], np.int64) for own in (self.a, self.b)]
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.characters = 0
        #: ids and group sizes of all stretches behind each other, for A and B, and where each stretch begins
        self.flat = [np.zeros(0, np.int64) for _ in range(4)]
        self.starts = [np.zeros(1, np.int64) for _ in range(4)]
        self.right = np.zeros(0, bool)

    def add(self, stretches: list[str]) -> None:
        raw = [s.encode() for s in stretches]
        whole, sizes = b"".join(raw), np.array([len(r) for r in raw], np.int64)
        right = np.ones(len(stretches), bool)
        ids = [self.a.encode([s[1:] for s in stretches]), self.b.encode([s[1:] for s in stretches])]
        for side_ids, own, length in zip(ids, (self.a, self.b), self.lengths, strict=True):
            flat = [i for x in side_ids for i in x]
            ends = np.cumsum(np.array([len(x) for x in side_ids]))
            measured = np.diff(np.concatenate([[0], np.cumsum(length[flat])])[ends], prepend=0)
            if b"".join(map(own.bytes_of.__getitem__, flat)) != whole or (measured != sizes).any():
                right &= [b"".join(map(own.bytes_of.__getitem__, x)) == r for x, r in zip(side_ids, raw, strict=True)]
        ids_a, ids_b = ([x if ok else [] for x, ok in zip(side_ids, right.tolist(), strict=True)] for side_ids in ids)
        flat = [np.array([i for x in own for i in x], np.int64) for own in (ids_a, ids_b)]
        # Stretches stand behind each other, so that one search serves all; an end of a stretch is shared and closes a group.
        ends = [np.cumsum(length[ids]) for length, ids in zip(self.lengths, flat, strict=True)]
        in_a, in_b, closed = groups_of(*ends)
        counts = [np.array([len(x) for x in own], np.int64) for own in (ids_a, ids_b)]
        own_end = np.concatenate([[0], ends[0]])[np.cumsum(counts[0])]
        n_groups = np.diff(np.searchsorted(closed, own_end, side="right"), prepend=0)
        for k, (values, n) in enumerate(((flat[0], counts[0]), (flat[1], counts[1]), (in_a, n_groups), (in_b, n_groups))):
            self.flat[k] = np.concatenate([self.flat[k], values])
            self.starts[k] = np.concatenate([self.starts[k], self.starts[k][-1] + np.cumsum(n)])
        self.right = np.concatenate([self.right, right])
        for stretch in stretches:
            self.number[stretch] = len(self.number)
            self.characters += len(stretch)

    def align(self, values: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A, of B, and tokens a group of A, of B: each as one array and how many of it each text has."""
        if len(self.number) > self.most or self.characters > 32 * self.most:
            self.clear()
        cut = [(self.STRETCH.findall(" " + t) if self.cuts else [" " + t]) if t else [] for t in values]
        words = [w for own in cut for w in own]
        known = list(map(self.number.get, words))
        if None in known:
            self.add(list(dict.fromkeys(w for w, k in zip(words, known, strict=True) if k is None)))
            known = list(map(self.number.__getitem__, words))
        at = np.array(known, np.int64)
        text = np.repeat(np.arange(len(cut)), [len(own) for own in cut])
        good = np.ones(len(cut), bool)
        good[text[~self.right[at]]] = False
        at, text = at[good[text]], text[good[text]]
        out = []
        for flat, starts in zip(self.flat, self.starts, strict=True):
            n = starts[at + 1] - starts[at]
            place = np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append((flat[place], np.bincount(text, n, len(cut)).astype(np.int64)))
        return out


def units(name_a: str, name_b: str) -> Units:
    """The stretches of two tokenizers, kept in the process."""
    key = f"{name_a} {name_b}"
    if key not in _LOADED:
        _LOADED[key] = Units(name_a, name_b)
    return _LOADED[key]


def tokens_of(values: list[str], name_a: str = "byte_bpe_50k.json", name_b: str = "piece_bpe_32k.model") -> dict[str, pa.Array]:
    """Packed ids of both sides and tokens a group, for each text."""
    return {name: packed(*pair) for name, pair in zip(("a_ids", "b_ids", "a_sizes", "b_sizes"), units(name_a, name_b).align(values), strict=True)}


def encode(docs: DataFrame, tokenizer_a: str = "byte_bpe_50k.json", tokenizer_b: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, packed: the ids of both sides, and how many of each stand in each group; row_key is any unique number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in weighed(batch, "text", 1 << 20):
                yield columns(row_key=part.column("row_key"), doc_id=part.column("doc_id"), **tokens_of(texts(part), tokenizer_a, tokenizer_b))

    return docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, TOKENS)


def align(docs: DataFrame, **names: str) -> DataFrame:
    """One row per document: the ids of both sides (a_ids, b_ids), and how many of each stand in each group (a_sizes, b_sizes), as lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in weighed(batch, "a_ids", 1 << 20):
                lists = {c: pa.array([np.frombuffer(raw, f"u{raw[0]}", offset=1).tolist() for raw in part.column(c).to_pylist()], pa.list_(pa.int32())) for c in ("a_ids", "b_ids", "a_sizes", "b_sizes")}
                yield columns(doc_id=part.column("doc_id"), **lists)

    return encode(docs, **names).mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>")


def spelled(highest: int) -> np.ndarray:
    """At 3 * id + k: the id's decimals with the k-th of the separators , | ;"""
    have = _LOADED.get("spelled")
    if have is None or len(have) <= 3 * highest + 2:
        have = _LOADED["spelled"] = np.array([f"{k}{s}".encode() for k in range(1 << max(16, (highest + 1).bit_length())) for s in ",|;"], object)
    return have


class Flat:
    """The tokens and groups of some documents in plain arrays."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        (a, self.n_a), (b, self.n_b), (in_a, self.n_groups), (in_b, _) = (unpacked(batch.column(c)) for c in ("a_ids", "b_ids", "a_sizes", "b_sizes"))
        self.ids, self.sizes = [a, b], [in_a, in_b]
        self.rows = batch.num_rows
        self.doc_of_group = np.repeat(np.arange(self.rows), self.n_groups)

    def per_doc(self, of_group: np.ndarray) -> np.ndarray:
        ends = np.cumsum(self.n_groups)
        total = np.concatenate([[0], np.cumsum(of_group)])
        return total[ends] - total[ends - self.n_groups]

    def side_entries(self, k: int, large: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group, id and times of the tokens of a side, by group; in large groups an id stands once."""
        ids, group = self.ids[k], np.repeat(np.arange(len(self.sizes[k])), self.sizes[k])
        times = np.ones(len(ids), np.int64)
        mask = large[group]
        if not mask.any():
            return group, ids, times
        found, n = np.unique(group[mask] << BITS | ids[mask], return_counts=True)
        group = np.concatenate([group[~mask], found >> BITS])
        ids, times = np.concatenate([ids[~mask], found & ((1 << BITS) - 1)]), np.concatenate([times[~mask], n])
        order = np.argsort(group, kind="stable")
        return group[order], ids[order], times[order]

    def links(self, most: int = LINKS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Document, pair and times of all links, in parts; no two parts hold the same pair of the same document."""
        large = self.sizes[0] * self.sizes[1] > LARGE
        group, ids, times = self.side_entries(0, large)
        group_b, ids_b, times_b = self.side_entries(1, large)
        width = np.bincount(group_b, minlength=len(self.doc_of_group))
        first = np.cumsum(width) - width
        wide = width[group]
        cuts = [0, len(group)]
        if wide.sum() > most:
            order = np.lexsort((ids, self.doc_of_group[group]))
            group, ids, times, wide = group[order], ids[order], times[order], wide[order]
            own = self.doc_of_group[group] << BITS | ids
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            reach = np.concatenate([[0], np.cumsum(wide)])
            cuts = [0]
            while cuts[-1] < len(group):
                stop = np.searchsorted(reach, reach[cuts[-1]] + most, side="right") - 1
                at = np.searchsorted(starts, stop, side="right") - 1
                if starts[at] <= cuts[-1]:
                    at = np.searchsorted(starts, cuts[-1], side="right")
                cuts.append(int(starts[at]) if at < len(starts) and stop < len(group) else len(group))
        for a, z in zip(cuts, cuts[1:]):
            w = wide[a:z]
            entry = np.repeat(np.arange(a, z), w)
            other = first[group[entry]] + np.arange(len(entry)) - np.repeat(np.cumsum(w) - w, w)
            yield self.doc_of_group[group[entry]], ids[entry] << BITS | ids_b[other], times[entry] * times_b[other]

    def digests(self) -> list[str]:
        """SHA-256 of each document's groups as text, '' without tokens."""
        before = np.cumsum(self.sizes[0] + self.sizes[1]) - self.sizes[0] - self.sizes[1]
        line = np.empty(len(self.ids[0]) + len(self.ids[1]), np.int64)
        for k, start, separator in ((0, before, 1), (1, before + self.sizes[0], 2)):
            ids, sizes = self.ids[k] * 3, self.sizes[k]
            ids[np.cumsum(sizes) - 1] += separator
            line[np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))] = ids
        words = spelled(int(line.max(initial=0)) // 3)
        ends = np.cumsum(self.n_a + self.n_b)
        return [hashlib.sha256(b"".join(words[line[e - n : e]].tolist())[:-1]).hexdigest() if n else "" for e, n in zip(ends.tolist(), (self.n_a + self.n_b).tolist(), strict=True)]


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def link_counts(tokens: DataFrame) -> DataFrame:
    """How many documents hold each pair of ids linked: pair (the id of A above 20 bits of B's), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for part in weighed(batch, "a_ids", 1 << 20):
                for doc, pair, _ in Flat(part).links():
                    once = np.unique(doc << 2 * BITS | pair) & ((1 << 2 * BITS) - 1)
                    found, n = np.unique(once, return_counts=True)
                    keys.append(found)
                    counts.append(n)
                    held += len(found)
                    if held > PAIRS:
                        found, n = summed(keys, counts)
                        if len(found) > PAIRS // 2:
                            yield columns(pair=found, n=n)
                            keys, counts, held = [], [], 0
                        else:
                            keys, counts, held = [found], [n], len(found)
        if keys:
            found, n = summed(keys, counts)
            yield columns(pair=found, n=n)

    return tokens.select("a_ids", "b_ids", "a_sizes", "b_sizes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def table_floor(counts: DataFrame, table_pairs: int) -> int:
    """The least power of two, 2 at least, that at most ``table_pairs`` pairs reach."""
    steps = {r.step: r.pairs for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("step")).agg(F.count("*").alias("pairs")).collect()}
    floor, above = 64, 0
    while floor > 1 and above + steps.get(floor - 1, 0) <= table_pairs:
        floor -= 1
        above += steps.get(floor, 0)
    return 1 << floor


def link_statistics(tokens: DataFrame, table_pairs: int = 2_000_000) -> DataFrame:
    """One row per document of ``encode``'s table, which is read twice: its numbers of tokens, groups and links, and the links' corpus-wide counts.

    n_best counts the links whose pair has its A id's highest count, count_sum sums the counts over links.
    """
    spark = tokens.sparkSession
    counts = materialize(link_counts(tokens), "link-counts")
    floor = table_floor(counts, table_pairs)
    highest = counts.groupBy(F.shiftright("pair", BITS).cast("int").alias("a")).agg(F.max("n").alias("best"))
    # Bounded by the vocabulary and by table_pairs.
    of_id = highest.toArrow()
    ids = of_id.column("a").to_numpy()
    best = np.zeros(ids.max(initial=0) + 1, np.int64)
    best[ids] = of_id.column("best").to_numpy()
    known = counts.where(F.col("n") >= floor).toArrow()
    pairs, n = known.column("pair").to_numpy(), known.column("n").to_numpy()
    order = np.argsort(pairs)
    shared = spark.sparkContext.broadcast((pairs[order], n[order], best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, table_n, highest_n = shared.value
        for batch in batches:
            for part in weighed(batch, "a_ids", 1 << 20):
                flat = Flat(part)
                n_best, count_sum = np.zeros(flat.rows, np.int64), np.zeros(flat.rows, np.int64)
                rare_doc, rare_pair, rare_times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for doc, pair, times in flat.links():
                    own, back = np.unique(pair, return_inverse=True)
                    at = np.minimum(np.searchsorted(table, own), max(len(table) - 1, 0))
                    in_table = table[at] == own if len(table) else np.zeros(len(own), bool)
                    # Below a floor of 2 is 1; below a higher one the join decides.
                    own_n = np.where(in_table, table_n[at] if len(table) else 0, 1 if floor == 2 else 0)
                    top = (own_n > 0) & (own_n == highest_n[own >> BITS])
                    np.add.at(count_sum, doc, times * own_n[back])
                    np.add.at(n_best, doc, times * top[back])
                    if floor > 2 and not in_table.all():
                        left = ~in_table[back]
                        rare, where = np.unique(doc[left] << 2 * BITS | pair[left], return_inverse=True)
                        rare_doc.append(rare >> 2 * BITS)
                        rare_pair.append(rare & ((1 << 2 * BITS) - 1))
                        sums = np.zeros(len(rare), np.int64)
                        np.add.at(sums, where, times[left])
                        rare_times.append(sums)
                rare_of, pairs_of, times_of = map(np.concatenate, (rare_doc, rare_pair, rare_times))
                by_doc = np.argsort(rare_of, kind="stable")
                rare_lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.bincount(rare_of, minlength=flat.rows))]).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(pairs_of[by_doc]), pa.array(times_of[by_doc])], ["pair", "times"]),
                )
                yield columns(
                    row_key=part.column("row_key"), doc_id=part.column("doc_id"), n_a=flat.n_a, n_b=flat.n_b, n_groups=flat.n_groups, n_links=flat.per_doc(flat.sizes[0] * flat.sizes[1]),
                    n_best=n_best, count_sum=count_sum, groups_sha256=pa.array(flat.digests(), pa.string()), rare=rare_lists,
                )

    out = tokens.mapInArrow(run, STATISTICS)
    if floor > 2:
        out = with_rare(materialize(out, "link-statistics"), counts.where(F.col("n") < floor), highest)
    return out.drop("row_key", "rare")


def with_rare(statistics: DataFrame, counts: DataFrame, highest: DataFrame) -> DataFrame:
    """Add the links whose pairs aren't in the broadcast table, by a join on the pair; such a pair is in few documents."""
    rows = statistics.select("row_key", F.explode("rare").alias("_r")).select("row_key", "_r.pair", "_r.times")
    found = rows.join(counts, "pair").withColumn("a", F.shiftright("pair", BITS).cast("int")).join(F.broadcast(highest), "a")
    sums = found.groupBy("row_key").agg(F.sum(F.col("times") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("_best"))
    out = statistics.join(sums, "row_key", "left")
    return out.withColumns({"count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("_best", F.lit(0))}).drop("_sum", "_best")


def aligned_documents(docs: DataFrame, table_pairs: int = 2_000_000, **names: str) -> DataFrame:
    """``link_statistics`` of ``encode``, whose table goes to the shared folder."""
    return link_statistics(materialize(encode(docs, **names), "aligned-tokens"), table_pairs)
