"""Token counts and token ids of whole texts with a public byte-level vocabulary.

``count_tokens`` looks pre-token lengths up on the map side in two tiers: a broadcast table of frequent pre-tokens,
whose size is bounded by ``table_size``, and a cache in each Python worker (emptied when it holds ``cache_size``
entries) that misses fill from the tokenizer itself. The table's pre-tokens are counted over all whole texts, in a
bounded number of counters a task; only each task's most frequent ones are summed up over tasks, the texts' own
pre-tokens are never shuffled. The table only saves time, it never changes a count.

Cases: null text counts as empty (0 tokens); empty tables give empty results; texts of any length are counted whole;
special strings inside a text are one token each, as the library treats them by default; repeated rows and nulls in
the id pass through; other columns are passed by.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, map_batches, sliced, texts

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_LOADED: dict[str, object] = {}
_CACHE: dict[str, dict[str, int]] = {}


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(name: str):
    """The library's tokenizer, loaded once per process; it runs in the task's own thread."""
    if name not in _LOADED:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _LOADED[name] = Tokenizer.from_file(tokenizer_path(name))
    return _LOADED[name]


def _splitter():
    """The published pre-token pattern, and the special strings that come before it."""
    if "split" not in _LOADED:
        import public_tokenizers
        import regex

        _LOADED["split"] = regex.compile(public_tokenizers.PATTERN)
    return _LOADED["split"]


def special_strings(name: str) -> list[str]:
    return [t.content for t in load_tokenizer(name).get_added_tokens_decoder().values() if t.special]


def lowered(seen: Counter, counters: int) -> Counter:
    """At most ``counters`` counts: all are lowered by the largest one beyond them, and those at nothing go.

    At least ``counters`` + 1 counts lose that much each time, so that a piece loses at most 1 / ``counters`` of all
    that was counted, however often this is done.
    """
    if len(seen) <= counters:
        return seen
    least = seen.most_common(counters + 1)[-1][1]
    return Counter({k: v - least for k, v in seen.items() if v > least})


def frequent_pretokens(docs: DataFrame, text_col: str, table_size: int, counters: int) -> list[str]:
    """The most frequent pre-tokens of all whole texts: each task sends its ``table_size`` most frequent ones at most, and so many reach the driver.

    A task holds up to twice ``counters`` counts between texts.
    """

    def count(batches):
        split, seen = _splitter(), Counter()
        for batch in (part for whole in batches for part in sliced(whole)):
            for text in texts(batch):
                seen.update(split.findall(text))
                if len(seen) > 2 * counters:
                    seen = lowered(seen, counters)
        kept = seen.most_common(table_size)
        yield columns(piece=pa.array([k for k, _ in kept], pa.string()), n=pa.array([v for _, v in kept], pa.int64()))

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r.piece for r in found.orderBy(F.desc("n"), "piece").limit(table_size).collect()]


def count_tokens(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512, id_col: str = "doc_id", text_col: str = "text",
    table_size: int = 20_000, cache_size: int = 400_000, counters: int = 80_000,
) -> DataFrame:
    """One row per document: UTF-8 bytes, tokens, and whether there are more than ``limit``."""
    spark = docs.sparkSession
    frequent = frequent_pretokens(docs, text_col, table_size, counters)
    own = load_tokenizer(tokenizer)
    lengths = [len(e.ids) for e in own.encode_batch_fast(frequent, add_special_tokens=False)] if frequent else []
    shared = spark.sparkContext.broadcast(dict(zip(frequent, lengths, strict=True)))

    def make():
        table: dict[str, int] = shared.value
        cache = _CACHE.setdefault(tokenizer, {})
        split, library = _splitter(), load_tokenizer(tokenizer)
        specials = special_strings(tokenizer)

        def pieces(text: str) -> tuple[list[str], int]:
            """Pre-tokens, and the number of special strings, which the library takes out first."""
            if not any(s in text for s in specials):
                return split.findall(text), 0
            import re

            parts = re.split("|".join(map(re.escape, sorted(specials, key=len, reverse=True))), text)
            return [w for part in parts for w in split.findall(part)], len(parts) - 1

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            values = texts(batch)
            if len(cache) > cache_size:
                cache.clear()
            counts = []
            for text in values:
                words, n = pieces(text)
                first = list(map(table.get, words))
                if None in first:
                    words = [w for w, m in zip(words, first, strict=True) if m is None]
                    n += sum(m for m in first if m is not None)
                    missing = list({w for w in words if w not in cache})
                    if missing:
                        cache.update(zip(missing, (len(e.ids) for e in library.encode_batch_fast(missing, add_special_tokens=False)), strict=True))
                    n += sum(map(cache.__getitem__, words))
                else:
                    n += sum(first)
                counts.append(n)
            return columns(
                doc_id=batch.column("doc_id"),
                n_bytes=pa.array([len(t.encode()) for t in values], pa.int64()),
                n_tokens=pa.array(counts, pa.int64()),
                over_limit=pa.array([n > limit for n in counts], pa.bool_()),
            )

        return step

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, SCHEMA)


def fast_encoder(name: str):
    """A function from text to a uint32 array of ids, equal to the tokenizers library's for every text.

    The same vocabulary as ranks gives the same ids some five times faster (a test compares both on every
    code point); where a rank file isn't at hand, the library itself encodes.
    """
    key = f"fast {name}"
    if key not in _LOADED:
        ranks_file = tokenizer_path(name.removesuffix(".json") + ".tiktoken") if name == "byte_bpe_50k.json" else None
        if ranks_file is None:
            library = load_tokenizer(name)
            _LOADED[key] = lambda text: np.array(library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        else:
            import public_tokenizers
            import tiktoken

            with open(ranks_file, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            coder = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
            _LOADED[key] = lambda text: coder.encode_to_numpy(text, allowed_special="all")
    return _LOADED[key]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
