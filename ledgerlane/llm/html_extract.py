"""HTML extraction: the article of a page, without what its host repeats from page to page.

1. One scan of the markup, linear in its length, gives blocks of text. Elements that are never the article (menus, footers,
   asides, forms, adverts, notices, comments, scripts and the like, by tag, role, class or id) are set apart; blocks inside
   an article or main element are article blocks, all others are undecided.
2. The token stream of each page - all its blocks, those set apart too, so that boilerplate that is marked on some pages
   is known on those that don't mark it - is searched per host: a suffix array over the streams' parts (sharded by
   content, so a host may have any number of pages) finds long substrings that are on a share of ``many`` of the host's
   pages (half of them), and on ``least_pages`` at least. Most parts of a stream have a key that too few pages of the host
   have: batches of pages first send their distinct keys, as blocks of numbers, to the tasks of their hash ranges and get back
   those that enough pages have, so that only their parts become rows.
3. What such substrings cover is boilerplate, the rest are unique runs. An undecided block is kept if at least half of it is
   in unique runs, and then whole, so that no sentence is cut. Article blocks are kept whatever is found: stories that a host
   tells again on other pages are still stories. A page without an article block of which nothing would be left is a copy,
   and keeps its undecided blocks.

Cases: null html is an empty page with empty text; a null url counts as its own host; empty tables give empty
results; repeated rows are pages of their own (two equal pages without an article are each other's repeats only if
their ids or urls differ); unclosed and stray tags are taken as they come; a tag's quotes count as long as all tags of the page
end outside them; what follows the last ``>`` is text; long pages are taken whole; other columns are passed by.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import fold, splitmix
from .common import columns, map_batches, materialize, sliced, texts
from .suffix_dedup import counted_ranges, segments
from .url_filter import split_url

SCHEMA = "page_id long, url string, text string, n_chars long"

# Elements and names by their role in a page.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
APART = {"head", "nav", "footer", "aside", "form", "button", "select", "datalist", "menu", "dialog", "template", "svg", "math", "object", "canvas", "video", "audio", "map"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
}
CLOSES_P = BLOCK - {"br", "html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend"}
APART_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
APART_NAMES = {
    "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "topbar", "masthead", "header", "footer", "foot", "sidebar", "aside",
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr",
    "notice", "notices", "popup", "modal", "overlay", "alert", "comment", "comments", "disqus", "respond", "replies", "share", "sharing", "social", "related", "recommended", "newsletter",
    "subscribe", "subscription", "signup", "login", "widget", "hidden",
}
TAG_NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
TAG_MARK = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


#: Kinds of blocks in a stream.
APART_BLOCK, OPEN_BLOCK, ARTICLE_BLOCK = 0, 1, 2
SEGMENT_TYPES = {"doc_id": pa.int64(), "row_key": pa.int64(), "key": pa.int64(), "seg_hash": pa.int64(), "a": pa.int32(), "b": pa.int32(), "self": pa.bool_(), "need": pa.int64(), "piece": pa.binary()}


@dataclass
class Block:
    text: str
    article: bool
    apart: bool


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text.strip(" /") else {}


def _is_apart(tag: str, own: dict[str, str], in_article: bool) -> bool:
    if tag in APART or own.get("role", "").lower() in APART_ROLES:
        return True
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", "")):
        return True
    if tag == "header":
        return not in_article
    if tag in ("html", "body", "main"):
        return False
    names = {n.lower() for n in NAME.findall(f"{own.get('class', '')} {own.get('id', '')}")}
    if tag == "article":
        return bool(names & {"comment", "ad", "advert", "promo", "sponsored", "related"})
    return bool(names & (APART_NAMES - {"header"} if in_article else APART_NAMES))


def tags(page: str) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, name (after a slash for an end tag; empty for comments and declarations) and attributes of the tags in order.

    Each character is looked at a bounded number of times: a tag is searched to its end once, the last places of ``>`` and of
    both quotes tell that a search would find nothing, and once a tag has its end only inside quotes, quotes count no more.
    """
    last = {c: page.rfind(c) for c in ">\"'"}
    quotes, at = True, 0
    while True:
        start = page.find("<", at)
        if start < 0 or start > last[">"]:
            return
        name = TAG_NAME.match(page, start + 1)
        if name is None:
            if page.startswith("<!--", start):
                close = page.find("-->", start + 4)
                at = len(page) if close < 0 else close + 3
            elif page.startswith(("<!", "<?"), start):
                at = page.index(">", start) + 1
            else:
                at = start + 1
                continue
            yield start, at, "", ""
            continue
        end, place = -1, name.end()
        while quotes and end < 0:
            mark = TAG_MARK.search(page, place)
            if mark is None:
                quotes = False
            elif mark[0] == ">":
                end = mark.start()
            else:
                place = mark.end() if place > last[mark[0]] or mark.start() == last[mark[0]] else page.index(mark[0], mark.end()) + 1
        if end < 0:
            end = page.index(">", name.end())
        at = end + 1
        yield start, at, name[0].lower(), page[name.end() : end]
        if name[0].lower() in RAW:
            close = re.compile(rf"</{name[0]}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            after = len(page) if close is None else close.end()
            yield at, after, "", ""
            at = after


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; white space inside each is one space."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, in an article, apart
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    article = apart = False

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, article, apart))
            pieces.clear()

    at = 0
    for start, end, name, rest in tags(page):
        if start > at:
            pieces.append(html.unescape(page[at:start]))
        at = end
        tag = name.removeprefix("/")
        if not tag or name in RAW:
            continue
        if tag in BLOCK:
            flush()
        if name != tag:
            if opened[tag]:
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                outer = stack[depth - 1][1:] if depth else (False, False)
                if outer != (article, apart):
                    flush()
                opened.subtract(t for t, _, _ in stack[depth:])
                del stack[depth:]
                article, apart = outer
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P and stack and stack[-1][0] == "p":
            stack.pop()
            opened["p"] -= 1
            article, apart = stack[-1][1:] if stack else (False, False)
        own = _attributes(rest)
        now_article = article or tag in ("article", "main") or own.get("role", "").lower() in ("main", "article")
        now_apart = apart or _is_apart(tag, own, article)
        if not rest.endswith("/") or tag in BLOCK:
            if (now_article, now_apart) != (article, apart):
                flush()
            stack.append((tag, now_article, now_apart))
            opened[tag] += 1
            article, apart = now_article, now_apart
    if at < len(page):
        pieces.append(html.unescape(page[at:]))
    flush()
    return out


def _parse(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """batch and place (of a page in it), page_id, row_key, url, scope (of the host), the stream of all blocks (packed), and of each block where it is in it (in bytes) and its kind."""

    def make():
        pack = zstandard.ZstdCompressor(level=3).compress
        numbers = count(TaskContext.get().partitionId() << 32)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            streams, places = [], []
            for page in texts(batch, "html"):
                stream, marks, size = [], [], 0
                for b in blocks(page):
                    data = b.text.encode()
                    marks.append((size, size + len(data), APART_BLOCK if b.apart else ARTICLE_BLOCK if b.article else OPEN_BLOCK))
                    stream.append(data)
                    size += len(data) + 1
                streams.append(pack(b"\n".join(stream)))
                places.append(marks)
            hosts = [split_url(u)[0] or "" for u in batch.column("url").to_pylist()]
            return columns(
                batch=pa.array([next(numbers)] * len(hosts), pa.int64()), place=pa.array(range(len(hosts)), pa.int32()), page_id=batch.column("page_id"), row_key=batch.column("row_key"), url=batch.column("url"),
                scope=pa.array([int.from_bytes(hashlib.blake2b(h.encode(), digest_size=8).digest(), "big", signed=True) for h in hosts], pa.int64()), stream=pa.array(streams, pa.binary()),
                starts=pa.array([[a for a, _, _ in p] for p in places], pa.list_(pa.int32())), ends=pa.array([[b for _, b, _ in p] for p in places], pa.list_(pa.int32())),
                kinds=pa.array([[i for _, _, i in p] for p in places], pa.list_(pa.int8())),
            )

        return step

    key = F.xxhash64(F.col(id_col), F.col(url_col), F.col(html_col))
    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), key.alias("row_key"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_batches(chosen, make, "batch long, place int, page_id long, row_key long, url string, scope long, stream binary, starts array<int>, ends array<int>, kinds array<tinyint>")


def _segments(data: bytes, scope: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The segments of a stream, with keys of their host's own."""
    key, *rest = segments(np.frombuffer(data, dtype=np.uint8), length, gram)
    if len(key):
        key = fold([key.view(np.uint64), np.full(len(key), np.int64(scope)).view(np.uint64)]).view(np.int64)
    return key, *rest


def _touched(a: np.ndarray, b: np.ndarray, length: int, starts: list[int], ends: list[int], kinds: list[int]) -> np.ndarray:
    """For each segment the kinds of its blocks, as bits: 1 for open ones, 2 for article ones."""
    start, end, kind = (np.array(x, dtype=np.int64) for x in (starts, ends, kinds))
    bits = np.zeros(len(a), dtype=np.uint8)
    for bit in (OPEN_BLOCK, ARTICLE_BLOCK):
        first, last = start[kind == bit], end[kind == bit]
        bits |= np.where(np.searchsorted(first, b - 1 + length, side="left") > np.searchsorted(last, a, side="right"), bit, 0).astype(np.uint8)
    return bits


def key_blocks(parsed: DataFrame, length: int, gram: int, ranges: int) -> DataFrame:
    """For each batch and hash range the keys, and of each its page's place in the batch and the kinds of blocks it is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        number, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                key, place, bit = (np.concatenate(x) for x in zip(*held, strict=True))
                of = (splitmix(key.view(np.uint64)) % np.uint64(ranges)).astype(np.int64)
                parts = [p for p in np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of, minlength=ranges))[:-1]) if len(p)]
                packed = lambda x: pa.array([x[p].tobytes() for p in parts], pa.binary())
                yield columns(batch=pa.array([number] * len(parts), pa.int64()), part=pa.array([int(of[p[0]]) for p in parts], pa.int32()), keys=packed(key), places=packed(place), bits=packed(bit))

        # The rows of a batch follow each other; where a split of the scan parts them, each part is sent by itself.
        for batch in batches:
            for own, at, scope, stream, starts, ends, kinds in zip(*(batch.column(c).to_pylist() for c in ("batch", "place", "scope", "stream", "starts", "ends", "kinds")), strict=True):
                if own != number:
                    yield from flush()
                    number, held = own, []
                key, _, a, b, _ = _segments(unpack(stream), scope, length, gram)
                if len(key):
                    order = np.argsort(key, kind="stable")
                    key, touched = key[order], _touched(a, b, length, starts, ends, kinds)[order]
                    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                    held.append((key[head], np.full(len(head), at, dtype=np.uint16), np.bitwise_or.reduceat(touched, head)))
        yield from flush()

    return parsed.select("batch", "place", "scope", "stream", "starts", "ends", "kinds").mapInArrow(run, "batch long, part int, keys binary, places binary, bits binary")


def shared_keys(blocks_of: DataFrame, ranges: int) -> DataFrame:
    """batch, keys, places, counts and bits: the keys that two pages have, one of them outside what is apart, with the number of their pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("batch", "keys", "places", "bits")), strict=True)]
        if not rows:
            return
        keys = np.concatenate([np.frombuffer(k, dtype=np.int64) for _, k, _, _ in rows])
        bits = np.concatenate([np.frombuffer(b, dtype=np.uint8) for _, _, _, b in rows])
        order = np.argsort(keys)
        ordered = keys[order]
        head = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        sizes = np.diff(np.append(head, len(keys)))
        total, every = np.empty(len(keys), dtype=np.uint32), np.empty(len(keys), dtype=np.uint8)
        total[order], every[order] = np.repeat(sizes, sizes), np.repeat(np.bitwise_or.reduceat(bits[order], head), sizes)
        wanted = (total > 1) & (every > 0)
        start = 0
        for number, block, places, _ in rows:
            end = start + len(block) // 8
            chosen = np.flatnonzero(wanted[start:end])
            if len(chosen):
                at = chosen + start
                yield columns(
                    batch=pa.array([number], pa.int64()), keys=pa.array([keys[at].tobytes()], pa.binary()), places=pa.array([np.frombuffer(places, dtype=np.uint16)[chosen].tobytes()], pa.binary()),
                    counts=pa.array([total[at].tobytes()], pa.binary()), bits=pa.array([every[at].tobytes()], pa.binary()),
                )
            start = end

    return blocks_of.repartition(ranges, "part").mapInArrow(run, "batch long, keys binary, places binary, counts binary, bits binary")


def wanted_keys(parsed: DataFrame, shared: DataFrame, needs: DataFrame) -> DataFrame:
    """page_id, row_key, need and keys of the pages with keys that are in open blocks somewhere, and on as many pages as their host needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, need_of, infos, known = None, {}, (), []

        def flush() -> pa.RecordBatch | None:
            if not known:
                return None
            key, place, total, bit = (np.concatenate(x) for x in zip(*known, strict=True))
            need = np.array([need_of[s] for s in infos[2]], dtype=np.int64)
            kept = np.flatnonzero((bit & OPEN_BLOCK > 0) & (total >= need[place]))
            kept = kept[np.argsort(place[kept], kind="stable")]
            pages, head = np.unique(place[kept], return_index=True)
            parts = np.split(key[kept], head[1:]) if len(head) else []
            return columns(
                page_id=pa.array([infos[0][p] for p in pages], pa.int64()), row_key=pa.array([infos[1][p] for p in pages], pa.int64()), need=pa.array(need[pages], pa.int64()),
                keys=pa.array([np.sort(p).tobytes() for p in parts], pa.binary()),
            )

        # Of a batch the needs of its hosts come first, then its pages, then its keys.
        for batch in batches:
            for own, kind, scopes, need, page_ids, row_keys, keys, places, counts, bits in zip(*(batch.column(c).to_pylist() for c in ("batch", "kind", *names)), strict=True):
                if own != number:
                    if (out := flush()) is not None:
                        yield out
                    number, need_of, infos, known = own, {}, (), []
                if kind == 0:
                    need_of = dict(zip(scopes, need, strict=True))
                elif kind == 1:
                    infos = page_ids, row_keys, scopes
                else:
                    known.append((np.frombuffer(keys, dtype=np.int64), np.frombuffer(places, dtype=np.uint16), np.frombuffer(counts, dtype=np.uint32), np.frombuffer(bits, dtype=np.uint8)))
        if (out := flush()) is not None:
            yield out

    names = {"scopes": "array<long>", "needs": "array<long>", "page_ids": "array<long>", "row_keys": "array<long>", "keys": "binary", "places": "binary", "counts": "binary", "bits": "binary"}

    def rows(df: DataFrame, kind: int) -> DataFrame:
        return df.select("batch", F.lit(kind).alias("kind"), *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in names.items()])

    pages = parsed.join(shared.select("batch").distinct(), "batch", "left_semi").groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("place", "page_id", "row_key", "scope"))).alias("p"))
    pages = pages.select("batch", F.col("p.page_id").alias("page_ids"), F.col("p.row_key").alias("row_keys"), F.col("p.scope").alias("scopes"))
    by_batch = pages.select("batch", F.explode(F.array_distinct("scopes")).alias("scope")).join(needs, "scope").groupBy("batch").agg(F.collect_list(F.struct("scope", "need")).alias("n"))
    by_batch = by_batch.select("batch", F.col("n.scope").alias("scopes"), F.col("n.need").alias("needs"))
    every = rows(by_batch, 0).unionByName(rows(pages, 1)).unionByName(rows(shared, 2))
    return every.repartition("batch").sortWithinPartitions("batch", "kind").mapInArrow(run, "page_id long, row_key long, need long, keys binary")


def own_hashes(key: np.ndarray, seg_hash: np.ndarray, *page: int | None) -> np.ndarray:
    """The segments' hashes; those of a key with different segments on this page become the page's own."""
    order = np.lexsort((seg_hash, key))
    same_key = key[order[1:]] == key[order[:-1]]
    mixed = key[order[1:]][same_key & (seg_hash[order[1:]] != seg_hash[order[:-1]])]
    if not len(mixed):
        return seg_hash
    mark = np.array([x or 0 for x in page], dtype=np.int64).view(np.uint64)
    own = fold([seg_hash.view(np.uint64), *(np.full(len(key), m) for m in mark)]).view(np.int64)
    return np.where(np.isin(key, mixed), own, seg_hash)


def shared_segments(parsed: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """The segments of all pages with a wanted key, and their bytes."""

    def make():
        unpack = zstandard.ZstdDecompressor().decompress

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for page_id, row_key, scope, stream, need, keys in zip(*(batch.column(c).to_pylist() for c in ("page_id", "row_key", "scope", "stream", "need", "keys")), strict=True):
                data = unpack(stream)
                key, seg_hash, a, b, again = _segments(data, scope, length, gram)
                seg_hash = own_hashes(key, seg_hash, row_key, page_id)
                for k in np.flatnonzero(np.isin(key, np.frombuffer(keys, dtype=np.int64))).tolist():
                    out.append((page_id, row_key, int(key[k]), int(seg_hash[k]), int(a[k]), int(b[k]), bool(again[k]), need, data[a[k] : b[k] - 1 + length]))
            return columns(**{c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(SEGMENT_TYPES.items())})

        return step

    # The table of wanted keys is written before, so that Spark knows its size: a small one is broadcast, and no page shuffled.
    chosen = parsed.alias("l").join(wanted.dropDuplicates(["page_id", "row_key"]).alias("r"), _same_page("l", "r")).select("l.page_id", "l.row_key", "l.scope", "l.stream", "r.need", "r.keys")
    return map_batches(chosen, make, "doc_id long, row_key long, key long, seg_hash long, a int, b int, self boolean, need long, piece binary")


def covered_bytes(places: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
    """How many bytes of each place (start, end) lie in any of the ranges."""
    if not ranges:
        return np.zeros(len(places), np.int64)
    own = np.array(sorted(ranges), np.int64)
    reach = np.maximum.accumulate(own[:, 1])
    head = np.flatnonzero(np.concatenate(([True], own[1:, 0] > reach[:-1])))
    start, end = own[head, 0], reach[np.append(head[1:] - 1, len(own) - 1)]
    before = np.concatenate([[0], np.cumsum(end - start)])

    def upto(x: np.ndarray) -> np.ndarray:
        k = np.searchsorted(start, x, side="right")
        return before[k] - np.where(k > 0, np.maximum(end[k - 1] - x, 0), 0)

    return upto(places[:, 1]) - upto(places[:, 0])


def _same_page(left: str, right: str) -> list:
    return [F.col(f"{left}.page_id").eqNullSafe(F.col(f"{right}.page_id")), F.col(f"{left}.row_key") == F.col(f"{right}.row_key")]


def extract_articles(
    pages: DataFrame, length: int = 64, gram: int = 16, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", many: float = 0.5, least_pages: int = 2, ranges: int | None = None,
) -> DataFrame:
    """One row per page: its id, url, main text and the text's code points. Substrings of ``length`` bytes count as long."""
    parsed = materialize(_parse(pages, id_col, url_col, html_col), "pages")
    # Hash ranges of some two million keys.
    ranges = ranges or max(8, parsed.count() // 40_000)
    shared = materialize(shared_keys(key_blocks(parsed, length, gram, ranges), ranges), "shared")
    sizes = parsed.select("scope", "page_id", "row_key").distinct().groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    needs = sizes.select("scope", F.greatest(F.lit(least_pages), F.ceil(F.col("n") * many)).cast("long").alias("need"))
    wanted = materialize(wanted_keys(parsed, shared, needs), "wanted")
    rows = materialize(shared_segments(parsed, wanted, length, gram), "segments")
    # Repeated rows are found once each; what they cover is the same.
    often = counted_ranges(rows, length).filter("r.often")
    covered = materialize(often.groupBy(F.col("doc_id").alias("page_id"), "row_key").agg(F.collect_set(F.struct("r.a", "r.b")).alias("ranges")), "covered")
    joined = parsed.alias("l").join(covered.alias("r"), _same_page("l", "r"), "left")

    def make():
        unpack = zstandard.ZstdDecompressor().decompress

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for stream, starts, ends, kinds, own in zip(*(batch.column(c).to_pylist() for c in ("stream", "starts", "ends", "kinds", "ranges")), strict=True):
                data = unpack(stream)
                place, kind = np.column_stack([np.array(starts, np.int64), np.array(ends, np.int64)]), np.array(kinds, np.int64)
                repeated = covered_bytes(place, [(r["a"], r["b"] - 1 + length) for r in own or ()])
                unique = 2 * repeated <= place[:, 1] - place[:, 0]
                chosen = (kind == ARTICLE_BLOCK) | ((kind == OPEN_BLOCK) & unique)
                if not chosen.any():
                    chosen = kind == OPEN_BLOCK
                out.append(" ".join(data[a:b].decode() for a, b in place[chosen].tolist()))
            return columns(page_id=batch.column("page_id"), url=batch.column("url"), text=pa.array(out, pa.string()))

        return step

    kept = map_batches(joined.select("l.page_id", "l.url", "l.stream", "l.starts", "l.ends", "l.kinds", "r.ranges"), make, "page_id long, url string, text string")
    return kept.withColumn("n_chars", F.char_length("text").cast("long"))
