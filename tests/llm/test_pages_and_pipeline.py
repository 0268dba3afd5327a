"""Page operators, the suffix array and the pipeline against plain versions."""

import html
import random
import sys
import time
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from ledgerlane.llm import html_extract, packing, queries, url_filter
from ledgerlane.llm.suffix_array import common_prefixes, suffix_array


def test_suffix_array_and_prefixes():
    rng = random.Random(3)
    for case in [b"", b"a", b"aaaaaa", b"banana", bytes(rng.randrange(3) for _ in range(500)), bytes(range(256)) * 2]:
        if not case:
            continue
        data = np.frombuffer(case, dtype=np.uint8)
        sa = suffix_array(data)
        want = sorted(range(len(case)), key=lambda k: case[k:])
        assert sa.tolist() == want
        prefix = common_prefixes(data, sa)
        for k in range(1, len(want)):
            a, b = case[want[k - 1] :], case[want[k] :]
            assert prefix[want[k]] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_suffix_array_takes_few_passes_whatever_repeats():
    """Each round is a few calls over whole arrays, so their number doesn't grow with the text; long repeats included."""
    rng = np.random.default_rng(5)
    passages = [rng.integers(97, 123, 900).astype(np.uint8) for _ in range(40)]
    text = np.concatenate([passages[k] for k in rng.integers(0, 40, 130)])
    calls = Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        sa = suffix_array(text)
    finally:
        sys.setprofile(None)
    assert calls["call"] + calls["c_call"] < 1000
    ranks = np.append(np.argsort(sa), -1)
    assert (np.diff(text[sa] * np.int64(len(text) + 1) + ranks[sa + 1] + 1) > 0).all() and len(sa) == len(text)


@pytest.mark.parametrize("text", [np.tile(np.arange(7, dtype=np.uint8), 300_001), np.array([70_000, 3, 70_000, 3, 3, 0, 70_000, 3]), np.zeros(20, dtype=np.uint8)])
def test_suffix_array_orders_neighbours(text):
    """Ranks of over 21 bits, symbols beyond bytes, and zeros at the end: by first symbols, then by the ranks of the rest."""
    sa = suffix_array(text)
    ranks = np.full(len(text) + 1, -1)
    ranks[sa] = np.arange(len(text))
    assert (np.diff(text[sa] * np.int64(len(text) + 1) + ranks[sa + 1] + 1) > 0).all() and (ranks[:-1] >= 0).all()


def brute_verdict(url, rules):
    _, found, rest = (url or "").partition("://")
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)]) if found else 0
    host, tail = (rest[:end].lower(), rest[end:]) if found else ("", "")
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text)) if fits else None
    return host, path, best and best.text, best.verdict if best else "allow"


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://WWW.Example.com/en/x?y", "https://example.com/en/", "https://a.example.com/en", "http://net/es/1", "x://b.net/fr/?q", "x://b.net/fr", "x://evilnet/fr/", "http://com", "http://a.com/", "http://a.com?x/en/", "x://e.com#/", "http://c.net//es/", "a://b://c/d"]
    rows = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id int, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(rows, queries.URL_RULES).collect()}
    assert got == {k: brute_verdict(u, queries.URL_RULES) for k, u in enumerate(urls)}
    for n in (1, 2, 4):
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(rows.union(rows), queries.URL_RULES, max_rules=n).collect()} == got
    assert url_filter.filter_urls(rows.limit(0), queries.URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(rows, []).collect()} == {"allow"}


def test_articles(spark):
    menu = "<nav><a href='/a'>Home</a></nav><div class='cookie-notice'>We use cookies</div>"
    shared = "This long line of site text stands on each and every page of this host, always."
    pages = [
        (1, "http://a.com/1", f"<html><head><title>T</title><script>x('</p>')</script></head><body>{menu}<article><h1>A &amp; B</h1><p>One\n two<p>Three <b>bo</b>ld<br>four</article><footer>&copy;</footer>"),
        (2, "http://a.com/2", f"<body><div><p>{shared}</p><p>Only this page says that one.</p></div>{menu}"),
        (3, "http://a.com/3", f"<body><div><p>{shared}</p><p>And this one another thing.</p></div><div id=comments>nice</div>"),
        (4, "http://b.com/4", f"<body><p>{shared}</p>"), (5, None, None), (6, "http://a.com", ""), (None, "http://c.com", "<article>null id</article>"),
    ]
    found = html_extract.extract_articles(spark.createDataFrame([(*p, "x") for p in pages], "page_id int, url string, html string, text string"))
    got = {r.page_id: r for r in found.collect()}
    assert got[1].text == "A & B One two Three bold four" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "Only this page says that one." and got[3].text == "And this one another thing."
    assert got[4].text == shared and got[5].text == got[6].text == "" and got[None].text == "null id"
    assert html_extract.extract_articles(spark.createDataFrame([], "page_id int, url string, html string")).count() == 0


def test_pipeline_stages(spark, docs, fixture_rows):
    sf = "/root/testdata/sf0.001"
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "best-fit packing"]
    out = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = out.schema, {r.doc_id for r in out.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, sf).cache()
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert out.schema == columns and now <= ids and now
        ids = now
    packed = corpus_pipeline.STAGES[-1][1](spark, out, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, sf).collect())) == sorted(map(key, packed.collect()))
    assert sorted(map(key, packing.pack_documents(out).collect())) == sorted(map(key, packed.collect()))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs.limit(0), sf).count()


def test_articles_are_kept_whole_and_boxes_go(spark):
    """What a host repeats goes where nothing says that it is the article; stories that it tells again stay."""
    box = "Get our weekly letter with the best of the site in your inbox, for free and without adverts."
    story = "The council met on Monday to speak about the old bridge, which will be closed for all traffic until the next spring comes."
    pages = [(k, f"http://a.com/{k}", f"<article><p>{story}</p><p>Update number {k} of this story.</p></article><div>{box}</div>") for k in range(4)]
    pages += [(10 + k, f"http://b.com/{k}", f"<div>{box}</div><div><p>Story {k} begins with words {k * 7919}.</p><p>{k * 31 + 5} ends it, and {story if k < 3 else str(k * 7919) * 9}</p></div><div>{box[::-1]}</div>") for k in range(12)]
    pages += [(30 + k, f"http://c.com/{k}", f"<div>{story}</div>") for k in range(3)]
    pages += [(40, "http://d.com/1", "<article>A card</article><div>The body stands in plain boxes here.</div>"), (41, "http://d.com/2", "<article>Other card</article><div>And one more body of text.</div>")]
    found = {r.page_id: r.text for r in html_extract.extract_articles(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    for k in range(4):
        assert found[k] == f"{story} Update number {k} of this story."
    for k in range(12):
        assert found[10 + k] == f"Story {k} begins with words {k * 7919}. {k * 31 + 5} ends it, and {story if k < 3 else str(k * 7919) * 9}"
    assert all(found[30 + k] == story for k in range(3))
    assert found[40] == "A card The body stands in plain boxes here." and found[41] == "Other card And one more body of text."


def test_pages_without_any_telling_tag(spark):
    """The given pages with all elements turned into plain boxes: the array alone tells menus and footers from articles."""
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    rng, pages, want = random.Random(8), [], {}
    menus = {h: [" ".join(rng.choice(["home", "news", "sport", "travel", "money", "letters"]) + str(rng.randrange(99)) for _ in range(14)) for _ in range(2)] for h in range(5)}
    for k, r in enumerate(rows):
        text = [b.text for b in html_extract.blocks(r.html) if b.article and not b.apart]
        want[k] = " ".join(text)
        head, foot = menus[k % 5]
        pages.append((k, f"http://h{k % 5}.com/{k}", f"<div>{head}</div>" + "".join(f"<div>{html.escape(t)}</div>" for t in text) + f"<div>{foot}</div>"))
    got = {r.page_id: r.text for r in html_extract.extract_articles(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()}
    kept = sum(len(want[k]) for k in want if want[k] in got[k]) / sum(map(len, want.values()))
    clean = sum(not any(m in got[k] for m in menus[k % 5]) for k in want) / len(want)
    assert kept >= 0.9 and clean >= 0.99


def test_markup_is_read_in_linear_time():
    shapes = {
        "unclosed tags": "<a " * 350_000, "unclosed quotes": '<div a="x ' * 100_000, "odd quotes": '<a "x>" ' * 120_000 + ">", "stray ends": "<b>" * 100_000 + "</i>" * 100_000, "declarations": "<!" * 500_000,
        "comments": "<!-- " * 200_000, "raw": "<script>" * 120_000, "names": "<a" + " b" * 400_000 + ">", "spaces": "<a " + " " * 1_000_000 + ">x", "text": "a < b & c " * 100_000, "closed deep": "<b>" * 100_000 + "</b>" * 100_000,
    }
    for name, page in shapes.items():
        began = time.process_time()
        html_extract.blocks(page)
        assert time.process_time() - began < 4, name


def test_odd_markup():
    text = lambda page: " ".join(b.text for b in html_extract.blocks(page))
    assert text("a < b and <b>c</b> > d") == "a < b and c > d"
    assert text('<a title="x > y">one</a> <a title=\'it "is"\'>two') == "one two"
    assert text("<p>one<!-- no <b> --> two<!DOCTYPE x><?php y ?>three") == "one twothree"
    assert text("<script>if (a < b) '</p>'</SCRIPT >kept<style>p{}") == "kept"
    assert text('<a href="x>lost</a> <b>kept</b>') == "lost kept" and text("end <a href=") == "end <a href="
    assert text("&lt;p&gt; &amp;amp; &eacute;") == "<p> &amp; é"


def plain_articles(pages, length=64, least=2):
    """The same by comparing every window of every page with all pages of the host."""
    parsed = []
    for page_id, url, page in pages:
        found = html_extract.blocks(page or "")
        parsed.append((page_id, url_filter.split_url(url)[0], found, b"\n".join(b.text.encode() for b in found)))
    out = {}
    for page_id, host, found, stream in parsed:
        own = [s for _, h, _, s in parsed if h == host]
        need = max(least, -(-len(own) // 2))
        count = [sum(stream[k : k + length] in s for s in own) for k in range(len(stream) - length + 1)]
        cover = [False] * len(stream)
        for k, n in enumerate(count):
            if n >= need:
                cover[k : k + length] = [True] * length
        at, kept, open_ones = 0, [], []
        for block in found:
            data = block.text.encode()
            hit = sum(cover[at : at + len(data)])
            at += len(data) + 1
            if block.apart:
                continue
            if not block.article:
                open_ones.append(data)
            if block.article or 2 * hit <= len(data):
                kept.append(data)
        out[page_id] = b" ".join(kept or open_ones).decode()
    return out


def test_articles_equal_a_plain_search(spark):
    rng = random.Random(17)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    shared = [prose(12) for _ in range(6)]
    pages = []
    for k in range(40):
        host = f"h{k % 3}.com" if k < 36 else "small.com"
        boxes = [f"<div>{rng.choice(shared)}</div>" if rng.random() < 0.5 else f"<p>{prose(rng.randrange(1, 20))}</p>" for _ in range(5)]
        body = "".join(boxes[:2]) + f"<article><p>{prose(30)}</p>{boxes[2]}<p>{shared[0] if k % 3 == 0 else prose(9)} é</p></article>" + "".join(boxes[3:]) if k % 4 else "".join(boxes)
        pages.append((k, f"http://{host}/{k}", f"<body><nav>{shared[5]}</nav>{body}<footer>{prose(4)}</footer>"))
    rows = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id int, url string, html string, scope string, batch int").repartition(3)
    want = plain_articles(pages)
    for ranges in (None, 3):
        got = {r.page_id: r.text for r in html_extract.extract_articles(rows, ranges=ranges).collect()}
        wrong = [k for k in got if got[k] != want[k]]
        assert len(got) == 40 and not wrong, (wrong, got[wrong[0]], want[wrong[0]])


def test_long_and_repeated_pages(spark):
    body = " ".join(f"word{k}" for k in range(60_000))
    pages = [(1, "http://a.com/1", f"<article><p>{body}</p></article>"), (2, "http://a.com/2", "<p>only once said</p>"), (2, "http://a.com/2", "<p>only once said</p>")]
    got = html_extract.extract_articles(spark.createDataFrame(pages, "page_id int, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(1, body), (2, "only once said"), (2, "only once said")]
