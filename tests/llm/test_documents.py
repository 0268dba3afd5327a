"""The document operators against plain brute-force versions on a small fixture."""

import hashlib
import json
import random
import re
import time
import struct
import zlib
from collections import Counter, defaultdict

import pytest

from ledgerlane.llm import decontaminate, jaccard_join, packing, quality_rules, secret_scan, sharding, suffix_dedup, tokens

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def same(df, expected, columns):
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    assert got == Counter(expected)


@pytest.fixture(scope="module")
def library():
    return tokens.load_tokenizer("byte_bpe_50k.json")


def test_token_counts(docs, fixture_rows, library):
    want = [(r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "", add_special_tokens=False).ids), n > 512) for r in fixture_rows]
    same(tokens.count_tokens(docs, table_size=50, cache_size=20), want, ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def test_frequent_pretokens_cover_all_whole_texts(spark, docs, fixture_rows):
    import public_tokenizers
    import regex

    split = regex.compile(public_tokenizers.PATTERN)
    want = Counter(w for r in fixture_rows for w in split.findall(r[1] or ""))
    assert tokens.frequent_pretokens(docs, "text", len(want), len(want)) == sorted(want, key=lambda w: (-want[w], w))
    # A word that only comes late in the last text still makes the table, with few counters.
    late = spark.createDataFrame([(" ".join(f"w{k}" for k in range(c, c + 300)),) for c in range(0, 3000, 300)] + [("x" * 9000 + " late" * 5000,)], "text string").coalesce(1)
    assert tokens.frequent_pretokens(late, "text", 1, 20) == [" late"]


def test_lowered_counts_lose_at_most_their_share():
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(1))}" for _ in range(5000)]
    seen, true = Counter(), Counter(words)
    for k, w in enumerate(words):
        seen[w] += 1
        if len(seen) > 40:
            seen = tokens.lowered(seen, 20)
    assert all(true[w] - len(words) / 20 <= seen[w] <= true[w] for w in true)


def test_special_strings_and_odd_code_points_count_as_the_library_does(spark, library):
    texts = ["a<|endoftext|>b", "<|endoftext|>", "\u2028x\u0085 y", "  \n\n  z", "don't I'LL", "日本語 ٣٤ ½", "\U0001f600\u200d", "e\u0301 \ufeff"]
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert got == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}
    fast = tokens.fast_encoder("byte_bpe_50k.json")
    assert all(fast(t).tolist() == library.encode(t, add_special_tokens=False).ids for t in texts)
    every = [chr(c) + " " + chr(c) + "a" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    assert [fast(t).tolist() for t in every] == [e.ids for e in library.encode_batch(every, add_special_tokens=False)]


def test_packing_round_trip(docs, fixture_rows, library):
    rows = packing.pack_documents(docs, capacity=256, with_ids=True).collect()
    want = Counter((r[0], tuple([*library.encode(r[1] or "", add_special_tokens=False).ids, 0])) for r in fixture_rows)
    alone = defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids)) and len(r.ids) == r.length
        alone[r.doc_id].append(r)
    unique = {k: v for k, v in Counter(r[0] for r in fixture_rows).items() if v == 1}
    for key in unique:
        parts = sorted(alone[key], key=lambda r: r.piece)
        assert [p.start for p in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
        assert all(p.length == 256 for p in parts[1:])
        assert (key, tuple(i for p in parts for i in p.ids)) in want
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= 1.03 * -(-sum(r.length for r in rows) // 256) + 1


def test_plan_fills_gaps_exactly_with_singles_pairs_and_triples():
    assert len([1 for n, _ in packing.plan_packing({6: 2, 4: 2}, 10).groups for _ in range(n)]) == 2
    assert sum(n for n, _ in packing.plan_packing({5: 1, 3: 1, 2: 1}, 10).groups) == 1
    assert sum(n for n, _ in packing.plan_packing({4: 1, 3: 1, 2: 1, 1: 1}, 10).groups) == 1
    assert sum(n for n, _ in packing.plan_packing({7: 3}, 10).groups) == 3


def brute_repeats(texts, length):
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        mask = [False] * len(t)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                mask[k : k + length] = [True] * length
        kept = bytes(b for b, m in zip(t, mask, strict=True) if not m)
        runs = sum(m and (k == 0 or not mask[k - 1]) for k, m in enumerate(mask))
        out.append((len(t), sum(mask), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "gram"), [(400, 128), (60, 16)])
def test_suffix_dedup(docs, fixture_rows, length, gram):
    want = [(r[0], *b) for r, b in zip(fixture_rows, brute_repeats([(r[1] or "").encode() for r in fixture_rows], length), strict=True)]
    same(suffix_dedup.remove_repeats(docs, length=length, gram=gram), want, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def test_suffix_dedup_splits_hot_keys(docs, fixture_rows):
    own = suffix_dedup.keyed(docs, "doc_id", "text")
    plain = suffix_dedup.repeated_ranges(own, 60, 16)[1]

    def windows(ranges):
        return {(r.doc_id, r.row_key, w) for r in ranges.select("doc_id", "row_key", "r.*").collect() for w in range(r.a, r.b)}

    want = windows(plain)
    # With 90 bytes, most sub-shards are too large as well.
    assert all(windows(suffix_dedup.repeated_ranges(own, 60, 16, shard_bytes=n)[1]) == want != set() for n in (500, 90))


def test_hot_keys_are_split_within_bounds(spark):
    """A passage in 600 contexts, some of which are met twice: not more is sent than the pieces have, and no sub-shard is over its bound."""
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)).encode()
    passage = letters(520)
    contexts = [letters(300) + passage + letters(300) for _ in range(600)]
    pieces = contexts + [c[:-1] + b"!" for c in contexts[:60]]
    reps = spark.createDataFrame([(1, k, k + 1, 0, 0, 0, bytearray(p)) for k, p in enumerate(pieces)], "key long, seg_hash long, tag long, weight long, need long, n_bytes long, piece binary")
    parts = suffix_dedup.hot_parts(reps, 400, False).cache()
    seen = Counter(p[k : k + 400] for p in pieces for k in range(len(p) - 399))
    got = Counter((r.seg_hash, r.base + k) for r in parts.collect() for k in range(r.n))
    assert got == Counter((i, k) for i, p in enumerate(pieces) for k in range(len(p) - 399) if seen[p[k : k + 400]] > 1)
    for bound in (40_000, 2_000_000):
        sent, large = suffix_dedup.hot_shards(parts, False, bound)
        sizes = Counter()
        for r in sent.collect():
            sizes[r.shard] += len(r.piece)
        assert max(sizes.values()) <= bound
        assert sum(sizes.values()) <= sum(map(len, pieces)) and (bound < 2_000_000 or large.count() == 0)


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_components(rows, shingle, percent):
    sets = []
    for _, text in rows:
        w = SPACE.findall(ascii_lower(text or ""))
        sets.append({tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for k, (key, _) in enumerate(rows):
        if sets[k] and key is not None:
            least[label[k]] = min(least.get(label[k], key), key)
    return [(key, len(sets[k]), least.get(label[k]) if sets[k] else key) for k, (key, _) in enumerate(rows)]


@pytest.mark.parametrize(("shingle", "percent", "block"), [(3, 90, 2048), (5, 80, 2), (2, 50, 3)])
def test_jaccard_components(docs, fixture_rows, shingle, percent, block):
    want = brute_components([r[:2] for r in fixture_rows], shingle, percent)
    assert len({w[2] for w in want}) < len(want) - 8
    same(jaccard_join.jaccard_components(docs, shingle, percent, block=block), want, ["doc_id", "n_shingles", "component_id"])


def test_hot_group_of_near_copies_in_blocks(spark):
    """A group that fills many blocks: near copies of one text, a few that only link to each other, and chance members."""
    rng = random.Random(11)
    words = [f"word{k}" for k in range(120)]
    rows = []
    for k in range(150):
        w = list(words)
        w[rng.randrange(120)] = f"own{k}"
        rows.append((k, " ".join(w)))
    other = words[:60] + [f"else{k}" for k in range(60)]
    rows += [(1000 + k, " ".join(other[:100] + [f"z{k}"] + other[101:])) for k in range(9)]
    rows += [(2000 + k, " ".join(words[:30] + [f"q{k}x{i}" for i in range(90)])) for k in range(20)]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    same(jaccard_join.jaccard_components(own, 3, 90, block=8), brute_components(rows, 3, 90), ["doc_id", "n_shingles", "component_id"])
    same(jaccard_join.jaccard_components(own, 3, 90, block_tokens=900), brute_components(rows, 3, 90), ["doc_id", "n_shingles", "component_id"])


def test_join_sends_few_blocks(spark):
    """Short documents of one task are one batch, so that blocks (one for a batch and a range) don't grow with the square of the table."""
    rows = [(k, k, " ".join(f"w{k * i % 997}" for i in range(1, 12))) for k in range(3000)]
    own = spark.createDataFrame(rows, "doc_id long, row_key long, text string").coalesce(1)
    blocks = jaccard_join.token_blocks(own, 3, 90, 50)
    assert blocks.filter("part < 0").count() == 1 and blocks.filter("part >= 0").count() <= 50


def test_sets_of_joined_texts():
    """Texts in one array: no shingle crosses from a text to the next one, and short and empty ones keep their places."""
    rng = random.Random(3)
    texts = [b" ".join(rng.choice([b"a", b"B", b"b", "é".encode()]) for _ in range(rng.randrange(9))) + rng.choice([b"", b" ", b"\n"]) for _ in range(300)] + [b"", b"a b a b a b", b""]
    found, sizes = jaccard_join.shingle_sets(texts, 3, most=100)
    ends = sizes.cumsum().tolist()
    sets = [found[b - n : b].tolist() for b, n in zip(ends, sizes.tolist(), strict=True)]
    assert sets == [jaccard_join.shingle_set(t, 3).tolist() for t in texts]
    assert [(k, len(s)) for k, s in enumerate(sets)] == [r[:2] for r in brute_components([(k, t.decode()) for k, t in enumerate(texts)], 3, 90)]


def test_groups_hold_only_sizes_that_can_link(spark):
    """Classes 1 and 2 can link, and 3 with 2; 5 is too small and 4 too large; without 3 and 5 both tokens' groups are the same."""
    sizes, weights = {1: 100, 2: 90, 3: 89, 4: 1000, 5: 80}, {1: 2, 2: 2, 3: 5, 4: 9, 5: 1}
    tokens_of = {1: (7, 8), 2: (7, 8), 3: (7,), 4: (8,), 5: (8,)}
    rows = [(c, o, t, weights[c], sizes[c]) for c in sizes for o in range(2) for t in tokens_of[c]]
    rows = spark.createDataFrame(rows, "cid long, order int, token long, weight int, n long")
    got = jaccard_join.candidate_groups(rows.filter("cid NOT IN (3, 5)"), 90, 2, 2048, 4_000_000).collect()
    assert sorted((r.cid, r.n, r.blocks, r.i) for r in got) == [(1, 100, 1, 0), (2, 90, 1, 0)] and len({r.k for r in got}) == 1 and sum(r.hub for r in got) == 1
    # 89 can link with 90, so the part is cut only at gaps.
    got = jaccard_join.candidate_groups(rows, 90, 2, 2048, 4_000_000).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r.k].add(r.cid)
    assert sorted(map(sorted, groups.values())) == [[1, 2], [1, 2, 3]]


def test_components_of_long_chains(spark):
    rng = random.Random(5)
    names = list(range(1, 1201))
    rng.shuffle(names)
    # A shuffled chain; one whose territories around local minima the least node has to cross; a pair.
    hard = [5000 + (k if k % 2 else 3000 + k) for k in range(600)]
    links = list(zip(names, names[1:])) + list(zip(hard, hard[1:])) + [(9001, 9002)]
    rng.shuffle(links)
    got = {r.node: r.label for r in jaccard_join.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == dict.fromkeys(names, 1) | dict.fromkeys(hard, min(hard)) | {9001: 9001, 9002: 9001}


def test_keep_one(docs, fixture_rows):
    components = brute_components([r[:2] for r in fixture_rows], 5, 80)
    want = {c for _, n, c in components if n} | {k for k, n, _ in components if not n}
    kept = jaccard_join.keep_one(docs)
    assert kept.schema == docs.schema
    rows = kept.collect()
    assert {r.doc_id for r in rows} == want and all(r.row_key == "mine" and r._id == 1 for r in rows)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(rows, items, window=10):
    found = defaultdict(set)
    for key, text in items:
        w = WORD.findall(ascii_lower(text or ""))
        for k in range(max(1, len(w) - window + 1)) if w else ():
            found[tuple(w[k : k + window])].add("null" if key is None else str(key))
    out = []
    for r in rows:
        w, hit, own = WORD.findall(ascii_lower(r[1] or "")), set(), set()
        for size in {len(x) for x in found}:
            for k in range(len(w) - size + 1):
                if (names := found.get(tuple(w[k : k + size]))) is not None:
                    hit |= set(range(k, k + size))
                    own |= names
        out.append((r[0], len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture(scope="module")
def items(fixture_rows):
    texts = [r[1] for r in fixture_rows]
    cut = [" ".join(texts[k].split()[3:20]).upper() for k in (12, 13, 14)]
    return [(1, cut[0]), (2, cut[1]), (10, cut[1]), (3, "never seen here at all"), (4, ""), (5, None), (6, "One two"), (6, "One two"), (7, " ".join(cut[2].split()[:9])), (None, cut[2])]


@pytest.mark.parametrize("block_bytes", [8_000_000, 150])
def test_contamination(spark, docs, fixture_rows, items, block_bytes):
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(fixture_rows, items)
    assert sum(w[5] for w in want) >= 4
    found = decontaminate.contamination(docs, bench, block_bytes=block_bytes)
    same(found, want, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
    clean = decontaminate.drop_contaminated(docs, bench, block_bytes=block_bytes)
    assert Counter(r.doc_id for r in clean.collect()) == Counter(w[0] for w in want if not w[5])


def test_contamination_with_empty_tables(spark, docs, no_docs, fixture_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in decontaminate.contamination(docs, none).collect()} == {False}
    assert decontaminate.contamination(no_docs, none).count() == 0


def test_quality_counts(spark, docs, fixture_rows):
    more = ["a b c d e f g h " * 6, "same line\nsame line\n\n\nsame line \nx", "## | ** $ & <>%"]
    rows = [*[r[:2] for r in fixture_rows], *[(1000 + k, t) for k, t in enumerate(more)]]
    want = []
    for key, text in rows:
        text = text or ""
        w = SPACE.findall(text)
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {p for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        lines = [x for x in text.split("\n") if SPACE.search(x)]
        want.append((key, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)))
    found = quality_rules.quality_report(docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows[-3:], "doc_id long, text string")))
    same(found, want, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])
    assert not [r for r in found.collect() if r.base_failed and r.kept]


def test_quality_removes_lines_and_rejects_what_loses_too_much():
    good = "A plain sentence with a number of words that says something of its own. Another one follows here, quite different from the first of them."
    row, text = quality_rules.judge(f"Home | About | News | Contact\n{good}\nAll rights reserved".encode())
    assert row["kept"] and row["n_removed_lines"] == 2 and text.decode() == good
    row, _ = quality_rules.judge(("Home | About | News | Contact\n" * 9 + good[:130]).encode())
    assert not row["kept"]


def test_labels_agree_with_the_quality_rules(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = quality_rules.quality_report(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(r.kept for r in bad) <= 0.03 * len(bad)


ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def plain_run(text, at, allowed):
    while at < len(text) and text[at] in allowed:
        at += 1
    return at


def plain_secrets(text):
    """The base spans, character by character."""
    out, at = [], 0
    while at < len(text):
        lower = ascii_lower(text[at : at + 8])
        word = next((w for w in ("password", "passwd", "secret", "token", "api_key", "apikey") if lower.startswith(w)), None)
        end = -1
        if word:
            k = at + len(word)
            k += text[k : k + 1] in ('"', "'") and k < len(text)
            k = plain_run(text, k, " ")
            if text[k : k + 1] and text[k] in ":=":
                k = plain_run(text, k + 1, " ")
                k += text[k : k + 1] in ('"', "'") and k < len(text)
                end = plain_run(text, k, ALNUM + "+/_.=-")
                if end - k >= 8:
                    out.append((at, "assign", end))
                end = end if end > k else -1
        at = max(at + 1, end)
    for kind, start, allowed, least in (("access", "AKIA", ALNUM[:26] + ALNUM[52:], 16), ("hex", "", "0123456789abcdef", 32)):
        at = 0
        while at < len(text):
            end = plain_run(text, at + len(start), allowed) if text.startswith(start, at) else at
            if end > at + len(start) and end - at >= least:
                out.append((at, kind, end))
            at = max(at + 1, end if end > at + len(start) else 0)
    order = ("assign", "access", "hex")
    return sorted(out, key=lambda s: (s[0], order.index(s[1])))


def test_base_secrets_equal_a_plain_scan():
    rng = random.Random(21)
    parts = ["password", "PassWd", "secret", "Token", "api_key", "apikey", "api", "AKIA", "AKIAAKIA", "ABCDEF0123456789", "0123456789abcdef", "deadbeef" * 4, "=", ":", " ", "  ", '"', "'", "é", "\n", "x", "12345678", "a.b-c_d=", "-"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        got = sorted(secret_scan.base_spans(text), key=lambda s: (s[0], secret_scan.KINDS.index(s[2])))
        assert [(a, kind, b) for a, b, kind in got] == plain_secrets(text), text


def test_secrets_in_very_long_texts_and_key_structures():
    began = time.time()
    for piece in ("eyJ", "eyJ.", "AKIA", "a.", "A" * 63 + "=", "-----BEGIN A-----", "password="):
        secret_scan.confirmed_spans(piece * (1_000_000 // len(piece)))
        secret_scan.base_spans(piece * (1_000_000 // len(piece)))
    assert time.time() - began < 60
    field = lambda b: len(b).to_bytes(4, "big") + b
    public = field(b"ssh-ed25519") + field(bytes(32))
    private = b"abcdabcd" + field(b"ssh-ed25519") + field(bytes(32)) + bytes(range(1, 8))
    whole = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(public) + field(private)
    assert secret_scan.is_private_key(whole)
    assert not secret_scan.is_private_key(whole[:-1]) and not secret_scan.is_private_key(whole.replace(b"abcdabcd", b"abcdabce")) and not secret_scan.is_private_key(b"openssh-key-v1\0" + bytes(16))
    pkcs8 = lambda inner: bytes([0x30, 3 + 7 + 2 + len(inner), 2, 1, 0, 0x30, 5, 6, 3, 0x2B, 0x65, 0x70, 4, len(inner)]) + inner
    assert secret_scan.is_private_key(pkcs8(bytes([4, 32, *range(32)]))) and not secret_scan.is_private_key(pkcs8(bytes([4, 33, *range(32)])))


def test_secrets(spark):
    head = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0."  # {"alg":"HS256"}.{"sub":"1"}
    sec1 = bytes([0x30, 0x25, 2, 1, 1, 4, 32, *range(32)])
    import base64

    key = base64.b64encode(sec1).decode()
    texts = [
        'pass PASSWORD = "abcDEF123" and password: short', "AKIA" + "Z" * 12 + " AKIA123", "f" * 31 + " " + "a" * 32, f"é {head}sig {key} tail", None, "", "eyJub3QiOiJhIn0.eyJhIjoxfQ.x " + "A" * 60, sec1.hex() + " end", "api_key='12345678' ApiKey:87654321 token token=12345678",
    ]
    got = {r.doc_id: r for r in secret_scan.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert got[0].spans == "assign:5:26" and got[1].spans == "access:0:16" and got[2].spans == "hex:32:64"
    assert re.fullmatch(r"jwt:2:\d+,key:\d+:\d+", got[3].spans) and got[4].spans == got[5].spans == got[6].spans == ""
    assert got[7].n_hex >= 0 and "key:" in got[7].spans and got[8].n_assign == 3
    for r in got.values():
        base = ",".join(s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    clean = secret_scan.redact_documents(spark.createDataFrame([(1, texts[0], 99)], "doc_id int, text string, n_chars long")).first()
    assert clean.text == "pass [assign]\" and password: short" and clean.n_chars == len(clean.text)


def test_signed_token_needs_an_algorithm():
    part = lambda x: __import__("base64").urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    assert secret_scan.is_signed_token(f"{part({'alg': 'none'})}.{part({'a': 1})}.")
    assert not secret_scan.is_signed_token(f"{part({'typ': 'JWT'})}.{part({'a': 1})}.")
    assert not secret_scan.is_signed_token(f"{part({'alg': 'none'})}.{part([1])}.")


def test_sharding(docs, fixture_rows):
    rows = sharding.shard_documents(docs).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in fixture_rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    by_shard = defaultdict(list)
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None
        by_shard[r.shard].append(r.slot)
    assert set(by_shard) == set(range(8)) and max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    groups = defaultdict(set)
    for r in rows:
        groups[(r.text_crc32, r.size)].add(r.shard)
    assert sum(len(s) > 1 for s in groups.values()) <= 1


@pytest.mark.parametrize("alone", [0, 40])
def test_sharding_keeps_groups_whole_beside_a_hot_one(spark, alone):
    texts = ["hot"] * 400 + [f"group {k}" for k in range(200) for _ in range(2 + k % 5)] + [f"alone {k}" for k in range(alone)]
    rows = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    sizes, found = Counter(r.shard for r in rows), defaultdict(set)
    for r in rows:
        found[texts[r.doc_id]].add(r.shard)
    assert len(rows) == len(texts) and set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    # 400 of 1200 or 1240 documents take two whole shards and a part; the rest cut a few groups at most, none if there are single ones.
    assert len(found.pop("hot")) == 3
    assert sum(len(s) > 1 for s in found.values()) <= (0 if alone else 7)


def test_empty_tables(no_docs):
    for found in (packing.pack_documents, suffix_dedup.remove_repeats, tokens.count_tokens, quality_rules.quality_report, quality_rules.clean_documents, secret_scan.scan_secrets, secret_scan.redact_documents, jaccard_join.jaccard_components, jaccard_join.keep_one, sharding.shard_documents):
        assert found(no_docs).count() == 0


def best_fit_decreasing(counts, capacity):
    """Sequences that plain best fit needs, piece by piece."""
    gaps, n = Counter(), 0
    for length in sorted(Counter(counts).elements(), reverse=True):
        gap = min((g for g in gaps if g >= length and gaps[g]), default=None)
        if gap is None:
            n, gap = n + 1, capacity
        else:
            gaps[gap] -= 1
        gaps[gap - length] += 1
    return n


def fewest(lengths, capacity):
    """The least number of sequences, by trying every place for every piece."""
    best = len(lengths)

    def put(k, open_ones):
        nonlocal best
        if len(open_ones) >= best:
            return
        if k == len(lengths):
            best = len(open_ones)
            return
        for i, used in enumerate(open_ones):
            if used + lengths[k] <= capacity and used not in open_ones[:i]:
                put(k + 1, [*open_ones[:i], used + lengths[k], *open_ones[i + 1 :]])
        put(k + 1, [*open_ones, lengths[k]])

    put(0, [])
    return best


def test_packing_never_needs_more_sequences_than_best_fit():
    rng = random.Random(21)
    for case in range(60):
        capacity = rng.choice([16, 64, 256, 2048])
        draw = rng.choice([lambda: rng.randrange(1, capacity + 1), lambda: rng.randrange(1, capacity // 3 + 2), lambda: int(min(capacity, rng.paretovariate(0.7)))])
        counts = Counter(draw() for _ in range(rng.randrange(0, 400)))
        plan = packing.plan_packing(counts, capacity)
        assert plan.sequences() <= best_fit_decreasing(counts, capacity), case
        used = Counter()
        for n, lengths in plan.groups:
            assert sum(lengths) <= capacity and n > 0
            for x in lengths:
                used[x] += n
        assert used == counts
    for _ in range(40):
        lengths = sorted((rng.randrange(1, 13) for _ in range(rng.randrange(1, 9))), reverse=True)
        assert packing.plan_packing(Counter(lengths), 12).sequences() <= fewest(lengths, 12) + 1


def test_packing_of_the_given_lengths(spark):
    pieces = packing.token_pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 2048, "byte_bpe_50k.json", 0, "doc_id", "text", False)
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    assert packing.plan_packing(counts, 2048).sequences() <= best_fit_decreasing(counts, 2048)


def plain_header(part):
    """The first suffix of a part that is an object with an algorithm, suffix by suffix."""
    for at in range(len(part)):
        if part.startswith("eyJ", at) and isinstance((secret_scan._object(part[at:]) or {}).get("alg"), str):
            return at
    return None


def test_headers_of_any_length_are_found_at_any_place():
    import base64

    part = lambda value: base64.urlsafe_b64encode(json.dumps(value, ensure_ascii=False).encode()).decode().rstrip("=")
    rng = random.Random(6)
    for size in (1, 50, 2000, 9000):
        token = part({"alg": "RS256", "x5c": ["é" + "A" * size], "in": {"alg": "x"}})
        for before in ("", "id_", "eyJ_", "eyJhbG", "eyJ" * 50 + "_", "x" * 999):
            text = f"{before}{token}.{part({'sub': 1})}.sig"
            assert secret_scan.signed_tokens(text) == [(len(before), len(text), "jwt")], (size, before)
    for _ in range(300):
        pieces = [rng.choice(["eyJ", part({"alg": "a"}), part({"a": {"alg": "b"}}), part({"alg": 1}), "x", "_-", part({"k": "é", "alg": "c"})[: rng.randrange(30)]]) for _ in range(rng.randrange(1, 5))]
        assert secret_scan.header_start("".join(pieces)) == plain_header("".join(pieces)), pieces
    for long in (part([{"a": 1}] * 40_000), "eyJh" * 200_000, part({"a": "b" * 500_000}) * 2, part({"alg": "x"}) * 20_000 + "_"):
        began = time.process_time()
        secret_scan.signed_tokens(f"{long}.{part({'a': 1})}.s")
        assert time.process_time() - began < 5


KEPT_LINES = [
    "She baked a cookie for her brother and he ate it.", "The newsletter of 1912 was printed in Leipzig.", "The judge ruled that copyright did not apply here.", "They log in the forest during winter, near the old mill.", "Der Datenschutz war das Thema der Sitzung am Montag.",
    "Sous la pluie, le droit d'auteur fut longuement discuté.", "He wrote JavaScript for years before he turned to painting.",
]
GONE_LINES = [
    "TOUS DROITS RÉSERVÉS pour tous les pays du monde.", "Copyright © 2021 The Company.", "We use cookies to give you the best experience.", "Impressum", "Datenschutz | AGB", "Licensed under CC BY-NC 4.0.", "Subscribe to our newsletter for more of this.", "Política de privacidad del sitio.",
]


def test_boilerplate_lines_and_lines_that_only_look_like_them():
    limits = quality_rules.Limits()
    assert [line for line in KEPT_LINES if quality_rules.line_fails(line.encode(), limits)] == []
    assert [line for line in GONE_LINES if not quality_rules.line_fails(line.encode(), limits)] == []
