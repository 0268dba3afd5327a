"""Tokenizer alignment, hard negatives and toxicity against plain versions and held-out accuracy."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerlane.llm import alignment, hard_negatives, toxicity


def plain_groups(text):
    """Groups of ids of both sides of one text, walking byte by byte."""
    a, b = alignment.side("byte_bpe_50k.json"), alignment.side("piece_bpe_32k.model")
    if not text:
        return []
    ids = [a.encode([text])[0], b.encode([text])[0]]
    joined = [b"".join(s.bytes_of[i] for i in own) for s, own in zip((a, b), ids)]
    if joined[0] != (" " + text).encode() or joined[1] != joined[0]:
        return []
    groups, at, ends, held = [], [0, 0], [0, 0], ([], [])
    while at[0] < len(ids[0]) or at[1] < len(ids[1]):
        k = 0 if ends[0] <= ends[1] and at[0] < len(ids[0]) else 1
        held[k].append(ids[k][at[k]])
        ends[k] += len((a, b)[k].bytes_of[ids[k][at[k]]])
        at[k] += 1
        if ends[0] == ends[1]:
            groups.append(held)
            held = ([], [])
    return groups


def plain_alignment(rows):
    groups = [plain_groups(t) for _, t in rows]
    links = [Counter((x, y) for g in own for x in g[0] for y in g[1]) for own in groups]
    count = Counter(p for own in links for p in own)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (key, _), own, pairs in zip(rows, groups, links):
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in own)
        out.append((
            key, sum(len(g[0]) for g in own), sum(len(g[1]) for g in own), len(own), sum(pairs.values()), sum(n for p, n in pairs.items() if count[p] == best[p[0]]),
            sum(n * count[p] for p, n in pairs.items()), hashlib.sha256(text.encode()).hexdigest() if own else "",
        ))
    return Counter(out)


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["", None, " ", "a", "  lead", "trail  ", "<|endoftext|> <s>", "日本語テキスト ٣٤", "\U0001f600‍ x", "é﻿", "a\x00b", "▁▁ x", "\n\t\r\n", "ﬁ Å", "https://ex.org/a_b?c=%20", "don't I'LL"]


@pytest.mark.parametrize("table_pairs", [10_000, 30, 0])
def test_alignment_equals_a_walk_over_bytes(spark, docs, fixture_rows, table_pairs):
    rows = [(r[0], r[1]) for r in fixture_rows] + [(1000 + k, t) for k, t in enumerate(ODD)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(rows[len(fixture_rows) :], "doc_id long, text string"))
    got = alignment.aligned_documents(table, table_pairs)
    assert got.columns == ALIGNED
    assert Counter(tuple(r) for r in got.collect()) == plain_alignment(rows)


def test_alignment_of_long_runs_without_shared_ends(spark):
    """Groups of thousands of tokens a side: the links are made of distinct ids, in small parts."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc1漢́") for _ in range(3000)), "ab" * 4000, "x" * 3000 + " y " + "x" * 3000, " ".join("z" * k for k in range(120))]
    import pyarrow as pa

    flat = alignment.Flat(pa.RecordBatch.from_pydict(alignment.tokens_of(texts)))
    want = Counter()
    for k, t in enumerate(texts):
        for g in plain_groups(t):
            for (x, n), (y, m) in ((p, q) for p in Counter(g[0]).items() for q in Counter(g[1]).items()):
                want[(k, x << alignment.BITS | y)] += n * m
    for most in (7, 1000, 1 << 30):
        got, parts = Counter(), []
        for doc, pair, times in flat.links(most):
            parts.append(set(zip(doc.tolist(), pair.tolist())))
            for d, p, n in zip(doc.tolist(), pair.tolist(), times.tolist()):
                got[(d, p)] += n
        assert got == want
        assert sum(map(len, parts)) == len(set().union(*parts))
    assert max(len(x) for x in parts) < sum(want.values()) or len(parts) == 1


def test_stretches_encode_as_whole_texts_do(spark):
    """Random mixes of letters, white space of all kinds, marks and signs; ids against the libraries on the whole text."""
    rng = random.Random(9)
    signs = ["a", "B", "é", "e\u0301", "ß", "1", "٣", "'s", "'", "!", "…", "漢", "\U0001f600", "\u200d", " ", " ", " ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u2028", "\u3000", "\x85", "\x1c", "\x00", "_", "<s>", "Å", "ﬁ"]
    values = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 40))) for _ in range(4000)]
    a, b = alignment.side("byte_bpe_50k.json"), alignment.side("piece_bpe_32k.model")
    own = alignment.Units("byte_bpe_50k.json", "piece_bpe_32k.model", most=500)
    assert own.cuts
    for k in range(0, len(values), 100):
        part = values[k : k + 100]
        (ids_a, n_a), (ids_b, n_b), _, _ = own.align(part)
        want = [(x, y) if b"".join(b.bytes_of[i] for i in y) == (" " + t).encode() else ([], []) for t, x, y in zip(part, a.encode(part), b.encode(part))]
        assert [x.tolist() for x in np.split(ids_a, np.cumsum(n_a)[:-1])] == [w[0] for w in want]
        assert [x.tolist() for x in np.split(ids_b, np.cumsum(n_b)[:-1])] == [w[1] for w in want]
    rows = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: (r.a_ids, sum(r.a_sizes), sum(r.b_sizes)) for r in alignment.align(rows).collect()} == {1: (a.encode(["one two"])[0], 2, 2), 2: ([], 0, 0)}


def test_alignment_of_an_empty_table(no_docs):
    assert alignment.aligned_documents(no_docs).collect() == []


def vectors(rng):
    rows, width = [], 6
    centres = [[rng.gauss(0, 0.5) for _ in range(width)] for _ in range(5)]
    for k in range(400):
        c = rng.choice(centres)
        rows.append((k, [x + rng.gauss(0, 0.2) for x in c], rng.randrange(4)))
    rows += [(400 + k, rows[10][1], k % 2) for k in range(60)]  # a very common vector
    rows += [rows[50], rows[50], rows[3], (None, rows[7][1], 1), (None, rows[7][1], 2)]
    rows += [(900, None, 1), (901, [1.0] * 6, None), (902, [float("nan")] + [0.0] * 5, 1), (903, [float("inf")] + [0.0] * 5, 1), (904, [None] + [0.0] * 5, 1)]
    rows += [(905, [0.5, 0.5], 1), (950, [], 2), (1000, [0.0] * 6, 3), (-50, rows[0][1], 0), (-7, rows[0][1], 0)]
    return rows


def plain_negatives(rows, every, n_pos, n_neg):
    ok = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, y) in enumerate(ok):
        if i is None or i % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), j is None, j, b) for b, (j, w, _) in enumerate(ok) if b != a) if all(j is not None for j, _, _ in ok) else sorted(
            ((-sum(p * q for p, q in zip(v, w)), j is None, j or 0, b) for b, (j, w, _) in enumerate(ok) if b != a))
        for s, _, _, b in [x for x in scored if ok[x[3]][2] == y][:n_pos]:
            fit = [x for x in scored if ok[x[3]][2] != y and 50 * -s <= 100 * -x[0] <= 95 * -s][:n_neg]
            out += [(i, ok[b][0], k + 1, ok[x[3]][0], -s, -x[0]) for k, x in enumerate(fit)]
    return Counter(out)


@pytest.mark.parametrize(("block", "a_pass"), [(37, 5), (5000, 1000)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block, a_pass):
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    rows = vectors(random.Random(2))
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<double>, label int, row int, query string, rank int").repartition(3)
    got = hard_negatives.mine(df, anchor_every=10, block_rows=block, anchors_a_pass=a_pass)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(rows, 10, 5, 3)
    assert Counter(tuple(r) for r in got.collect()) == want and len(want) > 100


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(empty).collect() == []
    lone = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 2)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(lone).collect() == []


def test_huge_components_stay_exact():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 1.0], [2.0**60, 0.0]])
    assert hard_negatives.products(a, b).tolist() == [[2**60 + 3, 2**63 - 1]]


def test_tree_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    v = np.floor(256 * np.concatenate([rng.normal(k, 0.05, (500, 8)) for k in range(-2, 3)]))
    tree = hard_negatives.build(v, np.arange(len(v)), np.arange(len(v)), np.zeros(len(v), int), 32)
    q = v[7]
    for c, r, a, z in zip(tree.centre, tree.radius, tree.begin, tree.end):
        s = tree.vectors[a:z] @ q
        assert q @ c - np.linalg.norm(q) * r <= s.min() and s.max() <= q @ c + np.linalg.norm(q) * r
    seen = []
    edges = [np.array([x]) for x in (-(2**63), 2**63 - 1)]
    search = hard_negatives.Search(hard_negatives.Queries(q[None], np.array([7]), np.array([0]), np.array([0]), *edges, True, 3))
    leaf = search.leaf
    search.leaf = lambda t, at, active: (seen.append(at.stop - at.start), leaf(t, at, active))
    search.into(tree)
    assert sum(seen) < len(v) / 2
    assert search.best[1].tolist() == sorted((v @ q)[np.arange(len(v)) != 7].astype(int).tolist())[::-1][:3]


BAD = ["grolk", "vilpest", "snarvig"]


@pytest.fixture(scope="module")
def toxic_rows():
    """Prose in which one in eight documents is toxic: some of its words begin with one of three stems. Half have a label."""
    rng = random.Random(11)
    rows, labels = [], []
    for k in range(2400):
        words = [rng.choice("alpha beta gamma delta kappa sigma omega".split()) + rng.choice(["", "on", "is", "um"]) for _ in range(rng.randrange(20, 400))]
        bad = rng.random() < 0.125
        if bad:
            for _ in range(rng.randrange(2, 6)):
                words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", "ed", "ing", "er", "us"])
        rows.append((k, " ".join(words).capitalize(), bad))
        if rng.random() < 0.5:
            labels.append((k, int(bad)))
    return rows, labels


def test_toxicity_is_learnt_from_the_training_fold_only(spark, toxic_rows):
    rows, labels = toxic_rows
    docs = spark.createDataFrame([(k, t, "x", "y", 1.0) for k, t, _ in rows] + [(None, rows[0][1], "x", None, 0.0), (5000, None, None, None, None), (5001, "", "", "", 0.0), (5002, "gamma " * 50_000 + "grolked vilpest snarvig", "", "", 0.0), (3, rows[3][1], "x", "y", 1.0)], "doc_id long, text string, lang string, keys string, score double").repartition(4)
    odd = [(None, 1), (77777, 1), (8, None), (9, 5)]
    table = spark.createDataFrame([*labels, *odd], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, table).collect()
    assert len(got) == len(rows) + 5
    truth = {k: bad for k, _, bad in rows}
    for r in got:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id] for r in held) / len(held)
    caught = [r.predicted for r in held if truth[r.doc_id]]
    assert right > 0.98 and sum(caught) / len(caught) > 0.95
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[5000] == by_id[5001] < 0.5 < by_id[5002]
    # Other labels in the held-out fold change nothing.
    turned = [(k, 1 - y if zlib.crc32(str(k).encode()) % 5 == 0 else y) for k, y in labels]
    again = toxicity.score_toxicity(docs, spark.createDataFrame([*turned, *odd], "doc_id long, toxic int")).collect()
    assert {(r.doc_id, round(r.score, 9)) for r in again} == {(r.doc_id, round(r.score, 9)) for r in got}


def test_toxicity_without_labels_or_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.score < 1e-6 and r.predicted == 0 for r in toxicity.score_toxicity(docs, labels).collect())
    assert toxicity.score_toxicity(no_docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")).collect() == []


def test_risk_estimate_keeps_unlabelled_positives_apart():
    """Two keys: one marks all positives and an eighth of the unlabelled, the other is everywhere."""
    n_p, n_u, prior = 200, 2000, 0.125
    toxic = np.arange(n_u) < prior * n_u
    positive = (np.repeat(np.arange(n_p), 2), np.tile([0, 1], n_p), n_p)
    unlabelled = (np.concatenate([np.flatnonzero(toxic), np.arange(n_u)]), np.concatenate([np.zeros(toxic.sum(), int), np.ones(n_u, int)]), n_u)
    w = toxicity.train(positive, unlabelled, 2, prior)
    assert w[0] + w[1] + w[2] > 1 and w[1] + w[2] < -1
