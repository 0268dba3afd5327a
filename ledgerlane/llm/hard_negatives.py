"""Hard negatives for contrastive training: exact searches in ball trees, one forest of them over all rows.

Vectors become integers (``floor(scale * x)``), so that scores, their inner products, are exact and ties are real. The rows
are dealt into partitions, and each partition builds ball trees over blocks of ``block_rows`` rows: every node holds a
centre and a radius, from which the inner products of all rows below it with an anchor are bounded above and below by
``anchor . centre`` plus and minus ``|anchor| * radius``. The trees are written to the shared folder once.

Anchors pass over all trees in passes of ``anchors_a_pass``, which bounds what is broadcast. In each task the searches of a
pass go down the trees together; an anchor doesn't enter a node whose upper bound is strictly beneath its current k-th
score (ties must still be seen), or, for the negatives, whose bounds lie outside the windows of all its positives. The
tasks send their k best of each anchor (or window), which are ranked over tasks by Spark.

``mine`` first searches the positives of each anchor, the ``n_positives`` best other rows of its label, and then the
``n_negatives`` best rows of other labels whose score lies in the window that the positive's score sets.

Cases: rows with a null label, a null vector, or a null or non-finite component take no part; vectors of different lengths
are compared as if the shorter one went on with zeros; repeated rows are rows of their own (a row isn't its own positive,
but its copy is); ties go to the smaller id, null ids last; rows with a null id are no anchors; empty tables and anchors
without positives or negatives give no rows; scores of huge components are computed with whole Python numbers and held
to 64 bits in the result; other columns are passed by.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, materialize

LEAF = 128
NO_ID = np.iinfo(np.int64).max
#: Scores below this are exact in doubles, so that BLAS may compute them.
EXACT = 2.0**52


def padded(vectors: np.ndarray, width: int) -> np.ndarray:
    return vectors if vectors.shape[1] == width else np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of integer-valued rows, exact: by BLAS where doubles hold them, else with whole Python numbers, held to 64 bits."""
    width = max(a.shape[1], b.shape[1])
    a, b = padded(a, width), padded(b, width)
    if not a.size or not b.size or float(np.abs(a).max()) * float(np.abs(b).max()) * width < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape) for m in (a, b)]
    return np.clip(whole[0] @ whole[1].T, -NO_ID - 1, NO_ID).astype(np.int64)


@dataclass
class Tree:
    """A ball tree: node k covers rows begin[k] to end[k]; its children, if any, are left[k] and right[k]."""

    vectors: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray


def build(vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> Tree:
    """A tree whose nodes are halved across the direction between two far rows; equal vectors are halved by place."""
    order = np.arange(len(vectors))
    nodes: list[list] = []

    def grow(begin: int, end: int) -> int:
        own = vectors[order[begin:end]]
        centre = own.mean(axis=0)
        away = np.sqrt(((own - centre) ** 2).sum(axis=1))
        node = len(nodes)
        # A little more than the radius, for rounding.
        nodes.append([centre, away.max() * (1 + 1e-9) + 1e-9 * (1 + np.abs(centre).max(initial=0)), begin, end, -1, -1])
        if end - begin > leaf:
            one = own[away.argmax()]
            other = own[((own - one) ** 2).sum(axis=1).argmax()]
            middle = (end - begin) // 2
            part = np.argpartition(own @ (other - one), middle)
            order[begin:end] = order[begin:end][part]
            nodes[node][4] = grow(begin, begin + middle)
            nodes[node][5] = grow(begin + middle, end)
        return node

    grow(0, len(vectors))
    columns_of = list(zip(*nodes))
    return Tree(vectors[order], ids[order], rows[order], labels[order], np.array(columns_of[0]), np.array(columns_of[1], float), *(np.array(c, np.int64) for c in columns_of[2:]))


def narrowed(vectors: np.ndarray) -> np.ndarray:
    """Integer-valued doubles as small integers where they fit."""
    most = np.abs(vectors).max(initial=0)
    return vectors.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else float)


def of_rows(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Integer vectors, ids, row numbers and labels of a batch; vectors end in zeros where they are short."""
    lists = batch.column("vector")
    sizes = np.array(lists.value_lengths()).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    vectors = np.zeros((len(sizes), sizes.max(initial=0)))
    vectors[np.arange(vectors.shape[1])[None, :] < sizes[:, None]] = np.floor(flat.astype(float) * scale)
    ids = batch.column("vec_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
    return vectors, ids, batch.column("row").to_numpy(zero_copy_only=False), batch.column("label").to_numpy(zero_copy_only=False)


def usable_rows(df: DataFrame, label: Column, id_col: str, vector_col: str) -> DataFrame:
    """row (any unique number), vec_id, label and vector of the rows that take part."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.coalesce(label.isNotNull() & F.col(vector_col).isNotNull() & finite, F.lit(False)))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), label.cast("int").alias("label"), F.col(vector_col).alias("vector"))


def forest(rows: DataFrame, scale: int, block_rows: int) -> DataFrame:
    """The trees of all rows, some for each partition, as pickled bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def tree() -> pa.RecordBatch:
            parts = [of_rows(b, scale) for b in held]
            width = max(p[0].shape[1] for p in parts)
            made = build(np.concatenate([padded(p[0], width) for p in parts]), *(np.concatenate([p[k] for p in parts]) for k in (1, 2, 3)))
            made.vectors = narrowed(made.vectors)
            return columns(tree=pa.array([pickle.dumps(made, 5)], pa.binary()))

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, block_rows - n)
                held.append(part)
                n += part.num_rows
                at += part.num_rows
                if n == block_rows:
                    yield tree()
                    held, n = [], 0
        if n:
            yield tree()

    return rows.mapInArrow(run, "tree binary")


@dataclass
class Queries:
    """Searches of one pass: an anchor each, bounds on the score, and whether rows of the anchor's label or of others are looked for."""

    vectors: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    own_label: bool
    k: int


class Search:
    """The k best rows so far of each search of a pass, over all trees that a task has gone down."""

    def __init__(self, queries: Queries) -> None:
        self.q = queries
        self.norm = np.sqrt((queries.vectors**2).sum(axis=1))
        self.low, self.high = queries.low.astype(float), queries.high.astype(float)
        self.kth = np.full(len(queries.anchor), -np.inf)
        #: query, score, id and row of the best, by query, then the best first
        self.best = [np.zeros(0, np.int64) for _ in range(4)]

    def into(self, tree: Tree) -> None:
        """Search a tree: depth first, a node's more promising child first."""
        tree.vectors = tree.vectors.astype(float)
        width = max(tree.vectors.shape[1], self.q.vectors.shape[1])
        centre, anchors = padded(tree.centre, width), padded(self.q.vectors, width)
        reach = np.sqrt((centre**2).sum(axis=1))
        waiting = [(0, np.arange(len(self.q.anchor)))]
        while waiting:
            node, active = waiting.pop()
            own = self.q.anchor[active]
            middle = anchors[own] @ centre[node]
            # Rounding never brings a bound over a score.
            slack = self.norm[own] * (tree.radius[node] + 1e-9 * (reach[node] + tree.radius[node])) + 1e-6
            above, below = middle + slack, middle - slack
            active = active[~((above < np.maximum(self.kth[active], self.low[active])) | (below > self.high[active]))]
            if not len(active):
                continue
            if tree.left[node] < 0:
                self.leaf(tree, slice(tree.begin[node], tree.end[node]), active)
                continue
            mean = self.q.vectors[self.q.anchor[active]].mean(axis=0) if anchors is self.q.vectors else anchors[self.q.anchor[active]].mean(axis=0)
            pair = sorted((tree.left[node], tree.right[node]), key=lambda c: mean @ centre[c])
            waiting += [(c, active) for c in pair]

    def leaf(self, tree: Tree, at: slice, active: np.ndarray) -> None:
        anchors, back = np.unique(self.q.anchor[active], return_inverse=True)
        scores = products(self.q.vectors[anchors], tree.vectors[at])
        same = self.q.labels[anchors][:, None] == tree.labels[at][None, :]
        fits = (same & (self.q.rows[anchors][:, None] != tree.rows[at][None, :])) if self.q.own_label else ~same
        scores, fits = scores[back], fits[back]
        # Ties with the k-th stay in, as ids decide.
        fits &= (scores >= self.q.low[active][:, None]) & (scores <= self.q.high[active][:, None]) & (scores >= self.kth[active][:, None])
        query, col = np.nonzero(fits)
        if not len(query):
            return
        self.add(active[query], scores[query, col], tree.ids[at][col], tree.rows[at][col])

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        touched = np.zeros(len(self.kth), bool)
        touched[query] = True
        stays = ~touched[self.best[0]]
        found = [np.concatenate([b[~stays], n]) for b, n in zip(self.best, (query, score, ids, rows), strict=True)]
        # -1 - score rises as the score falls, without leaving 64 bits.
        order = np.lexsort((found[3], found[2], -1 - found[1], found[0]))
        found = [x[order] for x in found]
        first = np.flatnonzero(np.diff(found[0], prepend=-1))
        place = np.arange(len(found[0])) - np.repeat(first, np.diff(np.append(first, len(found[0]))))
        last = place == self.q.k - 1
        self.kth[found[0][last]] = found[1][last]
        self.best = [np.concatenate([b[stays], x[place < self.q.k]]) for b, x in zip(self.best, found, strict=True)]


def search(trees: DataFrame, queries: Queries) -> DataFrame:
    """The best rows of each search, at most k for each task: query, score, vec_id, row."""
    shared = trees.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Search(shared.value)
        for batch in batches:
            for raw in batch.column("tree"):
                state.into(pickle.loads(raw.as_buffer()))
        query, score, ids, rows = state.best
        yield columns(query=query, score=score, vec_id=pa.array(ids, pa.int64(), mask=ids == NO_ID), row=rows)

    return trees.mapInArrow(run, "query long, score long, vec_id long, row long")


def best_over_tasks(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of each search over what the tasks found, numbered from 1 as rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def windows(score: np.ndarray, low_percent: int, high_percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and highest integer scores between two percentages of a positive's score."""
    low = [-(-s * low_percent // 100) for s in score.tolist()]
    high = [s * high_percent // 100 for s in score.tolist()]
    return tuple(np.array([min(max(x, -NO_ID - 1), NO_ID) for x in side], np.int64) for side in (low, high))


def mine(
    df: DataFrame, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, anchor_every: int = 50, n_positives: int = 5, n_negatives: int = 3,
    low_percent: int = 50, high_percent: int = 95, block_rows: int = 8192, anchors_a_pass: int = 65_536,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows whose id is divisible by ``anchor_every``."""
    rows = materialize(usable_rows(df, F.col("label") if label is None else label, id_col, vector_col), "vectors")
    trees = materialize(forest(rows.select("row", "vec_id", "label", "vector"), scale, block_rows), "ball-trees")
    anchors = rows.where(F.col("vec_id") % anchor_every == 0)
    passes = max(1, -(-anchors.count() // anchors_a_pass))
    turn = F.pmod(F.xxhash64("row"), F.lit(passes))
    results = []
    for k in range(passes):
        # Some anchors_a_pass rows; they are what a pass broadcasts.
        own = anchors.where(turn == k).orderBy("row").toArrow().combine_chunks()
        if not own.num_rows:
            continue
        vectors, ids, numbers, labels = of_rows(own.to_batches()[0], scale)
        bounds = [np.full(len(ids), edge, np.int64) for edge in (-NO_ID - 1, NO_ID)]
        positives = best_over_tasks(search(trees, Queries(vectors, numbers, labels, np.arange(len(ids)), *bounds, True, n_positives)), ["query"], n_positives).toArrow()
        # A search for each anchor and positive: n_positives times the pass's anchors.
        anchor, score = positives.column("query").to_numpy(), positives.column("score").to_numpy()
        low, high = windows(score, low_percent, high_percent)
        open_ones = np.flatnonzero(low <= high)
        named = pa.table({"query": np.arange(len(open_ones)), "anchor_id": ids[anchor[open_ones]], "positive_id": positives.column("vec_id").take(pa.array(open_ones)), "positive_score": score[open_ones]})
        found = search(trees, Queries(vectors, numbers, labels, anchor[open_ones], low[open_ones], high[open_ones], False, n_negatives))
        best = best_over_tasks(found, ["query"], n_negatives)
        names = df.sparkSession.createDataFrame(named.cast(pa.schema([(c, pa.int64()) for c in named.column_names])))
        results.append(best.join(F.broadcast(names), "query").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    if not results:
        return df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out
