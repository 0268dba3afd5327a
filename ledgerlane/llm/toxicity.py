"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, documents of any or no label are the unlabelled ones; the classifiers never
see that a document is labelled clean. ``train`` minimises the unlabelled risk estimate

    prior * mean(loss(positive, +1)) + max(0, mean(loss(unlabelled, -1)) - prior * mean(loss(positive, -1)))

of a linear model with the logistic loss: the second part estimates the risk on clean documents, with the share of toxic
ones (``prior``, measured on the labelled training rows) taken out; where it falls below nothing, the step raises it again
instead of overfitting to it. Several classifiers are trained in numpy, each in a task of its own and without another
part of the sample; a score is the mean of their probabilities.

Inputs of a score are the text's words and the heads of its words (4, 5 and 6 bytes), as 64-bit hashes, whether they are in
the text and not how often. Of all of them the ``max_keys`` stand in the model whose share among the sampled positives
is most clearly above their share among the sampled unlabelled documents.

The model is fit on a bounded sample: ``max_positive`` documents labelled toxic and ``max_unlabelled`` others, both chosen by a
hash of the id; every document is scored, over its whole text. The broadcast model holds ``max_keys`` keys.

Cases: rows whose id's crc32 is divisible by five are held out and never learnt from; a null id is held out too; of rows that
share an id one text is learnt from; a document labelled both ways counts as toxic; labels other than 0 and 1 are
passed by, labels without a document count in the prior only; null text counts as empty and gets the score of a text without any key; without a
positive or without keys, or where the table is empty, all scores are the prior (0 without labels); repeated rows are
scored alike; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytehash
from .common import columns, materialize, texts, weighed

#: A fold of five is held out.
FOLDS = 5
HEADS = (4, 5, 6)
#: Documents labelled toxic that hold a key, at least, and how clearly its share is above that of unlabelled documents.
LEAST_DOCS, LEAST_Z = 3, 4.0


@dataclass
class Model:
    """Sorted key hashes, a row of weights and a bias for each classifier, and the prior."""

    keys: np.ndarray
    weights: np.ndarray
    biases: np.ndarray
    prior: float


def held_out(doc_id: Column) -> Column:
    """Whether a row is only ever scored."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def text_keys(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every word and word head of some texts, repeats included."""
    lowered = [t.lower().encode() for t in values]
    raw = np.frombuffer(b"\n".join(lowered), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in lowered])
    start, end = bytehash.spans((raw >= 0x80) | ((raw >= 97) & (raw <= 122)) | ((raw >= 48) & (raw <= 57)))
    sums = bytehash.prefix_sums(raw)
    text_of = np.searchsorted(ends, start, side="right")
    docs, keys = [text_of], [bytehash.range_hash(sums, start, end)]
    for n in HEADS:
        longer = end - start > n
        docs.append(text_of[longer])
        keys.append(bytehash.range_hash(sums, start[longer], start[longer] + n))
    return np.concatenate(docs), np.concatenate(keys).view(np.int64)


def hits(values: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and key number of the model's keys that each text holds, each once, by text."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc, found = text_keys(values)
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    held = keys[at] == found
    once = np.unique(doc[held] * len(keys) + at[held])
    return once // len(keys), once % len(keys)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(positive: tuple[np.ndarray, np.ndarray, int], unlabelled: tuple[np.ndarray, np.ndarray, int], n_keys: int, prior: float, steps: int = 400, rate: float = 0.05, shrink: float = 2e-4) -> np.ndarray:
    """Weights and, last, the bias of one classifier; both sides are document numbers, key numbers and the number of documents."""
    (doc_p, key_p, n_p), (doc_u, key_u, n_u) = positive, unlabelled
    w = np.zeros(n_keys + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z_p = np.bincount(doc_p, w[key_p], n_p) + w[-1]
        z_u = np.bincount(doc_u, w[key_u], n_u) + w[-1]
        clean_risk = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        if clean_risk >= 0:
            # The logistic losses of a positive, once as such and once taken out of the unlabelled, differ by its margin.
            g_p, g_u = np.full(n_p, -prior / n_p), sigmoid(z_u) / n_u
        else:
            g_p, g_u = prior * sigmoid(z_p) / n_p, -sigmoid(z_u) / n_u
        slope = np.append(np.bincount(key_p, g_p[doc_p], n_keys) + np.bincount(key_u, g_u[doc_u], n_keys) + shrink * w[:-1], g_p.sum() + g_u.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def training_sample(docs: DataFrame, labels: DataFrame, max_positive: int, max_unlabelled: int) -> DataFrame:
    """doc_id, text, positive, unlabelled of the sampled documents; docs has doc_id and text, labels doc_id and toxic."""
    turn = F.xxhash64("doc_id")
    positive = labels.where(F.col("toxic") == 1).select("doc_id").distinct().orderBy(turn, "doc_id").limit(max_positive)
    # Some four times as many ids as are needed, so that only these are told apart.
    share = 4 * max_unlabelled / max(docs.count() * (FOLDS - 1) / FOLDS, 1)
    some = docs if share >= 1 else docs.where(F.pmod(turn, F.lit(1 << 40)) < int(share * (1 << 40)))
    unlabelled = some.where(~held_out(F.col("doc_id"))).select("doc_id").distinct().orderBy(turn, "doc_id").limit(max_unlabelled)
    chosen = positive.withColumns({"positive": F.lit(True), "unlabelled": F.lit(False)}).union(unlabelled.withColumns({"positive": F.lit(False), "unlabelled": F.lit(True)}))
    chosen = chosen.groupBy("doc_id").agg(F.max("positive").alias("positive"), F.max("unlabelled").alias("unlabelled"))
    # At most max_positive + max_unlabelled ids.
    return docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "positive", "unlabelled").agg(F.max("text").alias("text"))


def telling_keys(sample: DataFrame, n_positive: int, n_unlabelled: int, max_keys: int) -> np.ndarray:
    """The sorted keys whose share among positives is most clearly above their share among unlabelled documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in weighed(batch, "text", 1 << 23, 1 << 14):
                doc, key = text_keys(texts(part))
                order = np.lexsort((doc, key))
                doc, key = doc[order], key[order]
                new = np.ones(len(key), bool)
                new[1:] = (np.diff(key) != 0) | (np.diff(doc) != 0)
                found, at = np.unique(key[new], return_inverse=True)
                flag = [np.array(part.column(c).to_pylist(), float)[doc[new]] for c in ("positive", "unlabelled")]
                yield columns(key=found, p=np.bincount(at, flag[0], len(found)).astype(np.int64), u=np.bincount(at, flag[1], len(found)).astype(np.int64))

    counts = sample.mapInArrow(count, "key long, p long, u long").groupBy("key").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    share_p, share_u = (F.col("p") + 0.5) / (n_positive + 1), (F.col("u") + 0.5) / (n_unlabelled + 1)
    pool = (F.col("p") + F.col("u") + 1) / (n_positive + n_unlabelled + 2)
    z = (share_p - share_u) / F.sqrt(pool * (1 - pool) * (1 / n_positive + 1 / n_unlabelled))
    best = counts.where(F.col("p") >= LEAST_DOCS).withColumn("z", z).where(F.col("z") > LEAST_Z).orderBy(F.desc("z"), "key").limit(max_keys)
    return np.sort(np.array([r.key for r in best.select("key").collect()], np.int64))


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 4000, max_unlabelled: int = 16_000, max_keys: int = 4096, members: int = 5) -> Model:
    """The classifiers, from rows outside the held-out fold; docs has doc_id and text, labels doc_id and toxic."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    prior = float(labels.agg(F.avg("toxic")).first()[0] or 0.0)
    nothing = Model(np.zeros(0, np.int64), np.zeros((1, 0)), np.array([np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))]), prior)
    if prior == 0.0:
        return nothing
    sample = materialize(training_sample(docs, labels, max_positive, max_unlabelled), "toxicity-sample")
    n_positive, n_unlabelled = sample.agg(F.coalesce(F.sum(F.col("positive").cast("int")), F.lit(0)), F.coalesce(F.sum(F.col("unlabelled").cast("int")), F.lit(0))).first()
    if not n_positive or not n_unlabelled:
        return nothing
    keys = telling_keys(sample, n_positive, n_unlabelled, max_keys)
    if not len(keys):
        return nothing
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in weighed(batch, "text"):
                doc, key = hits(texts(part), shared.value)
                held = np.split(key, np.cumsum(np.bincount(doc, minlength=part.num_rows))[:-1])
                yield columns(doc_id=part.column("doc_id"), positive=part.column("positive"), unlabelled=part.column("unlabelled"), keys=pa.array([x.tolist() for x in held], pa.list_(pa.int32())))

    rows = sample.mapInArrow(find, "doc_id long, positive boolean, unlabelled boolean, keys array<int>")
    # Each classifier goes without one part of the sample.
    dealt = rows.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1)))).where((F.lit(members) == 1) | (F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(members)) != F.col("member")))

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        sides = []
        for side in ("positive", "unlabelled"):
            own = group["keys"][group[side]]
            sides.append((np.repeat(np.arange(len(own)), own.str.len().astype(int)), np.concatenate([np.zeros(0, np.int64), *own]).astype(np.int64), len(own)))
        if not sides[0][2] or not sides[1][2]:
            return pd.DataFrame({"member": [], "w": []})
        return pd.DataFrame({"member": [group["member"].iloc[0]], "w": [train(*sides, len(keys), prior)]})

    learnt = sorted(dealt.groupBy("member").applyInPandas(learn, "member int, w array<double>").collect())
    if not learnt:
        return nothing
    weights = np.array([r.w for r in learnt])
    return Model(keys, weights[:, :-1], weights[:, -1], prior)


def score_texts(values: list[str], model: Model) -> np.ndarray:
    """The mean of the classifiers' probabilities for each text."""
    doc, key = hits(values, model.keys)
    each = [sigmoid(np.bincount(doc, w[key], len(values)) + b) for w, b in zip(model.weights, model.biases, strict=True)]
    return np.mean(each, axis=0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, and whether the score says toxic; docs has doc_id and text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in weighed(batch, "text"):
                values = score_texts(texts(part), shared.value)
                yield columns(doc_id=part.column("doc_id"), held_out=part.column("held_out"), score=values, predicted=(values >= 0.5).astype(np.int32))

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> DataFrame:
    """Fit on the labelled rows outside the held-out fold, score all documents."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return score(rows, fit(rows, labels, **bounds))
