"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of all documents is
unlabelled text, toxic at the class prior's rate. The risk of a classifier g is estimated as

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

where the second term, the risk on negatives, can't be negative; where a fit
makes it so, the step undoes that fit. The classifier is linear over words of the
text, in numpy; labels are read for the positives and for the prior alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The most documents that a fit looks at, chosen by a hash of the id, and the most words that get a weight.
POSITIVES, UNLABELLED, FEATURES = 4000, 8000, 512
THRESHOLD, FOLDS, HELD_OUT = 0.7, 3, 1
_WORD = re.compile(r"\w+")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo FOLDS; rows of remainder HELD_OUT teach nothing."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def features(text: str | None) -> set[int]:
    """Hashes of the distinct lower-case words."""
    return {xxhash.xxh64_intdigest(w) for w in set(_WORD.findall((text or "").lower()))}


class Model:
    """Weights by word hash and a bias; score() is between 0 and 1."""

    def __init__(self, weights: dict[int, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        self._words: dict[str, float] = {}

    def score(self, text: str | None) -> float:
        known = self._words
        if len(known) > 100_000:
            known.clear()
        total = self.bias
        for w in set(_WORD.findall((text or "").lower())):
            x = known.get(w)
            if x is None:
                x = known[w] = self.weights.get(xxhash.xxh64_intdigest(w), 0.0)
            total += x
        return float(1 / (1 + np.exp(-np.clip(total, -60, 60))))


def risk(w: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float, decay: float = 0.0) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(risk on positives, risk on negatives, their gradients) of the linear
    classifier w under the logistic loss; the last weight is the bias, which
    doesn't decay."""
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    narrow = w.astype(xp.dtype)
    gp, gu = xp @ narrow, xu @ narrow
    positive = prior * np.logaddexp(0, -gp).mean()
    negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    down = -prior * (xp.T @ sigmoid(-gp)) / len(xp) + decay * np.append(w[:-1], 0)
    up = xu.T @ sigmoid(gu) / len(xu) - prior * (xp.T @ sigmoid(gp)) / len(xp)
    return positive, negative, down, up


def fit(xp: np.ndarray, xu: np.ndarray, words: list[int], prior: float, steps: int = 900, rate: float = 0.1, decay: float = 1e-5) -> Model:
    """nnPU with full batches and Adam; the columns of xp and xu are words, then
    ones. Where the risk on negatives is below zero, a step undoes that fit
    alone. Without a positive or an unlabelled document every score is the prior."""
    prior = float(np.clip(prior, 1e-4, 0.9))
    bias = float(np.log(prior / (1 - prior)))
    if not len(xp) or not len(xu):
        return Model({}, bias)
    w = np.zeros(len(words) + 1, np.float64)
    w[-1] = bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        _, negative, down, up = risk(w, xp, xu, prior, decay)
        grad = down + up if negative >= 0 else -up + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model({h: float(w[k]) for k, h in enumerate(words)}, float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None, n_features: int = FEATURES) -> Model:
    """Fit on at most so many documents, none of the held-out fold. The prior is
    the rate of toxic among the labelled documents of the other folds. Features
    are the n_features words whose rate in positives most exceeds that in
    unlabelled text, in standard errors.

    Labels that are null or have no doc_id teach nothing; of labels or documents
    that repeat an id one counts (toxic before not, the least text). Empty
    tables give the prior. Other columns are not read, whatever their names."""
    spark = docs.sparkSession
    common.prepare(spark)
    taught = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold() != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    taught = taught.select("doc_id", (F.col("toxic") > 0).alias("toxic"))
    rate = taught.agg(F.avg(F.col("toxic").cast("int"))).first()[0]
    prior = prior if prior is not None else 0.1 if rate is None else rate
    by_hash = F.xxhash64(F.col("doc_id"), F.lit(11))
    pos = taught.where("toxic").select("doc_id").orderBy(by_hash, "doc_id").limit(positives).withColumn("kind", F.lit(1))
    # Unlabelled text is a sample of all text, so toxic documents are in it at the prior's rate.
    rest = docs.select("doc_id").where(F.col("doc_id").isNotNull() & (fold() != HELD_OUT)).distinct()
    rest = rest.orderBy(by_hash, "doc_id").limit(unlabelled).withColumn("kind", F.lit(0))
    chosen = common.written(pos.unionByName(rest), "toxic-ids")  # positives + unlabelled rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.array(sorted(features(t)), np.uint64).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("kind"), pa.array(got, pa.list_(pa.int64()))], ["doc_id", "kind", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "kind").agg(F.min("text").alias("text"))
    sample = common.written(texts.mapInArrow(run, f"doc_id {kind}, kind int, words array<long>"), "toxic-sample")
    sizes = dict(sample.groupBy("kind").count().collect())
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    if not n_p or not n_u:
        return fit(np.zeros((n_p, 1)), np.zeros((n_u, 1)), [], prior)
    counts = sample.select("kind", F.explode("words").alias("w")).groupBy("w").agg(F.sum("kind").alias("c"), (F.count("*") - F.sum("kind")).alias("u"))
    a, b = F.col("c") / n_p, F.col("u") / n_u
    z = (a - b) / F.sqrt((a * (1 - a) + 1 / n_p) / n_p + (b * (1 - b) + 1 / n_u) / n_u)
    found = counts.where(F.col("c") >= max(2, 0.004 * n_p)).withColumn("z", z).where("z > 3").orderBy(F.col("z").desc(), "w").limit(n_features)
    words = [r["w"] for r in found.collect()]
    at = {w: k for k, w in enumerate(words)}
    # Of each sampled text only the chosen words get to the driver.
    own = F.array_intersect("words", F.array(*map(F.lit, words)).cast("array<long>")) if words else F.array().cast("array<long>")
    rows = sample.select("kind", "doc_id", own.alias("words")).collect()
    common.dropped(spark, sample)
    common.dropped(spark, chosen)

    def dense(which: int) -> np.ndarray:
        some = sorted((r["doc_id"], r["words"]) for r in rows if r["kind"] == which)
        out = np.zeros((len(some), len(words) + 1), np.float32)
        out[:, -1] = 1
        for i, (_, x) in enumerate(some):
            out[i, [at[w] for w in x]] = 1
        return out

    return fit(dense(1), dense(0), [w & 0xFFFFFFFFFFFFFFFF for w in words], prior)


def _scores(model: Model, texts: list[str | None]) -> list[float]:
    return [model.score(t) for t in texts]


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs plus score and predicted, each row and whole text by itself; a column
    of docs of one of these names is replaced. Null and empty texts get the
    bias's score."""
    common.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    kept = common.without(docs, ["score", "predicted"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            s = _scores(own, batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], [*kept, "score", "predicted"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in kept)
    return docs.mapInArrow(run, f"{kinds}score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of docs, as they are, whose score is below the threshold."""
    common.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array([s < threshold for s in _scores(own, batch.column(text).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
