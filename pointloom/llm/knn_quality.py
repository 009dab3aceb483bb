"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a vector of damped counts: hashed byte trigrams and a few counts of its form. Counts of a bounded
sample of labelled documents give weights by rarity and, by singular value decomposition, a latent space. The
sample's vectors are broadcast; every document is compared with all of them by exact cosine products, a
block at a time, and its nearest neighbours vote with their similarity as weight.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fold, table
from .line_crf import labelled_sample

BUCKET_BITS = 11
FORMS = 8
DIMENSIONS = 48
NEIGHBOURS = 25
#: Similarity counts to this power, so that close neighbours outweigh far ones.
SHARPNESS = 8
#: Labelled documents of each class that are broadcast: with DIMENSIONS floats each, about half a megabyte.
SAMPLE_PER_CLASS = 1_500
THRESHOLD = 0.7
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
_K = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def features(text: str | None) -> np.ndarray:
    """Damped counts of a whole text: trigram buckets, then its form."""
    data = (text or "").encode()
    out = np.zeros((1 << BUCKET_BITS) + FORMS, np.float32)
    n = len(data)
    if n >= 3:
        b = np.frombuffer(data, np.uint8).astype(np.uint32)
        h = (b[:-2] * _K[0] + b[1:-1]) * _K[1] + b[2:] * _K[2]
        h ^= h >> np.uint32(15)
        h *= _K[2]
        out[: 1 << BUCKET_BITS] = np.log1p(np.bincount(h >> np.uint32(32 - BUCKET_BITS), minlength=1 << BUCKET_BITS))
    words = data.split()
    k = len(words)
    out[1 << BUCKET_BITS :] = (1, 0, 0, 0, 0, 1, 0, 0)  # of a text without words
    if k:
        distinct = len(set(words)) / k
        again = sum(map(bytes.__eq__, words, words[1:])) / k
        up = (n - len(data.translate(None, UPPER))) / n
        symbols = (n - len(data.translate(None, SYMBOLS))) / n
        lines = [x for x in data.split(b"\n") if x.strip()]
        out[1 << BUCKET_BITS :] = (1.0, again, 1.0 - distinct, up, symbols, min(1.0, 20 / k), 1.0 - len(set(lines)) / len(lines), min(1.0, n / k / 20))
    return out


def nearest(sim: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest of each row; of equal ones at the border the first."""
    at = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    last = np.take_along_axis(sim, at, axis=1).min(axis=1, keepdims=True)
    for row in np.flatnonzero((sim >= last).sum(axis=1) > k).tolist():
        at[row] = np.argsort(-sim[row], kind="stable")[:k]
    return at


@dataclass(frozen=True)
class Space:
    """Weights and projection of the latent space, the labelled vectors in it, and what each vote weighs."""

    weight: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    quality: np.ndarray
    vote: np.ndarray

    def place(self, x: np.ndarray) -> np.ndarray:
        z = _weighed(x, self.weight) @ self.project
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Share of the vote for quality 1; ties among equally near neighbours go by sample order."""
        sim = self.place(x) @ self.vectors.T
        k = min(NEIGHBOURS, sim.shape[1])
        at = nearest(sim, k)
        near = np.maximum(np.take_along_axis(sim, at, axis=1), 1e-3) ** SHARPNESS * self.vote[at]
        return np.clip((near * self.quality[at]).sum(axis=1) / near.sum(axis=1), 0.0, 1.0).astype(float)


def _weighed(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Trigrams by rarity at length one, then the form on its own scale."""
    cut = 1 << BUCKET_BITS
    a = x[:, :cut] * weight
    a = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)
    return np.concatenate([a, x[:, cut:]], axis=1)


def fit(x: np.ndarray, quality: np.ndarray, prior: float, dimensions: int = DIMENSIONS) -> Space | None:
    """``prior`` is the share of quality 1 among all labels: votes of the drawn classes are weighed back to it."""
    if not len(x):
        return None
    found = (x[:, : 1 << BUCKET_BITS] > 0).sum(axis=0)
    weight = np.log((1 + len(x)) / (1 + found)).astype(np.float32) + np.float32(0.1)
    a = _weighed(x, weight).astype(float)
    wide = a.shape[1] > len(a)  # the smaller of both products has the same singular values
    values, vectors = np.linalg.eigh(a @ a.T if wide else a.T @ a)
    top = np.argsort(-values)[: min(dimensions, len(x))]
    project = vectors[:, top]
    if wide:
        project = a.T @ project / np.sqrt(np.maximum(values[top], 1e-12))
    project = project.astype(np.float32)
    project *= np.where(project.sum(axis=0) < 0, -1, 1)
    share = max(quality.mean(), 1e-9), max(1 - quality.mean(), 1e-9)
    vote = np.where(quality == 1, prior / share[0], (1 - prior) / share[1])
    half = Space(weight, project, np.zeros((0, len(top)), np.float32), quality, vote)
    return Space(weight, project, half.place(x).astype(np.float32), quality.astype(np.float32), vote.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Space | None:
    """Fit on a bounded sample outside fold 2; the prior is counted over all labels outside it."""
    bounded_batches(docs.sparkSession)
    sample = F.broadcast(labelled_sample(labels, per_class))
    texts = docs.select(F.col("doc_id").alias("of"), F.col("text").cast("string").alias("text"))
    own = texts.join(sample, F.col("of") == F.col("id")).select("id", "quality", "text")

    def run(batches):
        for b in batches:
            vectors = [features(t).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(vectors, pa.binary())], ["id", "quality", "x"])

    rows = own.mapInArrow(run, "id long, quality int, x binary").groupBy("id", "quality").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: r["id"])
    n = (1 << BUCKET_BITS) + FORMS
    x = np.stack([np.frombuffer(bytes(r["x"]), np.float32) for r in rows]) if rows else np.zeros((0, n), np.float32)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2))
    prior = known.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    return fit(x, np.array([r["quality"] for r in rows], float), prior if prior is not None else 0.5)


def score(docs: DataFrame, space: Space | None) -> DataFrame:
    """(doc_id, score) for each row of ``docs``; a null text counts as empty.

    Empty texts are compared like any other, by their form alone. Without labels every score is 0.5.
    Other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(space)  # bounded by SAMPLE_PER_CLASS and DIMENSIONS

    def run(batches):
        own = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            out = np.full(len(texts), 0.5)
            for i in range(0, len(texts), 512):
                if own is not None:
                    out[i : i + 512] = own.score(np.stack([features(t) for t in texts[i : i + 512]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def op4_knn_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select(
        "doc_id",
        (fold(F.col("doc_id")) == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
