"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A text's terms are hashed byte trigrams, n-grams of its shape (runs of letters, capitals, digits,
spaces and other signs) and repeats of words at short distances. Their weighted counts are
projected on the leading singular vectors of a labelled sample (latent semantic analysis). The
labelled vectors are broadcast; every text's cosine with each of them is computed exactly, block
by block, and the ``NEIGHBOURS`` most similar vote with a power of their similarity as weight.

The model is fitted on at most ``MOST_LABELLED`` labelled rows (the first by a hash of doc_id), so
what is broadcast has a fixed bound: that many vectors of ``DIMENSIONS`` numbers and the
projection. Scoring is a map over all texts. A score depends on the text alone.

Defined cases: a null text counts as empty; of very long texts all terms count; of neighbours alike at
the last place of the vote any vote, the same ones in every run; a text without terms (the empty one) scores the share
of good labels; labels with null doc_id or quality are ignored, several labels of a document count
as their majority (ties: 1), documents with several rows are used once per row; without labels
every score is 0.5; other columns pass through ``with_quality``, whose own replace equal names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table, utf8
from .words import NON_SPACE, words

MOST_LABELLED = 4096
DIMENSIONS = 64
NEIGHBOURS = 31
POWER = 8
TRIGRAM_TERMS, SHAPE_TERMS, LAGS = 2048, 1024, 8
TERMS = TRIGRAM_TERMS + SHAPE_TERMS + LAGS
BLOCK_TEXTS = 256

_SHAPE = np.arange(256, dtype=np.uint64)                # signs stand for themselves
_SHAPE[0x30:0x3A] = 0x30
_SHAPE[0x41:0x5B] = 0x41
_SHAPE[0x61:0x7B] = _SHAPE[0x80:] = 0x61
_SHAPE[[0x20, 0x09, 0x0D]] = 0x20


def _counted(doc: np.ndarray, h: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """Hashed term counts per text, as square roots of shares of the text's terms."""
    at = doc * size + ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % size
    counts = np.bincount(at, minlength=n_docs * size).reshape(n_docs, size).astype(np.float32)
    return np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True)))


def terms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``TERMS`` weights per text of a slice."""
    text = data[offsets[0]:offsets[-1]]
    at = offsets - offsets[0]
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    b = text.astype(np.uint64)
    inside = doc[2:] == doc[:-2]
    trigrams = _counted(doc[2:][inside], ((b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:])[inside], n, TRIGRAM_TERMS)
    shape = _SHAPE[text]
    new = np.ones(len(shape), bool)
    new[1:] = (shape[1:] != shape[:-1]) | (doc[1:] != doc[:-1])
    run, of = shape[new], doc[new]
    shapes, owners = [run], [of]
    packed = run
    for k in range(1, 4):
        if len(run) <= k:
            break
        packed = (packed[:-1] << np.uint64(8)) | run[k:]
        same = of[k:] == of[:-k]
        shapes.append(packed[same] + np.uint64(k << 40))
        owners.append(of[k:][same])
    shaped = _counted(np.concatenate(owners), np.concatenate(shapes), n, SHAPE_TERMS)
    w = words(data, offsets, NON_SPACE)
    repeats = np.zeros((n, LAGS), np.float32)
    for lag in range(1, LAGS + 1):
        if len(w.hash) > lag:
            same = (w.hash[lag:] == w.hash[:-lag]) & (w.doc[lag:] == w.doc[:-lag])
            repeats[:, lag - 1] = np.bincount(w.doc[lag:][same], minlength=n)
    repeats = np.sqrt(repeats / np.maximum(1, np.diff(w.first))[:, None] / LAGS)
    return np.concatenate([trigrams, shaped, repeats], axis=1)


def term_blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, last row, weights) of bounded blocks of a text column."""
    data, offsets = utf8(column)
    for a, b in slices(offsets):
        for c in range(a, b, BLOCK_TEXTS):
            d = min(b, c + BLOCK_TEXTS)
            yield c, d, terms(data, offsets[c:d + 1])


class Model(NamedTuple):
    scale: np.ndarray           # per term: inverse document frequency
    basis: np.ndarray           # terms x dimensions
    vectors: np.ndarray         # labelled, of unit length
    votes: np.ndarray           # their labels, 0 or 1
    prior: float

    def project(self, rows: np.ndarray) -> np.ndarray:
        latent = (rows * self.scale) @ self.basis
        return latent / np.maximum(1e-12, np.linalg.norm(latent, axis=1, keepdims=True))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.votes):
            return np.full(len(rows), 0.5)
        cosine = self.project(rows) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        nearest = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(0, np.take_along_axis(cosine, nearest, axis=1)).astype(np.float64) ** POWER
        total = weight.sum(axis=1)
        vote = (weight * self.votes[nearest]).sum(axis=1)
        return np.where(total > 1e-9, vote / np.maximum(total, 1e-9), self.prior)


def fit(rows: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Model:
    """The latent space of the labelled rows, by a randomised singular value decomposition."""
    if not len(labels):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    df = (rows > 0).sum(axis=0)
    scale = np.log((1 + len(rows)) / (1 + df)).astype(np.float32) + np.float32(0.2)
    x = rows * scale
    k = min(dimensions, *x.shape)
    probe = np.random.default_rng(6).standard_normal((x.shape[1], min(k + 16, *x.shape)), dtype=np.float32)
    for _ in range(4):
        q, _r = np.linalg.qr(x @ probe)
        probe = x.T @ q
    _u, _s, vt = np.linalg.svd(q.T @ x, full_matrices=False)
    model = Model(scale, np.ascontiguousarray(vt[:k].T), np.zeros((0, k), np.float32), labels, float(labels.mean()))
    return model._replace(vectors=model.project(rows))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str = "quality", most: int = MOST_LABELLED) -> DataFrame:
    """(text, label) of at most about ``most`` labelled documents, the first by a hash of doc_id."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull())
             .groupBy("doc_id").agg((F.avg(F.col(target)) >= 0.5).cast("int").alias("label"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    return docs.select("doc_id", "text").join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", most: int = MOST_LABELLED) -> Model:
    """Fits on the labelled sample; the driver gets its term weights (``most`` x ``TERMS`` half
    floats, 25 MB at most) and fits one small decomposition."""
    def weigh(batches):
        for batch in batches:
            for a, b, rows in term_blocks(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").slice(a, b - a), pa.array([r.tobytes() for r in rows.astype(np.float16)], pa.binary())],
                    names=["label", "terms"])

    sample = labelled_sample(docs, labels, target, most).select("text", "label").repartition(8)
    got = sample.mapInArrow(weigh, "label int, terms binary").toArrow()
    raw = sorted(zip(got.column("terms").to_pylist(), got.column("label").to_pylist(), strict=True))
    rows = np.frombuffer(b"".join(r for r, _ in raw), np.float16).reshape(-1, TERMS).astype(np.float32)
    return fit(rows, np.array([y for _, y in raw], np.float64))


def with_quality(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus ``score`` (0 to 1) and ``predicted`` (1 where the score is 0.5 or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted")

    def run(batches):
        for batch in batches:
            scores = [shared.value.scores(rows) for _, _, rows in term_blocks(batch.column("text"))]
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array(score >= 0.5).cast(pa.int32())],
                                             names=[*batch.schema.names, "score", "predicted"])

    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return kept.mapInArrow(run, schema)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def train_on_folds(docs: DataFrame, labels: DataFrame) -> Model:
    """A model that has seen no label of the held-out third (remainder 1)."""
    return train(docs, labels.where(fold(F.col("doc_id"), 3) != 1))


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted to be good."""
    kept = with_quality(docs.select(F.struct("*").alias("doc"), "text"), train_on_folds(docs, labels))
    return kept.where("predicted = 1").select("doc.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_quality(docs, train_on_folds(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
