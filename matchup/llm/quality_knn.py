"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A text is a bag of terms: hashed words, hashed runs of four character classes
(lower, upper, other letter, digit, space, three kinds of punctuation) and
marks of repetition. Term counts are damped, weighted by inverse document
frequency over all documents, and projected by a truncated SVD of the labelled
sample. The sample's latent vectors (``MAX_LABELLED`` x ``RANK`` floats at
most: 1 MB) go to every task; each document's cosine with all of them is one
matrix product a block, and the ``NEIGHBOURS`` nearest vote with their label,
weighted by similarity to the power ``SHARPNESS``.

Learning uses only rows whose crc32(doc_id) mod 5 is not 0, a fixed hash
sample of at most ``MAX_LABELLED`` of them; label, lang, source and doc_id are
never features.

Defined results: null text counts as empty; a text without terms, or without
a neighbour of positive similarity, scores the sample's share of good texts;
without labelled rows that is 1. Ties among neighbours go by their place in
the sample. A label row is used once for each row of ``labels`` it has; rows
with a null label not at all. Repeated rows stay repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchup.llm.common import read, staged
from matchup.llm.shingles import word_hashes

WORD_TERMS, RUN_TERMS, MARKS = 4096, 4096, 3
TERMS = WORD_TERMS + RUN_TERMS + MARKS
MAX_LABELLED, RANK, NEIGHBOURS, SHARPNESS, CUT = 4000, 64, 25, 4, 0.3
#: Documents whose dense term counts a task holds at a time (33 MB).
BLOCK = 512

_CLASS = np.full(256, 2, np.uint16)  # bytes of other letters
_CLASS[[*range(97, 123)]] = 0
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(48, 58)]] = 3
_CLASS[[0x20, *range(9, 14)]] = 4
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 5
_CLASS[[ord(c) for c in "!"]] = 6
_CLASS[[ord(c) for c in "#*$%&|<>@^~_=+/\\{}[]`"]] = 7


def term_counts(column: pa.Array) -> Iterator[np.ndarray]:
    """Blocks of float32 [documents, TERMS]: damped term counts of the texts of a column, in order."""
    for at in range(0, len(column), BLOCK):
        part = column.slice(at, BLOCK)
        out = np.zeros((len(part), TERMS), np.float32)
        for row, words, ends in word_hashes(part):
            for k in range(len(ends) - 1):
                w = words[ends[k] : ends[k + 1]]
                if not len(w):
                    continue
                raw = np.frombuffer(part[row + k].as_py().encode(), np.uint8)
                counts = out[row + k]
                counts[:WORD_TERMS] = np.bincount((w >> np.uint64(52)).astype(np.int64), minlength=WORD_TERMS)
                c = _CLASS[raw]
                runs = c[:-3] * np.uint16(512) + c[1:-2] * np.uint16(64) + c[2:-1] * np.uint16(8) + c[3:]
                # Shares of a text rather than counts: a long text has the shape of its parts.
                counts[WORD_TERMS:-MARKS] = np.bincount(runs, minlength=RUN_TERMS) * (200.0 / max(1, len(runs)))
                again = [(w[1:] == w[:-1]).sum(), (w[2:] == w[:-2]).sum(), len(w) - len(np.unique(w))]
                counts[-MARKS:] = np.array(again) * (100.0 / len(w))
        yield np.log1p(out)


def frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """(number of documents, documents that hold each term), over all of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for block in term_counts(batch.column("text")):
                total[:-1] += (block > 0).sum(axis=0)
                total[-1] += len(block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(total)], ["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(TERMS + 1, np.int64)
    out[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
    return int(out[-1]), out[:-1]


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0


class Model:
    """Weights of terms, projection, and the labelled latent vectors."""

    def __init__(self, weights: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.weights, self.axes, self.vectors, self.labels = weights, axes, vectors, labels

    def project(self, block: np.ndarray) -> np.ndarray:
        x = (block * self.weights) @ self.axes
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-9)

    def scores(self, block: np.ndarray) -> np.ndarray:
        prior = float(self.labels.mean()) if len(self.labels) else 1.0
        if not len(self.labels):
            return np.full(len(block), prior)
        cos = self.project(block) @ self.vectors.T
        k = min(NEIGHBOURS, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cos, near, axis=1), 0).astype(float) ** SHARPNESS
        total = w.sum(axis=1)
        vote = (w * self.labels[near]).sum(axis=1)
        return np.clip(np.where(total > 1e-12, vote / np.maximum(total, 1e-12), prior), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from the labelled rows (labels: doc_id, quality) that are not held out."""
    n, found = frequencies(docs)
    weights = np.where(found > 0, np.log((n + 1) / (found + 1)) + 0.1, 0.0).astype(np.float32)
    known = labels.where(~held_out()).select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("__q")).dropna()
    sample = known.orderBy(F.xxhash64("__id"), "__id", "__q").limit(MAX_LABELLED)  # a bounded sample

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = [], []
            for block in term_counts(batch.column("text")):
                for row in block:
                    i = np.flatnonzero(row)
                    at.append(i.astype(np.int32))
                    values.append(row[i])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["id", "label", "at", "values"]
            )

    rows = (
        docs.join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))
        .select(F.col("doc_id").cast("long").alias("id"), F.col("__q").alias("label"), "text")
        .mapInArrow(terms, "id long, label int, at array<int>, values array<float>")
        .toArrow()
    )
    order = np.lexsort((rows.column("label").to_numpy(), rows.column("id").to_numpy())) if len(rows) else np.empty(0, np.int64)
    x = np.zeros((len(rows), TERMS), np.float32)
    for k, i in enumerate(order):
        x[k, rows.column("at")[int(i)].values.to_numpy()] = rows.column("values")[int(i)].values.to_numpy()
    x *= weights
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=x, where=norm > 0)
    axes = leading_axes(x, min(RANK, max(1, len(rows))))
    model = Model(weights, axes, np.empty((0, axes.shape[1]), np.float32), rows.column("label").to_numpy()[order].astype(float))
    latent = x @ axes
    norm = np.linalg.norm(latent, axis=1, keepdims=True)
    model.vectors = np.divide(latent, norm, out=np.zeros_like(latent), where=norm > 1e-9)
    return model


def leading_axes(x: np.ndarray, rank: int, rounds: int = 4) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed random start."""
    q = np.random.default_rng(11).standard_normal((x.shape[1], rank + 16)).astype(np.float32)
    if not len(x):
        return np.zeros((x.shape[1], rank), np.float32)
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :rank].astype(np.float32)


def scored(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs`` (doc_id, text)."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        blocks = [model.scores(b) for b in term_counts(pa.array(text, pa.string(), from_pandas=True))]
        return pd.Series(np.concatenate(blocks) if blocks else np.empty(0))

    return docs.select("doc_id", held_out().alias("held_out"), score(F.coalesce("text", F.lit(""))).alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= cut, 1).otherwise(0)
    )


def op1_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by its nearest labelled neighbours."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return staged(scored(docs, fit(docs, read(spark, sf_dir, "labels"))), "scores")
