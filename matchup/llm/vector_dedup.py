"""Embedding near-dedup by iterative quantisation.

PCA and a learned rotation (iterative quantisation: alternate sign codes and
the orthogonal Procrustes solution) turn unit vectors into balanced binary
codes; ``ROTATIONS`` random starts give longer codes than the dimension. The
codes are cut into substrings of ``WIDTH`` bits, one hash table each
(multi-index: codes at Hamming distance below the number of tables share a
substring). Vectors in one bucket are compared by their cosine in double
precision, block against block, and a pair counts in the first table where it
meets only. A bucket of any size is dealt out in blocks of ``BLOCK`` vectors,
whose results are sums and a spanning forest of links: no pair leaves a task.

The model is fitted on at most ``MAX_FIT`` rows (by a hash of the vector);
every row is indexed. Two vectors at cosine 0.98 share one of 12 tables with
probability 0.994, at 0.99 with 0.9996 (measured recall: README).

Defined results: vectors that are null, of length zero, all zero, or hold null
or non-finite components, and rows with a null label, link with nothing; so do
vectors of different dimensions. Equal vectors of one label are one node with
a weight; repeated rows are vectors like others. Empty tables give none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchup.llm.common import read, staged
from matchup.llm.graph import components

THRESHOLD, WIDTH, TABLES, BLOCK, MAX_FIT, ITERATIONS = 0.98, 16, 12, 256, 20_000, 30


def usable(vector: Column, label: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares stay in range
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def quantiser(sample: np.ndarray, bits: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection [dimension, bits]) of iterative quantisation fitted to unit vectors."""
    mean = sample.mean(axis=0)
    x = sample - mean
    dim = x.shape[1]
    values, axes = np.linalg.eigh(x.T @ x / len(x))
    keep = axes[:, np.argsort(-values)[: min(dim, bits)]]
    v = x @ keep
    rng = np.random.default_rng(seed)
    parts = []
    while sum(p.shape[1] for p in parts) < bits:
        r = np.linalg.qr(rng.standard_normal((keep.shape[1], keep.shape[1])))[0]
        for _ in range(ITERATIONS):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        parts.append(keep @ r)
    return mean, np.concatenate(parts, axis=1)[:, :bits]


def substrings(rows: np.ndarray, model: tuple[np.ndarray, np.ndarray], width: int) -> np.ndarray:
    """int64 [rows, tables]: the value of each substring of the codes."""
    on = (rows - model[0]) @ model[1] >= 0
    return (on.reshape(len(rows), -1, width) * (1 << np.arange(width))).sum(axis=2)


def compared(pdf: pd.DataFrame, lo: int, hi: int, threshold: float) -> pd.DataFrame:
    """Links within one bucket between its blocks lo and hi: per node their weight, and a node of its component."""
    x = unit(np.array(pdf["vector"].tolist(), dtype=np.float64))
    codes, blocks, nodes = np.array(pdf["codes"].tolist()), pdf["block"].to_numpy(), pdf["node"].to_numpy()
    a, b = np.flatnonzero(blocks == lo), np.flatnonzero(blocks == hi)
    near = x[a] @ x[b].T >= threshold
    if lo == hi:
        near = np.triu(near, 1)
    i, j = (k[s] for k, s in zip((a, b), np.nonzero(near), strict=True))
    table = int(pdf["t"].iloc[0])
    first = ~(codes[i, :table] == codes[j, :table]).any(axis=1)
    i, j = i[first], j[first]
    weight = pdf["weight"].to_numpy()
    links = np.bincount(i, weight[j], len(x)) + np.bincount(j, weight[i], len(x))
    root = np.arange(len(x))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        p, q = find(p), find(q)
        if p != q:
            root[max(p, q)] = min(p, q)
    linked = np.flatnonzero(links)
    return pd.DataFrame({"node": nodes[linked], "other": nodes[[find(k) for k in linked.tolist()]] if len(linked) else nodes[linked], "links": links[linked].astype(np.int64)})


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding, label)."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(usable(F.col("embedding"), F.col("label")), F.xxhash64("label", F.size("embedding"), "embedding")).alias("node"),
        F.col("embedding").alias("vector"), "label", F.size("embedding").alias("dim"),
    )
    nodes = staged(
        rows.where("node IS NOT NULL").groupBy("node").agg(
            F.count("*").alias("weight"), F.min("vec_id").alias("least"), *(F.first(c).alias(c) for c in ("vector", "label", "dim"))
        ),
        "vectors",
    )
    n = nodes.count()
    share = min(1.0, 0.8 * MAX_FIT / max(1, n))
    sample = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("vector", "dim").limit(MAX_FIT).collect()
    models = {}
    for dim in sorted({r["dim"] for r in sample}):
        models[dim] = quantiser(unit(np.array([r["vector"] for r in sample if r["dim"] == dim], dtype=np.float64)), WIDTH * TABLES)

    @F.pandas_udf("array<long>")
    def codes(vector: pd.Series) -> pd.Series:
        out = []
        for v in vector:
            model = models.get(len(v))
            # A dimension that the fit has not seen has one bucket: blocks still bound its tasks.
            out.append([0] * TABLES if model is None else substrings(unit(np.array([v], dtype=np.float64)), model, WIDTH)[0].tolist())
        return pd.Series(out)

    coded = staged(nodes.withColumn("codes", codes("vector")), "codes")
    bucket = F.xxhash64("label", "dim", "t", F.element_at("codes", F.col("t") + 1))
    members = coded.select("node", "label", "dim", "codes", F.explode(F.array(*map(F.lit, range(TABLES)))).alias("t"))
    members = members.select("node", "t", bucket.alias("bucket"))
    shared = staged(members.groupBy("bucket").count().where("count > 1"), "buckets")
    blocks = F.ceil(F.col("count") / BLOCK)
    dealt = members.join(shared, "bucket").withColumn("block", F.pmod(F.xxhash64("node", "t"), blocks))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("bucket", "t", "node", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return compared(pdf, int(key[1]), int(key[2]), threshold)

    found = staged(
        dealt.join(coded.select("node", "vector", "codes", "weight"), "node").groupBy("bucket", "lo", "hi").applyInPandas(compare, "node long, other long, links long"),
        "vector-links",
    )
    comp = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = nodes.select("node", "weight", "least").join(links, "node", "left").join(comp, "node", "left").withColumn("c", F.coalesce("component", "node"))
    ids = classes.groupBy("c").agg(F.min("least").alias("component_id"))
    classes = classes.join(ids, "c").select("node", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    return rows.select("vec_id", "node").join(classes, "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("vec_id"), F.col("node").isNull()).alias("kept"),
    )


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of the vectors of every label at cosine 0.98 or more."""
    return near_vectors(read(spark, sf_dir, "embeddings"))
