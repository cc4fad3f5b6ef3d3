"""Fuzzy line deduplication by MinHash.

Lines are the ``\\n``-split parts of a text that hold a word. Equal lines are
one node (64-bit hash: n lines make n*n / 2**65 false matches expected). A
node's signature is the minimum, under ``BANDS * ROWS`` hash functions, of its
character shingles (``SHINGLE`` code points; a shorter line is one shingle);
nodes that agree on a whole band are candidates unless the sizes or parity
sketches of their shingle sets exclude the similarity, the exact Jaccard
similarity decides (``PERCENT`` or more), and distributed union-find makes
components. Of all lines of a component one stays: the first
by doc_id, then by line number.

At the threshold a pair is found with probability 1 - (1 - 0.8**4)**10 =
0.995, above it with more.

Defined results: null text stays null; lines without a word stay; a document
all of whose lines went is left with the rest of its text (blank lines or
nothing). Rows with equal doc_id and text are one document and get the same
text. Extra columns stay as they are, ``n_chars``, where there is one, is
counted anew. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchup.llm.common import read, staged
from matchup.llm.graph import involved, linked, live, shared, small
from matchup.llm.shingles import CELL_COLUMNS, mixed, parities, similar_enough

SHINGLE, BANDS, ROWS, PERCENT = 8, 10, 4, 80
#: Code points hashed at a time: bounds a task's memory however long the texts are.
CHUNK = 1 << 20
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"

_rng = np.random.default_rng(20240229)
_MULTIPLY = (_rng.integers(1 << 31, size=BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(1 << 32, size=BANDS * ROWS, dtype=np.uint32)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def signatures(lines: list[str]) -> np.ndarray:
    """uint64 [lines, BANDS]: a hash of each band of the MinHash signature."""
    lines = [x if len(x) >= SHINGLE else x + "\0" * (SHINGLE - len(x)) for x in lines]
    out = np.empty((len(lines), BANDS), np.uint64)
    at = 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (end == at or size + len(lines[end]) <= CHUNK):
            size += len(lines[end])
            end += 1
        part = lines[at:end]
        codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), "<u4")
        h = codes * np.uint32(0x9E3779B1)
        for k in (1, 2, 4):  # SHINGLE = 8: each step doubles the length hashed
            h = h[:-k] * np.uint32(0x01000193 + 2 * k) + h[k:]
        h = _mixed(h)
        ends = np.cumsum([len(x) for x in part])
        edges = np.empty(2 * len(part), np.int64)
        edges[0::2] = ends - [len(x) for x in part]
        edges[1::2] = ends - SHINGLE + 1
        edges = edges[:-1]  # the last segment runs to the end
        least = np.stack([np.minimum.reduceat(h * m + a, edges)[0::2] for m, a in zip(_MULTIPLY, _ADD, strict=True)], axis=1)
        bands = np.full((len(part), BANDS), 0xCBF29CE484222325, np.uint64) + np.arange(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            bands = (bands ^ least[:, r::ROWS].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            bands ^= bands >> np.uint64(29)
        out[at:end] = bands
        at = end
    return out


def occurrences(docs: DataFrame) -> DataFrame:
    """(key, doc_id, line, node, bands) per line with a word of ``docs`` (key, doc_id, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, numbers, lines = [], [], [], []
            for key, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text")), strict=True):
                for i, x in enumerate(text.split("\n")) if text else ():
                    if x.strip(_SPACE):
                        keys.append(key)
                        ids.append(doc_id)
                        numbers.append(i)
                        lines.append(x)
            sig = signatures(lines) if lines else np.empty((0, BANDS), np.uint64)
            nodes = np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(nodes.view(np.int64)),
                    pa.ListArray.from_arrays(np.arange(len(lines) + 1, dtype=np.int32) * BANDS, sig.view(np.int64).ravel()),
                ],
                ["key", "doc_id", "line", "node", "bands"],
            )

    return docs.mapInArrow(scan, "key long, doc_id long, line int, node long, bands array<long>")


def runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive items of at most ``CHUNK`` in sum, a larger one on its own."""
    at = 0
    while at < len(sizes):
        end, size = at, 0
        while end < len(sizes) and (end == at or size + sizes[end] <= CHUNK):
            size += sizes[end]
            end += 1
        yield at, end
        at = end


def code_points(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points + 1 of ``lines``, short ones filled with 0 to ``SHINGLE``, joined; and the offsets of the lines."""
    sizes = np.array([max(SHINGLE, len(x)) for x in lines], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    own = np.array([len(x) for x in lines], np.int64)
    codes = np.zeros(at[-1], np.uint64)
    codes[np.arange(len(raw)) + np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(own)[:-1]]), own)] = raw + np.uint64(1)
    return codes, at


def line_sketches(texts: DataFrame) -> DataFrame:
    """(node, n, parities) of the lines of ``texts`` (node, text), from distinct 64-bit hashes of their shingles."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column("text").to_pylist()
            sizes, cells = [], []
            for start, end in runs([len(x) for x in lines]):
                h, at = code_points(lines[start:end])
                h = mixed(h)
                for k in (1, 2, 4):  # SHINGLE = 8: each step doubles the length hashed
                    h = mixed(h[:-k] * np.uint64(0x9E3779B97F4A7C15 + 2 * k) + h[k:])
                for a, b in zip(at[:-1], at[1:], strict=True):
                    grams = distinct(h[a : b - SHINGLE + 1])
                    sizes.append(len(grams))
                    cells.append(parities(grams))
            flat = np.array(cells, np.int64).reshape(-1, len(CELL_COLUMNS))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sizes, pa.int32()), *map(pa.array, flat.T)], ["node", "n", *CELL_COLUMNS])

    return texts.mapInArrow(scan, "node long, n int" + "".join(f", {c} long" for c in CELL_COLUMNS))


def distinct(values: np.ndarray) -> np.ndarray:
    v = np.sort(values)
    return v[np.concatenate([[True], v[1:] != v[:-1]])]


def exact_shingles(lines: list[str]) -> list[np.ndarray]:
    """Per line its distinct shingles as numbers; equal numbers are equal shingles within one call, no hash is taken."""
    codes, at = code_points(lines)
    alphabet, v = np.unique(codes, return_inverse=True)
    v = v.astype(np.uint64)
    if len(alphabet) <= 256:
        for k in (1, 2, 4):
            v = (v[:-k] << np.uint64(8 * k)) | v[k:]
    else:
        for k in (1, 2, 4):
            v = np.unique((v[:-k] << np.uint64(32)) | v[k:], return_inverse=True)[1].astype(np.uint64)
    return [distinct(v[a : b - SHINGLE + 1]) for a, b in zip(at[:-1], at[1:], strict=True)]


def similar_lines(a: list[str], b: list[str]) -> np.ndarray:
    """Whether the shingle sets of a[i] and b[i] have the Jaccard similarity."""
    out = np.zeros(len(a), bool)
    for start, end in runs([len(x) + len(y) for x, y in zip(a, b, strict=True)]):
        lines = list(dict.fromkeys(a[start:end] + b[start:end]))  # a hub's line once
        sets = dict(zip(lines, exact_shingles(lines), strict=True))
        for i in range(start, end):
            s, t = sets[a[i]], sets[b[i]]
            v = np.sort(np.concatenate([s, t]))
            both = int(np.count_nonzero(v[1:] == v[:-1]))
            out[i] = 100 * both >= PERCENT * (len(v) - both)
    return out


def similar(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs (a, b) whose lines' shingle sets have the Jaccard similarity; ``lines``: (node, text)."""

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(similar_lines(a.tolist(), b.tolist()), dtype=bool)

    a = lines.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    b = lines.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(a, "a").join(b, "b").where(near("ta", "tb"))


def dropped(keyed: DataFrame) -> DataFrame:
    """(key, drop: line numbers that go) for the documents of ``keyed`` (key, doc_id, text) that lose lines."""
    occ = staged(occurrences(keyed), "lines")
    place = F.struct("doc_id", "key", "line")
    nodes = staged(occ.groupBy("node").agg(F.min(place).alias("first"), F.count("*").alias("n")), "nodes")
    groups = shared(occ.select(F.explode("bands").alias("group"), "node"))
    wanted = nodes.join(groups.select("node").distinct(), "node", "left_semi").select("node", "first.key", "first.line")
    by_doc = staged(wanted.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("line", "node"))).alias("w")), "wanted")  # a document's own lines
    texts = keyed.select("key", "text").join(small(by_doc), "key")
    if not wanted.select("key", "line").join(occ.select("key", "line"), ["key", "line"]).groupBy("key", "line").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["key"])  # repeated rows
    texts = (
        texts.select("w", F.filter(F.split("text", "\n"), lambda x, i: F.exists("w", lambda s: s["line"] == i)).alias("t"))
        .select(F.inline(F.arrays_zip("w", "t")))
        .select("w.node", F.col("t").alias("text"))
    )
    texts = staged(texts, "texts")
    sketches = staged(line_sketches(texts), "line-sketches")
    groups = live(groups.join(small(sketches), "node"), lambda x, y: similar_enough(x, y, PERCENT))
    comp = linked(groups, lambda pairs: similar(pairs, involved(texts, pairs)), lambda x, y: similar_enough(x, y, PERCENT))
    affected = nodes.select("node", "first", "n")
    if comp is None:
        affected = affected.where("n > 1").select("node", F.col("first").alias("keep"))
    else:
        affected = affected.join(small(comp), "node", "left").where("n > 1 OR component IS NOT NULL").withColumn("c", F.coalesce("component", "node"))
        affected = staged(affected, "affected")
        keep = staged(affected.groupBy("c").agg(F.min("first").alias("keep")), "keep")
        affected = affected.join(small(keep), "c").select("node", "keep")
    gone = occ.select("node", "key", "doc_id", "line").join(affected, "node").where(~place.eqNullSafe(F.col("keep")))
    return staged(gone.groupBy("key").agg(F.collect_set("line").alias("drop")), "drops")  # a document's own lines


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the repeated lines gone, plus n_lines and n_dropped (last two columns)."""
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    drops = dropped(keyed.select(F.col("__key").alias("key"), "doc_id", "text"))
    out = keyed.join(small(drops.select(F.col("key").alias("__key"), F.col("drop").alias("__drop"))), "__key", "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__drop", i)), "\n")
    n_lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    n_dropped = F.coalesce(F.size("__drop"), F.lit(0)).cast("long")
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    out = out.withColumns({"n_lines": n_lines, "n_dropped": n_dropped, "text": F.when(F.col("__drop").isNull(), F.col("text")).otherwise(kept)})
    if "n_chars" in own:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*own, "n_lines", "n_dropped")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat a kept line nearly."""
    return deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated lines go, and with them documents that had lines and lost them all."""
    out = deduplicated(docs)
    return out.where("n_dropped = 0 OR n_dropped < n_lines").select(*docs.columns)
