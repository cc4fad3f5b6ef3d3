"""N-gram Jaccard join by vertical partitioning.

A document is its set of word shingles (64-bit hashes of ``WORDS`` words; the
pipeline takes five and a similarity of 80 % where the query takes 85 %). All
shingles stand in one global order, rarest first: those that are frequent (see
``frequent``) by their count, before them all others by hash. Documents with
equal sets are one node.

Candidates: two sets of Jaccard similarity t share a shingle among the first
n - ceil(t n) + 1 of each (prefix filter); at the first one they share, sizes
and places must leave room for the overlap (length and positional filters),
and the parities of the shingles that fall into each of 512 cells must not
differ in more cells than shingles may (``shingles.parities``).
Of shingles with the same sets only the first in the order makes pairs. Pairs
are then held against parities of as many cells as the sets have members, so
the sets themselves are compared of little more than the true links. None of
these filters loses a link.
Overlaps: the global order is cut into ``FRAGMENTS`` pieces, the first
``RARE`` of them by hash where all rare shingles lie, the others at equal
numbers of frequent ones. Each piece counts the partial overlaps of the
candidate pairs on its own, and they are summed per pair: first over the rare
pieces, and only a pair that can still reach the similarity with all that its
other pieces may add is counted there too.
Components come from ``graph.linked``, which spares pairs that are already in
one component, so a large group of copies costs as many pairs as members.

Sets are compared as 64-bit hashes: a false equality is to be expected once in
2**65 / n**2 for n documents.

Defined results: null text is empty; a document without words has no
shingles, links with nothing and is its own component; with fewer than
``WORDS`` words the whole sequence is one shingle. Equal texts, repeated rows
among them, share a component. A null doc_id is never a component's id unless
all its documents have none. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchup.llm.common import read, staged
from matchup.llm.graph import involved, linked, live, small
from matchup.llm.shingles import CELL_COLUMNS, apart, mixed, parities, shingle_sets, similar_enough, wide_parities

WORDS, PERCENT, FRAGMENTS, RARE = 4, 85, 8, 4
#: A shingle in this share of the documents of a task's input is counted as frequent.
SHARE = 1 / 4000
#: Bound on the table of frequent shingles (16 bytes each) that tasks hold; rarer ones
#: than fit stay in the order of their hashes. The order decides costs, not results.
FREQUENT = 500_000
#: Bytes of shared prefix shingles that may be broadcast: as a hash table they take four times as much.
MANY_BYTES = 4_000_000


def frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the frequent shingles of all documents, and their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, rows = np.empty(0, np.uint64), np.empty(0, np.int64), 0

        def merged(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            k, n = np.unique(np.concatenate(sets), return_counts=True)
            both = np.concatenate([keys, k])
            order = np.argsort(both, kind="stable")
            both, n = both[order], np.concatenate([counts, n])[order]
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            k, n = both[first], np.add.reduceat(n, first)
            floor = 1
            while len(k) > 2 * FREQUENT:  # the rarest so far go
                floor += 1
                k, n = k[n >= floor], n[n >= floor]
            return k, n

        for batch in batches:
            held, size = [], 0
            for grams in shingle_sets(batch.column("text"), words):
                rows += 1
                held.append(grams)
                size += len(grams)
                if size > FREQUENT:
                    keys, counts = merged(held)
                    held, size = [], 0
            if size:
                keys, counts = merged(held)
        keep = counts >= max(2, SHARE * rows)
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), pa.array(counts[keep])], ["gram", "n"])

    found = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = staged(found, "frequent")
    sizes = {r[0]: r[1] for r in found.groupBy(F.floor(F.log2("n"))).count().collect()}  # at most 63 rows
    least, held = 64, 0
    while sizes.get(least - 1, 0) + held <= FREQUENT and least > 0:
        least -= 1
        held += sizes.get(least, 0)
    table = found.where(F.floor(F.log2("n")) >= least).toArrow()
    keys, counts = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def ordered(grams: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``grams`` (sorted) in the global order: by (count where frequent else 0, hash)."""
    if not len(keys) or not len(grams):
        return grams
    at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
    n = np.where(keys[at] == grams, counts[at], 0)
    return grams[np.lexsort((grams, n))]


def node_of(grams: np.ndarray) -> int:
    total = mixed(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(keepdims=True) + np.uint64(len(grams))
    return int(mixed(total).view(np.int64)[0]) if len(grams) else 0


def sketched(keyed: DataFrame, words: int, percent: int, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, doc_id, node, n, prefix) per row of ``keyed`` (key, doc_id, text)."""
    keys, counts = heavy

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, prefixes, cells = [], [], [], []
            for grams in shingle_sets(batch.column("text"), words):
                n = len(grams)
                nodes.append(node_of(grams))
                sizes.append(n)
                cells.append(parities(grams))
                prefixes.append(ordered(grams, keys, counts)[: n - math.ceil(percent * n / 100) + 1 if n else 0])
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            flat = np.concatenate(prefixes) if prefixes else np.empty(0, np.uint64)
            cells = np.array(cells, np.int64).reshape(-1, len(CELL_COLUMNS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("doc_id").cast(pa.int64()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(ends, flat.view(np.int64)), *map(pa.array, cells.T)],
                ["key", "doc_id", "node", "n", "prefix", *CELL_COLUMNS],
            )

    return keyed.mapInArrow(scan, "key long, doc_id long, node long, n int, prefix array<long>" + "".join(f", {c} long" for c in CELL_COLUMNS))


def pieces(grams: np.ndarray, keys: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """The fragment of each of ``grams`` (sorted) in the global order, from 0; ``piece``: that of the frequent ``keys``."""
    rare = np.minimum(grams // np.uint64((1 << 64) // RARE), np.uint64(RARE - 1)).astype(np.int64)
    if not len(keys) or not len(grams):
        return rare
    at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
    return np.where(keys[at] == grams, piece[at], rare)


def fragments(texts: DataFrame, words: int, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(node, n, fragment, later, grams, bits) of the sets of ``texts`` (node, text); later: its shingles in the frequent fragments.

    ``bits``: the set's wide parities in fragment 0, else null.
    """
    keys, counts = heavy
    cut = np.empty(len(keys), np.int64)
    cut[np.lexsort((keys, counts))] = RARE + np.arange(len(keys)) * (FRAGMENTS - RARE) // max(1, len(keys))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, numbers, sizes, later, parts, bits = [], [], [], [], [], []
            for node, grams in zip(batch.column("node").to_pylist(), shingle_sets(batch.column("text"), words), strict=True):
                piece = pieces(grams, keys, cut)
                order = np.argsort(piece, kind="stable")
                cuts = np.searchsorted(piece[order], np.arange(1, FRAGMENTS))
                for f, part in enumerate(np.split(grams[order], cuts)):
                    nodes.append(node)
                    numbers.append(f)
                    sizes.append(len(grams))
                    later.append(len(grams) - int(cuts[RARE - 1]))
                    parts.append(part)
                    bits.append(None if f else wide_parities(grams))
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(numbers, pa.int32()), pa.array(later, pa.int32()), pa.ListArray.from_arrays(ends, flat.view(np.int64)), pa.array(bits, pa.list_(pa.int64()))],
                ["node", "n", "fragment", "later", "grams", "bits"],
            )

    return texts.mapInArrow(scan, "node long, n int, fragment int, later int, grams array<long>, bits array<long>")


def near(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose wide parities leave the similarity possible, staged."""
    own = involved(parts.where("fragment = 0").select("node", "n", "bits"), pairs)
    a, b = (own.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    enough = (100 + percent) * apart("bits_a", "bits_b") <= (100 - percent) * (F.col("na") + F.col("nb"))
    return staged(pairs.join(a, "a").join(b, "b").where(enough).select("a", "b"), "near-pairs")


def partial(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, b, na, nb, la, lb, o) of the pairs (a, b), staged, in each fragment of ``parts``: o shingles in common."""
    a = parts.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("later").alias("la"), "fragment", F.col("grams").alias("ga"))
    b = parts.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("later").alias("lb"), "fragment", F.col("grams").alias("gb"))
    return small(pairs).join(a, "a").join(b, ["b", "fragment"]).select("a", "b", "na", "nb", "la", "lb", F.size(F.array_intersect("ga", "gb")).alias("o"))


def overlapping(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), staged, whose partial overlaps, summed over the fragments, reach the similarity."""
    pairs = near(pairs, parts, percent)
    parts = involved(parts.drop("bits"), pairs)
    sizes = [F.first(c).alias(c) for c in ("na", "nb", "la", "lb")]
    rare = partial(pairs, parts.where(F.col("fragment") < RARE)).groupBy("a", "b").agg(*sizes, F.sum("o").alias("o"))
    reach = F.col("o") + F.least("la", "lb")
    open_pairs = staged(rare.where((100 + percent) * reach >= percent * (F.col("na") + F.col("nb"))), "open")
    more = partial(open_pairs.where("la > 0 AND lb > 0").select("a", "b"), parts.where((F.col("fragment") >= RARE) & (F.size("grams") > 0)))
    total = open_pairs.select("a", "b", "na", "nb", "o").unionAll(more.select("a", "b", "na", "nb", "o"))
    total = total.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("o").alias("o"))
    return total.where((100 + percent) * F.col("o") >= percent * (F.col("na") + F.col("nb")))


def feasible(percent: int):
    """The filters for two members (n, place, parities) of a prefix shingle, taken as the first that they share."""

    def test(x: str, y: str):
        n, m, i, j = (F.col(f"{s}.{c}") for c in ("n", "place") for s in (x, y))
        return similar_enough(x, y, percent) & ((100 + percent) * F.least(n - i, m - j) >= percent * (n + m))

    return test


def first_shared(members: DataFrame) -> DataFrame:
    """The rows of ``members`` (group, node, place), distinct, of groups with several nodes, staged; of groups with the same nodes the first.

    All sets stand in one order, so the first of those groups has the least
    place in each of them: what two sets share first is in it. Equal groups
    are known by number, ends and sum of the node hashes. Most shingles are of
    one node: they go by their counts alone, before more of a row is shuffled.
    """
    many = staged(members.groupBy("group").count().where("count > 1").select("group"), "many")
    members = staged(members.join(small(many, MANY_BYTES), "group", "left_semi"), "several")
    same = [F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("nodes")]
    mixed_node = F.xxhash64("node")  # in halves: no sum overflows
    sums = [F.sum(F.shiftright(mixed_node, 32)).alias("high"), F.sum(mixed_node.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low")]
    ends = members.groupBy("group").agg(*same, *sums, F.sum("place").alias("places")).where("lo <> hi")
    first = ends.groupBy("lo", "hi", "nodes", "high", "low").agg(F.min_by("group", F.col("places")).alias("group"))
    return staged(members.join(small(staged(first.select("group"), "first")), "group", "left_semi"), "groups")


def components(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, doc_id, n, c) per row of ``docs`` (doc_id, text): its number of shingles and component; key = xxhash64(doc_id, text)."""
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    heavy = frequent(docs, words)
    rows = staged(sketched(keyed, words, percent, heavy), "sketches")
    filled, columns = rows.where("n > 0"), ("n", "prefix", *CELL_COLUMNS)
    again = small(staged(filled.groupBy("node").count().where("count > 1").select("node"), "again"))
    once = filled.join(again, "node", "left_anti").select("node", "key", *columns)
    nodes = filled.join(again, "node", "left_semi").groupBy("node").agg(F.min("key").alias("key"), *(F.first(c).alias(c) for c in columns))
    nodes = staged(nodes.unionAll(once), "nodes")
    groups = first_shared(nodes.select("node", F.posexplode("prefix").alias("place", "group")))
    met = staged(nodes.join(small(staged(groups.select("node").distinct(), "met")), "node", "left_semi").select("node", "n", *CELL_COLUMNS), "met")
    groups = live(groups.join(small(met), "node"), feasible(percent))
    wanted = staged(groups.select("node").distinct().join(nodes.select("node", "key"), "node"), "wanted")
    texts = keyed.select("key", "text").join(small(wanted), "key")
    if not rows.select("key").join(small(wanted), "key").groupBy("key").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["node"])  # repeated rows
    parts = staged(fragments(texts.select("node", "text"), words, heavy), "fragments")
    comp = linked(groups, lambda pairs: overlapping(pairs, parts, percent), feasible(percent), central="place")
    out = rows.select("key", "doc_id", "node", "n")
    out = out.withColumn("c", F.col("node")) if comp is None else out.join(small(comp), "node", "left").withColumn("c", F.coalesce("component", "node"))
    return out.select("key", "doc_id", "n", "c")


def joined(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(key, doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text); key = xxhash64(doc_id, text)."""
    out = staged(components(docs, words, percent), "classes")
    ids = out.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    ids = small(staged(ids.where("rows > 1").select("c", "least"), "class-ids"))  # a class of one row needs no join
    least = F.when((F.col("n") > 0) & F.col("least").isNotNull(), F.col("least")).otherwise(F.col("doc_id"))
    return out.join(ids, "c", "left").select("key", "doc_id", F.col("n").cast("long").alias("n_shingles"), least.alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle set size and component of every document, links at 85 % of four-word shingles."""
    return joined(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Pipeline stage: of each group of linked documents the one with the smallest (doc_id, key) stays.

    A null doc_id comes after all others. Documents without words stay; of
    repeated rows (equal doc_id and text) one.
    """
    found = staged(components(docs.select("doc_id", "text"), words, percent), "near")
    linked_rows = found.where("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    kept = linked_rows.groupBy("c").agg(first.alias("first")).select("first.key")
    gone = staged(linked_rows.select("key").distinct().join(kept, "key", "left_anti").withColumnRenamed("key", "__key"), "gone")
    out = docs.withColumn("__key", F.xxhash64("doc_id", "text")).join(small(gone), "__key", "left_anti")
    if not found.groupBy("key").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["__key"])
    return out.select(*docs.columns)
