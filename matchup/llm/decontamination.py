"""Benchmark decontamination by a prefix-filtered set join [native].

A benchmark item is cut into windows of ``window`` consecutive words (an item
of fewer words is one window), a window into shingles of ``shingle`` words, or
of all its words if it has fewer. Shingles are ordered by rarity: by the
number of their places in the documents, ties by hash. A document holds a
window only if it holds all its shingles, so of a window's ordered shingles
the necessary prefix is the first one: documents meet windows by equi-join on
each window's rarest shingle. The place of the shingle fixes where the window
would start; that must not lie before the document (positional bound) nor end
behind it (length bound). Then containment is verified exactly: the shingles
that cover the window must stand at their own places in the document.

The documents are scanned once for the places of benchmark shingles, which are
few; only these are written, counted and joined again. Words that a window
covers are counted once, however many windows overlap there.

Bounds: the distinct shingles of the benchmark are broadcast if they are at
most ``graph.BROADCAST_ROWS`` longs, else they meet the documents by a shuffle
join; everything else joins on (document, place), which no passage or copy
makes hot.

Words are compared by 64-bit hashes of the shingles; a window of ten words is
covered by two.

Defined results: null text has no words; an item without words has no
windows; rows that share an item_id are one item, and a null item_id reads as
''; documents without a hit have the digest of the empty string; repeated
rows, null doc_ids and different texts under one doc_id each get their own
row; an empty benchmark leaves all documents clean; no documents, no rows.
Columns other than the ids and texts are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchup.llm.common import folded, read, staged
from matchup.llm.graph import small

#: Everything up to 7F but 0-9 and a-z separates words (fixed by the contract).
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before lower-casing.
NOT_ANY_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 5


def words(text: Column) -> Column:
    return F.array_remove(F.split(folded(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def grams(hashes: Column, k: int) -> Column:
    """Hashes of the runs of ``k`` words, by start, of an array of word hashes."""
    last = F.size(hashes) - k
    runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.lit(k), *(F.get(hashes, i + j) for j in range(k))))
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<bigint>"))


def windows_of(items: DataFrame, window: int, shingle: int, text: str, item: str) -> DataFrame:
    """(item, win, len, k, grams): the windows of every item, a window's id being the hash of its words."""
    own = items.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("item"), words(F.col(f"`{text}`")).alias("w")).where(F.size("w") > 0)
    own = own.withColumn("len", F.least(F.size("w"), F.lit(window)))
    own = own.select("item", "len", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("len"))).alias("at"))
    own = own.select("item", "len", F.slice("w", F.col("at") + 1, F.col("len")).alias("w"))
    h = F.transform("w", lambda x: F.xxhash64(x))
    by_length = F.coalesce(*(F.when(F.col("len") == k, grams(h, k)) for k in range(1, shingle)), grams(h, shingle))
    return own.select("item", F.xxhash64(F.array_join("w", " ")).alias("win"), "len", F.least("len", F.lit(shingle)).alias("k"), by_length.alias("grams")).distinct()


def row_key(key: str, text: str) -> list[Column]:
    """Two hashes that stand for a document row; equal rows share them."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return [F.xxhash64(F.col(f"`{key}`"), t).alias("k1"), F.xxhash64(t, F.lit(1), F.col(f"`{key}`")).alias("k2")]


def places(docs: DataFrame, wanted: DataFrame, sizes: list[int], key: str, text: str) -> DataFrame:
    """(k1, k2, n, at, gram): where documents hold one of the ``wanted`` shingles (gram), staged."""
    own = docs.select(*row_key(key, text), F.transform(words(F.col(f"`{text}`")), lambda x: F.xxhash64(x)).alias("h"))
    own = own.withColumn("n", F.size("h"))
    found = None
    for k in sizes:
        part = own.select("k1", "k2", "n", F.posexplode(grams(F.col("h"), k)).alias("at", "gram")).join(wanted, "gram", "left_semi")
        found = part if found is None else found.unionAll(part)
    return staged(found.select("k1", "k2", "n", "at", "gram").distinct(), "benchmark-places")


def occurrences(found: DataFrame, windows: DataFrame) -> DataFrame:
    """(k1, k2, start, win, len) of every window that a document holds, staged."""
    ends = F.col("len") - F.col("k")
    cover = F.array_distinct(F.concat(F.sequence(F.lit(0), ends, F.col("k")), F.array(ends)))
    whole = windows.select("win", "len", "k", "grams").distinct()
    whole = whole.withColumn("cover", F.transform(cover, lambda o: F.struct(o.alias("o"), F.get("grams", o).alias("gram"))))
    counts = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n_places"))
    ordered = whole.select("win", "len", "cover", F.size("grams").alias("size"), F.posexplode("grams").alias("offset", "gram"))
    # A shingle without a place rules its window out: the inner join and the count drop it.
    ordered = ordered.join(counts, "gram")
    rarest = F.min(F.struct("n_places", "gram", "offset")).alias("r")
    prefix = ordered.groupBy("win").agg(rarest, F.count(F.lit(1)).alias("held"), F.first("size").alias("size"), F.first("len").alias("len"), F.first("cover").alias("cover"))
    prefix = staged(prefix.where("held = size").select("win", "len", "cover", F.col("r.gram").alias("gram"), F.col("r.offset").alias("offset")), "window-prefixes")
    start = F.col("at") - F.col("offset")
    candidates = found.join(prefix, "gram").select("k1", "k2", "n", start.alias("start"), "win", "len", "cover").where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n")))
    needed = candidates.select("k1", "k2", "start", "win", "len", F.size("cover").alias("need"), F.explode("cover").alias("c"))
    needed = needed.select("k1", "k2", (F.col("start") + F.col("c.o")).alias("at"), F.col("c.gram").alias("gram"), "start", "win", "len", "need")
    held = needed.join(found.select("k1", "k2", "at", "gram"), ["k1", "k2", "at", "gram"])
    held = held.groupBy("k1", "k2", "start", "win", "len", "need").agg(F.count(F.lit(1)).alias("got")).where("got = need")
    return staged(held.select("k1", "k2", "start", "win", "len"), "window-places")


def contaminated(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, text: str = "text", key: str = "doc_id",
    item_text: str = "text", item: str = "item_id",
) -> DataFrame:
    """One row a document: key, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = staged(windows_of(items, window, shingle, item_text, item), "benchmark-windows")
    sizes = [r["k"] for r in windows.select("k").distinct().orderBy("k").collect()]  # at most ``shingle`` values
    n_words = F.size(F.array_remove(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), NOT_ANY_WORD), "")).cast("long")
    rows = docs.select(F.col(f"`{key}`"), *row_key(key, text), n_words.alias("n_words"))
    if sizes:
        wanted = staged(windows.select(F.explode("grams").alias("gram")).distinct(), "benchmark-shingles")
        at = occurrences(places(docs, small(wanted), sizes, key, text), windows)
        before = Window.partitionBy("k1", "k2").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        spans = at.groupBy("k1", "k2", "start").agg(F.max(F.col("start") + F.col("len")).alias("end"))
        fresh = F.greatest(F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))), F.lit(0))
        hit = spans.withColumn("fresh", fresh).groupBy("k1", "k2").agg(F.sum("fresh").alias("n_hit"))
        owners = staged(windows.select("win", "item").distinct(), "window-items")
        named = at.select("k1", "k2", "win").distinct().join(small(owners), "win").groupBy("k1", "k2").agg(F.collect_set("item").alias("items"))
        rows = rows.join(hit.join(named, ["k1", "k2"]), ["k1", "k2"], "left")
    else:
        rows = rows.withColumns({"n_hit": F.lit(0), "items": F.lit(None).cast("array<string>")})
    found = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select(
        F.col(f"`{key}`"), "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(found), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a ten-word window of a benchmark item, and the items found."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i + 1:i + least(len(w), 10)], ' ') AS win
  FROM (SELECT item, w, unnest(range(len(w) - least(len(w), 10) + 1)) AS i FROM items WHERE len(w) > 0)
), starts AS (
  SELECT r, w, n, unnest(range(len(w) - n + 1)) AS i FROM docs CROSS JOIN (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
), hits AS (
  SELECT s.r, s.i, s.n, x.item FROM (SELECT r, i, n, array_to_string(w[i + 1:i + n], ' ') AS win FROM starts) s JOIN windows x ON x.win = s.win AND x.n = s.n
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
), found AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""
