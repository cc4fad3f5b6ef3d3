"""Source divergence audit: how far the word use of each source lies from the others' of its lang.

``CountVectorizer`` is fitted per lang (``minDF`` documents, all terms that
reach it: ``vocabSize`` is the largest int) and makes an exact sparse vector
of every document. The vectors' entries are summed per (lang, source, term),
map-side first, as ``Summarizer`` sums groups, but in longs, since its own
sums go through floating means. Term counts c of a group of N kept terms give
``p = 1 + floor(SCALE * (c + PRIOR) / (N + PRIOR * V))``, in exact decimals.

Pairs of sources are evaluated over blocks of the vocabulary: a block's task
gets the entries of at most ``2 * TILE`` sources for so many terms that the
dense block has ``CELLS`` cells at most, fills absent terms with the group's p
of count 0 and emits one partial sum a pair; the partial sums add up to the
pair's. No term's sources are paired as rows, and a hot source only has fewer
absent terms.

Bounds: the driver holds the kept terms of one lang at a time, as
``CountVectorizer`` does (terms of ``minDF`` documents or more; rarer ones stay
distributed), and the list of langs that have ``minDF`` documents. The result
has a row for each ordered pair of sources of a lang, as asked.

Defined results: null text, lang and source read as ''; texts without terms
count for their group's being there only; a lang without kept terms (V = 0)
has pairs of value 0 and no term rows; a lang with one source has no pairs;
repeated rows count each; ties rank by the item's UTF-8 bytes; no documents,
no rows. Columns other than text, lang and source are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchup.llm.common import folded, read, staged, staged_by

#: Everything up to 7F but A-Z and a-z separates terms (fixed by the contract).
NOT_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DF, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: No bound on the vocabulary but the type's.
ALL_TERMS = 2**31 - 1
#: Cells of a dense block (1 MB of longs) and sources of a side of it.
CELLS, TILE = 1 << 17, 1024


def tokens(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, terms) of every row, nulls as ''."""
    own = F.split(folded(F.coalesce(F.col(f"`{text}`"), F.lit(""))), NOT_TERM)
    empty = F.lit("")
    return docs.select(
        F.coalesce(F.col(f"`{lang}`"), empty).alias("lang"),
        F.coalesce(F.col(f"`{source}`"), empty).alias("source"),
        F.array_remove(own, "").alias("terms"),
    )


def p_of(count: str, total: str = "total", v: str = "v"):
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * v)), exact however large the counts."""
    top = f"CAST({SCALE} AS DECIMAL(19,0)) * CAST({count} + {PRIOR} AS DECIMAL(19,0))"
    return F.expr(f"1 + ({top}) div CAST({total} + {PRIOR} * {v} AS DECIMAL(19,0))")


def term_sums(rows: DataFrame, min_df: int) -> tuple[DataFrame, list[tuple[str, int]]]:
    """(lang, source, idx, term, n) with n > 0, staged, and (lang, V) of the langs with kept terms."""
    spark = rows.sparkSession
    sizes = rows.groupBy("lang").count().where(F.col("count") >= min_df).orderBy("lang").collect()  # a row a lang
    parts, kept = [], []
    for lang in (r["lang"] for r in sizes):
        own = rows.where(F.col("lang") == F.lit(lang))
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_df), vocabSize=ALL_TERMS).fit(own)
        if not model.vocabulary:
            continue
        kept.append((lang, len(model.vocabulary)))
        vector = F.unwrap_udt(F.col("vector"))
        entries = model.transform(own).select("lang", "source", F.explode(F.arrays_zip(vector["indices"].alias("idx"), vector["values"].alias("n"))).alias("e"))
        sums = entries.groupBy("lang", "source", F.col("e.idx").alias("idx")).agg(F.sum(F.col("e.n").cast("long")).alias("n"))
        names = pd.DataFrame({"idx": np.arange(len(model.vocabulary), dtype=np.int32), "term": model.vocabulary})
        parts.append(staged(sums.join(spark.createDataFrame(names, "idx int, term string"), "idx"), "term-sums"))
    if not parts:
        return spark.createDataFrame([], "idx int, lang string, source string, n long, term string"), kept
    return reduce(DataFrame.unionAll, parts), kept


def block_distances(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of |p - q| of the pairs (a, b) of one block; rows with idx -1 carry a source's p of count 0."""
    lang, _, left, right = key
    heads = frame[frame["idx"] < 0]
    sources, tiles = heads["source"].to_numpy(), heads["tile"].to_numpy()
    cells = frame[frame["idx"] >= 0]
    _, columns = np.unique(cells["idx"].to_numpy(), return_inverse=True)
    p = np.repeat(heads["p"].to_numpy(np.int64)[:, None], int(heads["width"].iloc[0]), axis=1)
    p[pd.Index(sources).get_indexer(cells["source"]), columns] = cells["p"].to_numpy(np.int64)
    out = []
    for i in np.flatnonzero(tiles == left):
        others = np.flatnonzero((tiles == right) & ((sources > sources[i]) if left == right else (sources != sources[i])))
        if len(others):
            out.append(pd.DataFrame({"a": sources[i], "b": sources[others], "value": np.abs(p[others] - p[i]).sum(axis=1)}))
    found = pd.concat(out, ignore_index=True) if out else pd.DataFrame({"a": [], "b": [], "value": []}).astype({"a": str, "b": str, "value": np.int64})
    found.insert(0, "lang", lang)
    return found


def pair_distances(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value), a before b: sums of |p - q| over all V terms, staged.

    ``cells`` (lang, source, idx, p) hold the terms present, ``groups`` (lang,
    source, v, p0) the p of an absent one.
    """
    most = groups.groupBy("lang").count().agg(F.max("count").alias("n")).first()["n"] or 1
    n_tiles = -(-most // TILE)
    width = max(1, CELLS // min(most, 2 * TILE))
    tile = F.pmod(F.xxhash64("source"), F.lit(n_tiles)).cast("int")
    last = F.greatest(F.ceil(F.col("v") / width).cast("int") - 1, F.lit(0))
    heads = groups.select(
        "lang", F.explode(F.sequence(F.lit(0), last)).alias("block"), "source", F.lit(-1).alias("idx"), F.col("p0").alias("p"), "v"
    )
    rows = cells.select("lang", F.floor(F.col("idx") / width).cast("int").alias("block"), "source", "idx", "p", F.lit(0).cast("long").alias("v")).unionAll(heads)
    rows = rows.withColumn("width", F.least(F.col("v") - F.col("block") * width, F.lit(width).cast("long"))).withColumn("tile", tile)
    rows = rows.withColumn("partner", F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))))
    rows = rows.withColumn("left", F.least("tile", "partner")).withColumn("right", F.greatest("tile", "partner"))
    partial = rows.groupBy("lang", "block", "left", "right").applyInPandas(block_distances, "lang string, a string, b string, value long")
    return staged(partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "source-pairs")


def audited(docs: DataFrame, min_df: int = MIN_DF, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): other sources by distance, and the terms a source overuses most."""
    rows = staged_by(tokens(docs, text, lang, source), "source-terms", "lang").withColumn("lang", F.coalesce("lang", F.lit("")))
    sums, kept = term_sums(rows, min_df)
    spark = docs.sparkSession
    sizes = spark.createDataFrame(kept, "lang string, v long")
    groups = rows.select("lang", "source").distinct()
    totals = sums.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = staged(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v")), "source-groups")
    cells = staged(sums.join(groups, ["lang", "source"]).select("lang", "source", "idx", "term", p_of("n").alias("p")), "source-cells")

    zeros = groups.select("lang", "source", "v", F.when(F.col("v") > 0, p_of("0")).otherwise(0).alias("p0"))
    pairs = pair_distances(cells.select("lang", "source", "idx", "p"), zeros)
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", sides.alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")

    whole = sums.groupBy("lang", "idx").agg(F.sum("n").alias("n"))
    whole = whole.join(groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("v").alias("v")), "lang")
    whole = whole.select("lang", "idx", p_of("n").alias("q"))
    terms = cells.join(whole, ["lang", "idx"]).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    return ranked.unionAll(terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of each lang's sources from each other, and the 50 terms each source overuses most."""
    return audited(read(spark, sf_dir, "documents").select("text", "lang", "source"))


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), toks AS (
  SELECT r, lang, source, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM docs)
), kept AS (
  SELECT lang, term FROM toks GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), sizes AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), sums AS (
  SELECT lang, source, term, count(*) AS n FROM toks JOIN kept USING (lang, term) GROUP BY lang, source, term
), totals AS (
  SELECT g.lang, g.source, coalesce(sum(s.n), 0)::HUGEINT AS total FROM groups g LEFT JOIN sums s USING (lang, source) GROUP BY g.lang, g.source
), cells AS (
  SELECT t.lang, t.source, k.term, coalesce(s.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(s.n, 0) + 5)) // (t.total + 5 * z.v) AS p
  FROM totals t JOIN sizes z USING (lang) JOIN kept k USING (lang) LEFT JOIN sums s ON s.lang = t.lang AND s.source = t.source AND s.term = k.term
), whole AS (
  SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (w.n + 5)) // (t.total + 5 * z.v) AS q
  FROM kept k JOIN (SELECT lang, term, sum(n)::HUGEINT AS n FROM sums GROUP BY lang, term) w USING (lang, term)
  JOIN (SELECT lang, sum(total) AS total FROM totals GROUP BY lang) t USING (lang) JOIN sizes z USING (lang)
), distances AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
), terms AS (
  SELECT c.lang, c.source, 'term' AS part, c.term AS item, (c.p - w.q)::BIGINT AS value
  FROM cells c JOIN whole w USING (lang, term) WHERE c.n > 0 AND c.p > w.q
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
) WHERE part = 'pair' OR rank <= 50
"""
