"""Spelling variants of the corpus vocabulary, found with pivotal bigrams.

Two words are near if one inserted, deleted or replaced code point turns one
into the other (``EDITS`` = 1). A word's bigrams, each with its place, are
ordered by how many words hold them, rarest first. Its prefix is the first
``GRAM * EDITS + 1`` of them (and further places of the same bigrams); its
pivots are ``EDITS + 1`` of the prefix that do not overlap, chosen by dynamic
programming for the least total number of words. An edit touches only one of
several disjoint bigrams, so of two near words the one whose prefix ends
earlier in the order has a pivot that stands in the other's prefix. Pivots
are therefore joined with prefixes, by bigram, place and length: a word of the
same length (one replaced code point) keeps the bigram's place, one that is a
code point longer or shorter keeps it or moves it by that one. ``levenshtein``
verifies the pairs.

One edit also leaves the first or the last half of a word as it is, so the
join key is a hash of bigram, place, length and either half: without the
halves, a frequent bigram pairs very many words that are far apart (hash
collisions only bring pairs that the verification drops). A hot key is split
by Spark's skew handling: nothing behind the join needs its rows together
before the verified pairs are grouped. Words are counted map-side first.

Bounds: bigrams are made of 90 letters (a-z and \\u00C0-\\u00FF), so their order
has 8,100 entries at most and travels with the tasks. Everything else stays distributed. Forms at least double the count at
each step, so pointer doubling over them ends after a number of rounds that
follows from the largest count.

Defined results: null text has no words; a null doc_id reads as ''; repeated
rows count each; among equally frequent near words the smallest in code-point
order is the form; a word without near words has form null, n_near 0 and
itself as root; no words, no rows. Columns other than the id and text are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchup.llm.common import folded, read, staged

#: Everything but the letters of the contract, A-Z, a-z and \u00C0-\u00FF (the negated class is much slower).
NOT_LETTER = r"[\x00-\x40\x5B-\x60\x7B-\xBF\x{100}-\x{10FFFF}]+"
GRAM, EDITS = 2, 1
MIN_LENGTH, MIN_COUNT, TIMES = 5, 3, 2
#: The contract's simulated typos: runs whose hash this divides lose a code point.
TYPO = 97


def vocabulary(docs: DataFrame, text: str = "text", key: str = "doc_id", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of ``min_length`` code points or more that occur ``min_count`` times or more."""
    runs = docs.select(
        F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("id"),
        F.explode(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), NOT_LETTER)).alias("run"),
    ).where(F.length("run") >= min_length)
    runs = runs.select("id", folded(F.col("run")).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.pmod("h", F.lit(TYPO)) == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def chosen(grams: list[tuple[int, int, int]], count: int) -> list[int]:
    """Indices of ``count`` of ``grams`` (place, weight, rank), ascending by place, that do not overlap, of least weight.

    ``best[k]`` holds, for the grams seen so far, the least weight of k disjoint ones and which they are.
    """
    best: list[list[tuple[int, list[int]] | None]] = [[(0, [])] + [None] * count]
    for i, (place, weight, _) in enumerate(grams):
        before = max((j for j in range(i) if grams[j][0] + GRAM <= place), default=-1) + 1
        row = list(best[i])
        for k in range(1, count + 1):
            rest = best[before][k - 1]
            if rest is not None and (row[k] is None or rest[0] + weight < row[k][0]):
                row[k] = (rest[0] + weight, [*rest[1], i])
        best.append(row)
    return best[-1][count][1]


def indexed(words: DataFrame, order: dict[str, tuple[int, int]]) -> DataFrame:
    """(word, pivots, prefix, last): bigrams as (gram, place) and the rank that ends the prefix; ``order``: (rank, words) of a bigram."""

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for word in frame["word"]:
                own = [(word[i : i + GRAM], i) for i in range(len(word) - GRAM + 1)]
                ranked = sorted((order[g][0], i, g) for g, i in own)
                last = ranked[GRAM * EDITS][0]
                first = sorted((i, order[g][1], r) for r, i, g in ranked[: GRAM * EDITS + 1])
                pivots = [(word[first[i][0] : first[i][0] + GRAM], first[i][0]) for i in chosen(first, EDITS + 1)]
                rows.append((word, pivots, [(g, i) for g, i in own if order[g][0] <= last], last))
            yield pd.DataFrame(rows, columns=["word", "pivots", "prefix", "last"])

    grams = "array<struct<gram:string,place:int>>"
    return words.select("word").mapInPandas(index, f"word string, pivots {grams}, prefix {grams}, last int")


def half_keys(word: str, gram: Column, length: Column, place: Column) -> Column:
    """Two join keys of a bigram at a place in a word of ``length`` code points: with its first half and with its last.

    One edit leaves one of the halves of two near words as it is; ``word`` may be one code point longer or shorter.
    """
    head = ((length - 1) / 2).cast("int")
    return F.array(
        F.xxhash64(gram, length, place, F.lit(0), F.left(F.col(word), head)),
        F.xxhash64(gram, length, place, F.lit(1), F.right(F.col(word), length - 1 - head)),
    )


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), both ways, of the words at distance 1, staged. Words have five code points or more."""
    own = F.transform(F.sequence(F.lit(1), F.length("word") - GRAM + 1), lambda i: F.substring(F.col("word"), i, F.lit(GRAM)))
    held = words.select(F.explode(F.array_distinct(own)).alias("gram")).groupBy("gram").count()
    ranked = sorted((r["count"], r["gram"]) for r in held.collect())  # 8,100 rows at most
    index = staged(indexed(words, {g: (rank, n) for rank, (n, g) in enumerate(ranked)}), "pivotal-grams")
    length = F.length("word")
    pivots = index.select(F.col("word").alias("a"), F.col("last").alias("end"), length.alias("len"), F.explode("pivots").alias("g"))
    pivots = pivots.select("a", "end", F.explode(half_keys("a", F.col("g.gram"), F.col("len"), F.col("g.place"))).alias("key"))
    # Lengths and places that a pivot's word may have, seen from the word whose prefix holds the bigram.
    moves = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(s).alias("s")) for d, s in ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))))
    prefix = index.select(F.col("word").alias("b"), F.col("last").alias("other"), length.alias("n"), F.explode("prefix").alias("g"))
    prefix = prefix.select("b", "other", "n", "g.gram", "g.place", F.explode(moves).alias("m"))
    prefix = prefix.select("b", "other", "gram", (F.col("n") + F.col("m.d")).alias("len"), (F.col("place") + F.col("m.s")).alias("place"))
    prefix = prefix.where("place >= 0").select("b", "other", F.explode(half_keys("b", F.col("gram"), F.col("len"), F.col("place"))).alias("key"))
    pairs = pivots.join(prefix, "key").where("end <= other AND a <> b")
    near = pairs.where(F.levenshtein("a", "b", EDITS) == EDITS).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sides = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("s")
    return staged(near.select(sides).select("s.a", "s.b"), "near-words")


def roots(forms: DataFrame, most: int, times: int) -> DataFrame:
    """(word, root) of the words that have a form: the last of the chain of forms, by pointer doubling.

    Counts grow by ``times`` a step, so a chain has at most log(most) steps.
    """
    chain = forms
    steps, n = 1, max(most, 1)
    while n >= times:
        n, steps = n // times, steps + 1
    reach = 1
    while reach < steps:
        nxt = chain.select(F.col("word").alias("root"), F.col("root").alias("further"))
        chain = staged(chain.join(nxt, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "word-roots")
        reach *= 2
    return chain


def grouped(
    docs: DataFrame, text: str = "text", key: str = "doc_id", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, times: int = TIMES
) -> DataFrame:
    """One row a word: word, form, root, n, n_near, form_n."""
    if min_length < GRAM * (EDITS + 1) + 1 or times < 2:
        raise ValueError("words need five code points, forms twice the count")
    words = staged(vocabulary(docs, text, key, min_length, min_count), "vocabulary")
    pairs = near_pairs(words).join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    best = pairs.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("m"), F.col("b").alias("form"))).alias("f"))
    out = words.join(best, "word", "left")
    fits = -F.col("f.m") >= F.col("n") * times
    out = staged(
        out.select("word", F.when(fits, F.col("f.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, -F.col("f.m")).alias("form_n")),
        "word-forms",
    )
    most = out.agg(F.max("n").alias("n")).first()["n"] or 0
    ends = roots(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")), most, times)
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their near words, their more frequent form and its last."""
    return grouped(read(spark, sf_dir, "documents").select("doc_id", "text"))
