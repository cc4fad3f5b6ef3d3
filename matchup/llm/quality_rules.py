"""Quality rules as weak supervision [native].

Each rule looks at counts of one whole text and votes good (1), bad (0) or
abstains (null). The corpus's vote patterns are counted in one aggregation
(at most 3 ** rules rows, however many documents), expectation-maximisation
over those counts estimates how often each rule votes bad on good and on bad
texts, and the posterior probability of quality replaces all-must-pass.

The counts of a text (``counted``) need no shuffle: repeated three-word
windows come from sorting the windows of that one text.

Defined results: null text has no words, like an empty one; a text with no
words has mean word length 0 and all rules abstain, so its posterior is the
prior (the base rules fail it anyway). With no documents the starting values
stay. Ties in votes cannot occur (a posterior of exactly the threshold is
kept). Input columns named like a count or a result are replaced; repeated
rows stay repeated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchup.llm.common import drop_clashes, read, staged, words

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_same")
RESULTS = ("posterior", "base_failed", "kept")
SYMBOLS = r"[^#*$%&|<>]+"


def _kept_chars(text: Column, others: str) -> Column:
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of COUNTS."""
    kept = drop_clashes(docs, *COUNTS, *RESULTS)
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.size("__w")
    a = kept.withColumn("__w", words(F.col(text))).withColumn(
        "__l", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    window = F.transform(
        F.slice("__w", F.lit(1), F.greatest(n - 2, F.lit(0))),
        lambda x, i: F.concat_ws(" ", x, F.get("__w", i + 1), F.get("__w", i + 2)),
    )
    a = a.select(
        *kept.columns,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        _kept_chars(t, SYMBOLS).alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        _kept_chars(t, r"[^\p{Lu}]+").alias("n_upper"),
        _kept_chars(t, r"[^!]+").alias("n_bangs"),
        (F.size(F.filter("__w", lambda x, i: (i > 0) & (F.get("__w", i - 1) == x)))).cast("long").alias("n_same"),
        window.alias("__v"),
    )
    # Only a text with a repeated window has its windows sorted.
    repeated = F.size(F.array_distinct("__v")) < F.size("__v")
    sorted_v = F.when(repeated, F.sort_array(F.transform("__v", lambda v, i: F.struct(v.alias("v"), i.alias("i")))))
    a = a.withColumn("__s", sorted_v).drop("__v")

    def again(s, j):
        return F.coalesce((F.get("__s", j - 1)["v"] == s["v"]) & (j > 0), F.lit(False)) | F.coalesce(F.get("__s", j + 1)["v"] == s["v"], F.lit(False))

    a = a.withColumn("__p", F.sort_array(F.transform(F.filter("__s", again), lambda s: s["i"]))).drop("__s")
    covered = F.aggregate(
        F.transform("__p", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("__p", j + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda x, y: x + y,
    )
    # inline() keeps later filters on the counts above it: pushed below, they would
    # repeat the expressions above inside each other's lambdas.
    counts = F.struct(*(F.col(c) for c in COUNTS if c != "n_repeat_words"), F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))
    return a.select(*kept.columns, F.inline(F.array(counts)))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def votes() -> list[Column]:
    """1 good, 0 bad, null abstains; each rule compares one count with the number of words."""
    n = F.col("n_words")

    def rule(bad: Column, good: Column) -> Column:
        return F.when(n < 10, None).when(bad, 0).when(good, 1)

    def share(count: str, bad: float, good: float) -> Column:
        c = F.col(count)
        return rule(c > bad * n, c <= good * n)

    length = F.col("word_chars") / F.greatest(n, F.lit(1))
    lines = F.col("n_lines")
    # One rule for each kind of fault: rules that see the same fault would count it twice.
    return [
        rule((length < 2.0) | (length > 14.0), length.between(3.0, 10.0)),
        share("n_symbols", 0.05, 0.01),
        rule((F.col("n_bangs") > 0.05 * n) | (F.col("n_upper") > n), (F.col("n_bangs") <= 0.01 * n) & (F.col("n_upper") <= 0.4 * n)),
        rule((F.col("n_repeat_words") > 0.4 * n) | (F.col("n_same") > 0.1 * n), (F.col("n_repeat_words") <= 0.1 * n) & (F.col("n_same") <= 0.02 * n)),
        rule((F.col("n_dup_lines") > 0.5 * lines) & (lines > 3), F.col("n_dup_lines") <= 0.25 * lines),
    ]


#: Start, and the mean of the Beta priors: share of good texts; probability that a
#: vote is bad, on bad and on good texts.
START = (0.85, 0.25, 0.005)
#: Weight of those priors (share of good, bad texts' votes, good texts' votes) as a share
#: of the corpus, so that they count alike at every size.
WEIGHT = (0.1, 0.02, 0.1)
#: Bounds of the two probabilities. Kinds of junk exclude each other, so rules don't err
#: independently: without bounds a kind that one rule alone sees would pass as good.
BOUNDS = ((0.05, 0.5), (0.0005, 0.005))


def fit(counts: list[tuple[tuple, int]], n_rules: int, rounds: int = 200) -> tuple[float, list[tuple[float, float]]]:
    """(share of good, per rule the probability of a bad vote on bad and on good texts) from vote patterns."""
    prior, rates = START[0], [START[1:]] * n_rules
    total = sum(n for _, n in counts)
    w = [total * x + 1.0 for x in WEIGHT]
    for _ in range(rounds if total else 0):
        mass = [w[0] * (1 - START[0]), w[0] * START[0]]
        bad = [[w[1] * START[1], w[2] * START[2]] for _ in range(n_rules)]
        cast = [w[1:] for _ in range(n_rules)]
        for pattern, n in counts:
            p = 1 / (1 + math.exp(min(700.0, -logit(pattern, prior, rates))))
            for c, share in enumerate(((1 - p) * n, p * n)):
                mass[c] += share
                for r, v in enumerate(pattern):
                    if v is not None:
                        cast[r][c] += share
                        bad[r][c] += share * (v == 0)
        old = prior, rates
        prior = mass[1] / sum(mass)
        rates = [tuple(min(max(b[k] / c[k], BOUNDS[k][0]), BOUNDS[k][1]) for k in (0, 1)) for b, c in zip(bad, cast, strict=True)]
        if abs(prior - old[0]) + sum(abs(a - b) for x, y in zip(rates, old[1], strict=True) for a, b in zip(x, y, strict=True)) < 1e-9:
            break
    return prior, rates


def logit(pattern: tuple, prior: float, rates: list[tuple[float, float]]) -> float:
    out = math.log(prior / (1 - prior))
    for v, (b, g) in zip(pattern, rates, strict=True):
        if v is not None:
            out += math.log(g / b) if v == 0 else math.log((1 - g) / (1 - b))
    return out


def learned(counted_docs: DataFrame) -> tuple[float, list[tuple[float, float]]]:
    """The model from the vote patterns of all documents."""
    rules = votes()
    names = [f"v{i}" for i in range(len(rules))]
    rows = counted_docs.select(*(r.alias(n) for r, n in zip(rules, names, strict=True))).groupBy(*names).count().collect()
    return fit(sorted(((tuple(r[:-1]), r[-1]) for r in rows), key=str), len(rules))


def judged(counted_docs: DataFrame, model: tuple[float, list[tuple[float, float]]], threshold: float = 0.5) -> DataFrame:
    """Adds posterior, base_failed and kept."""
    prior, rates = model
    score = F.lit(math.log(prior / (1 - prior)))
    for v, (b, g) in zip(votes(), rates, strict=True):
        score = score + F.when(v == 0, math.log(g / b)).when(v == 1, math.log((1 - g) / (1 - b))).otherwise(0.0)
    return counted_docs.withColumns({"posterior": 1 / (1 + F.exp(-score)), "base_failed": base_failed()}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base failure and the verdict of the weak-supervision model for every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counts = staged(counted(docs).drop("text"), "quality")
    return judged(counts, learned(counts)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go.

    The texts are counted twice (once for the votes, once to decide) rather
    than written next to their counts.
    """
    model = learned(counted(docs.select("text")))
    return judged(counted(docs), model).where("kept").select(*docs.columns)
