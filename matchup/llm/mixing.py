"""Mixing sources to target weights with soft membership [native].

A labelled table names the domain of some documents. A naive Bayes classifier
over hashed words, trained on them, gives every document a posterior over the
domains. Document rates r >= 0 are fitted so that expected tokens match the targets,

    sum_d tokens_d p_dk r_d = weight_k T for each domain k,      T = all tokens,

by projected gradient on the least squares of the gaps, from rates of one. A
step is one pass over the documents that sums each domain's tokens at the
rates and at the extrapolated rates (numbers in the count of domains go to the
driver), then a move of every rate along its own slope, cut at zero. Gaps are
weighted by one over a domain's curvature, so rare domains converge like
frequent ones; the step is one over the Lipschitz bound, the top eigenvalue of
the weighted domains' products; momentum restarts when the value rises. The
steps end when each share is within ``TOLERANCE`` of its target, relatively, or
when the rates stand still; missed targets are warned of. An anchor holds rates
near one, where asked for.
A rate becomes whole copies by a fixed hash: floor(rate + u).

Tokens are the words ``[^\\x20\\x09-\\x0D]+``. Defined results: null or empty
text has no tokens, the prior as posterior, and a rate like others; with no
labelled row the posterior is even; with no tokens at all rates are 1. Labels
of unknown domains or with nulls are left out, a document labelled twice
counts twice. Repeated rows get equal rates. Input columns named like a result
are replaced.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchup.llm.common import read, staged, words
from matchup.llm.graph import small

#: Buckets that words are hashed into.
BUCKETS = 16_384
#: Smoothing: share of the expected count, and count, added to a bucket's count in a domain.
SMOOTH = (0.5, 3.0)
#: Labelled documents the classifier is trained on, about and at most 1.2 times (by a hash of doc_id).
MAX_LABELLED = 20_000
#: Weight of staying near one in ``fitted`` by default, and that of ``mixed``.
ANCHOR, LAST = 0.005, 1e-8
#: Gradient steps at most, those between two written tables, and the relative gap to a target that ends them.
STEPS, WRITTEN, TOLERANCE = 400, 8, 1e-5
#: Mean square move of the rates in a step that counts as standing still.
STILL = 1e-14
#: Share of all tokens that each domain shall have.
TARGETS = {"clean": 0.90, "low": 0.02, "toxic": 0.08}


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from the tables of labels: toxic before low quality before clean."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    return labels.select(F.col("doc_id").alias("__id"), domain.alias("domain")).dropna()


def counted(docs: DataFrame) -> DataFrame:
    """``docs`` with tokens and __h, the buckets of its words, each once."""
    w = docs.withColumn("__w", words(F.col("text")))
    return w.withColumn("tokens", F.size("__w").cast("long")).withColumn(
        "__h", F.array_distinct(F.transform("__w", lambda x: F.pmod(F.xxhash64(F.lower(x)), F.lit(BUCKETS)).cast("int")))
    ).drop("__w")


def trained(docs: DataFrame, labels: DataFrame, domains: list[str]) -> tuple[list[float], list[list[float]]]:
    """(log prior, log of each bucket's probability over that in all domains) by domain."""
    known = labels.where(F.col("domain").isin(domains))
    share = min(1.0, MAX_LABELLED / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    part = counted(docs.join(F.broadcast(sample), F.col("doc_id") == F.col("__id")))  # a bounded sample
    rows = part.select("domain", F.explode("__h").alias("h")).groupBy("domain", "h").count().collect()  # domains x buckets
    docs_of = {r[0]: r[1] for r in sample.groupBy("domain").count().collect()}
    seen = {(r[0], r[1]): r[2] for r in rows}
    priors = [math.log((docs_of.get(d, 0) + 1) / (sum(docs_of.values()) + len(domains))) for d in domains]
    if not docs_of:
        return priors, [[0.0] * BUCKETS for _ in domains]
    every = [sum(seen.get((d, h), 0) for d in domains) for h in range(BUCKETS)]
    smooth = [(c + 0.5) / (sum(every) + 0.5 * BUCKETS) for c in every]
    out = []
    for d in domains:
        total = sum(seen.get((d, h), 0) for h in range(BUCKETS))
        # Against the count to expect if domains didn't differ; small counts say little.
        expected = [total * x for x in smooth]
        out.append([math.log((seen.get((d, h), 0) + SMOOTH[0] * e + SMOOTH[1]) / ((1 + SMOOTH[0]) * e + SMOOTH[1])) for h, e in enumerate(expected)])
    return priors, out


def posteriors(counted_docs: DataFrame, domains: list[str], model: tuple[list[float], list[list[float]]]) -> DataFrame:
    """Adds p_<domain>: softmax of prior and word evidence, which grows with the root of the number of words."""
    priors, logs = model
    base = logs[0]

    def evidence(k: int) -> Column:
        table = F.lit([a - b for a, b in zip(logs[k], base, strict=True)])
        total = F.aggregate("__h", F.lit(0.0), lambda acc, h: acc + F.element_at(table, h + 1))
        return F.lit(priors[k] - priors[0]) + 2.0 * total / F.sqrt(F.greatest(F.size("__h"), F.lit(1)))

    scored = counted_docs.withColumn("__s0", F.lit(0.0)).withColumns({f"__s{k}": evidence(k) for k in range(1, len(domains))})
    top = F.greatest(*(F.col(f"__s{k}") for k in range(len(domains)))) if len(domains) > 1 else F.col("__s0")
    scored = scored.drop("__h").withColumn("__top", top)
    powers = [F.exp(F.col(f"__s{k}") - F.col("__top")) for k in range(len(domains))]
    return scored.withColumns({f"p_{d}": p / sum(powers[1:], powers[0]) for d, p in zip(domains, powers, strict=True)}).drop(
        "__top", *(f"__s{k}" for k in range(len(domains)))
    )


def fitted(table: DataFrame, targets: dict[str, float], steps: int = STEPS, anchor: float = ANCHOR) -> DataFrame:
    """``table`` (tokens, p_<domain>..., staged) with rate, by accelerated projected gradient on the rates."""
    p = [F.col(f"p_{d}").cast("double") for d in targets]
    k, goal = len(p), np.array(list(targets.values()), float)
    total = table.agg(F.sum("tokens")).first()[0]
    if not total:
        return table.withColumn("rate", F.lit(1.0))
    weight = F.col("tokens").cast("double") / F.lit(float(total))
    pairs = [F.sum(weight * p[i] * p[j]) for i in range(k) for j in range(i, k)]
    products = np.zeros((k, k))
    products[np.triu_indices(k)] = table.agg(*pairs).first()
    products += np.triu(products, 1).T
    curved = np.diag(products) > 0
    scale = np.where(curved, 1 / np.where(curved, np.diag(products), 1), 0.0)
    scale *= curved.sum() / scale.sum()
    bound = np.linalg.eigvalsh(np.sqrt(np.outer(scale, scale)) * products)[-1] + anchor

    state = table.withColumns({"rate": F.lit(1.0), "__was": F.lit(1.0)})
    rate, was = F.col("rate"), F.col("__was")
    shift, momentum, last = 1.0, 0.0, math.inf
    for t in range(steps + 1):
        ahead = rate + momentum * (rate - was)
        sums = [F.sum(weight * x * r) for r in (rate, ahead) for x in p]
        row = np.array(state.agg(*sums, F.sum(weight * (rate - was) ** 2), F.sum(weight * (rate - 1) ** 2)).first(), float)
        shares, gap = row[:k], row[k : 2 * k] - goal
        own = shares - goal
        if t == steps or (np.abs(own) <= TOLERANCE * np.maximum(goal, 1e-3)).all() or (t and row[-2] < STILL):
            break
        value = (scale * own * own).sum() / 2 + anchor * row[-1] / 2
        if value > last:
            shift, ahead, gap = 1.0, rate, own
        last = value
        slope = sum((x * float(g) for x, g in zip(p, scale * gap, strict=True)), anchor * (ahead - 1))
        state = state.withColumn("__new", F.greatest(F.lit(0.0), ahead - slope / float(bound)))
        state = state.withColumns({"__was": rate, "rate": F.col("__new")}).drop("__new")
        after = (1 + math.sqrt(1 + 4 * shift * shift)) / 2
        shift, momentum = after, (shift - 1) / after
        if t % WRITTEN == WRITTEN - 1:  # keeps the plan short
            state = staged(state, "rates")
    missed = {d: float(x) for d, x, w in zip(targets, shares, goal, strict=True) if abs(x - w) > 1e-3 * w}
    if missed and anchor < ANCHOR:
        warnings.warn(f"mixing: no rates reach all targets {targets}; shares that miss theirs: {missed}", stacklevel=2)
    return state.drop("__was")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float]) -> DataFrame:
    """(key, doc_id, tokens, p_<domain>..., rate, copies) per row of ``docs`` (doc_id, text); key = xxhash64(doc_id, text)."""
    domains = list(targets)
    model = trained(docs, labels, domains)
    rows = counted(docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text"))
    table = staged(posteriors(rows.drop("text"), domains, model), "posteriors")
    u = F.pmod(F.xxhash64("key", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return fitted(table, targets, anchor=LAST).withColumn("copies", F.floor(F.col("rate") + u).cast("int"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and copies of every document for the target domain weights."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return mixed(docs, domains_of(read(spark, sf_dir, "labels")), TARGETS).drop("key")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as many times as its copies say (none: it goes)."""
    found = mixed(docs.select("doc_id", "text"), domains_of(read(spark, sf_dir, "labels")), TARGETS)
    other = staged(found.where("copies <> 1").select(F.col("key").alias("__key"), F.col("copies").alias("__copies")).distinct(), "copies")
    out = docs.withColumn("__key", F.xxhash64("doc_id", "text")).join(small(other), "__key", "left")
    times = F.array_repeat(F.lit(0), F.coalesce("__copies", F.lit(1)))
    return out.withColumn("__again", F.explode(times)).select(*docs.columns)
