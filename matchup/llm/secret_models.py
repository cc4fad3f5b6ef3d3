"""Secret scans by character Markov models [native].

Base kinds are patterns. The method adds spans of kind ``model``: tokens of
``MIN_TOKEN`` or more characters whose log-likelihood ratio per character,
first-order character model of random strings against that of ordinary
identifiers, is over ``THRESHOLD`` and that no base span touches.

Training (``fit``) is one aggregation over labelled samples: character pairs
counted per label and smoothed by single characters, 128 x 128 log-ratios at most, which
travel inside the plan as one literal array (128 KB, whatever the corpus).
``labelled`` draws the samples from all documents: values that base patterns
caught are random strings, other long tokens ordinary identifiers.

Defined results: null text counts as empty; no samples or no documents give
a model of zeros (no added spans); ties cannot occur within a kind, spans
that start together stand in the order of ``KINDS``. Repeated rows stay.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchup.llm.common import read, staged

#: (kind, pattern, group whose length is judged, least length). Fixed by the contract.
BASE = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
]
KINDS = [*(k for k, *_ in BASE), "model"]
MIN_TOKEN = 16
TOKEN = r"[A-Za-z0-9+/_=-]+"
#: Nats a character by which the random model has to win.
THRESHOLD = 0.5
_SIZE = 128
_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"
_RUN = 256
#: Pseudo-pairs, spread as single characters are, behind each first character.
_BACK_OFF = 8


def spans(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Array of (start, kind, end, value) for the non-overlapping matches of ``pattern``.

    The pieces between matches and the matches themselves come from the same
    leftmost search, so running sums of their lengths (in code points) are the
    positions.
    """
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    step = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), found.alias("hit"), judged.alias("value"))

    def add(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(F.coalesce(x["hit"], F.lit("")))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        return F.struct(
            end.alias("at"),
            F.when(F.length(x["value"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"),
        )

    def shift(acc, part):
        moved = F.transform(part["out"], lambda s: F.struct(
            (s["start"] + acc["at"]).alias("start"), s["kind"], (s["end"] + acc["at"]).alias("end"), s["value"]))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    # Appending copies the array, so a text with very many matches is added up in runs of _RUN.
    none = F.array().cast(_SPANS)
    runs = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(found) / _RUN).cast("int")),
        lambda k: F.aggregate(F.slice(step, k * _RUN + 1, F.lit(_RUN)), F.struct(F.lit(0).alias("at"), none.alias("out")), add),
    )
    whole = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("out")), shift, lambda a: F.flatten(a["out"]))
    return F.when(F.size(found) > 0, whole).otherwise(none)


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with __t (text), __base (base spans, in order) and __long (other long tokens' spans).

    Hex runs and long tokens shorter than their least length cannot become
    spans, so their patterns ask for the length at once.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    parts = [spans(F.col("__t"), p if group else f"{p[:-1]}{{{least - (4 if k == 'access' else 0)},}}", group, least, i) for i, (k, p, group, least) in enumerate(BASE)]
    token = f"{TOKEN[:-1]}{{{MIN_TOKEN},}}"
    return (
        docs.withColumn("__t", t)
        .withColumn("__base", F.sort_array(F.concat(*parts)))
        .withColumn("__all", spans(F.col("__t"), token, 0, MIN_TOKEN, len(BASE)))
        .withColumn(
            "__long",
            F.filter("__all", lambda s: ~F.exists("__base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))),
        )
        .drop("__all", "__t")
    )


def labelled(scanned: DataFrame) -> DataFrame:
    """(value, random): base values are random strings, other long tokens are not."""
    return scanned.select(
        F.explode(F.concat(
            F.transform("__base", lambda s: F.struct(s["value"].alias("value"), F.lit(True).alias("random"))),
            F.transform("__long", lambda s: F.struct(s["value"].alias("value"), F.lit(False).alias("random"))),
        )).alias("s")
    ).select("s.value", "s.random")


def fit(samples: DataFrame) -> list[float]:
    """Log-ratios of the two first-order models, by 128 * first + second code; null values are skipped."""
    n = F.length("value")
    pairs = samples.where((n > 1) & F.col("random").isNotNull()).select(
        "random",
        F.explode(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring("value", i, F.lit(2)))).alias("pair"),
    )
    first, second = F.ascii("pair"), F.ascii(F.substring("pair", 2, 1))
    counts = pairs.groupBy(first.alias("a"), second.alias("b"), "random").count().where(f"a < {_SIZE} AND b < {_SIZE}").collect()
    seen = {(a, b, r): c for a, b, r, c in counts}
    codes = {c for a, b, _ in seen for c in (a, b)}
    total, single = defaultdict(int), defaultdict(int)
    for (a, b, r), c in seen.items():
        total[a, r] += c
        single[b, r] += c
    every = {r: sum(c for (_, z), c in single.items() if z == r) for r in (True, False)}

    def log_p(a: int, b: int, r: bool) -> float:
        alone = (single[b, r] + 0.5) / (every[r] + 0.5 * len(codes))
        return math.log((seen.get((a, b, r), 0) + _BACK_OFF * alone) / (total[a, r] + _BACK_OFF))

    return [
        log_p(a, b, True) - log_p(a, b, False) if a in codes and b in codes else 0.0
        for a in range(_SIZE)
        for b in range(_SIZE)
    ]


def ratio(value: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a token's character pairs (0 for fewer than two)."""
    table = F.lit(model) if model else F.array(F.lit(0.0))

    def pair(i):
        return F.element_at(table, F.ascii(F.substring(value, i, F.lit(1))) * _SIZE + F.ascii(F.substring(value, i + 1, F.lit(1))) + 1)

    n = F.length(value)
    total = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda acc, i: acc + F.coalesce(pair(i), F.lit(0.0)))
    return F.when(n > 1, total / (n - 1)).otherwise(0.0)


def found(scanned: DataFrame, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``base`` and ``spans``: arrays of (start, kind, end) in order, kinds by name."""

    def named(s):
        return F.struct(s["start"].alias("start"), F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"), s["end"].alias("end"))

    extra = F.filter("__long", lambda s: ratio(s["value"], model) > threshold)
    return (
        scanned.withColumn("spans", F.transform(F.sort_array(F.concat("__base", extra)), named))
        .withColumn("base", F.transform("__base", named))
        .drop("__base", "__long")
    )


def joined(spans_col: str) -> Column:
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_secret_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: base patterns and the spans the character models add."""
    scanned = staged(with_base(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "secrets")
    out = found(scanned, fit(labelled(scanned)))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select(
        "doc_id",
        *(count(k) for k, *_ in BASE),
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )
