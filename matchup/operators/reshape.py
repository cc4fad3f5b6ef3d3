"""Reshaping operators: long-to-wide, cumulative-through-period, nested records.

* ``pivot_first`` (A1): one row per key, one column per vocabulary value,
  holding the first non-null value by an order column. The vocabulary is
  explicit, so no job runs to discover it and the schema is fixed.
* ``cumulate`` (A2/W3): running totals per entity and season through every
  period, including periods with no fact ("bye" periods), starting at the
  entity's first active period and ending at ``max_period``.
* ``flatten_struct`` (F15/U2), ``extract_paths`` (F16): nested records to
  flat numeric columns in one projection.
* ``dedupe_columns`` (P10): keep the first of equally named columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    MapType,
    NumericType,
    StringType,
    StructType,
)


def pivot_first(
    df: DataFrame,
    keys: Sequence[str],
    name: str,
    value: str,
    vocab: Sequence[str] | Mapping[str, str],
    order: str,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """A1: first non-null ``value`` by ``order`` per key x ``name``.

    Rows with a NULL key are dropped (as a pandas pivot index does). The
    aggregation is partial (map-side) so a hot key is combined before the
    shuffle. ``vocab`` may map a value to an output column name. ``tiebreak``
    columns extend the order so that "first" is unique when ``order`` ties.
    """
    names = dict(vocab) if isinstance(vocab, Mapping) else {v: v for v in vocab}
    v, n = F.col(value), F.col(name)
    o = F.struct(F.col(order), *[F.col(t) for t in tiebreak]) if tiebreak else F.col(order)
    aggs = [
        # The ordering is NULL unless this row is of value ``k`` with a value:
        # min_by skips NULL orderings, so NULL values never win.
        F.min_by(v, F.when((n == F.lit(k)) & v.isNotNull(), o)).alias(out)
        for k, out in names.items()
    ]
    return df.dropna(subset=list(keys)).where(n.isin(list(names))).groupBy(*keys).agg(*aggs)


def cumulate(
    df: DataFrame,
    entity: str,
    season: str,
    period: str,
    measures: Sequence[str],
    max_period: int,
) -> DataFrame:
    """A2: running totals through each period, bye periods included.

    Plan: pre-aggregate per (entity, season, period) with map-side combine, so
    a group holds at most ``max_period`` rows however skewed the input is;
    one window pass per (entity, season) gives the running totals; each row
    is then repeated for the periods until the next active one (``explode``
    of a short sequence), which fills bye periods without a spine join.
    """
    per_period = (
        df.where(F.col(period) <= max_period)
        .groupBy(entity, season, period)
        .agg(*[F.sum(m).alias(m) for m in measures])
    )
    w = Window.partitionBy(entity, season).orderBy(period)
    running = per_period.select(
        entity,
        season,
        period,
        *[F.sum(m).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(m) for m in measures],
        F.coalesce(F.lead(period).over(w) - 1, F.lit(max_period)).alias("_until"),
    )
    return running.select(
        entity,
        season,
        F.explode(F.sequence(F.col(period), F.col("_until"))).alias(period),
        *measures,
    )


def _leaves(schema: StructType, path: tuple[str, ...] = ()):
    for field in schema.fields:
        here = path + (field.name,)
        dtype = field.dataType
        if isinstance(dtype, StructType):
            yield from _leaves(dtype, here)
        elif isinstance(dtype, (NumericType, BooleanType)):
            yield here
        elif isinstance(dtype, (StringType, ArrayType, MapType)):
            continue  # strings and lists are not features
        else:
            continue


def flatten_struct(df: DataFrame, column: str, prefix: str, sep: str = "_") -> DataFrame:
    """numeric and boolean leaves of a struct become ``{prefix}_{path}``.

    The struct column is replaced in one projection (horizontal concat, U2).
    """
    dtype = df.schema[column].dataType
    if not isinstance(dtype, StructType):
        raise TypeError(f"{column} is not a struct: {dtype.simpleString()}")
    flat = [
        F.col(column).getField(p[0]) if len(p) == 1 else _get(column, p)
        for p in _leaves(dtype)
    ]
    names = [prefix + sep + sep.join(p) for p in _leaves(dtype)]
    others = [F.col(c) for c in df.columns if c != column]
    return df.select(*others, *[c.alias(n) for c, n in zip(flat, names)])


def _get(column: str, path: Sequence[str]):
    c = F.col(column)
    for p in path:
        c = c.getField(p)
    return c


def _has_path(dtype, path: Sequence[str]) -> bool:
    for p in path:
        if not isinstance(dtype, StructType) or p not in dtype.fieldNames():
            return False
        dtype = dtype[p].dataType
    return True


# The scalar paths read from an offense/defense record, as
# (source path, output suffix). Flat keys first, then (parent, child) pairs.
RECORD_FLAT_KEYS = (
    "explosiveness", "ppa", "successRate", "drives", "plays", "lineYards",
    "stuffRate", "powerSuccess", "pointsPerOpportunity",
)
RECORD_NESTED_KEYS = (
    ("fieldPosition.averagePredictedPoints", "fieldPosition_avgPredictedPoints"),
    ("fieldPosition.averageStart", "fieldPosition_avgStart"),
    ("havoc.total", "havoc_total"),
    ("havoc.db", "havoc_db"),
    ("havoc.frontSeven", "havoc_frontSeven"),
    ("rushingPlays.ppa", "rushingPlays_ppa"),
    ("rushingPlays.successRate", "rushingPlays_successRate"),
    ("passingPlays.ppa", "passingPlays_ppa"),
    ("passingPlays.successRate", "passingPlays_successRate"),
    ("standardDowns.ppa", "standardDowns_ppa"),
    ("standardDowns.successRate", "standardDowns_successRate"),
    ("passingDowns.ppa", "passingDowns_ppa"),
    ("passingDowns.successRate", "passingDowns_successRate"),
)
RECORD_PATHS = tuple((k, k) for k in RECORD_FLAT_KEYS) + RECORD_NESTED_KEYS


def extract_paths(
    df: DataFrame,
    column: str,
    paths: Sequence[tuple[str, str]] = RECORD_PATHS,
    default: float = 0,
    drop: bool = True,
) -> DataFrame:
    """F16: fixed dotted paths to ``{column}_{suffix}``; missing gives ``default``.

    Works on a struct column (paths resolved against the schema, an absent
    path is the default) or on a JSON string column (``get_json_object``).
    """
    dtype = df.schema[column].dataType
    out = []
    for path, suffix in paths:
        parts = path.split(".")
        if isinstance(dtype, StringType):
            value = F.get_json_object(F.col(column), "$." + path).cast("double")
        elif _has_path(dtype, parts):
            value = _get(column, parts).cast("double")
        else:
            value = F.lit(None).cast("double")
        out.append(F.coalesce(value, F.lit(float(default))).alias(f"{column}_{suffix}"))
    keep = [F.col(c) for c in df.columns if not (drop and c == column)]
    return df.select(*keep, *out)


def dedupe_columns(df: DataFrame, drop_suffix: str | None = "_dup") -> DataFrame:
    """P10: keep the first column of each name; drop ``*_dup`` collision columns."""
    names = df.columns
    tmp = [f"__c{i}" for i in range(len(names))]
    seen: set[str] = set()
    keep = []
    for i, n in enumerate(names):
        if n in seen or (drop_suffix and n.endswith(drop_suffix)):
            continue
        seen.add(n)
        keep.append(F.col(tmp[i]).alias(n))
    return df.toDF(*tmp).select(*keep)
