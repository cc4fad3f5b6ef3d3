"""Enrichment joins of a meeting table.

A meeting row has a season, a period and one entity column per side (e.g.
``home`` and ``away``). Every join here is a LEFT join: no meeting is ever
dropped, and a right side with repeated keys fans out exactly as an equi
left join does. Right sides are small by construction (keyed by entity and
season, or by pair), so they go through ``bounded_broadcast``: broadcast only
after a row-count probe proves the bound, else a shuffle join with AQE.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchup.plans.physical import DEFAULT_BROADCAST_ROWS, bounded_broadcast, small_side


def prefix_side(df: DataFrame, side: str, keys: Sequence[str], entity: str | None = None) -> DataFrame:
    """Every non-key column becomes ``{side}_{name}``; the entity ``{side}Team``-style."""
    cols = []
    for c in df.columns:
        if c in keys:
            cols.append(F.col(c))
        elif entity is not None and c == entity:
            cols.append(F.col(c).alias(f"{side}{entity[:1].upper()}{entity[1:]}"))
        else:
            cols.append(F.col(c).alias(f"{side}_{c}"))
    return df.select(*cols)


def _prepare(right: DataFrame, keys: Sequence[str], payload: Sequence[str], max_rows: int) -> tuple[DataFrame, bool]:
    """Project the right side once and probe its size once, for every role."""
    cols = list(dict.fromkeys([*keys, *payload]))
    return small_side(right.select(*cols), max_rows)


def _side_join(
    events: DataFrame,
    right: tuple[DataFrame, bool],
    on: Sequence[tuple[object, str]],
    payload: Mapping[str, str],
    flag: str | None,
) -> DataFrame:
    """LEFT join ``right`` keyed by ``on`` = [(event expression, right column)]."""
    tag = "__r"
    frame, small = right
    r = frame.select(
        *[F.col(rc).alias(f"{tag}{i}") for i, (_, rc) in enumerate(on)],
        *[F.col(src).alias(dst) for src, dst in payload.items()],
        *([F.lit(True).alias(flag)] if flag else []),
    )
    if small:
        r = F.broadcast(r)
    cond = None
    for i, (ev, _) in enumerate(on):
        ev_col = F.col(ev) if isinstance(ev, str) else ev
        c = ev_col == F.col(f"{tag}{i}")
        cond = c if cond is None else cond & c
    out = events.join(r, cond, "left").drop(*[f"{tag}{i}" for i in range(len(on))])
    if flag:
        out = out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    return out


def join_point_in_time(
    events: DataFrame,
    history: DataFrame,
    season: str,
    period: str,
    sides: Mapping[str, str],
    entity: str,
    measures: Sequence[str],
    lag: int = 1,
    history_season: str | None = None,
    history_period: str | None = None,
    flag_name: str = "stats",
    max_rows: int = DEFAULT_BROADCAST_ROWS,
) -> DataFrame:
    """Attach each side's history as of ``period - lag`` in the same season.

    With a cumulative history (``cumulate``) this is "stats through the
    previous period"; with single-period facts it is "stats of exactly the
    previous period" (J2) and a side idle in that period gets NULL. The lag
    sits in the join condition (P9), so no helper column is materialised.
    Adds ``{side}_{measure}`` and a ``{side}_has_{flag_name}`` flag (V1).
    """
    hs = history_season or season
    hp = history_period or period
    right = _prepare(history, [hs, entity, hp], measures, max_rows)
    out = events
    for side, side_col in sides.items():
        out = _side_join(
            out,
            right,
            on=[(season, hs), (side_col, entity), (F.col(period) - F.lit(lag), hp)],
            payload={m: f"{side}_{m}" for m in measures},
            flag=f"{side}_has_{flag_name}",
        )
    return out


def join_sides(
    events: DataFrame,
    dim: DataFrame,
    season: str,
    sides: Mapping[str, str],
    entity: str,
    measures: Sequence[str] | None = None,
    dim_season: str | None = None,
    flag_name: str | None = None,
    max_rows: int = DEFAULT_BROADCAST_ROWS,
) -> DataFrame:
    """Per-side lookup on (season, entity); ``measures=None`` takes all non-keys."""
    ds = dim_season or season
    cols = measures if measures is not None else [c for c in dim.columns if c not in (ds, entity)]
    right = _prepare(dim, [ds, entity], cols, max_rows)
    out = events
    for side, side_col in sides.items():
        out = _side_join(
            out,
            right,
            on=[(season, ds), (side_col, entity)],
            payload={m: f"{side}_{m}" for m in cols},
            flag=f"{side}_has_{flag_name}" if flag_name else None,
        )
    return out


def join_pair(
    events: DataFrame,
    pairs: DataFrame,
    keys: Mapping[str, str],
    measures: Sequence[str],
    max_rows: int = DEFAULT_BROADCAST_ROWS,
) -> DataFrame:
    """Lookup on a multi-column pair key {event column: pair column}.

    Repeated pair keys fan out, as an equi left join does.
    """
    return _side_join(
        events,
        _prepare(pairs, list(keys.values()), measures, max_rows),
        on=list(keys.items()),
        payload={m: m for m in measures},
        flag=None,
    )


def group_median(dim: DataFrame, group: str, measure: str, out: str = "median") -> DataFrame:
    """A3: exact median of ``measure`` per group, over the whole dimension."""
    return dim.groupBy(group).agg(F.median(measure).alias(out))


def fill_group_median(
    df: DataFrame,
    dim: DataFrame,
    group: str,
    dim_group: str,
    measure: str,
    targets: Sequence[str],
    max_rows: int = DEFAULT_BROADCAST_ROWS,
) -> DataFrame:
    """NULLs in ``targets`` become that group's median of ``measure``.

    A group without any dimension row has no median and stays NULL.
    """
    med = group_median(dim, dim_group, measure, "__median").withColumnRenamed(dim_group, "__g")
    med = bounded_broadcast(med, max_rows)
    joined = df.join(med, F.col(group) == F.col("__g"), "left")
    return joined.withColumns({t: F.coalesce(F.col(t), F.col("__median")) for t in targets}).drop(
        "__g", "__median"
    )


def differential(df: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """side differential ``left - right``."""
    return df.withColumn(out, F.col(left) - F.col(right))


def coverage(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Non-null count and share per column after a left join (one pass)."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in columns:
        aggs.append(F.count(F.col(c)).alias(f"n_{c}"))
    grouped = df.groupBy(*by).agg(*aggs)
    return grouped.withColumns(
        {f"share_{c}": F.col(f"n_{c}") / F.col("n_rows") for c in columns}
    )
