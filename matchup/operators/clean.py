"""Row filters and the cleaning policy.

``clean`` applies the steps in a fixed order, each as one projection or one
filter (never a column-at-a-time loop of ``withColumn`` over hundreds of
columns, which would deepen the plan):

  class exclusion -> drop never-predictive columns -> listed zero-fill ->
  pattern zero-fill -> nested extraction -> bool to int -> essential-row drop
  -> residual fill -> numeric coercion of leftover text.

Which columns are categorical is decided by the contract (``contract.py``),
not by dtype discovery at run time.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from matchup.operators.reshape import RECORD_PATHS, extract_paths

# Box-score stats of a side, alphabetical.
BOX_SCORE_STATS = (
    "fieldGoalAttempts", "fieldGoalReturnTD", "fieldGoalReturnTDs", "fieldGoalReturnYards",
    "fieldGoalReturns", "firstDowns", "fourthDownConversions", "fourthDowns", "fumblesLost",
    "fumblesRecovered", "games", "interceptionTDs", "interceptionYards", "interceptions",
    "kickReturnTDs", "kickReturnYards", "kickReturns", "kicksPunted", "netPassingYards",
    "passAttempts", "passCompletions", "passesIntercepted", "passingTDs", "penalties",
    "penaltyYards", "possessionTime", "puntReturnTDs", "puntReturnYards", "puntReturns",
    "puntYards", "receivingUsage", "rushingAttempts", "rushingTDs", "rushingYards", "sackYards",
    "sacks", "safeties", "tacklesForLoss", "tacklesForLossYards", "thirdDownConversions",
    "thirdDowns", "totalYards", "turnovers", "twoPointConversionAttempts", "twoPointConversions",
    "usage",
)
# Stats listed only without, or only with, the "Opponent" form.
OWN_ONLY_STATS = ("fieldGoalReturnTDs", "receivingUsage", "usage")
OPPONENT_ONLY_STATS = ("fieldGoalReturnTD",)

# Lower-case name fragments of advanced-stat columns (pattern fill).
ADVANCED_STAT_PATTERNS = (
    "explosiveness", "efficiency", "fieldposition", "havoc", "punting", "returning",
    "rushing", "passing", "standarddowns", "passingdowns", "offense", "defense",
    "specialteams", "overall", "ppa", "successrate",
)
# Lower-case name fragments of categorical columns.
CATEGORICAL_PATTERNS = ("team", "conference", "division", "poll", "rank")
# Market columns whose NULL is kept (never zero-filled).
KEEP_NULL = ("homeWinProbability", "awayWinProbability", "win_probability_differential", "spread", "spread_line")
# Class fragments excluded case-insensitively (either side).
EXCLUDED_CLASS_PATTERNS = ("fcs", "iii", "ii")
# Columns dropped as never predictive, and complex columns.
NEVER_PREDICTIVE = ("attendance", "homeClassification", "awayClassification", "seasonType")
COMPLEX_COLUMNS = ("lines", "homeLineScores", "awayLineScores", "highlights")
# Identifier / leakage columns dropped before the transform.
LEAKAGE_COLUMNS = (
    "homePostgameWinProbability", "awayPostgameWinProbability", "id", "homeId", "awayId",
    "homeLineScores", "awayLineScores", "venueId", "completed", "startTimeTBD", "venue",
    "notes", "homePostgameElo", "awayPostgameElo", "startDate", "highlights", "homeTeam",
    "awayTeam", "homePoints", "awayPoints", "excitementIndex",
)
# Rows missing any of these (when present) are dropped.
ESSENTIAL_ROW_COLUMNS = ("season", "week", "homeTeam", "awayTeam", "homePregameElo", "awayPregameElo")
# Target columns, never filled.
TARGET_COLUMNS = ("homePoints", "awayPoints", "home_win", "point_differential")


def listed_zero_fill_columns(sides: Sequence[str] = ("home", "away")) -> list[str]:
    """F1 list: side x stat x {own, Opponent}, plus the through-period column."""
    out = ["stats_through_week"]
    for side in sides:
        for stat in BOX_SCORE_STATS:
            if stat not in OPPONENT_ONLY_STATS:
                out.append(f"{side}_{stat}")
            if stat not in OWN_ONLY_STATS:
                out.append(f"{side}_{stat}Opponent")
    return out


# ---------------------------------------------------------------------------
# Row filters
# ---------------------------------------------------------------------------
def completed_rows(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose flag is TRUE (NULL is not completed)."""
    return df.where(F.col(flag))


def not_completed_rows(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose flag is not TRUE (NULL is kept)."""
    return df.where(~F.col(flag).eqNullSafe(True))


def slate(df: DataFrame, period: str, value: int, flag: str, classes: Sequence[str], top_class: str) -> DataFrame:
    """One period, not completed, every side in the top class (pushdown-able)."""
    cond = (F.col(period) == value) & ~F.col(flag).eqNullSafe(True)
    for c in classes:
        cond = cond & (F.col(c) == top_class)
    return df.where(cond)


def require_non_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep rows where every listed column is non-null."""
    return df.dropna(subset=list(columns))


def exclude_classes(df: DataFrame, columns: Sequence[str], patterns: Sequence[str] = EXCLUDED_CLASS_PATTERNS) -> DataFrame:
    """P5: drop rows whose class (any listed column) contains a pattern, any case.

    NULL classes are kept (compared as the empty string).
    """
    rx = "(?i)(" + "|".join(re.escape(p) for p in patterns) + ")"
    cond = F.lit(True)
    for c in columns:
        cond = cond & ~F.coalesce(F.col(c), F.lit("")).rlike(rx)
    return df.where(cond)


def drop_present(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop the listed columns that exist (missing names are ignored)."""
    return df.drop(*[n for n in names if n in df.columns])


def drop_null_essentials(df: DataFrame, essentials: Sequence[str] = ESSENTIAL_ROW_COLUMNS) -> DataFrame:
    """Drop rows with a NULL in any present essential column."""
    present = [c for c in essentials if c in df.columns]
    return df.dropna(subset=present) if present else df


def essential_drop_audit(df: DataFrame, essentials: Sequence[str] = ESSENTIAL_ROW_COLUMNS) -> DataFrame:
    """Rows before and after the essential drop, in one pass (count_if)."""
    present = [c for c in essentials if c in df.columns]
    ok = F.lit(True)
    for c in present:
        ok = ok & F.col(c).isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(ok).alias("rows_after"),
    ).withColumn("rows_dropped", F.col("rows_before") - F.col("rows_after"))


# ---------------------------------------------------------------------------
# Fill planner
# ---------------------------------------------------------------------------
def _is_numeric(dtype) -> bool:
    return isinstance(dtype, NumericType)


def zero_fill_listed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """NULL -> 0 in the listed columns that are present."""
    present = set(n for n in names if n in df.columns)
    return df.select(
        *[F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)).alias(f.name)
          if f.name in present and _is_numeric(f.dataType) else F.col(f.name)
          for f in df.schema.fields]
    )


def pattern_columns(df: DataFrame, patterns: Sequence[str] = ADVANCED_STAT_PATTERNS, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns whose lower-cased name contains a pattern (V3: numeric only)."""
    skip = set(exclude)
    return [
        f.name for f in df.schema.fields
        if f.name not in skip and _is_numeric(f.dataType) and any(p in f.name.lower() for p in patterns)
    ]


def zero_fill_pattern(df: DataFrame, patterns: Sequence[str] = ADVANCED_STAT_PATTERNS, exclude: Iterable[str] = ()) -> DataFrame:
    """NULL -> 0 in numeric columns matched by name pattern."""
    return zero_fill_listed(df, pattern_columns(df, patterns, exclude))


def residual_fill(
    df: DataFrame,
    categorical: Iterable[str] = (),
    keep_null: Iterable[str] = KEEP_NULL,
    targets: Iterable[str] = TARGET_COLUMNS,
    text_default: str = "unknown",
) -> DataFrame:
    """numeric NULL -> 0, text NULL -> ``text_default``; categorical,
    keep-null and target columns untouched (V4: every numeric type counts)."""
    skip = set(categorical) | set(keep_null) | set(targets)
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name not in skip:
            if _is_numeric(f.dataType):
                c = F.coalesce(c, F.lit(0).cast(f.dataType))
            elif isinstance(f.dataType, StringType):
                c = F.coalesce(c, F.lit(text_default))
        out.append(c.alias(f.name))
    return df.select(*out)


def coerce_leftover_text(df: DataFrame, categorical: Iterable[str] = (), fill: float = 0.0) -> DataFrame:
    """F5 inside the policy: non-categorical text columns become numbers (else 0)."""
    cats = set(categorical)
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, StringType) and f.name not in cats:
            c = F.coalesce(c.try_cast("double"), F.lit(fill))
        out.append(c.alias(f.name))
    return df.select(*out)


def categorical_columns(df: DataFrame, patterns: Sequence[str] = CATEGORICAL_PATTERNS, all_strings: bool = True) -> list[str]:
    """string columns are categorical (all of them, or those matching a name pattern)."""
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, StringType)
        and (all_strings or any(p in f.name.lower() for p in patterns))
    ]


@dataclass
class CleaningPolicy:
    class_columns: Sequence[str] = ("homeClassification", "awayClassification")
    class_patterns: Sequence[str] = EXCLUDED_CLASS_PATTERNS
    drop_columns: Sequence[str] = NEVER_PREDICTIVE + COMPLEX_COLUMNS
    zero_fill: Sequence[str] = field(default_factory=listed_zero_fill_columns)
    zero_fill_patterns: Sequence[str] = ADVANCED_STAT_PATTERNS
    nested_columns: Sequence[str] = ("offense", "defense", "offense_advanced", "defense_advanced")
    essentials: Sequence[str] = ESSENTIAL_ROW_COLUMNS
    keep_null: Sequence[str] = KEEP_NULL
    targets: Sequence[str] = TARGET_COLUMNS
    categorical: Sequence[str] | None = None  # None: every string column


def clean(df: DataFrame, policy: CleaningPolicy | None = None) -> DataFrame:
    """The cleaning transform, steps in the fixed order (see module doc)."""
    p = policy or CleaningPolicy()
    present_classes = [c for c in p.class_columns if c in df.columns]
    if present_classes:
        df = exclude_classes(df, present_classes, p.class_patterns)
    df = drop_present(df, p.drop_columns)
    df = zero_fill_listed(df, p.zero_fill)
    df = zero_fill_pattern(df, p.zero_fill_patterns, exclude=p.keep_null)
    for col in p.nested_columns:
        if col in df.columns:
            df = extract_paths(df, col, RECORD_PATHS, default=0)
    df = df.select(*[F.col(f.name).cast("int").alias(f.name) if isinstance(f.dataType, BooleanType) else F.col(f.name)
                     for f in df.schema.fields])
    cats = list(p.categorical) if p.categorical is not None else categorical_columns(df)
    df = drop_null_essentials(df, p.essentials)
    df = residual_fill(df, categorical=cats, keep_null=p.keep_null, targets=p.targets)
    return coerce_leftover_text(df, categorical=cats)
