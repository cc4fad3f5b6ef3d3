"""Season-partitioned storage of the source kinds.

Layout: ``{root}/{kind}/season=YYYY/part-*.parquet``. A season scan is a
partition-pruned read; a refresh replaces only the partitions present in the
new data (dynamic partition overwrite); raw records arrive as JSON lines in a
landing folder and are read with an explicit schema (no inference).
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from matchup.plans.physical import write_layout

Seasons = int | Sequence[int] | tuple[int, int] | None


def season_predicate(column: str, seasons: Seasons):
    """Predicate on the partition column: one season, an inclusive range, a list."""
    c = F.col(column)
    if seasons is None:
        return F.lit(True)
    if isinstance(seasons, int):
        return c == seasons
    if isinstance(seasons, tuple) and len(seasons) == 2:
        return c.between(seasons[0], seasons[1])
    return c.isin(list(seasons))


def date_range_predicate(df: DataFrame, column: str, first_season: int, last_season: int, first_month: int = 1):
    """Seasons ``first..last`` as a range on the raw date/time column.

    ``year(col) BETWEEN a AND b`` cannot reach the parquet scan; the equivalent
    ``col >= start(a) AND col < start(b + 1)`` can (row-group statistics skip
    data). A season starts on the first day of ``first_month``.
    """
    dtype = df.schema[column].dataType.typeName()
    to = {"timestamp_ntz": F.to_timestamp_ntz, "timestamp": F.to_timestamp, "date": F.to_date}[dtype]
    lo = to(F.lit(f"{first_season:04d}-{first_month:02d}-01 00:00:00" if dtype != "date" else f"{first_season:04d}-{first_month:02d}-01"))
    hi = to(F.lit(f"{last_season + 1:04d}-{first_month:02d}-01 00:00:00" if dtype != "date" else f"{last_season + 1:04d}-{first_month:02d}-01"))
    return (F.col(column) >= lo) & (F.col(column) < hi)


def empty_like(spark: SparkSession, schema: StructType) -> DataFrame:
    """Typed empty DataFrame: joins against it yield NULL columns, never errors."""
    return spark.createDataFrame([], schema)


def scan(
    spark: SparkSession,
    root: str,
    kind: str,
    seasons: Seasons = None,
    schema: StructType | None = None,
    season_col: str = "season",
) -> DataFrame:
    """Read one kind, pruned to ``seasons``; a missing kind is empty."""
    path = os.path.join(root, kind)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    try:
        df = reader.parquet(path)
    except AnalysisException:
        if schema is None:
            raise
        return empty_like(spark, schema)
    return df.where(season_predicate(season_col, seasons))


def load(
    spark: SparkSession,
    root: str,
    kinds: Iterable[str],
    seasons: Seasons,
    schemas: dict[str, StructType],
) -> dict[str, DataFrame]:
    """Several kinds at once. Unknown kinds raise; absent data is empty."""
    out = {}
    for kind in kinds:
        if kind not in schemas:
            raise KeyError(f"unknown kind {kind!r}; known: {sorted(schemas)}")
        out[kind] = scan(spark, root, kind, seasons, schemas[kind])
    return out


def refresh(df: DataFrame, root: str, kind: str, season_col: str = "season") -> None:
    """S3: replace the seasons present in ``df``; other seasons stay as they are."""
    (
        write_layout(df, [season_col]).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(season_col)
        .parquet(os.path.join(root, kind))
    )


def ingest_records(spark: SparkSession, landing: str, schema: StructType) -> DataFrame:
    """Raw records (JSON lines) to a typed table; the schema is explicit."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(landing)


def within_periods(df: DataFrame, period_col: str, max_period: int, first_period: int = 1) -> DataFrame:
    """The per-period pulls of one season become one range predicate."""
    return df.where(F.col(period_col).between(first_period, max_period))


def union_widen(frames: Sequence[DataFrame]) -> DataFrame:
    """Union all by name; columns missing on one side become NULL."""
    if not frames:
        raise ValueError("union_widen needs at least one frame")
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def tag(df: DataFrame, **values) -> DataFrame:
    """Constant tag columns in one projection."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})
