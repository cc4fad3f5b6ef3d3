"""Incremental season refresh from a landing folder (S2 + S3 as a stream).

The batch refresh (``catalog.refresh``) replaces a season with a new pull of
that season. As a stream: every landed JSON file is a snapshot of one or more
seasons of a kind, tagged with a ``snapshot`` value that grows over time. A
file-source stream with an ``availableNow`` trigger picks up only files it
has not processed (its checkpoint in the shared folder gives exactly-once
across restarts and executor loss); each micro-batch keeps, per season, the
rows of its newest snapshot and replaces those seasons by dynamic partition
overwrite. The snapshot a season holds is kept beside the store, so an older
one that lands later does not win. Seasons not in the batch are untouched.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from matchup.sources import catalog


def latest_snapshot(batch: DataFrame, season_col: str = "season", snapshot_col: str = "snapshot") -> DataFrame:
    """Rows of the newest snapshot of each season in ``batch``."""
    newest = batch.groupBy(season_col).agg(F.max(snapshot_col).alias("__newest"))
    # One row per season in the batch: a calendar-bounded side.
    joined = batch.join(F.broadcast(newest), season_col)
    return joined.where(F.col(snapshot_col) == F.col("__newest")).drop("__newest", snapshot_col)


def run_refresh_stream(
    spark: SparkSession,
    landing: str,
    root: str,
    kind: str,
    schema: StructType,
    checkpoint: str,
    season_col: str = "season",
    snapshot_col: str = "snapshot",
) -> int:
    """Process every landed file not yet seen, then stop; returns batches run."""
    batches = []

    def upsert(batch: DataFrame, batch_id: int) -> None:
        # One row per season (and the same in the store's table): calendar-bounded.
        newest = dict(batch.groupBy(season_col).agg(F.max(snapshot_col)).collect())
        held_path = os.path.join(root, f"_snapshots_{kind}")
        try:
            held = {r["season"]: r["snapshot"] for r in spark.read.parquet(held_path).groupBy("season").agg(F.max("snapshot").alias("snapshot")).collect()}
        except AnalysisException:
            held = {}
        fresh = {s: n for s, n in newest.items() if n is not None and (held.get(s) is None or n >= held[s])}
        if not fresh:
            return
        rows = batch.where(F.col(season_col).isin(list(fresh)))
        catalog.refresh(latest_snapshot(rows, season_col, snapshot_col), root, kind, season_col)
        types = f"season {batch.schema[season_col].dataType.simpleString()}, snapshot {batch.schema[snapshot_col].dataType.simpleString()}"
        spark.createDataFrame(list(fresh.items()), types).coalesce(1).write.mode("append").parquet(held_path)
        batches.append(batch_id)

    query = (
        spark.readStream.schema(schema).json(landing)
        .writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return len(batches)


def land_snapshot(df: DataFrame, landing: str, snapshot: int | str) -> None:
    """Write one snapshot of records into the landing folder (JSON lines)."""
    df.withColumn("snapshot", F.lit(snapshot)).write.mode("append").json(landing)


def paths(base: str) -> dict[str, str]:
    return {k: os.path.join(base, k) for k in ("landing", "store", "checkpoint")}
