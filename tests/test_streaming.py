"""Incremental refresh stream: exactly-once over restarts, newest snapshot wins."""

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from matchup.session import scratch_path
from matchup.sources import catalog
from matchup.streaming import refresh

SCHEMA = StructType([
    StructField("id", LongType()), StructField("v", StringType()),
    StructField("season", IntegerType()), StructField("snapshot", LongType()),
])


def test_stream_refresh_restart(spark):
    p = refresh.paths(scratch_path(spark, "t-stream"))
    first = spark.createDataFrame([(1, "a", 2024), (2, "b", 2025)], "id long, v string, season int")
    refresh.land_snapshot(first, p["landing"], 1)
    assert refresh.run_refresh_stream(spark, p["landing"], p["store"], "games", SCHEMA, p["checkpoint"]) == 1
    # a later pull of season 2025 only
    refresh.land_snapshot(spark.createDataFrame([(3, "c", 2025)], "id long, v string, season int"), p["landing"], 2)
    assert refresh.run_refresh_stream(spark, p["landing"], p["store"], "games", SCHEMA, p["checkpoint"]) == 1
    got = sorted((r["id"], r["season"]) for r in catalog.scan(spark, p["store"], "games").collect())
    assert got == [(1, 2024), (3, 2025)]
    # nothing new: no batch, nothing rewritten
    assert refresh.run_refresh_stream(spark, p["landing"], p["store"], "games", SCHEMA, p["checkpoint"]) == 0


def test_latest_snapshot_within_one_batch(spark):
    batch = spark.createDataFrame(
        [(1, "x", 2024, 1), (2, "y", 2024, 2), (3, "z", 2025, 1)], "id long, v string, season int, snapshot long"
    )
    got = sorted(r["id"] for r in refresh.latest_snapshot(batch).collect())
    assert got == [2, 3]


def test_older_snapshot_landed_later_does_not_win(spark):
    p = refresh.paths(scratch_path(spark, "t-stream-order"))
    for snapshot, row in ((2, (1, "new", 2024)), (1, (2, "old", 2024))):
        refresh.land_snapshot(spark.createDataFrame([row], "id long, v string, season int"), p["landing"], snapshot)
        refresh.run_refresh_stream(spark, p["landing"], p["store"], "games", SCHEMA, p["checkpoint"])
    assert [r["v"] for r in catalog.scan(spark, p["store"], "games").collect()] == ["new"]
