"""Season store, landing ingest and idempotent publishing."""

import os

import pytest
from pyspark.sql import functions as F

from matchup.session import scratch_path
from matchup.sources import catalog, publish


def _orders(spark):
    return spark.createDataFrame(
        [(1, 2024, 1, 10.0), (2, 2024, 2, 11.0), (3, 2025, 1, 12.0), (4, 2026, 1, 13.0)],
        "id long, season int, week int, v double",
    )


def test_refresh_replaces_only_its_season(spark):
    root = scratch_path(spark, "t-refresh")
    catalog.refresh(_orders(spark), root, "games")
    catalog.refresh(spark.createDataFrame([(9, 2025, 3, 1.0)], "id long, season int, week int, v double"), root, "games")
    got = sorted(r["id"] for r in catalog.scan(spark, root, "games").collect())
    assert got == [1, 2, 4, 9]
    assert [r["id"] for r in catalog.scan(spark, root, "games", (2025, 2025)).collect()] == [9]


def test_missing_kind_is_empty_and_unknown_kind_raises(spark):
    root = scratch_path(spark, "t-missing")
    schema = _orders(spark).schema
    assert catalog.scan(spark, root, "games", 2024, schema).count() == 0
    try:
        catalog.load(spark, root, ["nope"], 2024, {"games": schema})
    except KeyError:
        pass
    else:
        raise AssertionError("unknown kind accepted")


def test_landing_ingest_uses_schema(spark):
    landing = scratch_path(spark, "t-landing")
    local = landing[len("file:"):] if landing.startswith("file:") else landing
    os.makedirs(local)
    with open(os.path.join(local, "x.json"), "w") as f:
        f.write('{"id": 1, "season": 2024, "week": "2", "v": 1.5}\n{"id": 2, "season": 2024, "week": 3}\n')
    df = catalog.ingest_records(spark, landing, _orders(spark).schema)
    assert df.schema == _orders(spark).schema
    got = {r["id"]: (r["week"], r["v"]) for r in df.collect()}
    assert got[2] == (3, None)


def test_union_widen(spark):
    a = spark.createDataFrame([(1,)], "id int")
    b = spark.createDataFrame([(2, "x")], "id int, extra string")
    assert sorted(map(tuple, catalog.union_widen([a, b]).collect()), key=lambda t: t[0]) == [(1, None), (2, "x")]


def test_publish_is_idempotent_and_forced_overwrite(spark):
    root = scratch_path(spark, "t-publish")
    games = _orders(spark)
    assert publish.publish(games.where("season = 2024"), root, {"run_id": "r1"}) == 2
    assert publish.publish(games, root, {"run_id": "r2"}) == 2  # 2024 weeks skipped
    assert publish.publish(games.where(F.lit(False)), root, {"run_id": "r3"}) == 0
    runs = {(r["season"], r["week"]): r["run_id"] for r in spark.read.json(os.path.join(root, "runs")).collect()}
    assert runs == {(2024, 1): "r1", (2024, 2): "r1", (2025, 1): "r2", (2026, 1): "r2"}
    changed = games.where("season = 2024 AND week = 1").withColumn("v", F.lit(99.0))
    assert publish.publish(changed, root, {"run_id": "r4"}, force=True) == 1
    week = publish.load_week(spark, root, 2024, 1).collect()
    assert [r["v"] for r in week] == [99.0]
    assert publish.load_week(spark, root, 2024, 2).count() == 1
    assert publish.load_week(spark, root, 1990, 1).count() == 0
    weeks = [(r["season"], r["week"], r["position"]) for r in publish.list_weeks(spark, root).collect()]
    assert sorted(weeks) == [(2024, 1, 1), (2024, 2, 2), (2025, 1, 3), (2026, 1, 4)]


def test_week_documents_sorted(spark):
    games = spark.createDataFrame(
        [(2026, 1, 1, None, 0.6), (2026, 1, 2, "2026-08-29T16:00:00Z", 0.6), (2026, 1, 3, "2026-08-29T16:00:00Z", 0.9)],
        "season int, week int, id int, kickoff string, confidence double",
    )
    doc = publish.week_documents(
        games, ["id", "kickoff", "confidence"],
        [F.col("kickoff").isNotNull(), F.col("kickoff"), -F.col("confidence"), F.col("id")],
    ).first()
    assert [g["id"] for g in doc["games"]] == [1, 3, 2]


def test_latest_and_neighbours(spark):
    runs = spark.createDataFrame(
        [(2025, 14, "2025-12-01"), (2026, 1, "2026-08-30"), (2026, 2, "2026-09-06")],
        "season int, week int, generated_at string",
    )
    assert tuple(publish.latest(runs).first()) == (2026, 2, "2026-09-06")
    nav = {(r["season"], r["week"]): r for r in publish.with_neighbours(runs).collect()}
    assert (nav[(2026, 1)]["prev_season"], nav[(2026, 1)]["prev_week"]) == (2025, 14)
    assert nav[(2026, 2)]["next_week"] is None


def test_date_range_predicate_matches_season_of_date(spark):
    import datetime as dt

    from matchup.functions import scalar

    days = [dt.datetime(2025, 7, 31, 23, 59), dt.datetime(2025, 8, 1), dt.datetime(2026, 7, 31), dt.datetime(2026, 8, 1)]
    df = spark.createDataFrame([(d,) for d in days], "ts timestamp")
    got = df.where(catalog.date_range_predicate(df, "ts", 2025, 2025, first_month=8))
    assert sorted(r["ts"] for r in got.collect()) == days[1:3]
    both = df.withColumn("s", scalar.season_of_date("ts")).where(catalog.date_range_predicate(df, "ts", 2024, 2025, 8))
    assert all(2024 <= r["s"] <= 2025 for r in both.collect())


def test_list_weeks_ignores_non_numeric_folders(spark):
    root = scratch_path(spark, "t-weeks")
    publish.publish(_orders(spark), root, {"run_id": "r1"})
    local = root[len("file:"):] if root.startswith("file:") else root
    stray = os.path.join(local, "runs", "season=2026", "week=latest")
    os.makedirs(stray)
    with open(os.path.join(stray, "part-0.json"), "w") as f:
        f.write('{"n_games": 1, "run_id": "x"}\n')
    weeks = sorted((r["season"], r["week"]) for r in publish.list_weeks(spark, root).collect())
    assert weeks == [(2024, 1), (2024, 2), (2025, 1), (2026, 1)]


def test_a_narrower_publish_keeps_the_old_columns(spark):
    root = scratch_path(spark, "t-narrower")
    old = spark.createDataFrame([(1, 2025, 1, 1.5, "x")], "id int, season int, week int, v double, old string")
    assert publish.publish(old, root, {"run_id": "r1"}) == 1
    new = spark.createDataFrame([(2**40, 2025, 2, 7)], "id long, season int, week int, v int")
    assert publish.publish(new, root, {"run_id": "r2"}) == 1
    assert sorted((r["id"], r["v"], r["old"]) for r in publish.read_games(spark, root).collect()) == [(1, 1.5, "x"), (2**40, 7.0, None)]
    assert set(publish.load_week(spark, root, 1990, 1).columns) == {"id", "season", "week", "v", "old"}
    clash = spark.createDataFrame([(3, 2025, 3, True)], "id int, season int, week int, v boolean")
    with pytest.raises(ValueError, match="published column v"):
        publish.publish(clash, root, {"run_id": "r3"})
    assert publish.read_games(spark, root).count() == 2


def test_documents_page_a_hot_week_and_hold_empty_weeks(spark):
    root = scratch_path(spark, "t-documents")
    games = spark.range(25).select(F.lit(2025).alias("season"), F.when(F.col("id") < 23, 1).otherwise(3).alias("week"), (25 - F.col("id")).alias("id"))
    weeks = spark.createDataFrame([(2025, w) for w in (1, 2, 3)], "season int, week int")
    publish.publish_documents(publish.paged_documents(games, ["id"], [F.col("id")], weeks, page=10), root, {"run_id": "r1"})
    got = {(r["week"], r["page"]): (r["n_games"], [g["id"] for g in r["games"]], r["run_id"]) for r in publish.read_documents(spark, root).collect()}
    ids = list(range(3, 26))
    assert got == {(1, 0): (10, ids[:10], "r1"), (1, 1): (10, ids[10:20], "r1"), (1, 2): (3, ids[20:], "r1"), (2, 0): (0, [], "r1"), (3, 0): (2, [1, 2], "r1")}
    fresh = publish.paged_documents(games.where("week = 3 AND id = 2"), ["id"], [F.col("id")], page=10)
    publish.publish_documents(fresh, root, {"run_id": "r2"})
    assert [(r["run_id"], r["n_games"]) for r in publish.read_documents(spark, root, 2025, 3).collect()] == [("r2", 1)]
    assert publish.read_documents(spark, root, 2025, 1).count() == 3
    assert publish.read_documents(spark, scratch_path(spark, "t-none")).count() == 0
