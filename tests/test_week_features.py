"""One week's slate and features: the rule on both sides, and what the scans read."""

import pytest
from pyspark.sql import functions as F

from matchup.plans import jobs
from matchup.plans import standins as st

SF = "/root/testdata/sf0.001"


def test_slate_asks_both_sides(spark):
    every = st.with_classes(spark, SF, st.meetings(spark, SF)).where("season = 2000 AND period = 6")
    want = every.where("NOT completed AND home_class = 'top' AND away_class = 'top' AND flag <> 'N'").count()
    assert 0 < want < every.where("NOT completed AND home_class = 'top' AND flag <> 'N'").count()
    assert jobs.week_slate(spark, SF, 2000, 6).count() == want


def test_features_equal_those_of_the_full_dataset(spark):
    cols = ["order_key", "line", *jobs.STAT_COLS, "home_talent", "away_talent"]
    week = jobs.week_features(spark, SF, 2000, 6).select(cols)
    keys = week.select("order_key", "line")
    full = jobs.clean_features(jobs.feature_dataset(spark, SF)).join(F.broadcast(keys), ["order_key", "line"], "left_semi").select(cols)
    a, b = (sorted(map(tuple, x.collect())) for x in (week, full))
    assert a and a == [pytest.approx(r, rel=1e-9) for r in b]


def test_every_scan_of_orders_is_pruned_by_date(spark, capsys):
    fd = st.nation_period_facts(spark, SF, 2000)
    jobs.week_slate(spark, SF, 2000, 6).explain("formatted")
    fd.explain("formatted")
    plan = capsys.readouterr().out
    scans = [s for s in plan.split("\n\n") if "Scan parquet" in s and "o_orderdate" in s]
    assert len(scans) == 2 and all("GreaterThanOrEqual(o_orderdate" in s and "LessThan(o_orderdate" in s for s in scans)


def test_a_week_without_open_meetings_is_empty(spark):
    assert jobs.week_features(spark, SF, 1900, 6).count() == 0
