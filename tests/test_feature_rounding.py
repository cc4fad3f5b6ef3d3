"""The feature dataset's values are rounded in the small tables that the meetings look them up in."""

from matchup.plans import jobs, queries

SF = "/root/testdata/sf0.001"


def test_rounded_lookups_are_the_rounded_rows(spark):
    keys = ["order_key", "line"]
    shown = jobs.feature_dataset(spark, SF, shown=True)
    kept = [c for c in shown.columns if c not in ("start_ts", "home_talent", "away_talent", "talent_differential")]
    rows = queries._rounded(jobs.feature_dataset(spark, SF), kept)
    assert shown.select(kept).orderBy(*keys).collect() == rows.orderBy(*keys).collect()
