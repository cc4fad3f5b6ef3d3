"""Micro-fixtures for filters, reshaping and enrichment (FIXTURES.md section 4)."""

from pyspark.sql import functions as F

from matchup.operators import clean, enrich, labels, reshape


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_not_completed_keeps_false_and_null(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, completed boolean")
    assert rows(clean.not_completed_rows(df, "completed"), "id") == [(2,), (3,)]
    assert rows(clean.completed_rows(df, "completed"), "id") == [(1,)]


def test_class_exclusion(spark):
    df = spark.createDataFrame([(1, "fbs"), (2, "FCS"), (3, "ii"), (4, "iii"), (5, None)], "id int, c string")
    assert rows(clean.exclude_classes(df, ["c"]), "id") == [(1,), (5,)]


def test_slate_filter(spark):
    df = spark.createDataFrame(
        [(1, 3, None, "fbs", "fbs"), (2, 3, True, "fbs", "fbs"), (3, 3, False, "fcs", "fbs"), (4, 2, False, "fbs", "fbs")],
        "id int, week int, completed boolean, hc string, ac string",
    )
    assert rows(clean.slate(df, "week", 3, "completed", ["hc", "ac"], "fbs"), "id") == [(1,)]


def test_pivot_first_skips_nulls(spark):
    df = spark.createDataFrame(
        [("k", "a", None, 1), ("k", "a", 2.0, 2), ("k", "a", 3.0, 3), (None, "a", 9.0, 0)],
        "key string, name string, value double, ord int",
    )
    out = reshape.pivot_first(df, ["key"], "name", "value", ["a", "b"], "ord").collect()
    assert len(out) == 1 and out[0]["a"] == 2.0 and out[0]["b"] is None


def _weekly(spark):
    return spark.createDataFrame([("T", 2026, 1, 5.0), ("T", 2026, 3, 7.0)], "team string, season int, week int, yards double")


def test_cumulate_fills_bye_weeks(spark):
    cum = reshape.cumulate(_weekly(spark), "team", "season", "week", ["yards"], 3)
    assert rows(cum, "week", "yards") == [(1, 5.0), (2, 5.0), (3, 12.0)]


def test_cumulate_starts_at_first_active_period_and_combines_duplicates(spark):
    df = spark.createDataFrame(
        [("T", 2026, 2, 1.0), ("T", 2026, 2, 2.0), ("T", 2026, 4, 1.0), ("T", 2026, 9, 5.0)],
        "team string, season int, week int, yards double",
    )
    cum = reshape.cumulate(df, "team", "season", "week", ["yards"], 5)
    assert rows(cum, "week", "yards") == [(2, 3.0), (3, 3.0), (4, 4.0), (5, 4.0)]


def _games(spark):
    return spark.createDataFrame(
        [(1, 2026, 1, "T", "U"), (2, 2026, 2, "T", "U"), (3, 2026, 3, "T", "U")],
        "id int, season int, week int, home string, away string",
    )


def test_point_in_time_join(spark):
    hist = reshape.cumulate(_weekly(spark), "team", "season", "week", ["yards"], 3)
    out = enrich.join_point_in_time(_games(spark), hist, "season", "week", {"home": "home", "away": "away"}, "team", ["yards"])
    assert rows(out, "id", "home_yards", "home_has_stats", "away_yards") == [
        (1, None, False, None), (2, 5.0, True, None), (3, 5.0, True, None)
    ]


def test_lagged_single_week_join(spark):
    out = enrich.join_point_in_time(_games(spark), _weekly(spark), "season", "week", {"home": "home"}, "team", ["yards"])
    assert rows(out, "id", "home_yards") == [(1, None), (2, 5.0), (3, None)]


def test_left_joins_never_drop_rows(spark):
    games = _games(spark)
    dim = spark.createDataFrame([(2026, "T", 1.0), (2026, "T", 2.0)], "season int, team string, talent double")
    out = enrich.join_sides(games, dim, "season", {"home": "home", "away": "away"}, "team", ["talent"])
    # duplicated dimension keys fan out exactly like an equi left join
    assert out.count() == 6
    unique = spark.createDataFrame([(2026, "T", 1.0)], "season int, team string, talent double")
    assert enrich.join_sides(games, unique, "season", {"home": "home"}, "team").count() == 3


def test_median_fill(spark):
    dim = spark.createDataFrame([(2026, t, v) for t, v in zip("ABCD", [1.0, 2.0, 3.0, 10.0])], "season int, team string, talent double")
    games = spark.createDataFrame([(1, 2026, "A", "Z"), (2, 2027, "A", "Z")], "id int, season int, home string, away string")
    j = enrich.join_sides(games, dim, "season", {"home": "home", "away": "away"}, "team", ["talent"])
    out = enrich.fill_group_median(j, dim, "season", "season", "talent", ["home_talent", "away_talent"])
    assert rows(out, "id", "home_talent", "away_talent") == [(1, 1.0, 2.5), (2, None, None)]


def test_targets(spark):
    df = spark.createDataFrame([(21, 14), (14, 14), (None, 7)], "h int, a int")
    got = set(tuple(r) for r in labels.add_targets(df, "h", "a").select("home_win", "point_differential").collect())
    assert got == {(1, 7.0), (0, 0.0), (None, None)}
    absent = labels.add_targets(df, "h", "missing")
    assert absent.where(F.col("home_win").isNotNull()).count() == 0


def test_flatten_struct(spark):
    df = spark.sql(
        "SELECT 1 AS id, named_struct('ppa', 0.1D, 'fieldPosition', named_struct('averageStart', 70.1D),"
        " 'name', 's', 'l', array(1)) AS o"
    )
    out = reshape.flatten_struct(df, "o", "o")
    assert out.columns == ["id", "o_ppa", "o_fieldPosition_averageStart"]
    assert tuple(out.first()) == (1, 0.1, 70.1)


def test_extract_paths_defaults(spark):
    df = spark.sql("SELECT named_struct('ppa', 0.3D, 'havoc', named_struct('total', 0.2D)) AS offense")
    out = reshape.extract_paths(df, "offense").first().asDict()
    assert out["offense_ppa"] == 0.3 and out["offense_havoc_total"] == 0.2
    assert out["offense_drives"] == 0.0 and out["offense_fieldPosition_avgStart"] == 0.0
    assert len(out) == 22


def test_dedupe_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id int, v string")
    b = spark.createDataFrame([(1, "y")], "id int, w string")
    j = a.join(b, a.id == b.id).withColumn("v_dup", F.lit(0))
    out = reshape.dedupe_columns(j)
    assert out.columns == ["id", "v", "w"]


def test_listed_zero_fill_rule():
    cols = clean.listed_zero_fill_columns()
    assert len(cols) == 177 and len(set(cols)) == 177
    assert "home_fieldGoalReturnTDOpponent" in cols and "home_fieldGoalReturnTD" not in cols
    assert "away_usage" in cols and "away_usageOpponent" not in cols


def test_clean_is_idempotent(spark):
    df = spark.createDataFrame(
        [(1, "fbs", None, None, "SEC", True, 1.0, None), (2, "fbs", 3.0, 2.0, None, None, 2.0, 0.4),
         (3, "FCS", 1.0, 1.0, "ACC", False, 3.0, 0.6)],
        "id int, homeClassification string, home_passAttempts double, offense_ppa double, "
        "home_conference string, neutralSite boolean, homePregameElo double, spread double",
    )
    pol = clean.CleaningPolicy(class_columns=["homeClassification"], essentials=["homePregameElo"], categorical=["home_conference"])
    once = clean.clean(df, pol)
    twice = clean.clean(once, pol)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    got = {r["id"]: r.asDict() for r in once.collect()}
    assert set(got) == {1, 2}
    assert got[1]["home_passAttempts"] == 0.0 and got[1]["offense_ppa"] == 0.0
    assert got[1]["spread"] is None  # keep-null market column
    assert got[1]["neutralSite"] == 1 and got[2]["neutralSite"] == 0
    assert got[2]["home_conference"] is None  # categorical NULL stays


def test_point_in_time_has_no_leakage(spark):
    """Changing a period-w fact never changes features of meetings in periods <= w."""
    facts = spark.createDataFrame(
        [("T", 2026, w, float(w)) for w in range(1, 6)] + [("U", 2026, w, 10.0 * w) for w in range(1, 6)],
        "team string, season int, week int, yards double",
    )
    games = spark.createDataFrame([(w, 2026, w, "T", "U") for w in range(1, 6)], "id int, season int, week int, home string, away string")

    def feats(f):
        hist = reshape.cumulate(f, "team", "season", "week", ["yards"], 5)
        return {r["id"]: (r["home_yards"], r["away_yards"]) for r in enrich.join_point_in_time(
            games, hist, "season", "week", {"home": "home", "away": "away"}, "team", ["yards"]).collect()}

    base = feats(facts)
    changed = feats(facts.withColumn("yards", F.when(F.col("week") == 3, F.lit(999.0)).otherwise(F.col("yards"))))
    for gid in (1, 2, 3):
        assert base[gid] == changed[gid]
    assert base[4] != changed[4]


def test_prefix_side(spark):
    df = spark.createDataFrame([(2026, "T", 1.0)], "year int, team string, ppa double")
    out = enrich.prefix_side(df, "home", ["year"], entity="team")
    assert out.columns == ["year", "homeTeam", "home_ppa"]
