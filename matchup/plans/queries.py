"""Driver queries: each operator of the inventory run on the driver's tables.

Every callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole tables (no id subsets, no row caps; a limit only where top-k is the
feature). Computed columns are aliased to the names the oracle SQL uses, and
floating results are rounded the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchup.operators import enrich, labels, records, reshape
from matchup.plans import jobs
from matchup.plans import standins as st

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _r(c, digits=2):
    return scalar.round_half_away(F.col(c) if isinstance(c, str) else c, digits)


# --------------------------------------------------------------------------
# Flagship: long stats -> wide -> cumulative -> point-in-time dual join
# --------------------------------------------------------------------------
def history_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long stats -> wide (A1) -> cumulative through each period (A2)."""
    return jobs.history_cumulative(spark, sf_dir)


@query
def pit_dual_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each side's stats through period - 1, differential, targets."""
    m = st.meetings(spark, sf_dir).select(
        "order_key", "line", "season", "period", "home", "away", "home_points", "away_points"
    )
    hist = history_cumulative(spark, sf_dir)
    joined = enrich.join_point_in_time(
        m, hist, "season", "period", {"home": "home", "away": "away"}, "entity", st.STAT_NAMES, lag=1
    )
    joined = enrich.differential(joined, "home_urgent", "away_urgent", "urgent_differential")
    joined = labels.add_targets(joined, "home_points", "away_points")
    rounded = [f"{side}_{s}" for side in ("home", "away") for s in st.STAT_NAMES] + ["urgent_differential"]
    return joined.select(
        "order_key", "line", "season", "period", "home", "away",
        *[_r(c).alias(c) for c in rounded],
        "home_has_stats", "away_has_stats", "home_win", "point_differential",
    )


# --------------------------------------------------------------------------
# Sources and sinks
# --------------------------------------------------------------------------
from pyspark.sql import Window  # noqa: E402
from pyspark.sql.types import (  # noqa: E402
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from matchup.functions import display, scalar  # noqa: E402
from matchup.operators import calibrate, clean, contract, learn, metrics  # noqa: E402
import os  # noqa: E402
from matchup.plans import physical  # noqa: E402
from matchup.session import scratch_path  # noqa: E402
from matchup.sources import catalog, publish  # noqa: E402
from matchup.sources.tables import table  # noqa: E402

ORDERS_KIND = StructType(
    [
        StructField("o_orderkey", LongType()),
        StructField("o_custkey", LongType()),
        StructField("o_orderstatus", StringType()),
        StructField("o_totalprice", DoubleType()),
        StructField("o_orderdate", TimestampType()),
        StructField("o_orderpriority", StringType()),
        StructField("season", IntegerType()),
    ]
)
RANKINGS_KIND = StructType(
    [StructField("entity", IntegerType()), StructField("rank", IntegerType()), StructField("season", IntegerType())]
)


def _orders_kind(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("season", F.year("o_orderdate"))


def _ts_text(c):
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd HH:mm:ss")


@query
def season_scan(spark, sf_dir):
    """Season-partitioned store; pruned scan of one season, periods 1..6, tagged."""
    root = scratch_path(spark, "catalog")
    catalog.refresh(_orders_kind(spark, sf_dir), root, "orders")
    kinds = catalog.load(spark, root, ["orders", "rankings"], 1997, {"orders": ORDERS_KIND, "rankings": RANKINGS_KIND})
    orders = catalog.within_periods(kinds["orders"].withColumn("period", F.month("o_orderdate")), "period", 6)
    assert kinds["rankings"].isEmpty()  # absent kind -> typed empty frame
    return catalog.tag(orders, kind="orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "season", "period", "kind"
    )


@query
def season_bounds(spark, sf_dir):
    """Distinct seasons in order, with the table's min and max season."""
    seasons = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("season")).distinct()
    # The distinct-season table is bounded by the calendar: a global window is fine.
    whole = Window.partitionBy()
    return seasons.select(
        "season",
        F.row_number().over(Window.orderBy("season")).alias("season_rank"),
        F.min("season").over(whole).alias("min_season"),
        F.max("season").over(whole).alias("max_season"),
        F.count(F.lit(1)).over(whole).alias("n_seasons"),
    )


@query
def multi_season_union(spark, sf_dir):
    """Seasons 1996-1997 and 1998 with a drifted schema, unioned by name."""
    o = _orders_kind(spark, sf_dir)
    old = o.where(catalog.date_range_predicate(o, "o_orderdate", 1996, 1997)).select("o_orderkey", "season", "o_totalprice")
    new = o.where(catalog.date_range_predicate(o, "o_orderdate", 1998, 1998)).select(
        "o_orderkey", "season", "o_totalprice", "o_orderpriority"
    )
    return catalog.union_widen([old, new])


@query
def raw_ingest(spark, sf_dir):
    """Records landed as JSON lines, read back with an explicit schema."""
    landing = scratch_path(spark, "landing")
    table(spark, sf_dir, "orders").write.mode("overwrite").json(landing)
    schema = StructType([f for f in ORDERS_KIND.fields if f.name != "season"])
    got = catalog.ingest_records(spark, landing, schema)
    return got.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        _ts_text("o_orderdate").alias("o_orderdate"), "o_orderpriority",
    )


@query
def season_refresh(spark, sf_dir):
    """S3: replace season 1997 (now only status F rows); other seasons stay."""
    root = scratch_path(spark, "refresh")
    o = _orders_kind(spark, sf_dir)
    catalog.refresh(o, root, "orders")
    catalog.refresh(o.where((F.col("season") == 1997) & (F.col("o_orderstatus") == "F")), root, "orders")
    back = catalog.scan(spark, root, "orders", None, ORDERS_KIND)
    return back.select("o_orderkey", "season", "o_orderstatus")


@query
def empty_enrichment(spark, sf_dir):
    """Left join to an empty typed dimension: NULL columns, stable schema."""
    o = _orders_kind(spark, sf_dir)
    c = table(spark, sf_dir, "customer")
    games = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "season", F.col("c_nationkey").alias("home"))
    dim = catalog.empty_like(spark, StructType([
        StructField("season", IntegerType()), StructField("entity", IntegerType()), StructField("talent", DoubleType())
    ]))
    return enrich.join_sides(games, dim, "season", {"home": "home"}, "entity", ["talent"])


# --------------------------------------------------------------------------
# Projections, filters, predicates
# --------------------------------------------------------------------------
def _meetings3(spark, sf_dir):
    """Meetings with a three-valued completion flag (NULL for return flag N)."""
    m = st.meetings(spark, sf_dir)
    return m.withColumn("completed3", F.when(F.col("flag") != "N", F.col("completed")))


@query
def next_period(spark, sf_dir):
    """Per season, max completed period + 1, or 1 when none completed."""
    o = table(spark, sf_dir, "orders").select(
        F.year("o_orderdate").alias("season"),
        F.month("o_orderdate").alias("period"),
        (F.col("o_orderstatus") == "F").alias("completed"),
    )
    return o.groupBy("season").agg(
        F.coalesce(F.max(F.when(F.col("completed"), F.col("period"))) + 1, F.lit(1)).alias("next_period"),
        F.count_if(F.col("completed")).alias("n_completed"),
    )


@query
def resolve_target(spark, sf_dir):
    """Default target: the season of the latest date, and that season's next period."""
    o = table(spark, sf_dir, "orders")
    today = o.agg(F.max("o_orderdate").alias("today")).select(scalar.season_of_date("today").alias("season"))
    per_season = next_period(spark, sf_dir).select(F.col("season").alias("s"), "next_period")
    j = today.join(per_season, F.col("season") == F.col("s"), "left")
    return j.select("season", F.coalesce("next_period", F.lit(1)).alias("week"))


@query
def upcoming_filter(spark, sf_dir):
    """Slate of period 6: not completed (NULL kept), home class BUILDING."""
    m = _meetings3(spark, sf_dir)
    s = clean.slate(m, "period", 6, "completed3", ["home_segment"], "BUILDING")
    return s.select("order_key", "line", "season", "period", "completed3")


def _docs_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left")


@query
def labelled_filter(spark, sf_dir):
    """Keep rows whose four named columns are all non-null."""
    return clean.require_non_null(_docs_labels(spark, sf_dir), ["doc_id", "lang", "quality", "toxic"])


@query
def class_exclusion(spark, sf_dir):
    """P5: drop parts whose type or name contains a pattern, case-insensitive."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name")
    return clean.exclude_classes(p, ["p_type", "p_name"], ("promo", "economy", "sma"))


@query
def leakage_drop(spark, sf_dir):
    """Drop leakage / identifier columns that are present (absent ones ignored)."""
    m = st.meetings(spark, sf_dir).drop("start_ts")
    return clean.drop_present(m, ["home_points", "away_points", "completed", "startDate", "not_a_column"])


@query
def essential_drop(spark, sf_dir):
    """Drop rows with a NULL in a present essential column."""
    return clean.drop_null_essentials(_docs_labels(spark, sf_dir), ["doc_id", "quality", "toxic", "homeTeam"])


@query
def drop_audit(spark, sf_dir):
    """Rows before / after the essential drop, one pass."""
    return clean.essential_drop_audit(_docs_labels(spark, sf_dir), ["doc_id", "quality", "toxic", "homeTeam"])


@query
def column_dedupe(spark, sf_dir):
    """P10: a join that repeats a column name, plus a *_dup column; keep the first."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, sf_dir, "labels")
    joined = d.join(lab, d.doc_id == lab.doc_id, "left").withColumn("lang_dup", F.upper(d.lang))
    return reshape.dedupe_columns(joined)


# --------------------------------------------------------------------------
# Reshaping (A1, A2, W3) and enrichment
# --------------------------------------------------------------------------
EVENT_TYPES = ["view", "signup", "purchase", "error", "click"]


def _events_weekly(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    week = (F.floor(F.datediff(F.col("ts"), F.lit("2024-01-01")) / 7) + 1).cast("int")
    return e.withColumn("week", week).withColumn("season", F.year("ts"))


@query
def long_to_wide(spark, sf_dir):
    """A1: per (user, week) the first non-null value of each event type by time."""
    e = _events_weekly(spark, sf_dir)
    wide = reshape.pivot_first(e, ["user_id", "week"], "event_type", "value", EVENT_TYPES, "ts", tiebreak=["event_id"])
    return wide


@query
def cumulative_through_week(spark, sf_dir):
    """Per user running totals through each week up to the last of all (idle weeks included)."""
    e = _events_weekly(spark, sf_dir).withColumn("n_events", F.lit(1))
    last = e.agg(F.max("week").alias("week")).first()["week"] or 1
    cum = reshape.cumulate(e, "user_id", "season", "week", ["value", "n_events"], last)
    return cum.select("user_id", "season", "week", _r("value").alias("total_value"), F.col("n_events").cast("long").alias("n_events"))


def _history_wide(spark, sf_dir):
    return reshape.pivot_first(
        st.history_long(spark, sf_dir), ["entity", "season", "period"], "stat_name", "stat_value", st.STAT_NAMES, "ord"
    )


@query
def lag_week_join(spark, sf_dir):
    """Each side's facts of exactly period - 1 (an idle period gives NULL)."""
    m = st.meetings(spark, sf_dir).select("order_key", "line", "season", "period", "home", "away")
    j = enrich.join_point_in_time(
        m, _history_wide(spark, sf_dir), "season", "period", {"home": "home", "away": "away"}, "entity",
        ["urgent", "low"], lag=1, flag_name="week",
    )
    return j.select(
        "order_key", "line", _r("home_urgent").alias("home_urgent"), _r("home_low").alias("home_low"),
        _r("away_urgent").alias("away_urgent"), _r("away_low").alias("away_low"), "home_has_week", "away_has_week",
    )


def _meeting_keys(spark, sf_dir):
    return st.meetings(spark, sf_dir).select("order_key", "line", "season", "period", "home", "away")


@query
def dual_lookup(spark, sf_dir):
    """One measure per side on (season, entity), and its differential."""
    j = enrich.join_sides(_meeting_keys(spark, sf_dir), st.nation_season_dim(spark, sf_dir), "season",
                          {"home": "home", "away": "away"}, "entity", ["talent"])
    j = enrich.differential(j, "home_talent", "away_talent", "talent_differential")
    return j.select("order_key", "line", *[_r(c, 6).alias(c) for c in ("home_talent", "away_talent", "talent_differential")])


def _supplier_dim(spark, sf_dir):
    """(season, entity) -> every non-key column: supplier count and balance by nation,
    for the seasons in which the nation's suppliers shipped a line."""
    l = table(spark, sf_dir, "lineitem")
    s = table(spark, sf_dir, "supplier")
    return (
        l.join(s, l.l_suppkey == s.s_suppkey)
        .groupBy(F.year("l_shipdate").alias("season"), F.col("s_nationkey").alias("entity"))
        .agg(F.count_distinct("s_suppkey").alias("suppliers"), F.max("s_acctbal").alias("top_balance"))
    )


@query
def dual_lookup_all(spark, sf_dir):
    """Every non-key column of the dimension, prefixed per side."""
    j = enrich.join_sides(_meeting_keys(spark, sf_dir), _supplier_dim(spark, sf_dir), "season",
                          {"home": "home", "away": "away"}, "entity", None)
    return j.select("order_key", "line", "home_suppliers", "home_top_balance", "away_suppliers", "away_top_balance")


@query
def median_fill(spark, sf_dir):
    """Missing side measures take that season's median over the whole dimension."""
    dim = st.nation_season_dim(spark, sf_dir)
    j = enrich.join_sides(_meeting_keys(spark, sf_dir), dim, "season", {"home": "home", "away": "away"}, "entity", ["talent"])
    filled = enrich.fill_group_median(j, dim, "season", "season", "talent", ["home_talent", "away_talent"])
    return filled.select("order_key", "line", _r("home_talent", 6).alias("home_talent"), _r("away_talent", 6).alias("away_talent"))


def _pairs(spark, sf_dir):
    """(season, home, away) -> probability-like mean, for the keys that have a pair row."""
    m = st.meetings(spark, sf_dir)
    return (
        m.groupBy("season", "home", "away")
        .agg(F.count_if(F.col("discount") >= 0.05).alias("k"), F.count(F.lit(1)).alias("n"))
        .withColumn("p_home", F.col("k") / F.col("n"))
        .where(st.kept_pair("season", "home", "away"))
        .select("season", "home", "away", "p_home")
    )


def _pair_lookup(spark, sf_dir):
    m = _meeting_keys(spark, sf_dir)
    pairs = _pairs(spark, sf_dir).select(F.col("season").alias("ps"), F.col("home").alias("ph"), F.col("away").alias("pa"), "p_home")
    j = enrich.join_pair(m, pairs, {"season": "ps", "home": "ph", "away": "pa"}, ["p_home"])
    return j.withColumn("p_away", scalar.complement("p_home")).withColumn(
        "p_differential", F.col("p_home") - F.col("p_away")
    )


@query
def pair_lookup(spark, sf_dir):
    """Scalar lookup on (season, home, away); complement and its differential."""
    j = _pair_lookup(spark, sf_dir)
    return j.select("order_key", "line", *[_r(c, 6).alias(c) for c in ("p_home", "p_away", "p_differential")])


@query
def pair_lookup_nested(spark, sf_dir):
    """Pair lookup carrying a nested payload (array of provider lines); first line's spread."""
    m = st.meetings(spark, sf_dir)
    lines = (
        m.groupBy(F.col("season").alias("ps"), F.col("home").alias("ph"), F.col("away").alias("pa"))
        .agg(F.min("discount").alias("d_avg"), F.max("tax").alias("t_max"))
        .where(st.kept_pair("ps", "ph", "pa"))
        .select("ps", "ph", "pa", F.array(
            F.struct(F.lit("avg").alias("provider"), F.col("d_avg").alias("spread")),
            F.struct(F.lit("max").alias("provider"), F.col("t_max").alias("spread")),
        ).alias("lines"))
    )
    j = enrich.join_pair(_meeting_keys(spark, sf_dir), lines, {"season": "ps", "home": "ph", "away": "pa"}, ["lines"])
    return j.select("order_key", "line", _r(scalar.first_field("lines", "spread"), 6).alias("spread_line"),
                    F.size("lines").alias("n_lines"))


@query
def coverage(spark, sf_dir):
    """Per season, count and share of meetings the pair lookup covered."""
    cov = enrich.coverage(_pair_lookup(spark, sf_dir), ["p_home"], by=["season"])
    return cov.select("season", "n_rows", "n_p_home", _r("share_p_home", 6).alias("share_p_home"))


@query
def first_element(spark, sf_dir):
    """first element's field of a per-line array; empty or NULL array gives NULL."""
    l = table(spark, sf_dir, "lineitem")
    lines = F.filter(
        F.array(
            F.struct(F.lit("d").alias("provider"), F.col("l_discount").alias("spread")),
            F.struct(F.lit("t").alias("provider"), F.col("l_tax").alias("spread")),
        ),
        lambda x: x["spread"] >= 0.04,
    )
    arr = F.when(F.col("l_returnflag") != "N", lines)
    return l.select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"),
        scalar.first_field(arr, "spread").alias("spread_line"),
    )


def _event_record(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rec = F.struct(
        F.col("value").alias("value"),
        F.from_json("props", "k int").alias("props"),
        F.struct(F.col("event_type").alias("name"), F.col("user_id").alias("uid")).alias("who"),
        F.array(F.col("value")).alias("l"),
        (F.col("event_type") == "error").alias("is_error"),
    )
    return e.select("event_id", rec.alias("o"))


@query
def nested_flatten(spark, sf_dir):
    """numeric/boolean leaves to o_{path}; strings and lists dropped."""
    return reshape.flatten_struct(_event_record(spark, sf_dir), "o", "o")


def _mixed_records(spark, sf_dir):
    """JSON text whose shape depends on the event: a key is a number here, an object or a string there."""
    e = table(spark, sf_dir, "events")
    k, value, user = F.get_json_object("props", "$.k"), F.col("value").cast("string"), F.col("user_id").cast("string")
    fatal = F.when(F.col("value") > 100, "true").otherwise("false")
    text = (
        F.when(F.col("event_type") == "error", F.format_string('{"err": {"code": %s, "fatal": %s}, "v": "7"}', k, fatal))
        .when(F.col("event_type") == "view", F.format_string('{"v": %s, "who": {"uid": %s, "in": {"k": %s}}}', value, user, k))
        .when(F.col("event_type") == "click", F.format_string('{"who": %s, "tags": [1, 2], "v": null}', user))
        .when(F.col("event_type") == "signup", "[1]")
        .otherwise(F.col("props"))
    )
    return e.select("event_id", text.alias("o"))


@query
def nested_flatten_mixed(spark, sf_dir):
    """Records of unknown shape: paths discovered in a first pass, read as columns in a second."""
    return records.flatten_variant(_mixed_records(spark, sf_dir), "o", "o")


@query
def nested_extract(spark, sf_dir):
    """F16: fixed JSON paths with default 0 when the path is missing."""
    e = table(spark, sf_dir, "events").select("event_id", "props")
    return reshape.extract_paths(e, "props", [("k", "k"), ("missing", "missing"), ("a.b", "a_b")], default=0)


# --------------------------------------------------------------------------
# Scalar functions and fills
# --------------------------------------------------------------------------
@query
def target_derivation(spark, sf_dir):
    """home_win (tie = 0) and margin; NULL unless both scores known."""
    m = st.meetings(spark, sf_dir)
    return labels.add_targets(m, "home_points", "away_points").select("order_key", "line", "home_win", "point_differential")


@query
def safe_casts(spark, sf_dir):
    """Optional int/float/str, ISO-8601 text, boolean default."""
    e = table(spark, sf_dir, "events")
    flag = F.when(F.col("event_type") == "error", True).when(F.col("event_type") == "view", False)
    return e.select(
        "event_id",
        scalar.safe_int(F.get_json_object("props", "$.k")).alias("k_int"),
        scalar.safe_int(F.col("event_type")).alias("type_int"),
        scalar.safe_float("value").alias("value_f"),
        scalar.safe_str("user_id").alias("user_text"),
        scalar.iso_timestamp(F.date_trunc("second", F.col("ts"))).alias("ts_iso"),
        scalar.bool_default(flag).alias("is_error"),
    )


@query
def bool_to_int(spark, sf_dir):
    """booleans to 0/1 (NULL stays NULL)."""
    m = _meetings3(spark, sf_dir).select("order_key", "line", "completed", "completed3")
    return scalar.bool_to_int(m)


@query
def coerce_numeric(spark, sf_dir):
    """lenient numeric cast; unparsable -> 0 (feature) or row dropped (target)."""
    e = table(spark, sf_dir, "events")
    k_text = F.get_json_object("props", "$.k")
    out = e.select(
        "event_id",
        scalar.coerce_numeric(k_text).alias("k_num"),
        scalar.coerce_numeric(F.col("event_type")).alias("type_num"),
        scalar.coerce_numeric(F.concat(F.lit("1"), F.col("event_type")), fill=None).alias("target"),
    )
    return out.union(
        e.select("event_id", scalar.coerce_numeric(k_text).alias("k_num"), F.lit(0.0).alias("type_num"),
                 scalar.coerce_numeric(k_text, fill=None).alias("target"))
    ).where(F.col("target").isNotNull())


@query
def null_defaults(spark, sf_dir):
    """NULL defaults by type: numeric 0, string ''."""
    return scalar.null_defaults(_docs_labels(spark, sf_dir))


@query
def zero_fill_listed(spark, sf_dir):
    """listed columns (those present) NULL -> 0 on the flagship output."""
    pit = pit_dual_join(spark, sf_dir).select("order_key", "line", "home_urgent", "away_urgent", "home_low")
    return clean.zero_fill_listed(pit, ["home_urgent", "away_urgent", "not_present"])


@query
def zero_fill_pattern(spark, sf_dir):
    """numeric columns matched by name fragment NULL -> 0 (text untouched)."""
    return clean.zero_fill_pattern(_docs_labels(spark, sf_dir), ("qual", "tox", "lang"))


@query
def residual_fill(spark, sf_dir):
    """Numeric -> 0, text -> 'unknown'; categorical and keep-null untouched."""
    d = _docs_labels(spark, sf_dir).withColumn("source", F.when(F.col("quality").isNotNull(), F.col("source")))
    return clean.residual_fill(d, categorical=["lang"], keep_null=["toxic"], targets=[])


@query
def null_profile(spark, sf_dir):
    """NULL count per column in one aggregate, unpivoted."""
    d = _docs_labels(spark, sf_dir)
    counts = d.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in d.columns])
    stacked = counts.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in d.columns])).alias("kv")
    ).select("kv.*")
    return stacked.withColumn("needs_fill", F.col("n_null") > 0)


# --------------------------------------------------------------------------
# Contract: vocabulary, alignment, diff, audits
# --------------------------------------------------------------------------
def _customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "c_mktsegment", "n_name", "c_acctbal", "c_nationkey")


SHORT_VOCAB = {"c_mktsegment": ["AUTOMOBILE", "BUILDING", "FURNITURE"], "n_name": ["NATION_1", "NATION_2", "NATION_3"]}


def _short_contract():
    return contract.FeatureContract(
        feature_columns=["c_acctbal", "c_mktsegment", "missing_num", "missing_cat", "c_nationkey", "n_name"],
        categorical_features=["c_mktsegment", "missing_cat", "n_name"],
        categorical_values={**SHORT_VOCAB, "missing_cat": []},
        essential_features=["c_acctbal"],
    )


@query
def category_vocab(spark, sf_dir):
    """Sorted vocabulary of each categorical column, with the value index."""
    v = contract.vocabulary(_customers(spark, sf_dir), ["c_mktsegment", "n_name"])
    return v.withColumn("value_index", F.row_number().over(Window.partitionBy("column").orderBy("value")) - 1)


@query
def category_align(spark, sf_dir):
    """F8: values outside the (shortened) vocabulary become NULL."""
    c = _customers(spark, sf_dir)
    ctr = contract.FeatureContract(["c_mktsegment", "n_name"], ["c_mktsegment", "n_name"], SHORT_VOCAB)
    return contract.align(c, ctr, keep=["c_custkey"])


@query
def unseen_audit(spark, sf_dir):
    """Rows with unseen categories per column and the 5 smallest unseen values."""
    return contract.audit_unseen(_customers(spark, sf_dir), _short_contract())


@query
def schema_align(spark, sf_dir):
    """Contract order; missing numeric 0.0, missing categorical NULL."""
    return contract.align(_customers(spark, sf_dir), _short_contract(), keep=["c_custkey"])


@query
def schema_diff(spark, sf_dir):
    """Missing / extra / present columns against the contract, with non-null counts."""
    return contract.schema_diff(_customers(spark, sf_dir), _short_contract(), ignore=["c_custkey"])


# --------------------------------------------------------------------------
# Splits and metrics
# --------------------------------------------------------------------------
@query
def temporal_split(spark, sf_dir):
    """Train <= 1998, calib 1999, holdout 2000, production <= 2000; empty split raises."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("season"))
    s = labels.split_by_season(o, "season", 1998, 1999, 2000, prod_max=2000)
    labels.require_splits(labels.split_counts(s))
    return s


def _scored_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    n = F.col("n_chars").cast("double")
    return d.join(lab, "doc_id").withColumn("p", n / (n + F.lit(2000.0)))


@query
def binary_metrics(spark, sf_dir):
    """Accuracy, Brier, log-loss per language."""
    m = metrics.binary_metrics(_scored_docs(spark, sf_dir), "quality", "p", by=["lang"])
    return m.select("lang", "n", *[_r(c, 6).alias(c) for c in ("accuracy", "brier", "logloss")])


@query
def auc(spark, sf_dir):
    """Exact ROC AUC (ties count half) per language."""
    a = metrics.auc(_scored_docs(spark, sf_dir), "quality", "p", by=["lang"])
    return a.select("lang", _r("auc", 6).alias("auc"), "n_pos", "n_neg")


@query
def regression_metrics(spark, sf_dir):
    """MAE, RMSE, sign accuracy per return flag."""
    l = table(spark, sf_dir, "lineitem").select(
        "l_returnflag",
        (F.col("l_quantity") - 25).alias("y"),
        (F.col("l_discount") * 500 - 25).alias("pred"),
    )
    m = metrics.regression_metrics(l, "y", "pred", by=["l_returnflag"])
    return m.select("l_returnflag", "n", *[_r(c, 6).alias(c) for c in ("mae", "rmse", "sign_accuracy")])


@query
def isotonic_fit(spark, sf_dir):
    """M4: isotonic fit of quality on the score; fitted value at every distinct score."""
    docs = _scored_docs(spark, sf_dir)
    xs, ys = calibrate.fit_isotonic(docs, "p", "quality")
    distinct = docs.select(F.col("p").alias("score")).distinct()
    return calibrate.interpolate(distinct, "score", xs, ys, "fitted").select("score", _r("fitted", 6).alias("fitted"))


@query
def calibrate_interp(spark, sf_dir):
    """Knots fitted on the labelled documents applied to every document."""
    xs, ys = calibrate.fit_isotonic(_scored_docs(spark, sf_dir), "p", "quality")
    n = F.col("n_chars").cast("double")
    docs = table(spark, sf_dir, "documents").select("doc_id", (n / (n + F.lit(2000.0))).alias("p"))
    out = calibrate.apply_calibration(docs, "p", {"method": "isotonic", "X_thresholds": xs, "y_thresholds": ys}, "p_cal")
    return out.select("doc_id", "p", _r("p_cal", 6).alias("p_cal"))


@query
def calibration_decision(spark, sf_dir):
    """Fit on English documents; keep calibration only if holdout Brier does not worsen."""
    docs = _scored_docs(spark, sf_dir)
    xs, ys = calibrate.fit_isotonic(docs.where(F.col("lang") == "en"), "p", "quality")
    hold = calibrate.interpolate(docs.where(F.col("lang") != "en"), "p", xs, ys, "p_cal")
    raw = hold.select("quality", F.col("p").alias("prob"), F.lit("raw").alias("variant"))
    cal = hold.select("quality", F.col("p_cal").alias("prob"), F.lit("isotonic").alias("variant"))
    m = metrics.binary_metrics(raw.unionByName(cal), "quality", "prob", by=["variant"])
    d = metrics.calibration_decision(m)
    return d.select(_r("brier_raw", 6).alias("brier_raw"), _r("brier_calibrated", 6).alias("brier_calibrated"),
                    "ship_calibration", "method")


# --------------------------------------------------------------------------
# Scoring display and publishing
# --------------------------------------------------------------------------
def _slate(spark, sf_dir):
    m = st.meetings(spark, sf_dir)
    p = F.col("quantity") / F.lit(51.0)
    winner, conf = scalar.pick_winner(p, F.concat(F.lit("N"), F.col("home").cast("string")),
                                      F.concat(F.lit("N"), F.col("away").cast("string")))
    return m.select(
        "order_key", "line", "season", "period", "home", "away",
        p.alias("p"), winner.alias("predicted_winner"), conf.alias("conf"),
        "quantity",
        ((F.col("quantity") - 25.5) * 0.7).alias("margin"),
        F.when(F.col("flag") != "N", F.col("start_ts")).alias("kickoff_ts"),
        F.when(F.col("flag") != "R", F.col("home_segment")).alias("home_label"),
    )


@query
def pick_winner(spark, sf_dir):
    """Winner at p >= 0.5, confidence max(p, 1 - p), rounded 4 / margin 1."""
    s = _slate(spark, sf_dir)
    return s.select(
        "order_key", "line",
        scalar.round_half_up("p", 4).alias("home_win_probability"),
        "predicted_winner",
        scalar.round_half_up("conf", 4).alias("confidence"),
        scalar.round_half_up((F.col("quantity") - 25.5) / 2, 1).alias("predicted_margin"),
    )


@query
def slate_sort(spark, sf_dir):
    """Per week: kickoff ascending (unknown first), rounded confidence descending, id."""
    s = _slate(spark, sf_dir).withColumn("confidence", _r("conf", 4)).select(
        "season", "period", "order_key", "line", "kickoff_ts", "confidence"
    )
    order = [F.col("kickoff_ts").asc_nulls_first(), F.col("confidence").desc(), F.col("order_key"), F.col("line")]
    ranked = physical.position_within(s, ["season", "period"], order)
    return ranked.select(
        "season", "period", "order_key", "line", _ts_text("kickoff_ts").alias("kickoff"), "confidence", "position",
    )


@query
def display_columns(spark, sf_dir):
    """Percent pair, favourite, signed spread text, local kickoff, margin class."""
    s = _slate(spark, sf_dir)
    home, away, fav = display.percent_pair("p")
    return s.select(
        "order_key", "line", home.alias("home_pct"), away.alias("away_pct"), fav.alias("home_favored"),
        display.spread_text("margin").alias("away_spread"),
        display.kickoff_local("kickoff_ts").alias("kickoff"),
        display.margin_class("margin").alias("margin_class"),
        display.or_dash("home_label").alias("home_label"),
    )


@query
def season_of_date(spark, sf_dir):
    """month >= 8 belongs to its year's season, else the previous one."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", scalar.season_of_date("o_orderdate").alias("season"))


def _week_index(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week")).agg(
        F.count(F.lit(1)).alias("n_games"), F.max("o_orderdate").alias("last_ts")
    )


@query
def week_nav(spark, sf_dir):
    """Previous and next week across seasons."""
    return publish.with_neighbours(_week_index(spark, sf_dir))


@query
def weeks_by_season(spark, sf_dir):
    """Weeks per season (newest season first) and games per season."""
    return publish.weeks_by_season(_week_index(spark, sf_dir), count_col="n_games")


@query
def latest_run(spark, sf_dir):
    """The newest run by generated time."""
    runs = _week_index(spark, sf_dir).select("season", "week", _ts_text("last_ts").alias("generated_at"), "n_games")
    return publish.latest(runs)


def _games(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    p = F.col("o_totalprice") / (F.col("o_totalprice") + F.lit(150000.0))
    winner, conf = scalar.pick_winner(p, F.col("c_name"), F.col("n_name"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("o_orderkey").alias("id"),
        F.year("o_orderdate").alias("season"),
        F.month("o_orderdate").alias("week"),
        scalar.iso_timestamp("o_orderdate").alias("kickoff"),
        F.col("c_name").alias("home_team"),
        F.col("n_name").alias("away_team"),
        _r(p, 4).alias("home_win_probability"),
        winner.alias("predicted_winner"),
        _r(conf, 4).alias("confidence"),
    )


GAME_COLS = ["id", "kickoff", "home_team", "away_team", "home_win_probability", "predicted_winner", "confidence"]


@query
def publish_roundtrip(spark, sf_dir):
    """Publish every week's slate, read it back (partition discovery)."""
    root = scratch_path(spark, "publish")
    publish.publish(_games(spark, sf_dir), root, {"generated_at": "2026-12-01T00:00:00+00:00", "run_id": "r1"})
    back = publish.read_games(spark, root)
    return back.select(
        F.col("id").cast("long").alias("id"), F.col("season").cast("int").alias("season"),
        F.col("week").cast("int").alias("week"), *GAME_COLS[1:],
    )


@query
def published_week(spark, sf_dir):
    """Read one published week (partition-pruned), here season 1997 week 6."""
    root = scratch_path(spark, "publish-week")
    publish.publish(_games(spark, sf_dir), root, {"run_id": "r1"})
    week = publish.load_week(spark, root, 1997, 6)
    return week.select(F.col("id").cast("long").alias("id"), *GAME_COLS[1:])


@query
def publish_guard(spark, sf_dir):
    """Published weeks are not overwritten without force; empty slates write nothing."""
    root = scratch_path(spark, "guard")
    games = _games(spark, sf_dir)
    publish.publish(games.where(F.col("season") <= 1997), root, {"run_id": "r1"})
    publish.publish(games, root, {"run_id": "r2"})
    written = publish.publish(games.where(F.lit(False)), root, {"run_id": "r3"})
    assert written == 0
    runs = spark.read.json(os.path.join(root, "runs"))
    return runs.select(F.col("season").cast("int").alias("season"), F.col("week").cast("int").alias("week"),
                       "run_id", F.col("n_games").cast("long").alias("n_games"))


@query
def week_documents(spark, sf_dir):
    """Nested week documents of at most 1000 games a page, empty weeks included, written and read back."""
    root = scratch_path(spark, "documents")
    games = _games(spark, sf_dir)
    weeks = games.select("season").distinct().select("season", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("week"))
    order = [F.col("kickoff").asc_nulls_first(), F.col("confidence").desc(), F.col("id")]
    docs = publish.paged_documents(games, GAME_COLS, order, weeks=weeks, page=1000)
    publish.publish_documents(docs, root, {"generated_at": "2026-12-01T00:00:00+00:00"})
    back = publish.read_documents(spark, root)
    return back.select(
        F.col("season").cast("int").alias("season"), F.col("week").cast("int").alias("week"), F.col("page").cast("long").alias("page"),
        F.col("n_games").cast("long").alias("n_games"), "generated_at",
        F.array_join(F.col("games.id").cast("array<string>"), ",").alias("ids"),
        F.array_join(F.col("games.predicted_winner"), ",").alias("winners"),
    )


@query
def publish_widened(spark, sf_dir):
    """Runs with different columns share one merged schema; a narrower run keeps the columns of older weeks."""
    root = scratch_path(spark, "widened")
    games = _games(spark, sf_dir).select("id", "season", "week", "home_team", "confidence")
    publish.publish(games.where(F.col("season") <= 1997), root, {"run_id": "r1"})
    publish.publish(games.drop("confidence").withColumn("note", F.lit("late")), root, {"run_id": "r2"})
    back = publish.read_games(spark, root)
    keys = [F.col(c).cast(t).alias(c) for c, t in (("id", "long"), ("season", "int"), ("week", "int"))]
    return back.select(*keys, "home_team", "confidence", "note")


@query
def list_weeks(spark, sf_dir):
    """Published weeks from the folder layout, ordered, with their position."""
    root = scratch_path(spark, "weeks")
    publish.publish(_games(spark, sf_dir), root, {"run_id": "r1"})
    return publish.list_weeks(spark, root)


# --------------------------------------------------------------------------
# End-to-end jobs (E1-E9) and learning (M1-M11): the model queries have no
# SQL oracle (rows-only check); their bounds are unit-tested.
# --------------------------------------------------------------------------
_FD_ROUND2 = jobs.STAT_COLS
_FD_ROUND6 = ["home_talent", "away_talent", "talent_differential", "p_home", "p_away", "p_differential"]


def _rounded(df, keep):
    return df.select(
        *[_r(c).alias(c) if c in _FD_ROUND2 else _r(c, 6).alias(c) if c in _FD_ROUND6 else F.col(c) for c in keep]
    )


@query
def feature_dataset(spark, sf_dir):
    """Meetings + history through period-1 + median-filled dims + pair lookup + targets."""
    fd = jobs.feature_dataset(spark, sf_dir, shown=True)
    talents = {c: _r(c, 6) for c in ("home_talent", "away_talent", "talent_differential")}
    return fd.drop("start_ts").withColumns(talents)


@query
def training_matrix(spark, sf_dir):
    """Labelled rows, leakage dropped, class exclusion, cleaning; written by season."""
    tm = jobs.training_matrix(spark, sf_dir, scratch_path(spark, "matrix"))
    return _rounded(tm, tm.columns)


@query
def week_features(spark, sf_dir):
    """Features of one week's slate (season 2000, week 6), both sides of the top class, from its season alone."""
    wf = jobs.week_features(spark, sf_dir, 2000, 6)
    return _rounded(wf, ["order_key", "line", "season", "home", "away", *jobs.FEATURES])


def _trained(spark, sf_dir):
    return jobs.train(spark, sf_dir)


def _rounds(spark, run):
    rows = [(i + 1, float(v), i + 1 == run["best_iteration"]) for i, v in enumerate(run["losses"])]
    return spark.createDataFrame(rows, "round int, calib_loss double, is_best boolean")


@query
def gbt_winner(spark, sf_dir):
    """Winner classifier, per-round calibration loss, best round by patience."""
    return _rounds(spark, _trained(spark, sf_dir).winner)


@query
def gbt_margin(spark, sf_dir):
    """M3: margin regressor (absolute loss), per-round calibration loss, best round."""
    return _rounds(spark, _trained(spark, sf_dir).margin)


@query
def feature_importance(spark, sf_dir):
    """Top 10 features of the production winner model, numbered."""
    t = _trained(spark, sf_dir)
    return learn.importances(spark, t.winner_prod, jobs.FEATURES, top=10)


@query
def holdout_report(spark, sf_dir):
    """Holdout metrics by (model, variant)."""
    return _trained(spark, sf_dir).report


#: Trials of the registered sweep (the library's default is ``learn.TRIALS``, see README).
SWEEP_TRIALS = 6


@query
def search_leaderboard(spark, sf_dir):
    """Seeded random search; top 5 trials by calibration log-loss."""
    results, holdout = jobs.search(spark, sf_dir, SWEEP_TRIALS, parallelism=SWEEP_TRIALS)
    table_ = spark.createDataFrame(results)
    mean_s = F.avg("seconds").over(Window.partitionBy())
    ranked = table_.withColumn("seconds_per_trial", mean_s).withColumn(
        "rank", F.row_number().over(Window.orderBy("calib_logloss", "trial"))
    )
    out = ranked.where(F.col("rank") <= 5)
    out = out.withColumn("holdout_logloss", F.when(F.col("rank") == 1, F.lit(holdout)))
    out.coalesce(1).write.mode("overwrite").json(scratch_path(spark, "search-report"))  # S15
    return out.drop("seconds")


@query
def score_publish(spark, sf_dir):
    """Score not-completed meetings (keyed, not positional), calibrate, publish, read back."""
    t = _trained(spark, sf_dir)
    scored = jobs.score(spark, sf_dir, t)
    root = scratch_path(spark, "slates")
    publish.publish(scored, root, {"generated_at": "2026-12-01T00:00:00+00:00", **jobs.model_meta(t.contract)})
    return publish.read_games(spark, root)


@query
def predict_week(spark, sf_dir):
    """The weekly run: one slate (season 2000, week 6) scored, ordered, published."""
    t = _trained(spark, sf_dir)
    scored = jobs.score(spark, sf_dir, t, week=(2000, 6))
    root = scratch_path(spark, "week-run")
    publish.publish(scored, root, {"generated_at": "2026-12-01T00:00:00+00:00", **jobs.model_meta(t.contract)}, force=True)
    return publish.load_week(spark, root, 2000, 6)


@query
def model_report(spark, sf_dir):
    """The saved contract read back and shown for readers."""
    t = _trained(spark, sf_dir)
    ctr = contract.load_contract(spark, t.contract_path)
    h = ctr.honest_holdout_metrics
    rows = [(ctr.calibration.get("method"), float(h["calibrated"][k]), float(h["uncalibrated"][k]), k)
            for k in ("accuracy", "auc", "brier", "logloss")]
    df = spark.createDataFrame(rows, "method string, calibrated double, uncalibrated double, metric string")
    eff = display.effective_variant("method", "calibrated", "uncalibrated")
    return df.select(
        "metric", "method", eff.alias("value"),
        F.when(F.col("metric") == "accuracy", display.pct_label(eff)).otherwise(display.fixed_label(eff, 3)).alias("label"),
        display.all_finite(["calibrated", "uncalibrated"]).alias("valid"),
    )


# --------------------------------------------------------------------------
# Incremental refresh as a stream (S2 S3 with Structured Streaming)
# --------------------------------------------------------------------------
from matchup.streaming import refresh as stream_refresh_mod  # noqa: E402


@query
def stream_refresh(spark, sf_dir):
    """Landed snapshots ingested by an availableNow stream; newest snapshot per season wins."""
    p = stream_refresh_mod.paths(scratch_path(spark, "stream"))
    o = _orders_kind(spark, sf_dir).select("o_orderkey", "o_orderstatus", "season")
    stream_refresh_mod.land_snapshot(o, p["landing"], 1)
    stream_refresh_mod.land_snapshot(o.where((F.col("season") == 1997) & (F.col("o_orderstatus") == "F")), p["landing"], 2)
    schema = StructType([
        StructField("o_orderkey", LongType()), StructField("o_orderstatus", StringType()),
        StructField("season", IntegerType()), StructField("snapshot", LongType()),
    ])
    stream_refresh_mod.run_refresh_stream(spark, p["landing"], p["store"], "orders", schema, p["checkpoint"])
    back = catalog.scan(spark, p["store"], "orders")
    return back.select("o_orderkey", F.col("season").cast("int").alias("season"), "o_orderstatus")
