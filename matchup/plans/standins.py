"""Stand-ins: the paired-entity shapes derived from the driver's TPC-H-like tables.

* meeting: one lineitem; home side = the customer's nation, away side = the
  supplier's nation; season = year of the order date, period = its month.
  A meeting is "completed" when the line status is F; only then it has
  points: home = quantity, rounded, + 3 a month of the season + 5 a letter that
  the segment's name is longer than 8 (so that the features known before tell
  something about the result); away = discount x 500, rounded.
* history: per (nation, season, month) revenue of the nation's customers'
  orders in long form, one row per order-priority class.
* dims: per (nation, season) measures from customers and suppliers.

These are plain DataFrame derivations; the oracle SQL in ``oracle.py``
restates each of them for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchup.functions.scalar import round_half_away
from matchup.plans.physical import bounded_broadcast
from matchup.sources.catalog import date_range_predicate
from matchup.sources.tables import table

# Order-priority classes and the stat name each becomes.
PRIORITY_STATS = {
    "1-URGENT": "urgent",
    "2-HIGH": "high",
    "3-MEDIUM": "medium",
    "4-NOT SPECIFIED": "unspecified",
    "5-LOW": "low",
}
STAT_NAMES = list(PRIORITY_STATS.values())
MAX_PERIOD = 12


def home_edge() -> Column:
    """Points that month and segment bring the home side."""
    return 3 * F.month("o_orderdate") + 5 * (F.length("c_mktsegment") - 8)


def kept_pair(season: str, home: str, away: str) -> Column:
    """Seven of eight (season, home, away) keys have a pair row, at every size of the tables."""
    return F.pmod(F.col(season) * 31 + F.col(home) * 7 + F.col(away), F.lit(8)) != 0


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    s = table(spark, sf_dir, "supplier")
    done = F.col("l_linestatus") == F.lit("F")
    # Join order matters at scale: orders meet customers first (the smaller
    # fact side), so the lineitem fact is shuffled at most twice (by order key,
    # then by supplier key) instead of three times.
    oc = o.join(c, o.o_custkey == c.c_custkey)
    return (
        l.join(oc, l.l_orderkey == oc.o_orderkey)
        .join(s, l.l_suppkey == s.s_suppkey)
        .select(
            F.col("l_orderkey").alias("order_key"),
            F.col("l_linenumber").alias("line"),
            F.year("o_orderdate").alias("season"),
            F.month("o_orderdate").alias("period"),
            F.col("c_nationkey").alias("home"),
            F.col("s_nationkey").alias("away"),
            done.alias("completed"),
            F.when(done, round_half_away(F.col("l_quantity"), 0).cast("int") + home_edge()).alias("home_points"),
            F.when(done, round_half_away(F.col("l_discount") * 500, 0).cast("int")).alias("away_points"),
            F.col("o_orderdate").alias("start_ts"),
            F.col("l_returnflag").alias("flag"),
            F.col("c_mktsegment").alias("home_segment"),
            F.col("o_orderpriority").alias("priority"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_discount").alias("discount"),
            F.col("l_tax").alias("tax"),
            F.col("l_extendedprice").alias("price"),
        )
    )


#: Class of a side that a week's slate asks of both sides, and the region outside it.
TOP_CLASS, OTHER_REGION = "top", 0


def with_classes(spark: SparkSession, sf_dir: str, m: DataFrame) -> DataFrame:
    """Adds home_class and away_class: ``TOP_CLASS`` for nations of every region but one."""
    n = table(spark, sf_dir, "nation")
    top = F.when(F.col("n_regionkey") != OTHER_REGION, TOP_CLASS).otherwise("other")
    side = bounded_broadcast(n.select(F.col("n_nationkey").alias("__nation"), top.alias("__class")))
    for role in ("home", "away"):
        m = m.join(side, F.col(role) == F.col("__nation"), "left").withColumnRenamed("__class", f"{role}_class").drop("__nation")
    return m


def nation_period_facts(spark: SparkSession, sf_dir: str, season: int | None = None) -> DataFrame:
    """One pass over orders x customers at the finest grain both the history and
    the season dimension need: (entity, season, period, stat_name) with the
    revenue, first order key, order count and top customer balance. Its size is
    bounded by nations x seasons x 12 x 5, so one probed, cached copy can feed
    both derived tables. ``season`` reads that season's orders only."""
    o = table(spark, sf_dir, "orders")
    if season is not None:
        o = o.where(date_range_predicate(o, "o_orderdate", season, season))
    c = table(spark, sf_dir, "customer")
    mapping = F.create_map(*[x for k, v in PRIORITY_STATS.items() for x in (F.lit(k), F.lit(v))])
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .groupBy(
            F.col("c_nationkey").alias("entity"),
            F.year("o_orderdate").alias("season"),
            F.month("o_orderdate").alias("period"),
            mapping[F.col("o_orderpriority")].alias("stat_name"),
        )
        .agg(
            F.sum("o_totalprice").alias("stat_value"),
            F.min("o_orderkey").alias("ord"),
            F.count(F.lit(1)).alias("n_orders"),
            F.max("c_acctbal").alias("top_balance"),
        )
    )


def history_long(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None) -> DataFrame:
    """Long facts (entity, season, period, stat_name, stat_value, ord)."""
    f = facts if facts is not None else nation_period_facts(spark, sf_dir)
    return f.select("entity", "season", "period", "stat_name", "stat_value", "ord")


def nation_season_dim(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None) -> DataFrame:
    """Per (nation, season) measure with gaps: the top balance of customers
    of that nation with an order in that season; one of eight (nation, season)
    keys is left out, at every size of the tables. (Exact measures keep the
    oracle comparison independent of summation order.)"""
    f = facts if facts is not None else nation_period_facts(spark, sf_dir)
    return (
        f.where(F.pmod(F.col("season") * 31 + F.col("entity"), F.lit(8)) != 0)
        .groupBy("season", "entity")
        .agg(F.max("top_balance").alias("talent"))
    )
