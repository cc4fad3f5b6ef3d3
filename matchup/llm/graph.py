"""Links and components at scale: shared by the near-duplicate operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from matchup.llm.common import staged

#: Rounds in which each group compares its members with so many of them only.
HUBS = (1, 16)
#: Bytes that may be broadcast, as ``measured`` counts them first.
BROADCAST_BYTES = 32_000_000


def measured(df: DataFrame) -> Column:
    """Bytes of a row of ``df``: 16, and 8 a fixed-width field, the length of a text, the elements of an array."""

    def width(c: Column, kind: DataType) -> Column:
        if isinstance(kind, ArrayType):
            inner = kind.elementType
            return 16 + F.coalesce(F.size(c), F.lit(0)) * (8 * len(inner.fields) + 8 if isinstance(inner, StructType) else 8)
        if isinstance(kind, StructType):
            return sum((width(c[f.name], f.dataType) for f in kind.fields), F.lit(16))
        return 16 + F.coalesce(F.octet_length(c), F.lit(0)) if isinstance(kind, (StringType, BinaryType)) else F.lit(8)

    return sum((width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16)).cast("long")


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (already staged) marked for broadcast if its rows take at most ``limit`` bytes; else joins shuffle."""
    return F.broadcast(df) if (df.agg(F.sum(measured(df)).alias("size")).first()["size"] or 0) <= limit else df


def scattered(edges: DataFrame) -> bool:
    """Whether ``edges`` (u, v) are not yet stars: a node has two upper ends, or one and lower ends as well."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionAll(edges.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return bool(ends.agg(F.max(F.col("up") + F.when(F.col("up") > 0, F.col("down")).otherwise(0)).alias("most")).first()["most"] not in (None, 0, 1))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); component is the smallest node reachable.

    Distributed union-find by alternating large-star and small-star steps:
    each is an aggregation and a join, so a hub with very many links is
    combined before the shuffle and split by skew handling. Loops vanish.
    """
    e = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while scattered(e):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(low.select("u", F.col("m").alias("v")))
        e = staged(small_star.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)


def shared(members: DataFrame) -> DataFrame:
    """The distinct rows of ``members`` (group, node, ...) whose group has other nodes too, staged.

    ``members`` may repeat rows; it is read twice.
    """
    ends = members.groupBy("group").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    many = staged(ends.where("lo <> hi").select("group"), "many")
    return staged(members.join(small(many), "group", "left_semi").dropDuplicates(["group", "node"]), "groups")


def live(groups: DataFrame, feasible: Callable[[str, str], Column]) -> DataFrame:
    """The rows of ``groups`` that have a feasible partner in their group, staged: no pair is made."""
    x, y = groups.alias("x"), groups.alias("y")
    same = (F.col("x.group") == F.col("y.group")) & (F.col("x.node") != F.col("y.node"))
    return staged(x.join(y, same & feasible("x", "y"), "left_semi"), "live")


def involved(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``sets`` (node, ...) that the pairs (a, b) need: the others are not shuffled."""
    ids = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    return sets.join(small(staged(ids, "involved")), "node", "left_semi")


def linked(
    groups: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    feasible: Callable[[str, str], Column] | None = None,
    hubs: tuple[int, ...] = HUBS,
    central: str | None = None,
) -> DataFrame | None:
    """(node, component) over all verified links between nodes that share a group; None without links.

    ``groups``: (group, node, ...), staged, a node once a group. ``verify``
    keeps the true links of a frame of pairs (a, b); ``feasible`` is a cheap
    necessary condition on two members (aliases). Which links exist decides
    the result, so pairs inside one component need no look: at first every
    member meets one hub a group, which joins a large group of copies in as many
    pairs as it has members (the hub is the member with the least ``central``
    value, if that column is named); then a few hubs meet the members of other
    components, which a single hub of a group of near copies misses; what then
    still lies in several components is compared in full, across components only.
    """
    comp = None
    for k in range(len(hubs) + 1):
        own = groups.withColumn("c", F.col("node")) if comp is None else (
            groups.join(small(comp), "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        )
        if k:
            mixed = own.groupBy("group").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("group")
            own = staged(own.join(mixed, "group", "left_semi"), "mixed")
            if own.isEmpty():
                break
        if k < len(hubs):
            order = F.xxhash64(F.col("node"), F.lit(k))
            if central and not k % 2:
                order = F.struct(F.col(central), order)
            slot = F.pmod(F.xxhash64(F.col("node"), F.lit(-1 - k)), F.lit(hubs[k])).alias("slot")
            hub = own.groupBy("group", slot).agg(F.min_by(F.struct(*own.drop("group").columns), order).alias("y"))
            x, y, differ = own.alias("x"), hub.select("group", "y.*").alias("y"), F.col("x.c") != F.col("y.c")
        else:
            x, y, differ = own.alias("x"), own.alias("y"), (F.col("x.node") < F.col("y.node")) & (F.col("x.c") != F.col("y.c"))
        if feasible is not None:
            differ = differ & feasible("x", "y")
        pairs = x.join(y, (F.col("x.group") == F.col("y.group")) & differ)
        pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        found = staged(verify(staged(pairs, "pairs")).select("a", "b"), "links")
        if found.isEmpty():
            continue
        links = found if comp is None else found.unionAll(comp.select("node", "component"))  # the stars so far stand for their links
        comp = staged(components(links), "components")
    return comp
