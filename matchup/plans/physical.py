"""Physical-plan helpers shared by the operators.

``bounded_broadcast`` is the only place a broadcast hint is added. It probes
the small side with ``limit(max_rows + 1).count()`` (reads at most that many
rows of the final result) and hints a broadcast only when the probe proves the
bound; otherwise the join stays a shuffle join and AQE decides at run time.
The probed side is persisted first so the probe and the join share one
computation when it is derived from a large table.
"""

from __future__ import annotations

from pyspark import StorageLevel
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows a broadcast side may hold. Dimension sides here are keyed by
# (entity, season[, period]) or by vocabulary value: thousands of rows.
DEFAULT_BROADCAST_ROWS = 2_000_000


def small_side(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS, persist: bool = True) -> tuple[DataFrame, bool]:
    """Probe ``df``; return (frame to join, whether it provably fits ``max_rows``).

    A small side comes back persisted, so several joins (e.g. the home and
    the away role of one dimension) share one computation of it.
    """
    probed = df.persist(StorageLevel.MEMORY_AND_DISK) if persist else df
    n = probed.limit(max_rows + 1).count()
    if n <= max_rows:
        return probed, True
    if persist:
        # Too big to broadcast: do not keep a large side cached either.
        probed.unpersist(blocking=False)
    return df, False


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS, persist: bool = True) -> DataFrame:
    """Broadcast ``df`` if it provably has at most ``max_rows`` rows."""
    side, small = small_side(df, max_rows, persist)
    return F.broadcast(side) if small else side


def spread(df: DataFrame) -> DataFrame:
    """The rows in a partition a core at least, where what follows costs far more a row than a shuffle (scoring by hundreds of trees)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared ``spark.checkpoint.dir`` (never local)."""
    return df.checkpoint(eager=True)


def write_layout(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row layout for a write partitioned by ``keys`` (the REBALANCE hint).

    One hash shuffle on the keys, so each task writes into few partition
    folders (files ~ folders, not tasks x folders); AQE then splits a skewed
    key over several tasks and merges small ones, by the advisory partition
    size. Unlike range partitioning it needs no sampling pass over the input.
    """
    return df.hint("rebalance", *keys)


def position_within(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    out: str = "position",
    partitions: int | None = None,
) -> DataFrame:
    """1-based position of each row inside its ``by`` group, by ``order``.

    A plain ``row_number`` window would put a whole group in one task; a hot
    group (a third of the rows) would then be one task. Instead:

    1. checkpoint the input to the shared folder, so the upstream plan is
       computed once (range partitioning samples its input in a pass of its
       own);
    2. range-partition on (by, order): the sampled bounds split a hot group
       across many balanced partitions, in order;
    3. checkpoint that layout with its partition id. The sampling is seeded
       per execution, so two executions may draw different bounds: the piece
       counts and the row numbers must come from one fixed layout, also
       after an executor loss;
    4. number rows inside each (partition, group) piece (bounded by the
       partition size), count the pieces (a table of at most
       partitions x groups-per-partition rows) and add, per piece, the rows
       of the same group in earlier partitions.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_cols = [F.col(b) for b in by]
    laid_out = reliable_checkpoint(
        reliable_checkpoint(df)
        .repartitionByRange(n, *by_cols, *order)
        .withColumn("_pid", F.spark_partition_id())
    )
    local = laid_out.withColumn("_local", F.row_number().over(Window.partitionBy("_pid", *by).orderBy(*order)))
    pieces = laid_out.groupBy("_pid", *by).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("_pid", *by, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    offsets = bounded_broadcast(offsets, persist=False)
    joined = local.join(offsets, ["_pid", *by])
    return joined.withColumn(out, (F.col("_off") + F.col("_local")).cast("long")).drop("_pid", "_local", "_off")
