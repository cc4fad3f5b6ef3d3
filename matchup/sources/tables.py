"""Reading the driver's parquet tables (one file per table in a folder)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """Lazy scan of ``{sf_dir}/{name}.parquet``; Catalyst prunes the columns.

    ``spread``: a file that is a single row group scans as one task whatever
    its size; with ``spread`` the rows are redistributed round-robin when the
    scan has fewer input partitions than the cluster has cores (never the
    case on large inputs). Off by default: it costs a shuffle and measured no
    gain on the driver's tables.
    """
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    path = os.path.join(sf_dir, f"{name}.parquet")
    schema = _SCHEMAS.get(path)
    if schema is None:
        # Inferring a parquet schema runs a job; do it once per path.
        schema = spark.read.parquet(path).schema
        _SCHEMAS[path] = schema
    df = spark.read.schema(schema).parquet(path)
    if spread:
        cores = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < cores:
            df = df.repartition(cores)
    return df
