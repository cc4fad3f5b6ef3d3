"""Small helpers the operators share: reading tables, staging, text columns."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchup.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Word separators of the word-based contracts: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor rereads the files) and keeps columns
    compressed, which ``checkpoint()`` does not.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """``staged`` with a folder for each value of ``key``, read back as a string, '' as null."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"
    df.write.partitionBy(key).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def folded(c: Column) -> Column:
    """``ascii_lower``, by the much faster ``lower`` for values of ASCII characters alone."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(ascii_lower(c))


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def values(spark: SparkSession, schema: str, rows: Sequence[Sequence]) -> DataFrame:
    """A small literal table as a local relation (its exact size is known to the planner)."""

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        if isinstance(v, (list, tuple)):
            return f"array({', '.join(map(lit, v))})"
        return f"{v!r}D" if isinstance(v, float) else repr(v)

    names = [f.split()[0] for f in schema.split(",")]
    if not rows:
        return spark.createDataFrame([], schema)
    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    df = spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")
    return df.select(*(F.col(n).cast(f.split(None, 1)[1]).alias(n) for n, f in zip(names, schema.split(","), strict=True)))


def drop_clashes(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns (in any case) that an operator's own columns replace."""
    own = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in own))
