"""Records of unknown shape (F15): JSON text flattened to numeric and boolean columns.

Two passes. ``leaf_paths`` discovers the shape: a level of ``variant_explode``
a step, of which only the distinct (path, kind) pairs reach the driver: as many
as the records have different keys, whatever their number. ``flatten_variant``
then reads every leaf as a column in one projection.

Leaves are numbers, booleans and JSON nulls; strings and lists are no features.
A path may be a leaf in some records and an object, a string or a list in
others: it is null there. Integers alone give ``bigint``, booleans alone
``boolean``, everything else ``double`` (booleans as 1 and 0). Null or broken
text and records that are no object have null in every column. Paths whose
joined names are equal share a column: the first that is not null, in path
order. Input columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that a plan is given at most; records with more keys than that are maps, not features.
MAX_PATHS = 5_000
LEAVES = {"int", "real", "bool", "null"}


def _kind(value: Column) -> Column:
    shape = F.schema_of_variant(value)
    return (
        F.when(shape.startswith("OBJECT<"), "object")
        .when(shape == "BIGINT", "int")
        .when(shape.startswith("DECIMAL") | shape.isin("DOUBLE", "FLOAT"), "real")
        .when(shape == "BOOLEAN", "bool")
        .when(shape == "VOID", "null")
        .otherwise("other")
    )


def leaf_paths(df: DataFrame, column: str, max_paths: int = MAX_PATHS) -> dict[tuple[str, ...], set[str]]:
    """The kinds of value seen at each path that is a leaf somewhere, by path."""
    spark = df.sparkSession
    level = df.select(F.try_parse_json(column).alias("v"), F.array().cast("array<string>").alias("path"))
    level = level.where(_kind(F.col("v")) == "object")
    found: dict[tuple[str, ...], set[str]] = {}
    while True:
        inside = spark.sql(
            "SELECT array_append(path, t.key) AS path, t.value AS v FROM {level}, LATERAL variant_explode(v) AS t", level=level
        ).withColumn("kind", _kind(F.col("v")))
        rows = inside.select("path", "kind").distinct().limit(6 * max_paths + 1).collect()
        for r in rows:
            found.setdefault(tuple(r["path"]), set()).add(r["kind"])
        if len(found) > max_paths:
            raise ValueError(f"{column}: records with more than {max_paths} different paths")
        if not any(r["kind"] == "object" for r in rows):
            return {p: k for p, k in found.items() if k & LEAVES}
        level = inside.where(F.col("kind") == "object").select("v", "path")


def _read(record: Column, path: tuple[str, ...], as_type: str) -> Column:
    if all(k and '"' not in k for k in path):
        return F.try_variant_get(record, "$" + "".join(f'["{k}"]' for k in path), as_type)
    for k in path:  # keys that a path can't spell
        record = record.try_cast("map<string,variant>")[F.lit(k)]
    return F.try_variant_get(record, "$", as_type)


def flatten_variant(df: DataFrame, column: str, prefix: str, sep: str = "_", max_paths: int = MAX_PATHS) -> DataFrame:
    """the JSON text ``column`` replaced by ``{prefix}_{path}`` columns, in the order of the paths."""
    paths = leaf_paths(df, column, max_paths)
    record, named = F.col("__record"), {}
    for path in sorted(paths):
        kinds = paths[path] & {"int", "real", "bool"}
        as_type = "bigint" if kinds == {"int"} else "boolean" if kinds == {"bool"} else "double"
        value = _read(record, path, as_type)
        if "other" in paths[path]:  # a string there is not read as a number
            value = F.when(_kind(_read(record, path, "variant")) != "other", value)
        named.setdefault(sep.join([prefix, *path]), []).append((as_type, value))
    out = []
    for name, values in named.items():
        as_type = values[0][0] if len({t for t, _ in values}) == 1 else "double"
        out.append(F.coalesce(*(v.cast(as_type) for _, v in values)).alias(name))
    kept = [F.col(f"`{c}`") for c in df.columns if c != column and c not in named]
    return df.withColumn("__record", F.try_parse_json(column)).select(*kept, *out)
