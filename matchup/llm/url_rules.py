"""URL filters by hashed host-suffix / path-prefix expressions [native].

A URL is expanded into expressions ``host suffix + path prefix``. Only the
shapes (number of host labels, path length) that occur among the rules are
expanded, so an arbitrary string prefix is found exactly and a URL makes at
most one expression per rule shape. Expressions meet the rules by equi-join
on a short hash prefix; the full SHA-256 digest confirms; the longest rule
wins (a block rule where an allow rule is equally long and the same).

Defined results: a null URL, or one without ``://``, has empty host and path
and gets the default verdict; so does every URL that no rule fits. The rules
are a table; a rule with a null field is ignored, with no rules all get the
default. Input columns called host, path, rule or verdict are replaced. Rows
with the same URL get the same verdict, repeated rows stay repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchup.llm.common import ascii_lower, drop_clashes, read, values

#: Rule shapes a rule table may hold: the bound on expressions per URL.
MAX_SHAPES = 4096

RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return (
        ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)),
        F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
    )


def n_labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def hashed_rules(rules: DataFrame, prefix_hex: int) -> DataFrame:
    """One row per (host, path) with digest, digest prefix, verdict and shape."""
    r = rules.select("verdict", ascii_lower(F.col("host")).alias("host"), "path").dropna()
    r = r.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block > allow
    return r.select(
        "verdict",
        F.concat("host", "path").alias("rule"),
        n_labels(F.col("host")).alias("labels"),
        F.length("path").alias("chars"),
        F.sha2(F.concat("host", "path"), 256).alias("digest"),
    ).withColumn("short", F.substring("digest", 1, prefix_hex))


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", prefix_hex: int = 8) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    The rule table joins on the hash prefix (the planner broadcasts it only
    below its own size threshold); the distinct URLs alone are expanded, so a
    URL that a third of the pages share is judged once.
    """
    hashed = hashed_rules(rules, prefix_hex)
    shapes = [tuple(x) for x in hashed.select("labels", "chars").distinct().limit(MAX_SHAPES + 1).collect()]
    if len(shapes) > MAX_SHAPES:
        raise ValueError(f"more than {MAX_SHAPES} shapes of rules")
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(url).alias("url")).distinct().withColumns({"host": host, "path": path})
    if shapes:
        expressions = F.array(*(
            F.when(
                (n_labels(F.col("host")) >= k) & (F.length("path") >= n),
                F.concat(F.substring_index("host", ".", -k), F.substring("path", 1, n)),
            )
            for k, n in sorted(shapes)
        ))
        hits = (
            urls.where("host <> ''")
            .select("url", F.explode(F.array_compact(expressions)).alias("expression"))
            .withColumn("full", F.sha2("expression", 256))
            .withColumn("short", F.substring("full", 1, prefix_hex))
            .join(hashed.select("short", "digest", "rule", "verdict"), "short")
            .where("full = digest")
        )
        best = hits.groupBy("url").agg(F.max(F.struct(F.length("rule"), "rule", "verdict")).alias("best"))
        best = best.select(F.col("url").alias("__url"), "best.rule", "best.verdict")
    else:
        best = values(pages.sparkSession, "__url string, rule string, verdict string", [])
    kept = drop_clashes(pages, "host", "path", "rule", "verdict")
    host, path = host_and_path(F.col(url))
    return (
        kept.withColumns({"host": host, "path": path})
        .join(best, F.col(url) == F.col("__url"), "left")
        .drop("__url")
        .withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    )


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    rules = values(spark, "verdict string, host string, path string", RULES)
    return judged(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH p AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
u AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p),
r(verdict, rhost, rpath) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/'))
SELECT u.page_id, u.host, u.path,
       arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
       coalesce(arg_max(r.verdict, length(rhost || rpath)), 'allow') AS verdict
FROM u LEFT JOIN r ON (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath)
GROUP BY u.page_id, u.host, u.path
"""
