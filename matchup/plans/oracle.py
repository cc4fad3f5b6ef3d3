"""DuckDB oracle SQL for the driver queries (independent restatements).

Tables are the pre-registered views of the driver's parquet files. The CTEs
below restate the stand-ins of ``standins.py``; each query's SQL is written
from the operator's semantics, not from its Spark plan.
"""

from __future__ import annotations

MEETING = """
m AS (
  SELECT l.l_orderkey AS order_key, l.l_linenumber AS line,
         CAST(year(o.o_orderdate) AS INTEGER) AS season,
         CAST(month(o.o_orderdate) AS INTEGER) AS period,
         c.c_nationkey AS home, s.s_nationkey AS away,
         l.l_linestatus = 'F' AS completed,
         CASE WHEN l.l_linestatus = 'F' THEN CAST(round(l.l_quantity) + 3 * month(o.o_orderdate) + 5 * (length(c.c_mktsegment) - 8) AS INTEGER) END AS home_points,
         CASE WHEN l.l_linestatus = 'F' THEN CAST(round(l.l_discount * 500) AS INTEGER) END AS away_points,
         o.o_orderdate AS start_ts, l.l_returnflag AS flag, c.c_mktsegment AS home_segment,
         o.o_orderpriority AS priority, l.l_quantity AS quantity, l.l_discount AS discount,
         l.l_tax AS tax, l.l_extendedprice AS price
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
)"""

HIST_WIDE = """
hw AS (
  SELECT c.c_nationkey AS entity,
         CAST(year(o.o_orderdate) AS INTEGER) AS season,
         CAST(month(o.o_orderdate) AS INTEGER) AS period,
         sum(o.o_totalprice) FILTER (WHERE o.o_orderpriority = '1-URGENT') AS urgent,
         sum(o.o_totalprice) FILTER (WHERE o.o_orderpriority = '2-HIGH') AS high,
         sum(o.o_totalprice) FILTER (WHERE o.o_orderpriority = '3-MEDIUM') AS medium,
         sum(o.o_totalprice) FILTER (WHERE o.o_orderpriority = '4-NOT SPECIFIED') AS unspecified,
         sum(o.o_totalprice) FILTER (WHERE o.o_orderpriority = '5-LOW') AS low
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  GROUP BY ALL
)"""

HIST_CUM = """
spine AS (
  SELECT entity, season, unnest(generate_series(min(period), 12)) AS period
  FROM hw GROUP BY entity, season
),
hc AS (
  SELECT s.entity, s.season, s.period,
         sum(hw.urgent) OVER w AS urgent, sum(hw.high) OVER w AS high,
         sum(hw.medium) OVER w AS medium, sum(hw.unspecified) OVER w AS unspecified,
         sum(hw.low) OVER w AS low
  FROM spine s LEFT JOIN hw USING (entity, season, period)
  WINDOW w AS (PARTITION BY s.entity, s.season ORDER BY s.period
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""

STATS = ("urgent", "high", "medium", "unspecified", "low")


def _sides(alias_h: str, alias_a: str) -> str:
    cols = [f"round({alias_h}.{s}, 2) AS home_{s}" for s in STATS]
    cols += [f"round({alias_a}.{s}, 2) AS away_{s}" for s in STATS]
    return ", ".join(cols)


SQL: dict[str, str] = {}

SQL["pit_dual_join"] = f"""
WITH {MEETING}, {HIST_WIDE}, {HIST_CUM}
SELECT m.order_key, m.line, m.season, m.period, m.home, m.away,
       {_sides('h', 'a')},
       round(h.urgent - a.urgent, 2) AS urgent_differential,
       h.entity IS NOT NULL AS home_has_stats, a.entity IS NOT NULL AS away_has_stats,
       CASE WHEN m.home_points IS NOT NULL AND m.away_points IS NOT NULL
            THEN CAST(m.home_points > m.away_points AS INTEGER) END AS home_win,
       CAST(m.home_points - m.away_points AS DOUBLE) AS point_differential
FROM m
LEFT JOIN hc h ON h.season = m.season AND h.entity = m.home AND h.period = m.period - 1
LEFT JOIN hc a ON a.season = m.season AND a.entity = m.away AND a.period = m.period - 1
"""

# --------------------------------------------------------------------------
# Sources and sinks
# --------------------------------------------------------------------------
SQL["season_scan"] = """
SELECT o_orderkey, o_custkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS season,
       CAST(month(o_orderdate) AS INTEGER) AS period, 'orders' AS kind
FROM orders WHERE year(o_orderdate) = 1997 AND month(o_orderdate) BETWEEN 1 AND 6
"""

SQL["season_bounds"] = """
WITH s AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS season FROM orders)
SELECT season, CAST(row_number() OVER (ORDER BY season) AS INTEGER) AS season_rank,
       min(season) OVER () AS min_season, max(season) OVER () AS max_season,
       count(*) OVER () AS n_seasons
FROM s
"""

SQL["multi_season_union"] = """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS season, o_totalprice, CAST(NULL AS VARCHAR) AS o_orderpriority
FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1997
UNION ALL
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS season, o_totalprice, o_orderpriority
FROM orders WHERE year(o_orderdate) = 1998
"""

SQL["raw_ingest"] = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority
FROM orders
"""

SQL["season_refresh"] = """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS season, o_orderstatus
FROM orders WHERE year(o_orderdate) <> 1997 OR o_orderstatus = 'F'
"""

SQL["empty_enrichment"] = """
SELECT o.o_orderkey, CAST(year(o.o_orderdate) AS INTEGER) AS season, c.c_nationkey AS home,
       CAST(NULL AS DOUBLE) AS home_talent
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
"""

# --------------------------------------------------------------------------
# Filters
# --------------------------------------------------------------------------
SQL["next_period"] = """
SELECT CAST(year(o_orderdate) AS INTEGER) AS season,
       CAST(coalesce(max(month(o_orderdate)) FILTER (WHERE o_orderstatus = 'F') + 1, 1) AS INTEGER) AS next_period,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS n_completed
FROM orders GROUP BY 1
"""

SQL["upcoming_filter"] = f"""
WITH {MEETING},
m3 AS (SELECT *, CASE WHEN flag <> 'N' THEN completed END AS completed3 FROM m)
SELECT order_key, line, season, period, completed3 FROM m3
WHERE period = 6 AND completed3 IS DISTINCT FROM TRUE AND home_segment = 'BUILDING'
"""

DOCS_LABELS = """
dl AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

SQL["labelled_filter"] = f"""
WITH {DOCS_LABELS}
SELECT * FROM dl WHERE doc_id IS NOT NULL AND lang IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL
"""

SQL["class_exclusion"] = """
SELECT p_partkey, p_type, p_name FROM part
WHERE NOT (coalesce(p_type, '') ILIKE '%promo%' OR coalesce(p_type, '') ILIKE '%economy%' OR coalesce(p_type, '') ILIKE '%sma%')
  AND NOT (coalesce(p_name, '') ILIKE '%promo%' OR coalesce(p_name, '') ILIKE '%economy%' OR coalesce(p_name, '') ILIKE '%sma%')
"""

SQL["leakage_drop"] = f"""
WITH {MEETING}
SELECT order_key, line, season, period, home, away, flag, home_segment, priority, quantity, discount, tax, price
FROM m
"""

SQL["essential_drop"] = f"""
WITH {DOCS_LABELS}
SELECT * FROM dl WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL
"""

SQL["drop_audit"] = f"""
WITH {DOCS_LABELS}
SELECT count(*) AS rows_before,
       count(*) FILTER (WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL) AS rows_after,
       count(*) - count(*) FILTER (WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL) AS rows_dropped
FROM dl
"""

SQL["column_dedupe"] = f"""
WITH {DOCS_LABELS}
SELECT * FROM dl
"""

# --------------------------------------------------------------------------
# Reshaping and enrichment
# --------------------------------------------------------------------------
EVENTS_WEEKLY = """
ew AS (
  SELECT *, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) + 1 AS INTEGER) AS week,
         CAST(year(ts) AS INTEGER) AS season
  FROM events
)"""

SQL["long_to_wide"] = f"""
WITH {EVENTS_WEEKLY}
SELECT user_id, week,
       arg_min(value, (ts, event_id)) FILTER (WHERE event_type = 'view' AND value IS NOT NULL) AS view,
       arg_min(value, (ts, event_id)) FILTER (WHERE event_type = 'signup' AND value IS NOT NULL) AS signup,
       arg_min(value, (ts, event_id)) FILTER (WHERE event_type = 'purchase' AND value IS NOT NULL) AS purchase,
       arg_min(value, (ts, event_id)) FILTER (WHERE event_type = 'error' AND value IS NOT NULL) AS error,
       arg_min(value, (ts, event_id)) FILTER (WHERE event_type = 'click' AND value IS NOT NULL) AS click
FROM ew
WHERE user_id IS NOT NULL AND week IS NOT NULL
  AND event_type IN ('view', 'signup', 'purchase', 'error', 'click')
GROUP BY user_id, week
"""

SQL["cumulative_through_week"] = f"""
WITH {EVENTS_WEEKLY},
wk AS (SELECT user_id, season, week, sum(value) AS v, count(*) AS n FROM ew GROUP BY ALL),
sp AS (SELECT user_id, season, unnest(generate_series(min(week), (SELECT max(week) FROM ew))) AS week FROM wk GROUP BY user_id, season)
SELECT sp.user_id, sp.season, CAST(sp.week AS INTEGER) AS week,
       round(sum(wk.v) OVER w, 2) AS total_value,
       CAST(sum(wk.n) OVER w AS BIGINT) AS n_events
FROM sp LEFT JOIN wk USING (user_id, season, week)
WINDOW w AS (PARTITION BY sp.user_id, sp.season ORDER BY sp.week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""

SQL["lag_week_join"] = f"""
WITH {MEETING}, {HIST_WIDE}
SELECT m.order_key, m.line, round(h.urgent, 2) AS home_urgent, round(h.low, 2) AS home_low,
       round(a.urgent, 2) AS away_urgent, round(a.low, 2) AS away_low,
       h.entity IS NOT NULL AS home_has_week, a.entity IS NOT NULL AS away_has_week
FROM m
LEFT JOIN hw h ON h.season = m.season AND h.entity = m.home AND h.period = m.period - 1
LEFT JOIN hw a ON a.season = m.season AND a.entity = m.away AND a.period = m.period - 1
"""

NATION_DIM = """
nd AS (
  SELECT CAST(year(o.o_orderdate) AS INTEGER) AS season, c.c_nationkey AS entity, max(c.c_acctbal) AS talent
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE (year(o.o_orderdate) * 31 + c.c_nationkey) % 8 <> 0
  GROUP BY ALL
)"""

SQL["dual_lookup"] = f"""
WITH {MEETING}, {NATION_DIM}
SELECT m.order_key, m.line, round(h.talent, 6) AS home_talent, round(a.talent, 6) AS away_talent,
       round(h.talent - a.talent, 6) AS talent_differential
FROM m
LEFT JOIN nd h ON h.season = m.season AND h.entity = m.home
LEFT JOIN nd a ON a.season = m.season AND a.entity = m.away
"""

SQL["dual_lookup_all"] = f"""
WITH {MEETING},
sd AS (
  SELECT CAST(year(l.l_shipdate) AS INTEGER) AS season, s.s_nationkey AS entity,
         count(DISTINCT s.s_suppkey) AS suppliers, max(s.s_acctbal) AS top_balance
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY ALL
)
SELECT m.order_key, m.line, h.suppliers AS home_suppliers, h.top_balance AS home_top_balance,
       a.suppliers AS away_suppliers, a.top_balance AS away_top_balance
FROM m
LEFT JOIN sd h ON h.season = m.season AND h.entity = m.home
LEFT JOIN sd a ON a.season = m.season AND a.entity = m.away
"""

SQL["median_fill"] = f"""
WITH {MEETING}, {NATION_DIM},
med AS (SELECT season, median(talent) AS md FROM nd GROUP BY season)
SELECT m.order_key, m.line,
       round(coalesce(h.talent, med.md), 6) AS home_talent,
       round(coalesce(a.talent, med.md), 6) AS away_talent
FROM m
LEFT JOIN nd h ON h.season = m.season AND h.entity = m.home
LEFT JOIN nd a ON a.season = m.season AND a.entity = m.away
LEFT JOIN med ON med.season = m.season
"""

PAIRS = """
pr AS (
  SELECT season, home, away, count(*) FILTER (WHERE discount >= 0.05) / count(*) AS p_home
  FROM m WHERE (season * 31 + home * 7 + away) % 8 <> 0 GROUP BY season, home, away
),
pl AS (
  SELECT m.order_key, m.line, m.season, pr.p_home, 1.0 - pr.p_home AS p_away,
         pr.p_home - (1.0 - pr.p_home) AS p_differential
  FROM m LEFT JOIN pr ON pr.season = m.season AND pr.home = m.home AND pr.away = m.away
)"""

SQL["pair_lookup"] = f"""
WITH {MEETING}, {PAIRS}
SELECT order_key, line, round(p_home, 6) AS p_home, round(p_away, 6) AS p_away, round(p_differential, 6) AS p_differential
FROM pl
"""

SQL["coverage"] = f"""
WITH {MEETING}, {PAIRS}
SELECT season, count(*) AS n_rows, count(p_home) AS n_p_home, round(count(p_home) / count(*), 6) AS share_p_home
FROM pl GROUP BY season
"""

SQL["first_element"] = """
SELECT l_orderkey AS order_key, l_linenumber AS line,
       CASE WHEN l_returnflag <> 'N' THEN
         list_filter([{'provider': 'd', 'spread': l_discount}, {'provider': 't', 'spread': l_tax}],
                     lambda x: x.spread >= 0.04)[1].spread
       END AS spread_line
FROM lineitem
"""

SQL["nested_flatten"] = """
SELECT event_id, value AS o_value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS o_props_k,
       user_id AS o_who_uid, event_type = 'error' AS o_is_error
FROM events
"""

SQL["nested_flatten_mixed"] = """
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id,
       CASE WHEN event_type = 'error' THEN k END AS o_err_code,
       CASE WHEN event_type = 'error' THEN coalesce(value > 100, false) END AS o_err_fatal,
       CASE WHEN event_type NOT IN ('error', 'view', 'click', 'signup') THEN k END AS o_k,
       CASE WHEN event_type = 'view' THEN value END AS o_v,
       CASE WHEN event_type = 'click' THEN user_id END AS o_who,
       CASE WHEN event_type = 'view' THEN k END AS o_who_in_k,
       CASE WHEN event_type = 'view' THEN user_id END AS o_who_uid
FROM e
"""

SQL["nested_extract"] = """
SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), CAST(0 AS DOUBLE)) AS props_k,
       CAST(0 AS DOUBLE) AS props_missing, CAST(0 AS DOUBLE) AS props_a_b
FROM events
"""

# --------------------------------------------------------------------------
# Scalar functions and fills
# --------------------------------------------------------------------------
SQL["target_derivation"] = f"""
WITH {MEETING}
SELECT order_key, line,
       CASE WHEN home_points IS NOT NULL AND away_points IS NOT NULL THEN CAST(home_points > away_points AS INTEGER) END AS home_win,
       CAST(home_points - away_points AS DOUBLE) AS point_differential
FROM m
"""

SQL["safe_casts"] = """
SELECT event_id,
       CAST(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS BIGINT) AS k_int,
       CAST(TRY_CAST(event_type AS DOUBLE) AS BIGINT) AS type_int,
       CASE WHEN isnan(value) THEN NULL ELSE value END AS value_f,
       CAST(user_id AS VARCHAR) AS user_text,
       strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS ts_iso,
       coalesce(CASE WHEN event_type = 'error' THEN TRUE WHEN event_type = 'view' THEN FALSE END, FALSE) AS is_error
FROM events
"""

SQL["bool_to_int"] = f"""
WITH {MEETING}
SELECT order_key, line, CAST(completed AS INTEGER) AS completed,
       CAST(CASE WHEN flag <> 'N' THEN completed END AS INTEGER) AS completed3
FROM m
"""

SQL["coerce_numeric"] = """
SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), CAST(0 AS DOUBLE)) AS k_num,
       coalesce(TRY_CAST(event_type AS DOUBLE), CAST(0 AS DOUBLE)) AS type_num,
       TRY_CAST('1' || event_type AS DOUBLE) AS target
FROM events WHERE TRY_CAST('1' || event_type AS DOUBLE) IS NOT NULL
UNION ALL
SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), CAST(0 AS DOUBLE)) AS k_num, CAST(0 AS DOUBLE) AS type_num,
       TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS target
FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL
"""

SQL["null_defaults"] = f"""
WITH {DOCS_LABELS}
SELECT coalesce(doc_id, 0) AS doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
       coalesce(n_chars, 0) AS n_chars, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic
FROM dl
"""

SQL["zero_fill_listed"] = f"""
WITH {MEETING}, {HIST_WIDE}, {HIST_CUM}
SELECT m.order_key, m.line, coalesce(round(h.urgent, 2), CAST(0 AS DOUBLE)) AS home_urgent,
       coalesce(round(a.urgent, 2), CAST(0 AS DOUBLE)) AS away_urgent, round(h.low, 2) AS home_low
FROM m
LEFT JOIN hc h ON h.season = m.season AND h.entity = m.home AND h.period = m.period - 1
LEFT JOIN hc a ON a.season = m.season AND a.entity = m.away AND a.period = m.period - 1
"""

SQL["zero_fill_pattern"] = f"""
WITH {DOCS_LABELS}
SELECT doc_id, lang, source, n_chars, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM dl
"""

SQL["residual_fill"] = f"""
WITH {DOCS_LABELS}
SELECT coalesce(doc_id, 0) AS doc_id, lang,
       coalesce(CASE WHEN quality IS NOT NULL THEN source END, 'unknown') AS source,
       coalesce(n_chars, 0) AS n_chars, coalesce(quality, 0) AS quality, toxic
FROM dl
"""

SQL["null_profile"] = f"""
WITH {DOCS_LABELS},
c AS (
  SELECT 'doc_id' AS "column", count(*) FILTER (WHERE doc_id IS NULL) AS n_null FROM dl
  UNION ALL SELECT 'lang', count(*) FILTER (WHERE lang IS NULL) FROM dl
  UNION ALL SELECT 'source', count(*) FILTER (WHERE source IS NULL) FROM dl
  UNION ALL SELECT 'n_chars', count(*) FILTER (WHERE n_chars IS NULL) FROM dl
  UNION ALL SELECT 'quality', count(*) FILTER (WHERE quality IS NULL) FROM dl
  UNION ALL SELECT 'toxic', count(*) FILTER (WHERE toxic IS NULL) FROM dl
)
SELECT "column", n_null, n_null > 0 AS needs_fill FROM c
"""

# --------------------------------------------------------------------------
# Contract
# --------------------------------------------------------------------------
CUSTOMERS = """
cn AS (
  SELECT c.c_custkey, c.c_mktsegment, n.n_name, c.c_acctbal, c.c_nationkey
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""

SQL["category_vocab"] = f"""
WITH {CUSTOMERS},
v AS (
  SELECT DISTINCT 'c_mktsegment' AS "column", c_mktsegment AS value FROM cn WHERE c_mktsegment IS NOT NULL
  UNION
  SELECT DISTINCT 'n_name', n_name FROM cn WHERE n_name IS NOT NULL
)
SELECT "column", value, CAST(row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS INTEGER) AS value_index FROM v
"""

SQL["category_align"] = f"""
WITH {CUSTOMERS}
SELECT c_custkey,
       CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN c_mktsegment END AS c_mktsegment,
       CASE WHEN n_name IN ('NATION_1', 'NATION_2', 'NATION_3') THEN n_name END AS n_name
FROM cn
"""

SQL["unseen_audit"] = f"""
WITH {CUSTOMERS},
p AS (
  SELECT 'c_mktsegment' AS "column", c_mktsegment AS value FROM cn
  UNION ALL SELECT 'n_name', n_name FROM cn
),
u AS (
  SELECT * FROM p WHERE value IS NOT NULL
    AND NOT (("column" = 'c_mktsegment' AND value IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE'))
          OR ("column" = 'n_name' AND value IN ('NATION_1', 'NATION_2', 'NATION_3')))
),
pv AS (SELECT "column", value, count(*) AS n FROM u GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY value) AS rk FROM pv)
SELECT "column", CAST(sum(n) AS BIGINT) AS n_unseen, count(*) AS n_distinct_unseen,
       string_agg(value, ',' ORDER BY value) FILTER (WHERE rk <= 5) AS unseen_sample
FROM rk GROUP BY "column"
"""

SQL["schema_align"] = f"""
WITH {CUSTOMERS}
SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal,
       CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN c_mktsegment END AS c_mktsegment,
       CAST(0 AS DOUBLE) AS missing_num, CAST(NULL AS VARCHAR) AS missing_cat,
       CAST(c_nationkey AS DOUBLE) AS c_nationkey,
       CASE WHEN n_name IN ('NATION_1', 'NATION_2', 'NATION_3') THEN n_name END AS n_name
FROM cn
"""

SQL["schema_diff"] = f"""
WITH {CUSTOMERS},
meta("column", status, role) AS (VALUES
  ('c_acctbal', 'present', 'numeric'), ('c_mktsegment', 'present', 'categorical'),
  ('missing_num', 'missing', 'numeric'), ('missing_cat', 'missing', 'categorical'),
  ('c_nationkey', 'present', 'numeric'), ('n_name', 'present', 'categorical')
),
cnt AS (
  SELECT 'c_acctbal' AS "column", count(c_acctbal) AS n_non_null FROM cn
  UNION ALL SELECT 'c_mktsegment', count(c_mktsegment) FROM cn
  UNION ALL SELECT 'c_nationkey', count(c_nationkey) FROM cn
  UNION ALL SELECT 'n_name', count(n_name) FROM cn
)
SELECT meta."column", status, role, n_non_null FROM meta LEFT JOIN cnt ON meta."column" = cnt."column"
"""

# --------------------------------------------------------------------------
# Splits, metrics, calibration
# --------------------------------------------------------------------------
SQL["temporal_split"] = """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS season,
       CASE WHEN year(o_orderdate) <= 1998 THEN 'train' WHEN year(o_orderdate) = 1999 THEN 'calib'
            WHEN year(o_orderdate) = 2000 THEN 'holdout' END AS split,
       year(o_orderdate) <= 2000 AS split_prod
FROM orders
"""

SCORED = """
sd AS (
  SELECT d.doc_id, d.lang, l.quality, CAST(d.n_chars AS DOUBLE) / (CAST(d.n_chars AS DOUBLE) + 2000.0) AS p
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""

SQL["binary_metrics"] = f"""
WITH {SCORED}
SELECT lang, count(*) AS n,
       round(avg(CASE WHEN CAST(p >= 0.5 AS DOUBLE) = quality THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       round(avg((p - quality) * (p - quality)), 6) AS brier,
       round(-avg(quality * ln(greatest(least(p, 1 - 1e-15), 1e-15))
                 + (1 - quality) * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15))), 6) AS logloss
FROM sd GROUP BY lang
"""

SQL["auc"] = f"""
WITH {SCORED},
r AS (
  SELECT lang, quality AS y,
         rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0 AS ar
  FROM sd
)
SELECT lang,
       round((sum(ar) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
             / NULLIF(count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0), 0), 6) AS auc,
       count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg
FROM r GROUP BY lang
"""

SQL["regression_metrics"] = """
WITH x AS (SELECT l_returnflag, l_quantity - 25 AS y, l_discount * 500 - 25 AS pred FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(avg(abs(pred - y)), 6) AS mae,
       round(sqrt(avg((pred - y) * (pred - y))), 6) AS rmse,
       round(avg(CASE WHEN sign(pred) = sign(y) THEN 1.0 ELSE 0.0 END), 6) AS sign_accuracy
FROM x GROUP BY l_returnflag
"""


def _isotonic(where: str = "TRUE") -> str:
    """Fitted isotonic value per distinct score: max over j<=i of min over k>=i of mean(j..k)."""
    return f"""
ig AS (SELECT p AS x, CAST(sum(quality) AS DOUBLE) AS sy, CAST(count(*) AS DOUBLE) AS w FROM sd WHERE {where} GROUP BY p),
ic AS (SELECT x, sy, w, row_number() OVER (ORDER BY x) AS i,
              sum(sy) OVER (ORDER BY x) AS csy, sum(w) OVER (ORDER BY x) AS cw FROM ig),
ip AS (SELECT a.i AS j, b.i AS k, (b.csy - a.csy + a.sy) / (b.cw - a.cw + a.w) AS mean
       FROM ic a JOIN ic b ON a.i <= b.i),
imn AS (SELECT ic.i, ip.j, min(ip.mean) AS mn FROM ic JOIN ip ON ip.j <= ic.i AND ip.k >= ic.i GROUP BY ic.i, ip.j),
knots AS (SELECT ic.x, max(imn.mn) AS y FROM ic JOIN imn ON imn.i = ic.i GROUP BY ic.x)"""


def _interp(src: str, score: str) -> str:
    """Piecewise-linear interpolation of ``score`` over ``knots``, ends clamped."""
    return f"""
SELECT {src}.*, CASE
  WHEN lo.x IS NULL THEN hi.y
  WHEN hi.x IS NULL THEN lo.y
  ELSE lo.y + ({src}.{score} - lo.x) * (hi.y - lo.y) / (hi.x - lo.x) END AS p_cal
FROM {src}
ASOF LEFT JOIN knots lo ON {src}.{score} >= lo.x
ASOF LEFT JOIN knots hi ON {src}.{score} < hi.x"""


SQL["isotonic_fit"] = f"""
WITH {SCORED}, {_isotonic()}
SELECT x AS score, round(y, 6) AS fitted FROM knots
"""

SQL["calibrate_interp"] = f"""
WITH {SCORED}, {_isotonic()},
docs AS (SELECT doc_id, CAST(n_chars AS DOUBLE) / (CAST(n_chars AS DOUBLE) + 2000.0) AS p FROM documents),
cal AS ({_interp('docs', 'p')})
SELECT doc_id, p, round(greatest(least(p_cal, 1.0), 0.0), 6) AS p_cal FROM cal
"""

SQL["calibration_decision"] = f"""
WITH {SCORED}, {_isotonic("lang = 'en'")},
hold AS (SELECT * FROM sd WHERE lang <> 'en'),
cal AS ({_interp('hold', 'p')}),
b AS (
  SELECT avg((p - quality) * (p - quality)) AS brier_raw,
         avg((greatest(least(p_cal, 1.0), 0.0) - quality) * (greatest(least(p_cal, 1.0), 0.0) - quality)) AS brier_calibrated
  FROM cal
)
SELECT round(brier_raw, 6) AS brier_raw, round(brier_calibrated, 6) AS brier_calibrated,
       coalesce(brier_calibrated <= brier_raw, FALSE) AS ship_calibration,
       CASE WHEN brier_calibrated <= brier_raw THEN 'isotonic' ELSE 'none' END AS method
FROM b
"""

# --------------------------------------------------------------------------
# Scoring display and publishing
# --------------------------------------------------------------------------
SLATE = """
sl AS (
  SELECT order_key, line, season, period, home, away, quantity,
         quantity / 51.0 AS p,
         CASE WHEN quantity / 51.0 >= 0.5 THEN 'N' || CAST(home AS VARCHAR) ELSE 'N' || CAST(away AS VARCHAR) END AS predicted_winner,
         greatest(quantity / 51.0, 1.0 - quantity / 51.0) AS conf,
         (quantity - 25.5) * 0.7 AS margin,
         CASE WHEN flag <> 'N' THEN start_ts END AS kickoff_ts,
         CASE WHEN flag <> 'R' THEN home_segment END AS home_label
  FROM m
)"""

SQL["pick_winner"] = f"""
WITH {MEETING}, {SLATE}
SELECT order_key, line, round(p, 4) AS home_win_probability, predicted_winner,
       round(conf, 4) AS confidence, round((quantity - 25.5) / 2, 1) AS predicted_margin
FROM sl
"""

SQL["slate_sort"] = f"""
WITH {MEETING}, {SLATE}
SELECT season, period, order_key, line, strftime(kickoff_ts, '%Y-%m-%d %H:%M:%S') AS kickoff,
       round(conf, 4) AS confidence,
       row_number() OVER (PARTITION BY season, period
                          ORDER BY kickoff_ts ASC NULLS FIRST, round(conf, 4) DESC, order_key, line) AS position
FROM sl
"""

SQL["display_columns"] = f"""
WITH {MEETING}, {SLATE},
x AS (SELECT *, CAST(floor(p * 100 + 0.5) AS INTEGER) AS hp, floor(margin * 10 + 0.5) / 10 AS nm FROM sl)
SELECT order_key, line, hp AS home_pct, 100 - hp AS away_pct, hp >= 100 - hp AS home_favored,
       CASE WHEN nm > 0 THEN '+' || printf('%.1f', nm) ELSE printf('%.1f', nm) END AS away_spread,
       coalesce(strftime(timezone('America/Chicago', timezone('UTC', kickoff_ts)), '%-I:%M %p'), 'TBD') AS kickoff,
       CASE WHEN margin > 0 THEN 'plus' WHEN margin < 0 THEN 'minus' WHEN margin = 0 THEN 'even' END AS margin_class,
       coalesce(home_label, '—') AS home_label
FROM x
"""

SQL["season_of_date"] = """
SELECT o_orderkey, CAST(CASE WHEN month(o_orderdate) >= 8 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS INTEGER) AS season
FROM orders
"""

WEEK_INDEX = """
wi AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS season, CAST(month(o_orderdate) AS INTEGER) AS week,
         count(*) AS n_games, max(o_orderdate) AS last_ts
  FROM orders GROUP BY 1, 2
)"""

SQL["week_nav"] = f"""
WITH {WEEK_INDEX}
SELECT season, week,
       lag(season) OVER w AS prev_season, lag(week) OVER w AS prev_week,
       lead(season) OVER w AS next_season, lead(week) OVER w AS next_week
FROM wi WINDOW w AS (ORDER BY season, week)
"""

SQL["weeks_by_season"] = f"""
WITH {WEEK_INDEX},
s AS (
  SELECT season, string_agg(CAST(week AS VARCHAR), ',' ORDER BY week) AS weeks,
         count(DISTINCT week) AS n_weeks, CAST(sum(n_games) AS BIGINT) AS n_games
  FROM wi GROUP BY season
)
SELECT *, CAST(row_number() OVER (ORDER BY season DESC) AS INTEGER) AS season_rank FROM s
"""

SQL["latest_run"] = f"""
WITH {WEEK_INDEX}
SELECT season, week, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS generated_at, n_games
FROM wi ORDER BY last_ts DESC, season DESC, week DESC LIMIT 1
"""

GAMES = """
gm AS (
  SELECT o.o_orderkey AS id, CAST(year(o.o_orderdate) AS INTEGER) AS season,
         CAST(month(o.o_orderdate) AS INTEGER) AS week,
         strftime(o.o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS kickoff,
         c.c_name AS home_team, n.n_name AS away_team,
         round(o.o_totalprice / (o.o_totalprice + 150000.0), 4) AS home_win_probability,
         CASE WHEN o.o_totalprice / (o.o_totalprice + 150000.0) >= 0.5 THEN c.c_name ELSE n.n_name END AS predicted_winner,
         round(greatest(o.o_totalprice / (o.o_totalprice + 150000.0), 1.0 - o.o_totalprice / (o.o_totalprice + 150000.0)), 4) AS confidence
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""

SQL["publish_roundtrip"] = f"""
WITH {GAMES}
SELECT * FROM gm
"""

SQL["week_documents"] = f"""
WITH {GAMES},
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY season, week ORDER BY kickoff NULLS FIRST, confidence DESC, id) - 1) // 1000 AS page FROM gm
),
docs AS (
  SELECT season, week, page, count(*) AS n_games,
         string_agg(CAST(id AS VARCHAR), ',' ORDER BY kickoff NULLS FIRST, confidence DESC, id) AS ids,
         string_agg(predicted_winner, ',' ORDER BY kickoff NULLS FIRST, confidence DESC, id) AS winners
  FROM ranked GROUP BY ALL
),
weeks AS (SELECT season, CAST(unnest(generate_series(1, 12)) AS INTEGER) AS week FROM (SELECT DISTINCT season FROM gm))
SELECT season, week, coalesce(page, 0) AS page, coalesce(n_games, 0) AS n_games, '2026-12-01T00:00:00+00:00' AS generated_at,
       coalesce(ids, '') AS ids, coalesce(winners, '') AS winners
FROM weeks LEFT JOIN docs USING (season, week)
"""

SQL["publish_widened"] = f"""
WITH {GAMES}
SELECT id, season, week, home_team, CASE WHEN season <= 1997 THEN confidence END AS confidence,
       CASE WHEN season > 1997 THEN 'late' END AS note
FROM gm
"""

SQL["publish_guard"] = f"""
WITH {GAMES}
SELECT season, week, CASE WHEN season <= 1997 THEN 'r1' ELSE 'r2' END AS run_id, count(*) AS n_games
FROM gm GROUP BY ALL
"""

SQL["list_weeks"] = f"""
WITH {GAMES},
w AS (SELECT DISTINCT season, week FROM gm)
SELECT season, week, CAST(row_number() OVER (ORDER BY season, week) AS INTEGER) AS position FROM w
"""

# --------------------------------------------------------------------------
# End-to-end feature dataset and training matrix
# --------------------------------------------------------------------------
FEATURE_DATASET = """
med AS (SELECT season, median(talent) AS md FROM nd GROUP BY season),
pr AS (SELECT season, home, away, count(*) FILTER (WHERE discount >= 0.05) / count(*) AS p_home FROM m WHERE (season * 31 + home * 7 + away) % 8 <> 0 GROUP BY season, home, away),
fd AS (
  SELECT m.order_key, m.line, m.season, m.period, m.home, m.away, m.completed, m.home_points, m.away_points,
         m.flag, m.home_segment,
         h.urgent AS home_urgent, h.high AS home_high, h.medium AS home_medium,
         h.unspecified AS home_unspecified, h.low AS home_low,
         a.urgent AS away_urgent, a.high AS away_high, a.medium AS away_medium,
         a.unspecified AS away_unspecified, a.low AS away_low,
         h.entity IS NOT NULL AS home_has_stats, a.entity IS NOT NULL AS away_has_stats,
         coalesce(th.talent, med.md) AS home_talent, coalesce(ta.talent, med.md) AS away_talent,
         coalesce(th.talent, med.md) - coalesce(ta.talent, med.md) AS talent_differential,
         pr.p_home, 1.0 - pr.p_home AS p_away, pr.p_home - (1.0 - pr.p_home) AS p_differential,
         CASE WHEN m.home_points IS NOT NULL AND m.away_points IS NOT NULL
              THEN CAST(m.home_points > m.away_points AS INTEGER) END AS home_win,
         CAST(m.home_points - m.away_points AS DOUBLE) AS point_differential
  FROM m
  LEFT JOIN hc h ON h.season = m.season AND h.entity = m.home AND h.period = m.period - 1
  LEFT JOIN hc a ON a.season = m.season AND a.entity = m.away AND a.period = m.period - 1
  LEFT JOIN nd th ON th.season = m.season AND th.entity = m.home
  LEFT JOIN nd ta ON ta.season = m.season AND ta.entity = m.away
  LEFT JOIN med ON med.season = m.season
  LEFT JOIN pr ON pr.season = m.season AND pr.home = m.home AND pr.away = m.away
)"""

_R2 = [f"{s}_{x}" for s in ("home", "away") for x in STATS]

SQL["feature_dataset"] = f"""
WITH {MEETING}, {HIST_WIDE}, {HIST_CUM}, {NATION_DIM}, {FEATURE_DATASET}
SELECT order_key, line, season, period, home, away, completed, home_points, away_points, flag, home_segment,
       {', '.join(f'round({c}, 2) AS {c}' for c in _R2)},
       home_has_stats, away_has_stats,
       round(home_talent, 6) AS home_talent, round(away_talent, 6) AS away_talent,
       round(talent_differential, 6) AS talent_differential,
       round(p_home, 6) AS p_home, round(p_away, 6) AS p_away, round(p_differential, 6) AS p_differential,
       home_win, point_differential
FROM fd
"""

SQL["training_matrix"] = f"""
WITH {MEETING}, {HIST_WIDE}, {HIST_CUM}, {NATION_DIM}, {FEATURE_DATASET}
SELECT order_key, line, season, period, home, away, home_segment,
       {', '.join(f'round(coalesce({c}, 0), 2) AS {c}' for c in _R2)},
       CAST(home_has_stats AS INTEGER) AS home_has_stats, CAST(away_has_stats AS INTEGER) AS away_has_stats,
       round(coalesce(home_talent, 0), 6) AS home_talent, round(coalesce(away_talent, 0), 6) AS away_talent,
       round(coalesce(talent_differential, 0), 6) AS talent_differential,
       round(p_home, 6) AS p_home, round(p_away, 6) AS p_away, round(p_differential, 6) AS p_differential,
       home_win, point_differential
FROM fd
WHERE home_points IS NOT NULL AND away_points IS NOT NULL AND NOT (coalesce(flag, '') ILIKE '%n%')
  AND season IS NOT NULL AND period IS NOT NULL AND home IS NOT NULL AND away IS NOT NULL
"""

SQL["week_features"] = f"""
WITH {MEETING}, {HIST_WIDE}, {HIST_CUM}, {NATION_DIM}, {FEATURE_DATASET}
SELECT order_key, line, season, period, home, away, home_segment,
       {', '.join(f'round(coalesce({c}, 0), 2) AS {c}' for c in _R2)},
       CAST(home_has_stats AS INTEGER) AS home_has_stats, CAST(away_has_stats AS INTEGER) AS away_has_stats,
       round(coalesce(home_talent, 0), 6) AS home_talent, round(coalesce(away_talent, 0), 6) AS away_talent,
       round(coalesce(talent_differential, 0), 6) AS talent_differential
FROM fd JOIN nation hn ON hn.n_nationkey = fd.home JOIN nation an ON an.n_nationkey = fd.away
WHERE season = 2000 AND period = 6 AND completed IS DISTINCT FROM TRUE AND hn.n_regionkey <> 0 AND an.n_regionkey <> 0
  AND NOT (coalesce(flag, '') ILIKE '%n%')
"""

SQL["stream_refresh"] = SQL["season_refresh"]

SQL["pair_lookup_nested"] = f"""
WITH {MEETING},
pr AS (
  SELECT season, home, away,
         [{{'provider': 'avg', 'spread': min(discount)}}, {{'provider': 'max', 'spread': max(tax)}}] AS lines
  FROM m WHERE (season * 31 + home * 7 + away) % 8 <> 0 GROUP BY season, home, away
)
SELECT m.order_key, m.line, round(pr.lines[1].spread, 6) AS spread_line, CAST(len(pr.lines) AS INTEGER) AS n_lines
FROM m LEFT JOIN pr ON pr.season = m.season AND pr.home = m.home AND pr.away = m.away
"""

SQL["resolve_target"] = """
WITH t AS (SELECT max(o_orderdate) AS today FROM orders),
s AS (SELECT CAST(CASE WHEN month(today) >= 8 THEN year(today) ELSE year(today) - 1 END AS INTEGER) AS season FROM t),
np AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS season,
         CAST(coalesce(max(month(o_orderdate)) FILTER (WHERE o_orderstatus = 'F') + 1, 1) AS INTEGER) AS next_period
  FROM orders GROUP BY 1
)
SELECT s.season, coalesce(np.next_period, 1) AS week FROM s LEFT JOIN np ON np.season = s.season
"""

SQL["published_week"] = f"""
WITH {GAMES}
SELECT id, kickoff, home_team, away_team, home_win_probability, predicted_winner, confidence
FROM gm WHERE season = 1997 AND week = 6
"""
