"""Shared parts of the SQL counterparts."""

BARS = """
bars AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date,
   min_by(l_extendedprice / l_quantity, l_orderkey * 10 + l_linenumber) AS open, max(l_extendedprice / l_quantity) AS high,
   min(l_extendedprice / l_quantity) AS low,
   CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS close,
   CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS volume, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS amount
 FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2)"""
UNIVERSE = """
universe AS (SELECT s_suppkey AS code, n_name AS industry, r_name AS area FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
PANEL = (
    BARS
    + ","
    + UNIVERSE
    + """,
month0 AS (SELECT code, date_trunc('month', date)::DATE AS date, CAST(sum(CAST(amount AS DECIMAL(18,4))) AS DOUBLE) AS amount,
   CAST(sum(CAST(volume AS DECIMAL(18,4))) AS DOUBLE) AS volume, count(*) AS days FROM bars GROUP BY 1, 2),
month1 AS (SELECT *, amount / volume AS close FROM month0),
panel AS (SELECT code, date, industry, area, close, volume, days, 100 * (close / lag(close, 1) OVER w - 1) AS ret,
   100 * (close / lag(close, 3) OVER w - 1) AS ret3, 100 * (lead(close, 1) OVER w / close - 1) AS fwd
 FROM month1 LEFT JOIN universe USING (code) WINDOW w AS (PARTITION BY code ORDER BY date))"""
)
EVENTS = """
ev AS (SELECT user_id AS code, event_id, event_type, ts, CAST(ts AS DATE) AS event_date, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""


def rank_pct(x: str, *keys: str) -> str:
    k = ", ".join(keys)
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {k} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {k}) END"


def zscore(x: str, *keys: str, ddof: int = 1, least: int = 5) -> str:
    w = f"OVER (PARTITION BY {', '.join(keys)})"
    sd = f"{'stddev_samp' if ddof else 'stddev_pop'}({x}) {w}"
    return f"CASE WHEN count(*) {w} >= {least} AND {sd} > 1e-12 THEN ({x} - avg({x}) {w}) / ({sd}) ELSE 0.0 END"
