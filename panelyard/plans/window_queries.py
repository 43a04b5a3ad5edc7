"""Queries over time-series windows, labels and calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions.expr import rounded
from panelyard.functions.windows import by_code
from panelyard.operators import calendar, indicators, labels
from panelyard.plans.sql import BARS, PANEL
from panelyard.sources.tables import bars, panel

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _full(expr: str, x: str, n: int) -> str:
    w = f"OVER (PARTITION BY code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {n} THEN {expr} {w} END"


@query(f"""
WITH {BARS},
a AS (SELECT *, lag(close) OVER w AS before FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)),
b AS (SELECT *, CASE WHEN before IS NOT NULL THEN greatest(close - before, 0.0) END AS up, CASE WHEN before IS NOT NULL THEN greatest(before - close, 0.0) END AS down,
  greatest(high - low, coalesce(abs(high - before), 0), coalesce(abs(low - before), 0)) AS reach FROM a),
c AS (SELECT *, {_full('avg(close)', 'close', 5)} AS ma5, {_full('avg(close)', 'close', 20)} AS ma20, {_full('avg(close)', 'close', 60)} AS ma60, {_full('avg(close)', 'close', 120)} AS ma120,
  {_full('avg(up)', 'up', 14)} AS g, {_full('avg(down)', 'down', 14)} AS l, {_full('avg(reach)', 'reach', 20)} AS atr20, {_full('stddev_samp(close)', 'close', 20)} AS sd,
  {_full('avg(volume)', 'volume', 20)} AS mv, {_full('max(close)', 'close', 60)} AS top FROM b)
SELECT code, date, round(close, 6) AS close, round(ma5, 6) AS ma5, round(ma20, 6) AS ma20, round(ma60, 6) AS ma60, round(ma120, 6) AS ma120,
  round(100 * (close / lag(close, 20) OVER w - 1), 6) AS ret20, round(ma60 - lag(ma60, 20) OVER w, 6) AS ma60_slope, round(volume / mv, 6) AS volume_ratio,
  round(CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) END, 6) AS rsi14, round(atr20, 6) AS atr20, round(ma20 + 2 * sd, 6) AS bb_upper, round(ma20 - 2 * sd, 6) AS bb_lower,
  round(100 * (close / top - 1), 6) AS drawdown60
FROM c WINDOW w AS (PARTITION BY code ORDER BY date)
""")
def w_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indicators.trend(bars(spark, sf_dir)).drop("open", "high", "low", "volume", "amount"))


@query(f"""
WITH {BARS},
a AS (SELECT *, close - lag(close) OVER w AS step, coalesce(100 * (close / lag(close) OVER w - 1), NULL) AS r FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)),
b AS (SELECT *, sign(step) AS sg, sign(close - {_full('avg(close)', 'close', 20)}) AS gap FROM a),
c AS (SELECT *, last_value(CASE WHEN gap <> 0 THEN gap END IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING) AS side FROM b),
d AS (SELECT *, coalesce((sg * lag(sg) OVER w < 0)::INT, 0) AS turn, coalesce((side <> lag(side) OVER w)::INT, 0) AS flip FROM c WINDOW w AS (PARTITION BY code ORDER BY date)),
e AS (SELECT *, {_full('min(low)', 'low', 20)} AS lo, {_full('max(high)', 'high', 20)} AS hi, {_full('avg(close)', 'close', 20)} AS av, {_full('stddev_pop(close)', 'close', 20)} AS sd,
  {_full('sum(abs(step))', 'step', 20)} AS path, {_full('avg((coalesce(r, 0) > 0)::INT)', '*', 20)} AS con, {_full('sum(turn)', '*', 20)} AS tu, {_full('sum(flip)', '*', 20)} AS fl, {_full('stddev_pop(r)', 'r', 20)} AS vol FROM d)
SELECT code, date, round(CASE WHEN abs(hi - lo) > 1e-12 THEN (close - lo) / (hi - lo) END, 6) AS range_position, round((hi - lo) / av, 6) AS range_width, round(con, 6) AS consistency,
  round(CASE WHEN abs(path) > 1e-12 THEN abs(close - lag(close, 20) OVER w) / path END, 6) AS efficiency, tu::BIGINT AS reversals, fl::BIGINT AS crossings, round(vol, 6) AS volatility,
  round(CASE WHEN abs(sd) > 1e-12 THEN (close - av) / sd END, 6) AS reversion_z
FROM e WINDOW w AS (PARTITION BY code ORDER BY date)
""")
def w_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indicators.shape(bars(spark, sf_dir)))


@query(f"""
WITH {BARS},
a AS (SELECT code, date, coalesce(sign(close - lag(close) OVER w), 0)::INT AS sg FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)),
b AS (SELECT *, (sg = 0 OR coalesce(lag(sg) OVER w, 0) <> sg)::INT AS fresh FROM a WINDOW w AS (PARTITION BY code ORDER BY date)),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING) AS island FROM b),
d AS (SELECT code, date, sg * row_number() OVER (PARTITION BY code, island ORDER BY date) AS streak FROM c)
SELECT code, date, streak::INT AS streak, greatest(-5, least(5, streak)) / 5.0 AS streak_share FROM d
""")
def w_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.streaks(bars(spark, sf_dir))


@query(f"""
WITH {BARS},
a AS (SELECT *, coalesce((close < lag(close) OVER w)::INT, 0) AS fall FROM bars WINDOW w AS (PARTITION BY code ORDER BY date))
SELECT code, date, round(max(high) OVER p, 6) AS prior_high, round(min(low) OVER p, 6) AS prior_low, sum(fall) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 4 AS four_falls,
  round(CASE WHEN count(*) OVER w60 = 60 AND max(high) OVER w60 - min(low) OVER w60 > 1e-12 THEN (max(high) OVER w60 - close) / (max(high) OVER w60 - min(low) OVER w60) END, 6) AS retracement
FROM a WINDOW p AS (PARTITION BY code ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), w60 AS (PARTITION BY code ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)
""")
def w_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indicators.extremes(bars(spark, sf_dir)))


@query(f"""
WITH {BARS},
a AS (SELECT *, CASE WHEN count(close) OVER p = 20 THEN max(close) OVER p END AS top, 100 * (lead(close, 5) OVER w / close - 1) AS f5, 100 * (lead(close, 20) OVER w / close - 1) AS f20, 100 * (lead(close, 60) OVER w / close - 1) AS f60
  FROM bars WINDOW w AS (PARTITION BY code ORDER BY date), p AS (PARTITION BY code ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT code, date, round(close, 6) AS close, round(top, 6) AS top, round(f5, 6) AS fwd_ret_5, round(f20, 6) AS fwd_ret_20, round(f60, 6) AS fwd_ret_60 FROM a WHERE close > top
""")
def w_breakout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indicators.breakouts(bars(spark, sf_dir)))


@query(f"""
WITH RECURSIVE {BARS},
n AS (SELECT code, date, close, row_number() OVER (PARTITION BY code ORDER BY date) AS rn FROM bars),
e AS (SELECT code, rn, close AS f, close AS s FROM n WHERE rn = 1
  UNION ALL SELECT n.code, n.rn, e.f + 2.0 / 13 * (n.close - e.f), e.s + 2.0 / 27 * (n.close - e.s) FROM e JOIN n ON n.code = e.code AND n.rn = e.rn + 1),
d AS (SELECT code, rn, f - s AS dif FROM e),
g AS (SELECT code, rn, dif, dif AS dea FROM d WHERE rn = 1
  UNION ALL SELECT d.code, d.rn, d.dif, g.dea + 0.2 * (d.dif - g.dea) FROM g JOIN d ON d.code = g.code AND d.rn = g.rn + 1)
SELECT n.code, n.date, round(dif, 6) AS dif, round(dea, 6) AS dea, round(2 * (dif - dea), 6) AS hist FROM g JOIN n USING (code, rn)
""")
def w_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(indicators.macd(bars(spark, sf_dir)))


@query(f"""
WITH {BARS},
a AS (SELECT code, date, close, lead(close, 5) OVER w AS c5, lead(close, 10) OVER w AS c10, lead(close, 20) OVER w AS c20 FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)),
b AS (SELECT code, date, CASE WHEN c20 IS NOT NULL THEN 100 * (c5 / close - 1) END AS f5, CASE WHEN c20 IS NOT NULL THEN 100 * (c10 / close - 1) END AS f10, 100 * (c20 / close - 1) AS f20,
  CASE code % 3 WHEN 0 THEN 'strong' WHEN 1 THEN 'neutral' ELSE 'weak' END AS rating FROM a)
SELECT code, date, rating, round(f5, 6) AS fwd_ret_5, round(f10, 6) AS fwd_ret_10, round(f20, 6) AS fwd_ret_20, CASE WHEN f20 IS NOT NULL THEN 'evaluated' ELSE 'insufficient_future_data' END AS gt_status,
  CASE WHEN f20 IS NULL THEN NULL WHEN rating = 'strong' THEN f20 > 0 WHEN rating = 'weak' THEN f20 <= 0 ELSE abs(f20) <= 5 END AS gt_pass
FROM b
""")
def w_forward_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rating = F.when(F.col("code") % 3 == 0, "strong").when(F.col("code") % 3 == 1, "neutral").otherwise("weak")
    out = labels.forward(bars(spark, sf_dir)).withColumn("rating", rating)
    out = out.withColumn("gt_pass", labels.outcome(F.col("rating"), F.col("fwd_ret_20")))
    return rounded(out.select("code", "date", "rating", *(f"fwd_ret_{h}" for h in labels.HORIZONS), "gt_status", "gt_pass"))


@query(f"""
WITH {PANEL}, ic AS (SELECT date, avg(ret) AS ic FROM panel GROUP BY date)
SELECT date, round(ic, 6) AS ic, round(avg(ic) OVER (ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS smooth,
  round(CASE WHEN count(ic) OVER m >= 5 THEN avg(ic) OVER m END, 6) AS matured
FROM ic WINDOW m AS (ORDER BY date ROWS BETWEEN 17 PRECEDING AND 6 PRECEDING)
""")
def w_smooth_and_lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothing without a guard, and the mean of a matured (lagged) series with one; the series
    has one row a date."""
    from pyspark.sql import Window

    daily = panel(spark, sf_dir).groupBy("date").agg(F.avg("ret").alias("ic"))
    w = Window.orderBy("date")
    old = w.rowsBetween(-17, -6)
    return rounded(daily.select("date", "ic", F.avg("ic").over(w.rowsBetween(-2, 0)).alias("smooth"), F.when(F.count("ic").over(old) >= 5, F.avg("ic").over(old)).alias("matured")))


@query(f"""
WITH {BARS}, d AS (SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM bars))
SELECT a.date, a.idx::INT AS idx, b.date AS plus20 FROM d a LEFT JOIN d b ON b.idx = a.idx + 20
""")
def c_trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = calendar.trading_days(bars(spark, sf_dir))
    later = days.select(F.col("date").alias("plus20"), (F.col("idx") - 20).alias("idx"))
    return days.join(later, "idx", "left").select("date", "idx", "plus20")


def _weekday(d: int) -> str:
    return f"""
WITH {BARS}, d AS (SELECT DISTINCT date, isoyear(date)::INT AS iso_year, week(date)::INT AS iso_week, isodow(date) - 1 AS d FROM bars),
r AS (SELECT *, row_number() OVER (PARTITION BY iso_year, iso_week ORDER BY CASE WHEN d = {d} THEN 0 WHEN d < {d} THEN {d} - d ELSE 10 + d END) AS rn FROM d)
SELECT iso_year, iso_week, date FROM r WHERE rn = 1"""


@query(_weekday(1))
def c_tuesdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.weekday_schedule(bars(spark, sf_dir), 1)


@query(_weekday(4))
def c_fridays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.weekday_schedule(bars(spark, sf_dir), 4)


@query(f"""
WITH {BARS}, d AS (SELECT DISTINCT date FROM bars),
r AS (SELECT date, row_number() OVER (ORDER BY date) AS idx, row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY date) AS m FROM d)
SELECT date, (idx - 1) % 10 = 0 AS every_nth, m = 1 AS month_first, isodow(date) = 2 AS tuesday, isodow(date) = 5 AS friday, week(date) % 2 = 0 AS even_week FROM r
""")
def c_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.frequency(calendar.rebalance_dates(bars(spark, sf_dir)))


@query(f"""
WITH {PANEL}, d AS (SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM panel)),
n AS (SELECT max(idx) AS n FROM d), s AS (SELECT date, CASE WHEN idx <= floor(n * 0.65)::INT + 1 THEN 'train' ELSE 'valid' END AS part FROM d, n)
SELECT part, 'H' || year(date) || '_' || CASE WHEN month(date) <= 6 THEN '1' ELSE '2' END AS block, count(*) AS n, round(avg(fwd), 6) AS mean_fwd FROM panel JOIN s USING (date) GROUP BY 1, 2
""")
def l_time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = calendar.split(panel(spark, sf_dir))
    return rounded(marked.groupBy("part", calendar.half_year().alias("block")).agg(F.count("*").alias("n"), F.avg("fwd").alias("mean_fwd")))


@query(f"""
WITH {PANEL}, d AS (SELECT date, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM panel)),
e AS (SELECT max(idx) AS n, greatest(floor(max(idx) * 0.4), 8)::INT AS first FROM d),
t AS (SELECT first, ceil((n - first) / 4.0)::INT AS size, unnest([1, 2, 3, 4]) AS fold FROM e),
r AS (SELECT fold, date, CASE WHEN idx <= first + (fold - 1) * size THEN 'train' WHEN idx <= first + fold * size THEN 'valid' END AS role FROM d, t)
SELECT fold, role, count(*) AS n_rows, count(DISTINCT date) AS n_dates, round(avg(fwd), 6) AS mean_fwd FROM r JOIN panel USING (date) WHERE role IS NOT NULL GROUP BY 1, 2
""")
def l_walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir)
    return rounded(calendar.folds(rows).join(rows, "date").groupBy("fold", "role").agg(F.count("*").alias("n_rows"), F.count_distinct("date").alias("n_dates"), F.avg("fwd").alias("mean_fwd")))


@query(f"""
WITH {PANEL}, f AS (SELECT code, date, CASE WHEN lead(close, 6) OVER w IS NOT NULL THEN close END AS c, lead(close, 1) OVER w AS c1, lead(close, 3) OVER w AS c3, lead(close, 6) OVER w AS c6 FROM panel WINDOW w AS (PARTITION BY code ORDER BY date))
SELECT h AS horizon, count(*) AS n, round(avg(r), 6) AS mean_ret, round(avg((r > 0)::INT), 6) AS pos_rate FROM (
  SELECT 1 AS h, 100 * (c1 / c - 1) AS r FROM f UNION ALL SELECT 3, 100 * (c3 / c - 1) FROM f UNION ALL SELECT 6, 100 * (c6 / c - 1) FROM f) WHERE r IS NOT NULL GROUP BY 1
""")
def m_multi_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = labels.forward(panel(spark, sf_dir), (1, 3, 6))
    long = f.select(F.stack(F.lit(3), F.lit(1), F.col("fwd_ret_1"), F.lit(3), F.col("fwd_ret_3"), F.lit(6), F.col("fwd_ret_6")).alias("horizon", "r")).where("r is not null")
    return rounded(long.groupBy("horizon").agg(F.count("*").alias("n"), F.avg("r").alias("mean_ret"), F.avg((F.col("r") > 0).cast("int")).alias("pos_rate")))


@query(f"""
WITH {BARS}
SELECT code, min(date) AS first_date, max(date) AS last_date, round(100 * (max_by(close, date) / min_by(close, date) - 1), 6) AS hold_ret, count(*) AS n,
 CASE WHEN datediff('day', max(date), DATE '2001-12-31') < 0 THEN 'future_date' WHEN datediff('day', max(date), DATE '2001-12-31') < 60 THEN 'gt_pending' ELSE 'evaluated' END AS gt_maturity
FROM bars GROUP BY code
""")
def a_hold_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = bars(spark, sf_dir).groupBy("code").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), (100 * (F.max_by("close", "date") / F.min_by("close", "date") - 1)).alias("hold_ret"), F.count("*").alias("n"))
    marked = labels.maturity(held.withColumn("date", F.col("last_date")), F.to_date(F.lit("2001-12-31")), 60).drop("date")
    return rounded(marked)
