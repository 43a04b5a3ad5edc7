"""Queries over cross-sections: scores, peers, correlations, selections and portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.functions.expr import rank_pct, rounded, winsorized, zscore
from panelyard.operators import calendar, cross
from panelyard.plans.sql import EVENTS, PANEL, UNIVERSE
from panelyard.plans.sql import rank_pct as rank_sql
from panelyard.plans.sql import zscore as z_sql
from panelyard.sources.tables import panel, stream_events, table, universe

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""
WITH {PANEL}
SELECT code, date, round({rank_sql('ret', 'date')}, 6) AS rank_date, round({rank_sql('ret', 'date', 'industry')}, 6) AS rank_industry,
  round({z_sql('ret', 'date')}, 6) AS z_date, round({z_sql('ret', 'date', ddof=0)}, 6) AS z0_date, round(ret - avg(ret) OVER (PARTITION BY date, industry), 6) AS neutral, round(fwd - avg(fwd) OVER (PARTITION BY date), 6) AS pool_excess
FROM panel
""")
def x_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel(spark, sf_dir)
    return rounded(df.select("code", "date", rank_pct("ret", "date").alias("rank_date"), rank_pct("ret", "date", "industry").alias("rank_industry"), zscore("ret", "date").alias("z_date"), zscore("ret", "date", ddof=0).alias("z0_date"), cross.neutral("ret", "date", "industry").alias("neutral"), cross.neutral("fwd", "date").alias("pool_excess")))


@query(f"""
WITH {PANEL}, q AS (SELECT *, quantile_cont(ret, 0.05) OVER (PARTITION BY date) AS lo, quantile_cont(ret, 0.95) OVER (PARTITION BY date) AS hi FROM panel),
w AS (SELECT *, CASE WHEN ret IS NOT NULL THEN greatest(lo, least(hi, ret)) END AS v FROM q)
SELECT code, date, round(v, 6) AS winsorized, round({z_sql('v', 'date')}, 6) AS z FROM w
""")
def x_winsor_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel(spark, sf_dir).withColumn("v", winsorized("ret", "date", tail=0.05))
    return rounded(df.select("code", "date", F.col("v").alias("winsorized"), zscore("v", "date").alias("z")))


@query(f"""
WITH {PANEL}, a AS (SELECT *, count(*) OVER w - 1 AS others, sum(ret) OVER w AS s, count(ret) OVER w AS known, sum((ret > 0)::INT) OVER w AS up FROM panel WINDOW w AS (PARTITION BY date, industry))
SELECT code, date, others AS peer_count, round(CASE WHEN ret IS NOT NULL AND known > 1 THEN (s - ret) / (known - 1) END, 6) AS peer_mean,
 round(coalesce(CASE WHEN others > 0 THEN (s - coalesce(ret, 0)) / others END, 0), 6) AS peer_mean_rows,
 round(CASE WHEN ret IS NOT NULL AND known > 1 THEN (up - (ret > 0)::INT) / (known - 1) END, 6) AS peer_breadth,
 round(ret - CASE WHEN ret IS NOT NULL AND known > 1 THEN (s - ret) / (known - 1) END, 6) AS peer_relative FROM a
""")
def x_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cross.peers(panel(spark, sf_dir)).select("code", "date", "peer_count", "peer_mean", "peer_mean_rows", "peer_breadth", "peer_relative"))


def _event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per user and day: n events, risk (errors), gain (purchases), nation as industry."""
    per = stream_events(spark, sf_dir).groupBy("code", F.col("event_date").alias("date")).agg(F.count("*").cast("double").alias("n"), F.count_if(F.col("event_type") == "error").alias("risk"), F.count_if(F.col("event_type") == "purchase").alias("gain"))
    return per.withColumn("industry", F.col("code") % 5)


@query(f"""
WITH {EVENTS}, a AS (SELECT code, event_date AS date, count(*)::DOUBLE AS n, count(*) FILTER (event_type = 'error') AS risk, count(*) FILTER (event_type = 'purchase') AS gain, code % 5 AS industry FROM ev GROUP BY 1, 2),
b AS (SELECT *, {rank_sql('n', 'date')} AS attention, coalesce(n / greatest(avg(n) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 1.0), 1.0) AS spike,
  n - coalesce((sum(n) OVER p - n) / nullif(count(*) OVER p - 1, 0), 0) AS gap FROM a WINDOW p AS (PARTITION BY date, industry)),
c AS (SELECT *, least(1, greatest(0, 0.6 * risk / n + 0.4 * attention)) AS warning, least(1, greatest(0, 0.6 * gain / n + 0.4 * attention)) AS opportunity FROM b)
SELECT code, date, round(attention, 6) AS attention, round(spike, 6) AS spike, round(gap, 6) AS gap, round(warning, 6) AS warning, round(opportunity, 6) AS opportunity,
 CASE WHEN warning >= 0.6 AND warning > opportunity THEN 'warning' WHEN opportunity >= 0.6 THEN 'opportunity' ELSE 'quiet' END AS label,
 concat_ws('+', CASE WHEN spike >= 1.5 THEN 'spike' END, CASE WHEN gap > 0 THEN 'above_peers' END, CASE WHEN attention >= 0.9 THEN 'top_attention' END) AS reason FROM c
""")
def x_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cross.alerts(_event_panel(spark, sf_dir))
    return rounded(out.select("code", "date", "attention", "spike", "gap", "warning", "opportunity", "label", "reason"))


_IC = """
r AS (SELECT date, ret, fwd, industry, rank() OVER (PARTITION BY date ORDER BY ret) + (count(*) OVER (PARTITION BY date, ret) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY date ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0 AS ry FROM panel WHERE ret IS NOT NULL AND fwd IS NOT NULL),
ic AS (SELECT date, count(*) AS n, corr(rx, ry) AS ic FROM r GROUP BY date HAVING count(*) >= 5 AND count(DISTINCT ret) >= 5)"""


@query(f"WITH {PANEL}, {_IC} SELECT date, n, round(ic, 6) AS ic FROM ic")
def m_rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cross.rank_ic(panel(spark, sf_dir), "ret", "fwd", "date", least=5))


@query(f"""
WITH {PANEL.replace('panel AS', 'panel9 AS')}, panel AS (SELECT code, date, industry, ret - avg(ret) OVER w AS ret, fwd - avg(fwd) OVER w AS fwd FROM panel9 WINDOW w AS (PARTITION BY date, area)), {_IC}
SELECT 'H' || year(date) || '_' || CASE WHEN month(date) <= 6 THEN '1' ELSE '2' END AS block, count(*) AS n_dates, round(avg(ic), 6) AS mean_ic, round(avg(ic) / nullif(stddev_samp(ic), 0), 6) AS icir, round(avg((ic > 0)::INT), 6) AS pos_rate
FROM ic GROUP BY 1
""")
def m_neutral_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RankIC of area-neutral values, summed up by half-year block."""
    df = panel(spark, sf_dir)
    own = df.withColumns({"ret": cross.neutral("ret", "date", "area"), "fwd": cross.neutral("fwd", "date", "area")})
    ic = cross.rank_ic(own, "ret", "fwd", "date", least=5).withColumn("block", calendar.half_year())
    return rounded(ic.groupBy("block").agg(F.count("*").alias("n_dates"), F.avg("ic").alias("mean_ic"), (F.avg("ic") / F.nullif(F.stddev_samp("ic"), F.lit(0.0))).alias("icir"), F.avg((F.col("ic") > 0).cast("int")).alias("pos_rate")))


@query(f"""
WITH {PANEL}, l AS (SELECT date, fwd, unnest(['ret', 'ret3', 'volume']) AS feature, unnest([ret, ret3, volume]) AS x FROM panel WHERE fwd IS NOT NULL),
r AS (SELECT feature, date, rank() OVER (PARTITION BY feature, date ORDER BY x) + (count(*) OVER (PARTITION BY feature, date, x) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY feature, date ORDER BY fwd) + (count(*) OVER (PARTITION BY feature, date, fwd) - 1) / 2.0 AS ry FROM l WHERE x IS NOT NULL),
ic AS (SELECT feature, date, corr(rx, ry) AS ic FROM r GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT feature, count(*) AS n_dates, round(avg(ic), 6) AS mean_ic, round(avg(ic) / stddev_samp(ic), 6) AS icir, round(avg((ic > 0)::INT), 6) AS pos_rate FROM ic GROUP BY 1
""")
def m_feature_ics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many features in one pass: unpivoted, then one grouped correlation."""
    long = panel(spark, sf_dir).unpivot(["date", "code", "fwd"], ["ret", "ret3", "volume"], "feature", "x")
    ic = cross.rank_ic(long, "x", "fwd", "feature", "date", least=5, distinct=1)
    return rounded(ic.groupBy("feature").agg(F.count("*").alias("n_dates"), F.avg("ic").alias("mean_ic"), (F.avg("ic") / F.stddev_samp("ic")).alias("icir"), F.avg((F.col("ic") > 0).cast("int")).alias("pos_rate")))


@query(f"""
WITH {PANEL}, p AS (SELECT date, fwd, (rank() OVER (PARTITION BY date ORDER BY ret) + (count(*) OVER (PARTITION BY date, ret) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS p FROM panel WHERE ret IS NOT NULL AND fwd IS NOT NULL),
s AS (SELECT date, count(*) AS n, avg(fwd) FILTER (p >= 0.9) AS top, avg(fwd) FILTER (p <= 0.1) AS bottom FROM p GROUP BY date HAVING count(*) >= 8)
SELECT date, n, round(top, 6) AS top, round(bottom, 6) AS bottom, round(top - bottom, 6) AS spread, round(top - bottom - 1.5, 6) AS net FROM s
""")
def m_decile_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cross.long_short(panel(spark, sf_dir), "ret", "fwd", least=8).withColumn("net", F.col("spread") - 1.5))


_PICKS = f"""WITH {PANEL}, k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ret DESC NULLS LAST, code) AS rank FROM panel), picks AS (SELECT * FROM k WHERE rank <= 5)"""


@query(f"{_PICKS} SELECT code, date, rank, round(ret, 6) AS ret, round(fwd, 6) AS fwd FROM picks")
def s_top_per_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cross.top_n(panel(spark, sf_dir), "ret", 5, "date").select("code", "date", "rank", "ret", "fwd"))


@query(f"""
WITH {PANEL}, k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ret DESC NULLS LAST, code) AS rank, greatest(1, ceil(count(*) OVER (PARTITION BY date) * 0.2)) AS k,
  row_number() OVER (PARTITION BY date ORDER BY ret NULLS FIRST, code DESC) AS low FROM panel)
SELECT date, count(*) AS n, round(avg(fwd), 6) AS mean_fwd FROM k WHERE rank <= k GROUP BY date
""")
def s_top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cross.top_share(panel(spark, sf_dir), "ret", 0.2, "date").groupBy("date").agg(F.count("*").alias("n"), F.avg("fwd").alias("mean_fwd")))


@query(f"""
{_PICKS}, s AS (SELECT date, list(code) AS codes FROM picks GROUP BY date),
t AS (SELECT date, codes, coalesce(lag(codes) OVER (ORDER BY date), []) AS before FROM s)
SELECT date, len(codes)::INT AS n, round(CASE WHEN greatest(len(codes), len(before)) = 0 THEN 0.0 ELSE 1 - len(list_intersect(codes, before)) / greatest(len(codes), len(before)) END, 6) AS turnover FROM t
""")
def m_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cross.turnover(cross.top_n(panel(spark, sf_dir), "ret", 5, "date")))


@query(f"""
{_PICKS}, s AS (SELECT date, list(code) AS codes, avg(fwd) AS pick, max(n) / sum(n) AS conc FROM (SELECT *, count(*) OVER (PARTITION BY date, area) AS n FROM picks) GROUP BY date),
pool AS (SELECT date, avg(fwd) AS pool FROM panel GROUP BY date),
t AS (SELECT *, coalesce(lag(codes) OVER (ORDER BY date), []) AS before FROM s JOIN pool USING (date)),
u AS (SELECT *, 1 - len(list_intersect(codes, before)) / greatest(len(codes), len(before)) AS turnover FROM t)
SELECT date, round(pick - pool, 6) AS excess, round(turnover, 6) AS turnover, round(1.5 * turnover, 6) AS cost, round(pick - pool - 1.5 * turnover, 6) AS net,
 round(avg(turnover) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS past_turnover FROM u
""")
def m_portfolio_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excess over the pool, turnover and its cost at 1.5 % a round trip. A row per date."""
    df = panel(spark, sf_dir)
    picks = cross.top_n(df, "ret", 5, "date")
    excess = picks.groupBy("date").agg(F.avg("fwd").alias("pick")).join(df.groupBy("date").agg(F.avg("fwd").alias("pool")), "date")
    out = excess.join(cross.turnover(picks), "date").withColumn("cost", 1.5 * F.col("turnover")).withColumn("excess", F.col("pick") - F.col("pool"))
    past = F.avg("turnover").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1))
    return rounded(out.select("date", "excess", "turnover", "cost", (F.col("excess") - F.col("cost")).alias("net"), past.alias("past_turnover")))


@query(f"""
WITH {PANEL}, k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ret DESC NULLS LAST, code) AS rank FROM panel),
h AS (SELECT *, coalesce(last_value(CASE WHEN rank > 8 THEN FALSE WHEN rank <= 3 THEN TRUE END IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING), FALSE) AS held FROM k)
SELECT date, count(*) AS n_held, round(avg(fwd), 6) AS mean_fwd FROM h WHERE held GROUP BY date
""")
def m_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cross.held(panel(spark, sf_dir), "ret", 3, 8).where("held").groupBy("date").agg(F.count("*").alias("n_held"), F.avg("fwd").alias("mean_fwd")))


@query(f"""
{_PICKS}, d AS (SELECT date, avg(fwd) AS r FROM picks WHERE fwd IS NOT NULL GROUP BY date)
SELECT count(*) AS n_dates, round(avg(r), 6) AS mean_ret, round(avg((r > 0)::INT), 6) AS pos_rate, round(stddev_pop(r), 6) AS spread, round(avg((r <= -5)::INT), 6) AS loss_rate,
 round(avg(r) - 0.5 * stddev_pop(r) - 10 * avg((r <= -5)::INT), 6) AS stability FROM d
""")
def a_portfolio_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = cross.top_n(panel(spark, sf_dir), "ret", 5, "date").where("fwd is not null").groupBy("date").agg(F.avg("fwd").alias("r"))
    loss = F.avg((F.col("r") <= -5).cast("int"))
    return rounded(daily.agg(F.count("*").alias("n_dates"), F.avg("r").alias("mean_ret"), F.avg((F.col("r") > 0).cast("int")).alias("pos_rate"), F.stddev_pop("r").alias("spread"), loss.alias("loss_rate"), (F.avg("r") - 0.5 * F.stddev_pop("r") - 10 * loss).alias("stability")))


@query(f"""
{_PICKS}, d AS (SELECT date, avg(fwd) AS r FROM picks GROUP BY date), c AS (SELECT DISTINCT date FROM panel),
b AS (SELECT c.date, coalesce(CASE WHEN month(c.date) % 3 <> 0 THEN r END, (pow(1.03, 20.0 / 252) - 1) * 100) AS v, month(c.date) % 3 <> 0 AND r IS NOT NULL AS active FROM c LEFT JOIN d USING (date))
SELECT 'H' || year(date) || '_' || CASE WHEN month(date) <= 6 THEN '1' ELSE '2' END AS block, count(*) AS n, count(*) FILTER (active) AS n_active, round(avg(v), 6) AS blended FROM b GROUP BY 1
""")
def a_cash_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates without a position earn cash."""
    df = panel(spark, sf_dir)
    daily = cross.top_n(df, "ret", 5, "date").groupBy("date").agg(F.avg("fwd").alias("r"))
    cash = (F.pow(F.lit(1.03), F.lit(20.0 / 252)) - 1) * 100
    active = (F.month("date") % 3 != 0) & F.col("r").isNotNull()
    out = df.select("date").distinct().join(daily, "date", "left").withColumn("v", F.when(active, F.col("r")).otherwise(cash))
    return rounded(out.groupBy(calendar.half_year().alias("block")).agg(F.count("*").alias("n"), F.count_if(active).alias("n_active"), F.avg("v").alias("blended")))


@query(f"""
WITH {PANEL}
SELECT date, count(*) AS n, count(DISTINCT industry) AS n_industries, round(avg(ret), 6) AS mean_ret, round(stddev_pop(ret), 6) AS spread, round(avg(coalesce(ret > 0, FALSE)::INT), 6) AS breadth_rows, round(avg((ret > 0)::INT), 6) AS breadth_known,
 round(quantile_cont(ret, 0.25), 6) AS q25, round(median(ret), 6) AS med, round(quantile_cont(ret, 0.75), 6) AS q75, min_by(industry, code) AS first_industry, max_by(industry, code) AS last_industry FROM panel GROUP BY date
""")
def a_regime_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelyard.functions.expr import share

    up = F.col("ret") > 0
    return rounded(panel(spark, sf_dir).groupBy("date").agg(F.count("*").alias("n"), F.count_distinct("industry").alias("n_industries"), F.avg("ret").alias("mean_ret"), F.stddev_pop("ret").alias("spread"), share(up).alias("breadth_rows"), share(up, False).alias("breadth_known"), F.percentile("ret", F.lit(0.25)).alias("q25"), F.median("ret").alias("med"), F.percentile("ret", F.lit(0.75)).alias("q75"), F.min_by("industry", "code").alias("first_industry"), F.max_by("industry", "code").alias("last_industry")))


@query(f"""
WITH {PANEL}, m AS (SELECT *, ret >= 10 AS flagged, fwd <= -5 AS lost FROM panel WHERE ret IS NOT NULL AND fwd IS NOT NULL)
SELECT coalesce(area, 'ALL') AS area, count(*) AS n, count(*) FILTER (flagged) AS n_flagged, round(count(*) FILTER (flagged AND lost) / nullif(count(*) FILTER (lost), 0), 6) AS recall, round(count(*) FILTER (flagged AND lost) / nullif(count(*) FILTER (flagged), 0), 6) AS precision,
 round((avg(lost::INT) + 1.28 * 1.28 / (2 * count(*)) - 1.28 * sqrt((avg(lost::INT) * (1 - avg(lost::INT)) + 1.28 * 1.28 / (4 * count(*))) / count(*))) / (1 + 1.28 * 1.28 / count(*)), 6) AS wilson
FROM m GROUP BY GROUPING SETS ((area), ())
""")
def a_totals_and_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk recall and precision and a Wilson bound per area and in ALL, by grouping sets."""
    rows = panel(spark, sf_dir).where("ret is not null and fwd is not null").withColumns({"flagged": F.col("ret") >= 10, "lost": F.col("fwd") <= -5})
    hit, n, p, z2 = F.count_if(F.col("flagged") & F.col("lost")), F.count("*"), F.avg(F.col("lost").cast("int")), 1.28 * 1.28
    bound = (p + z2 / (2 * n) - 1.28 * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n)
    out = rows.groupingSets([[F.col("area")], []], F.col("area")).agg(n.alias("n"), F.count_if("flagged").alias("n_flagged"), F.try_divide(hit, F.count_if("lost")).alias("recall"), F.try_divide(hit, F.count_if("flagged")).alias("precision"), bound.alias("wilson"))
    return rounded(out.withColumn("area", F.coalesce("area", F.lit("ALL"))))


@query(f"""
WITH {PANEL}, p AS (SELECT code, date, area, fwd, row_number() OVER (PARTITION BY date, area ORDER BY ret DESC NULLS LAST, code) AS r FROM panel WHERE fwd IS NOT NULL)
SELECT date, area, count(*) AS n, round(max(fwd) FILTER (r = 1), 6) AS top1, round(max(fwd) FILTER (r = 2), 6) AS top2, round(max(fwd) FILTER (r = 1) - avg(fwd), 6) AS edge1, round(max(fwd) - max(fwd) FILTER (r = 1), 6) AS regret, max_by(code, (fwd, -code)) AS best, min_by(code, (fwd, code)) AS worst FROM p GROUP BY 1, 2
""")
def m_group_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("date", "area").orderBy(F.desc_nulls_last("ret"), "code")
    rows = panel(spark, sf_dir).where("fwd is not null").withColumn("r", F.row_number().over(w))
    one, two = F.max(F.when(F.col("r") == 1, F.col("fwd"))), F.max(F.when(F.col("r") == 2, F.col("fwd")))
    return rounded(rows.groupBy("date", "area").agg(F.count("*").alias("n"), one.alias("top1"), two.alias("top2"), (one - F.avg("fwd")).alias("edge1"), (F.max("fwd") - one).alias("regret"), F.max_by("code", F.struct("fwd", -F.col("code"))).alias("best"), F.min_by("code", F.struct("fwd", "code")).alias("worst")))


@query(f"""
WITH {PANEL}, c AS (SELECT *, 0.5 * coalesce({rank_sql('ret', 'date')}, 0.5) + 0.3 * coalesce({rank_sql('ret3', 'date')}, 0.5) + 0.2 * coalesce({rank_sql('volume', 'date')}, 0.5) AS score,
  -(({z_sql('ret', 'date')}) + ({z_sql('ret3', 'date')})) / 2 AS raw FROM panel)
SELECT code, date, round(score, 6) AS score, round({z_sql('raw', 'date')}, 6) AS reversal FROM c
""")
def l_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cross.composite(panel(spark, sf_dir), {"ret": 0.5, "ret3": 0.3, "volume": 0.2}, "date")
    return rounded(cross.reversal(df, ["ret", "ret3"]).select("code", "date", "score", "reversal"))


@query(f"""
WITH {PANEL}, y AS (SELECT a.code, a.date, a.close, b.close AS prior FROM month1 a LEFT JOIN month1 b ON b.code = a.code AND b.date = a.date - INTERVAL 12 MONTH)
SELECT code, date, round(100 * (close / prior - 1), 6) AS yoy FROM y
""")
def j_prior_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel(spark, sf_dir).select("code", "date", "close")
    prior = df.select("code", F.add_months("date", 12).alias("date"), F.col("close").alias("prior"))
    return rounded(df.join(prior, ["code", "date"], "left").select("code", "date", (100 * (F.col("close") / F.col("prior") - 1)).alias("yoy")))


@query(f"""
WITH {PANEL}, a AS (SELECT p.code AS a, q.code AS b, count(*) AS n, corr(p.ret, q.ret) AS corr FROM panel p JOIN panel q ON p.date = q.date AND p.area = q.area AND p.code < q.code WHERE p.ret IS NOT NULL AND q.ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 24)
SELECT a, b, n, round(corr, 6) AS corr FROM a
""")
def j_return_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of returns within an area, by products of the area's matrix blocks: no row stands
    for a date and a pair."""
    from panelyard.operators import gram

    rows = panel(spark, sf_dir).where("ret IS NOT NULL AND area IS NOT NULL").select("code", "date", F.col("area").alias("part"), F.col("ret").alias("x"))
    return rounded(gram.correlations(rows, least=24, flat=True).select(F.col("code").alias("a"), F.col("peer").alias("b"), "n", "corr"))
