"""Queries of single-name checks, factors, score profiles, cases and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.functions.expr import rounded
from panelyard.operators import policy, single
from panelyard.plans.decisions import DECISIONS, decisions
from panelyard.plans.sql import BARS, EVENTS
from panelyard.sources.tables import bars, stream_events, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""
WITH {BARS}, b AS (SELECT code, close, max(close) OVER p AS high, count(*) OVER p AS n, 100 * (lead(close, 20) OVER w / close - 1) AS r20, lead(close, 60) OVER w AS far
 FROM bars WINDOW w AS (PARTITION BY code ORDER BY date), p AS (PARTITION BY code ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)), s AS (SELECT *, n = 20 AND close > high AND far IS NOT NULL AS hit FROM b)
SELECT code, count(*) FILTER (hit) AS n_signals, round(avg(r20) FILTER (hit), 6) AS mean_20d, round(100 * avg((r20 > 0)::INT) FILTER (hit), 6) AS win_rate FROM s GROUP BY code HAVING count(*) >= 80
""")
def w_breakouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(single.breakouts(bars(spark, sf_dir)))


@query(f"""
WITH {BARS}, l AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS back FROM bars)
SELECT code, date, high - greatest(close, open) > abs(close - open) * 2 AS long_upper, least(close, open) - low > abs(close - open) * 2 AS long_lower, close > open AS gain FROM l WHERE back = 1
""")
def w_last_candle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single.last_candle(bars(spark, sf_dir))


_TREND = f"""{BARS}, l AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS back FROM bars),
tr AS (SELECT code, max(date) AS date, count(*) AS n, max(close) FILTER (back = 1) AS close, min(close) FILTER (back <= 20) AS low,
 {', '.join(f'avg(close) FILTER (back <= {n}) AS ma{n}, max(close) FILTER (back = {n}) AS c{n}' for n in single.LENGTHS)} FROM l GROUP BY code),
t AS (SELECT code, date, (4 + {' + '.join(f'(n >= {n} AND close > ma{n})::INT' for n in single.LENGTHS)})::INT AS score,
 {', '.join(f'CASE WHEN n > {n} THEN round(100 * (close / c{n} - 1), 6) END AS change{n}' for n in single.LENGTHS)}, n > 20 AND close < low * 1.02 AS near_low FROM tr)"""


@query(f"WITH {_TREND} SELECT * FROM t")
def w_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(single.trend(bars(spark, sf_dir)))


_TOPICS = ["1|3|5", "2|4|6|8"]


@query(f"""
WITH {_TREND}, s AS (SELECT s_suppkey AS code, s_name, s_acctbal, t.score AS trend_score, coalesce(near_low, false) AS near_low FROM supplier LEFT JOIN t ON code = s_suppkey),
k AS (SELECT *, {' + '.join(f"coalesce(regexp_matches(s_name, '{t}'), false)::INT" for t in _TOPICS)} AS topics, (s_acctbal <> 0)::INT AS ratios FROM s),
m AS (SELECT *, CASE WHEN coalesce(s_name, '') = '' THEN 3 WHEN topics = 2 THEN 5 ELSE 4 END AS financial, CASE WHEN s_acctbal IS NULL THEN 3 ELSE 4 END AS valuation, 2 - topics + 2 - ratios + near_low::INT AS items FROM k),
r AS (SELECT *, round((2 * financial + valuation + coalesce(trend_score, 3) + 6 + greatest(0, 10 - items) + CASE WHEN topics < 2 THEN 3 ELSE 5 END) / 8.0, 2)::DOUBLE AS total FROM m)
SELECT code, financial, valuation, items::INT AS items, total, CASE WHEN s_acctbal < -900 THEN 'drop' WHEN topics < 2 THEN 'insufficient' WHEN total >= 6.5 THEN 'dig_deeper' WHEN total >= 4.5 THEN 'watch' ELSE 'insufficient' END AS rating FROM r
""")
def f_module_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's name stands for its report, its balance for one price ratio; the other is absent,
    as are news and book modules."""
    df = table(spark, sf_dir, "supplier").join(single.trend(bars(spark, sf_dir)).withColumnRenamed("score", "trend_score"), F.col("code") == F.col("s_suppkey"), "left")
    text, pe = F.col("s_name"), F.col("s_acctbal").cast("double")
    known = sum((F.coalesce(text.rlike(t), F.lit(False)).cast("int") for t in _TOPICS), F.lit(0))
    financial, valuation = single.financial_score(text, _TOPICS), single.valuation_score(pe, F.lit(None).cast("double"))
    items = 2 - known + 2 - F.coalesce((pe != 0).cast("int"), F.lit(0)) + F.coalesce("near_low", F.lit(False)).cast("int")
    total, rating = single.rating([financial, financial, valuation, F.col("trend_score"), F.lit(None).cast("int"), F.lit(None).cast("int")], items, known < 2, F.coalesce(pe < -900, F.lit(False)))
    return df.select(F.col("s_suppkey").alias("code"), financial.alias("financial"), valuation.alias("valuation"), items.alias("items"), total.alias("total"), rating.alias("rating"))


_BUCKETS = {"trade": ["purchase", "signup"], "attention": ["view", "click"], "fault": ["error"], "entry": ["signup"]}


@query(f"""
WITH {EVENTS} SELECT code, count(*) AS n, {', '.join(f"round(sum(CASE WHEN regexp_matches(event_type, '{'|'.join(v)}') THEN CASE WHEN k < 20 THEN -value ELSE value END ELSE 0.0 END), 6) AS {k}" for k, v in _BUCKETS.items())} FROM ev GROUP BY code
""")
def a_signed_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = single.signed_buckets(F.col("event_type"), F.col("value").cast("double"), F.coalesce(F.col("k") < 20, F.lit(False)), _BUCKETS)
    return rounded(stream_events(spark, sf_dir).groupBy("code").agg(F.count("*").alias("n"), *(c.alias(k) for k, c in parts.items())))


@query(f"""
WITH {EVENTS} SELECT code, event_date AS decision_date, max(ts) AS available_at, count(*) AS n_events, round(max(value), 6) AS materiality, round(avg(k), 6) AS surprise, round(avg((k IS NULL)::INT), 6) AS missing_rate,
 array_to_string(list_sort(list(DISTINCT event_type)), ';') AS event_types FROM ev WHERE code IS NOT NULL GROUP BY code, event_date
""")
def a_report_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a code and day as one row."""
    types = F.concat_ws(";", F.array_sort(F.collect_set("event_type"))).alias("event_types")
    day = stream_events(spark, sf_dir).where("code is not null").groupBy("code", F.col("event_date").alias("decision_date"))
    return rounded(day.agg(F.max("ts").cast("timestamp_ntz").alias("available_at"), F.count("*").alias("n_events"), F.max("value").alias("materiality"), F.avg("k").alias("surprise"), F.avg(F.col("k").isNull().cast("int")).alias("missing_rate"), types))


@query("""
WITH r AS (SELECT o_custkey AS code, CAST(o_orderdate AS DATE) AS date, o_orderkey AS pos, o_totalprice::DOUBLE AS total FROM orders), q AS (SELECT DISTINCT code, make_date(year(date), 6, 30) AS date FROM r)
SELECT q.code, q.date, max(r.pos) AS pos, round(max_by(r.total, r.pos), 6) AS total FROM q LEFT JOIN r ON r.code = q.code AND r.date <= q.date GROUP BY 1, 2
""")
def j_last_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order by list order that was known at the middle of each year with orders."""
    records = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("code"), F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").cast("double").alias("total"))
    asked = records.select("code", F.make_date(F.year("date"), F.lit(6), F.lit(30)).alias("date")).distinct()
    return rounded(single.last_listed(asked, records, "total"))


@query("""
WITH p AS (SELECT l_suppkey AS code, date_trunc('month', l_shipdate)::DATE AS date, (l_extendedprice / l_quantity)::DOUBLE AS price, l_extendedprice::DOUBLE AS v, l_returnflag FROM lineitem WHERE l_quantity > 0),
g AS (SELECT code, date, quantile_cont(price, 0.05) AS c5, quantile_cont(price, 0.15) AS c15, quantile_cont(price, 0.5) AS c50, quantile_cont(price, 0.85) AS c85, quantile_cont(price, 0.95) AS c95, avg(price) AS close,
 coalesce(sum(v) FILTER (l_returnflag = 'R'), 0) AS rz, coalesce(sum(v) FILTER (l_returnflag = 'A'), 0) AS rq, sum(v) AS total FROM p GROUP BY 1, 2)
SELECT code, date, round((c85 - c15) / greatest(c50, 1e-6), 6) AS concentration, round(nullif(c95 - c5, 0) / greatest(c50, 1e-6), 6) AS band_width, round((c95 - c50) / greatest(c50, 1e-6), 6) AS overhang, round((c50 - c5) / greatest(c50, 1e-6), 6) AS support,
 round((close - c5) / nullif(c95 - c5, 0), 6) AS position, round((close - c50) / greatest(c50, 1e-6), 6) AS over_median, round(rz / nullif(rq, 0), 6) AS margin_ratio, round(-ln(greatest(rz, 1)), 6) AS small_margin, round(-ln(greatest(total, 1)), 6) AS small_size,
 round(CASE WHEN rz > 0 THEN 1 / (total / rz) END, 6) AS earnings_yield FROM g
""")
def f_cost_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of a code's month stand for the costs of its holders, flagged amounts for margins. The
    exact percentiles hold one month of one code."""
    at = [0.05, 0.15, 0.5, 0.85, 0.95]
    p = table(spark, sf_dir, "lineitem").where("l_quantity > 0").select(F.col("l_suppkey").alias("code"), F.to_date(F.trunc("l_shipdate", "month")).alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("price"), F.col("l_extendedprice").cast("double").alias("v"), "l_returnflag")
    flagged = lambda x: F.sum(F.when(F.col("l_returnflag") == x, F.col("v")).otherwise(0.0))
    g = p.groupBy("code", "date").agg(F.percentile("price", F.array(*map(F.lit, at))).alias("c"), F.avg("price").alias("close"), flagged("R").alias("rz"), flagged("A").alias("rq"), F.sum("v").alias("total"))
    g = g.withColumns({f"c{round(100 * q)}": F.col("c")[i] for i, q in enumerate(at)})
    parts = single.cost_factors() | {"margin_ratio": F.col("rz") / F.nullif("rq", F.lit(0.0)), "small_margin": single.small(F.col("rz")), "small_size": single.small(F.col("total")), "earnings_yield": single.inverse(F.when(F.col("rz") > 0, F.col("total") / F.col("rz")))}
    return rounded(g.select("code", "date", *(c.alias(k) for k, c in parts.items())))


_MODULES = {k: 1 / 8 for k in ("fundamental_quality", "financial_safety", "valuation_pressure", "trend_structure", "news_support", "book_strategy_match", "counterevidence_risk", "data_completeness")}


@query(f"""
WITH {DECISIONS}, r AS (SELECT *, CASE WHEN relative_strength_rank >= 0.7 THEN 'deep' WHEN relative_strength_rank >= 0.4 THEN 'watch' ELSE 'none' END AS rating FROM d WHERE return_20d IS NOT NULL),
s AS (SELECT count(*) FILTER (rating = 'deep' AND NOT gt_pass) > 0 AND coalesce(avg(drawdown60) FILTER (rating = 'deep' AND NOT gt_pass), 0) >= coalesce(avg(drawdown60) FILTER (gt_pass), 0) AS one,
 count(*) FILTER (rating = 'watch' AND NOT gt_pass) > 0 AND coalesce(avg(counter_score) FILTER (rating = 'watch' AND NOT gt_pass), 0) < 5 AS two FROM r)
SELECT module, round(0.125 + CASE module WHEN 'trend_structure' THEN -0.03 * one::INT WHEN 'counterevidence_risk' THEN 0.03 * one::INT WHEN 'book_strategy_match' THEN -0.03 * two::INT WHEN 'data_completeness' THEN 0.03 * two::INT ELSE 0 END, 6)::DOUBLE AS weight
FROM s, (VALUES {', '.join(f"('{m}')" for m in _MODULES)}) v(module)
""")
def l_weight_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights after a look at the rows that failed; one row of statistics decides."""
    r = F.col("relative_strength_rank")
    rows = decisions(spark, sf_dir).where("return_20d is not null").withColumn("rating", F.when(r >= 0.7, "deep").when(r >= 0.4, "watch").otherwise("none"))
    failed = lambda x: (F.col("rating") == x) & ~F.col("gt_pass")
    mean = lambda when, c: F.coalesce(F.avg(F.when(when, F.col(c))), F.lit(0.0))
    one = (F.count_if(failed("deep")) > 0) & (mean(failed("deep"), "drawdown60") >= mean(F.col("gt_pass"), "drawdown60"))
    two = (F.count_if(failed("watch")) > 0) & (mean(failed("watch"), "counter_score") < 5)
    stats = rows.agg(one.alias("one"), two.alias("two"))
    return rounded(single.moved(_MODULES, stats, [("trend_structure", "counterevidence_risk", F.col("one")), ("book_strategy_match", "data_completeness", F.col("two"))]))


_FEATURES = ["prior_return_20d", "kline_return_60d", "drawdown60", "counter_score"]


@query(f"""
WITH {DECISIONS}, p AS (SELECT *, lag(date) OVER w AS case_date, string_split(triggered_skills, ';') AS t, string_split(lag(triggered_skills) OVER w, ';') AS u, {', '.join(f'{c} - lag({c}) OVER w AS diff_{c}' for c in _FEATURES)}, lag(return_20d) OVER w AS outcome FROM d WINDOW w AS (PARTITION BY code ORDER BY date)),
b AS (SELECT *, list_sort(list_filter(list_intersect(t, u), lambda x: x <> '')) AS shared, len(list_filter(list_intersect(t, u), lambda x: x NOT IN ('', 'DOW-B-017'))) AS own FROM p WHERE case_date IS NOT NULL)
SELECT code, date, case_date, array_to_string(shared, ';') AS shared_skills, {', '.join(f'round(diff_{c}, 6) AS diff_{c}' for c in _FEATURES)}, round(outcome, 6) AS outcome,
 CASE WHEN len(shared) >= 2 AND own > 0 AND data_gaps = '' THEN 'applicable' WHEN len(shared) = 1 OR (len(shared) > 0 AND data_gaps <> '') THEN 'partial' ELSE 'none' END AS status FROM b
""")
def t_explained_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row against the case a row before it: shared skills, differences, applicability."""
    w = Window.partitionBy("code").orderBy("date")
    skills = lambda c: F.filter(F.split(c, ";"), lambda t: t != "")
    df = decisions(spark, sf_dir).withColumns({"case_date": F.lag("date").over(w), "tags": skills(F.col("triggered_skills")), "case_tags": skills(F.lag("triggered_skills").over(w)), "outcome": F.lag("return_20d").over(w)} | {f"diff_{c}": F.col(c) - F.lag(c).over(w) for c in _FEATURES}).where("case_date is not null")
    status = single.applicability(F.col("tags"), F.col("case_tags"), ["DOW-B-017"], F.col("data_gaps") != "")
    shared = F.concat_ws(";", F.array_sort(F.array_intersect("tags", "case_tags")))
    return rounded(df.select("code", "date", "case_date", shared.alias("shared_skills"), *(f"diff_{c}" for c in _FEATURES), "outcome", status.alias("status")))


_CHANNELS = {"price": "prior_return_20d IS NOT NULL", "history": "kline_return_60d IS NOT NULL", "peers": "peer_relative_to_group_20d IS NOT NULL", "skills": "triggered_skills <> ''", "gaps": "data_gaps <> ''"}


@query(f"""
WITH {DECISIONS}, c AS (SELECT time_block AS variant, count(*) AS records, {', '.join(f'count(*) FILTER ({v}) AS {k}' for k, v in _CHANNELS.items())} FROM d GROUP BY 1)
SELECT variant, channel, records, nonempty, round(nonempty / records, 6) AS coverage_rate FROM c, LATERAL (VALUES {', '.join(f"('{k}', {k})" for k in _CHANNELS)}, ('documents', 0)) v(channel, nonempty)
""")
def q_channel_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a signal by channel and variant; a channel without a column counts as empty."""
    df = decisions(spark, sf_dir)
    df = df.select("*", single.defaulted(df, "documents", ""))
    channels = {k: F.expr(v) for k, v in _CHANNELS.items()} | {"documents": F.col("documents") != ""}
    c = df.groupBy(F.col("time_block").alias("variant")).agg(F.count("*").alias("records"), *(F.count_if(v).alias(k) for k, v in channels.items()))
    long = c.unpivot(["variant", "records"], list(channels), "channel", "nonempty")
    return rounded(long.withColumn("coverage_rate", F.col("nonempty") / F.col("records")))


@query(f"""
WITH {DECISIONS}, top AS (SELECT industry FROM d GROUP BY 1 ORDER BY count(*) DESC, industry LIMIT 12),
z AS (SELECT code, date, industry, {', '.join(f"coalesce(CASE WHEN stddev_pop({c}) OVER w > 1e-12 THEN {'-' if c == 'drawdown60' else ''}({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w ELSE 0 END, 0) AS z{i}" for i, c in enumerate(_FEATURES))} FROM d WINDOW w AS (PARTITION BY date)),
l AS (SELECT *, (industry IN (SELECT industry FROM top))::INT AS mark, sqrt({' + '.join(f'z{i} * z{i}' for i in range(len(_FEATURES)))} + (industry IN (SELECT industry FROM top))::INT) AS length FROM z)
SELECT code, date, {', '.join(f'round(CASE WHEN length = 0 THEN z{i} ELSE z{i} / length END, 6) AS v{i}' for i in range(len(_FEATURES)))}, round(CASE WHEN length = 0 THEN 0 ELSE mark / length END, 6) AS industry_mark FROM l
""")
def t_context_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each row's unit vector; the mark is that of its industry, if it is a large one."""
    v = single.context_vectors(decisions(spark, sf_dir), _FEATURES, {"drawdown60"})
    mark = F.array_max(F.concat(F.slice("v", len(_FEATURES) + 1, 12), F.array(F.lit(0.0))))
    return rounded(v.select("code", "date", *(F.col("v")[i].alias(f"v{i}") for i in range(len(_FEATURES))), mark.alias("industry_mark")))


@query()
def s_diverse_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three codes a date, those first that the half-year has not taken yet."""
    return single.diverse(decisions(spark, sf_dir).withColumnRenamed("time_block", "block"), "counter_score", 3)
