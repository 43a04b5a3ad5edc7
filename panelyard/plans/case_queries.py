"""Queries of time-safe case retrieval, named gates over splits, and correlations by matrix blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.functions.expr import rounded
from panelyard.functions.windows import by_code
from panelyard.operators import cases, cross, gates
from panelyard.plans.signals import SIGNALS, signals
from panelyard.plans.sql import PANEL
from panelyard.plans.sql import zscore as z_sql
from panelyard.sources.folders import scratch
from panelyard.sources.tables import panel

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


FEATURES = ["ret", "ret3", "volume", "drawdown", "volatility_ratio", "peer_relative", "peer_mean"]
#: Rows of the panel are numbered by code and date; t_analogue_hits asks those divisible by 50.
ROW_ID, EACH = "code * 101 + date_idx", 50


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel rows as cases: context vector, tags, outcome and the date from which it is known."""
    w = by_code()
    spread = lambda n: F.stddev_samp("ret").over(w.rowsBetween(-(n - 1), 0))
    rows = cross.peers(cases.calendar_index(panel(spark, sf_dir)))
    rows = rows.withColumns({"drawdown": 100 * (F.col("close") / F.max("close").over(w.rowsBetween(-5, 0)) - 1), "volatility_ratio": F.try_divide(spread(3), spread(12))})
    return cases.context(rows, FEATURES, cases.largest_industries(rows))


_Z = lambda c: f"coalesce({z_sql(c, 'date', ddof=0, least=1)}, 0.0)"
_CASES = f"""{PANEL}, ti AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS date_idx FROM (SELECT DISTINCT date FROM panel)),
tm AS (SELECT *, lead(date_idx, {cases.HORIZON}) OVER (ORDER BY date_idx) AS maturity_idx FROM ti),
c0 AS (SELECT p.*, date_idx, maturity_idx, count(ret) OVER g AS known, sum(ret) OVER g AS s_, 100 * (close / max(close) OVER (PARTITION BY code ORDER BY date ROWS 5 PRECEDING) - 1) AS drawdown,
  stddev_samp(ret) OVER (PARTITION BY code ORDER BY date ROWS 2 PRECEDING) / nullif(stddev_samp(ret) OVER (PARTITION BY code ORDER BY date ROWS 11 PRECEDING), 0) AS volatility_ratio FROM panel p JOIN tm USING (date) WINDOW g AS (PARTITION BY date, industry)),
c1 AS (SELECT *, CASE WHEN ret IS NOT NULL AND known > 1 THEN (s_ - ret) / (known - 1) END AS peer_mean FROM c0),
c2 AS (SELECT *, ret - peer_mean AS peer_relative FROM c1),
c3 AS (SELECT *, -({_Z('ret')} + {_Z('ret3')} + {_Z('peer_mean')}) / 3 AS reversal FROM c2),
top AS (SELECT industry AS top_industry, row_number() OVER (ORDER BY count(*) DESC, industry) AS place FROM c3 GROUP BY 1 ORDER BY 2 LIMIT {cases.TOP_INDUSTRIES}),
tops AS (SELECT list(top_industry ORDER BY place) AS names FROM top),
c4 AS (SELECT *, list_concat([{', '.join(('-1.0 * ' if f in cases.FLIPPED else '') + _Z(f) for f in FEATURES)}, {_Z('reversal')}], list_transform(names, lambda i: (i = coalesce(industry, 'UNKNOWN'))::INT::DOUBLE)) AS raw FROM c3, tops),
lib AS (SELECT code, date, date_idx, maturity_idx, industry, fwd, list_transform(raw, lambda x: x / coalesce(nullif(sqrt(list_dot_product(raw, raw)), 0), 1)) AS v,
  list_filter([CASE WHEN reversal >= 0.5 THEN 'reversal_pullback' END, CASE WHEN drawdown <= -15 THEN 'deep_drawdown' END, CASE WHEN peer_mean > ret THEN 'weak_peer' END, CASE WHEN peer_relative < 0 THEN 'industry_laggard' END, CASE WHEN volatility_ratio >= 1.2 THEN 'high_volatility' END], lambda x: x IS NOT NULL) AS tags FROM c4),
own_n AS (SELECT industry, maturity_idx, count(*) AS n FROM lib WHERE maturity_idx IS NOT NULL GROUP BY 1, 2),
q0 AS (SELECT *, {ROW_ID} AS query_id, (SELECT coalesce(sum(n), 0) FROM own_n o WHERE o.industry IS NOT DISTINCT FROM lib.industry AND o.maturity_idx <= lib.date_idx) AS n_own, (SELECT coalesce(sum(n), 0) FROM own_n o WHERE o.maturity_idx <= lib.date_idx) AS n_all FROM lib),
ask AS (SELECT *, CASE WHEN n_own >= {cases.K} THEN n_own ELSE n_all END::BIGINT AS n_candidates FROM q0),
hit0 AS (SELECT q.query_id, q.code AS q_code, q.date AS q_date, q.date_idx AS q_at, b.code, b.date_idx, b.maturity_idx, b.fwd, b.tags, round(list_dot_product(q.v, b.v), 9) AS similarity FROM ask q JOIN lib b ON b.maturity_idx <= q.date_idx WHERE n_own < {cases.K} OR b.industry IS NOT DISTINCT FROM q.industry),
hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, date_idx, code) AS rank FROM hit0) WHERE rank <= {cases.K})"""
_SOME_CASES = _CASES.replace(" FROM lib),", f" FROM lib WHERE ({ROW_ID}) % {EACH} = 0),")


def _found(spark: SparkSession, sf_dir: str, each: int = 1) -> tuple[DataFrame, DataFrame]:
    path = scratch(spark, "library")
    library(spark, sf_dir).write.parquet(path)  # read for the cases, their numbers and the queries
    whole = spark.read.parquet(path)
    asked = whole.withColumn("query_id", F.expr(ROW_ID).cast("long")).where(F.col("query_id") % each == 0)
    return cases.analogues(asked.select("query_id", "code", "date", "date_idx", "industry", "v"), whole)


_STATS = ["analogue_base_rate", "analogue_pos_rate", "analogue_std", "regime_recent_mean", "regime_older_mean", "regime_decay_signal"]


@query(f"""
WITH {_CASES}, st AS (SELECT query_id, avg(fwd) AS analogue_base_rate, avg((fwd > 0)::INT) AS analogue_pos_rate, stddev_pop(fwd) AS analogue_std, avg(fwd) FILTER (date_idx >= q_at - {cases.RECENT}) AS regime_recent_mean, avg(fwd) FILTER (date_idx < q_at - {cases.RECENT}) AS regime_older_mean FROM hit GROUP BY 1),
tg AS (SELECT query_id, rank, unnest(tags) AS tag, generate_subscripts(tags, 1) AS nth FROM hit),
tc AS (SELECT query_id, tag, count(*) AS n, min(rank * 10 + nth) AS first FROM tg GROUP BY 1, 2),
dm AS (SELECT query_id, arg_max(tag, n * 1000 - first) AS dominant FROM tc GROUP BY 1)
SELECT code, date, {', '.join(f'round(CASE WHEN n_candidates >= {cases.K} THEN {c} END, 6) AS {c}' for c in _STATS[:5])}, round(CASE WHEN n_candidates >= {cases.K} THEN regime_recent_mean - regime_older_mean END, 6) AS regime_decay_signal, n_candidates,
 CASE WHEN n_candidates >= {cases.K} THEN coalesce(dominant, '') ELSE '' END AS dominant_skill_tag FROM ask LEFT JOIN st USING (query_id) LEFT JOIN dm USING (query_id)
""")
def t_analogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each row's most similar cases that were mature by its date."""
    return rounded(cases.outcomes(*_found(spark, sf_dir)))


@query(f"WITH {_SOME_CASES} SELECT query_id, rank, code, date_idx, maturity_idx, round(similarity, 6) AS similarity, round(fwd, 6) AS fwd FROM hit")
def t_analogue_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases themselves, best first, of every fiftieth row."""
    hits, _ = _found(spark, sf_dir, EACH)
    return rounded(hits.select("query_id", "rank", "code", "date_idx", "maturity_idx", "similarity", "fwd"))


@query(f"WITH {_CASES} SELECT q_at // 12 AS year_idx, count(*) AS n_hits, count(*) FILTER (maturity_idx IS NULL OR maturity_idx > q_at OR date_idx >= q_at) AS n_violations FROM hit GROUP BY 1")
def q_analogue_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits whose outcome was not known at the query's date: there must be none."""
    hits, asked = _found(spark, sf_dir)
    both = hits.select("query_id", "date_idx", "maturity_idx").join(asked.select("query_id", F.col("date_idx").alias("at")), "query_id")
    late = F.col("maturity_idx").isNull() | (F.col("maturity_idx") > F.col("at")) | (F.col("date_idx") >= F.col("at"))
    return both.groupBy(F.floor(F.col("at") / 12).alias("year_idx")).agg(F.count("*").alias("n_hits"), F.count_if(late).alias("n_violations"))


# -- named gates ------------------------------------------------------------------------------

_TEST_FROM = 2000
_SPLIT = f"""{SIGNALS}, gd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM sg WHERE year(date) < {_TEST_FROM})),
cut AS (SELECT max(date) FILTER (i = floor(n * 0.65)) AS cutoff, max(n) AS n FROM gd),
gs AS (SELECT sg.*, CASE WHEN year(date) >= {_TEST_FROM} THEN 'test' WHEN n < 4 OR date <= cutoff THEN 'search' ELSE 'valid' END AS split, CASE WHEN total_score >= 6 THEN '继续深挖' WHEN total_score >= 5 THEN '放入观察' WHEN total_score >= 3.5 THEN '暂时剔除' ELSE '信息不足' END AS rating FROM sg, cut),
gl AS (SELECT split, unnest({[g.name for g in gates.GATES]}) AS gate, unnest([{', '.join(f'coalesce({g.sql}, false)' for g in gates.GATES)}]) AS ok, return_20d AS r FROM gs),
gm AS (SELECT gate, split, count(*) AS sample_count, avg(r) AS avg_return_20d, avg((r > 0)::INT) AS positive_20d_rate, stddev_samp(r) AS std_return_20d, avg((r <= -5)::INT) AS loss_20d_over_5_rate FROM gl WHERE ok GROUP BY 1, 2)"""
_METRICS = ["avg_return_20d", "positive_20d_rate", "std_return_20d", "loss_20d_over_5_rate"]


def _gate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("total_score")
    rating = F.when(s >= 6, "继续深挖").when(s >= 5, "放入观察").when(s >= 3.5, "暂时剔除").otherwise("信息不足")
    rows = signals(spark, sf_dir).withColumn("rating", rating)
    return gates.metrics(gates.split(rows, F.year("date") >= _TEST_FROM))


@query(f"WITH {_SPLIT} SELECT gate, split, sample_count, {', '.join(f'round({c}, 6) AS {c}' for c in _METRICS)} FROM gm")
def l_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 37 named gates on search, validation and test dates, in one pass over the rows."""
    return rounded(_gate_metrics(spark, sf_dir).select("gate", "split", "sample_count", *_METRICS))


_HIT = lambda p, least: f"coalesce({p}_sample_count >= {least} AND {p}_avg_return_20d >= {gates.TARGET_AVG} AND {p}_positive_20d_rate >= {gates.TARGET_POS}, false)"


@query(f"""
WITH {_SPLIT}, gz AS (SELECT *, avg_return_20d - 0.5 * coalesce(std_return_20d, 0) - 10 * loss_20d_over_5_rate AS stability_score FROM gm),
gw AS (SELECT gate, {', '.join(f"max({c}) FILTER (split = '{p}') AS {p}_{c}" for p in gates.SPLITS for c in ('sample_count', 'avg_return_20d', 'positive_20d_rate', 'stability_score'))} FROM gz GROUP BY 1),
gx AS (SELECT *, {_HIT('search', gates.LEAST['search'])} AND {_HIT('valid', gates.LEAST['valid'])} AS target_hit_on_valid FROM gw)
SELECT gate, coalesce(search_sample_count, 0) AS search_sample_count, coalesce(valid_sample_count, 0) AS valid_sample_count, coalesce(test_sample_count, 0) AS test_sample_count, target_hit_on_valid, target_hit_on_valid AND {_HIT('test', gates.LEAST['test'])} AS target_hit_on_test,
 round(coalesce(valid_avg_return_20d, -999) + coalesce(valid_positive_20d_rate, 0) * 10 + coalesce(valid_stability_score, -999) * 0.2, 6) AS selection_score FROM gx
""")
def l_gate_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which gates hit their targets on validation and test dates, and by what they are ranked."""
    return rounded(gates.chosen(_gate_metrics(spark, sf_dir)))


# -- correlations -----------------------------------------------------------------------------


_LEAST_PAIRS, _PEERS = 24, 10


@query(f"""
WITH {PANEL}, r AS (SELECT code, date, ret FROM panel WHERE ret IS NOT NULL),
c AS (SELECT a.code, b.code AS peer, count(*) AS n, corr(a.ret, b.ret) AS corr FROM r a JOIN r b ON a.date = b.date AND a.code <> b.code GROUP BY 1, 2 HAVING count(*) >= {_LEAST_PAIRS}),
k AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY round(corr, 9) DESC, peer) AS rank FROM c WHERE corr > 0)
SELECT code, peer, n, round(corr, 6) AS corr, rank FROM k WHERE rank <= {_PEERS}
""")
def x_correlation_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each code's ten most correlated peers, over all areas, by products of matrix blocks."""
    from panelyard.operators import gram

    rows = panel(spark, sf_dir).where("ret IS NOT NULL").select("code", "date", F.col("ret").alias("x"))
    return rounded(gram.best_peers(rows, _PEERS, least=_LEAST_PAIRS))
