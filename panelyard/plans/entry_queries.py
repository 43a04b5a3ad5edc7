"""Queries over the signals table: statements, entry policies and their replay, learned positions,
walk-forward fits and guardrails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions.expr import rounded
from panelyard.operators import entries, guardrails, learners
from panelyard.plans.signals import SIGNALS, STATEMENTS, signals, statement_scores

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {STATEMENTS.strip()} SELECT code, period, interface, n_metrics, round(risk, 6) AS risk, round(surprise, 6) AS surprise, round(materiality, 6) AS materiality, round(missing_rate, 6) AS missing_rate FROM fs")
def f_statement_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements as maps of metrics: changes against the year before, ratios, risk, surprise."""
    return rounded(statement_scores(spark, sf_dir).select("code", "period", "interface", "n_metrics", "risk", "surprise", "materiality", "missing_rate"))


_SHOWN = """prior_return_20d kline_return_60d rsi14 atr20_pct drawdown60 upper_overhang lower_support news_warning_score news_opportunity_score news_net_materiality_30d news_conflict_intensity_30d
financial_quality_risk_score financial_surprise_score peer_relative_to_group_20d peer_group_positive_breadth_20d peer_group_above_ma200_rate peer_group_news_risk_avg agent_policy_score rev_chip_score_quantile
trend_score counter_score total_score pool_excess_20d pool_return_rank_pct""".split()
_PLAIN = ["code", "date", "close_above_ma200", "news_count_30d", "financial_report_event_count", "financial_report_join_status", "triggered_skills", "data_gaps", "sector_group", "time_block"]


@query(f"WITH {SIGNALS} SELECT {', '.join(_PLAIN)}, {', '.join(f'round({c}, 6) AS {c}' for c in _SHOWN)} FROM sg")
def w_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What policies and gates read: indicators of the last bar, prices by volume, peers, events, statements."""
    return rounded(signals(spark, sf_dir).select(*_PLAIN, *_SHOWN))


FACTS = f"""{SIGNALS},
fa AS (SELECT *, coalesce(news_warning_score, 0) AS nw, coalesce(news_opportunity_score, 0) AS no_, coalesce(financial_quality_risk_score, 0) AS fr, coalesce(financial_report_event_count, 0) AS fe, coalesce(financial_surprise_score, 0) AS fu,
  coalesce(peer_group_positive_breadth_20d, 0.5) AS pb, coalesce(peer_relative_to_group_20d, 0) AS pr, coalesce(prior_return_20d, 0) AS r20, coalesce(kline_return_60d, 0) AS r60, coalesce(rsi14, 50) AS rs, coalesce(upper_overhang, 0) AS uo, coalesce(lower_support, 0) AS ls,
  coalesce(rev_chip_score_quantile, 0.5) AS score_q, coalesce(agent_policy_score, 0) AS score FROM sg),
fb AS (SELECT *, (nw >= 0.67)::INT + (fr >= 0.70 OR (fe >= 1 AND fu <= -0.35))::INT + (pr <= -4 AND pb <= 0.40)::INT + ((r20 >= 25 AND rs >= 75 AND uo >= 0.25) OR (r60 >= 45 AND rs >= 78))::INT + (r20 <= -18 AND pr <= -3)::INT AS hard_risk_count,
  (no_ >= 0.33 AND nw < 0.5)::INT + (fe >= 1 AND fr <= 0.4 AND fu >= 0)::INT + (pb >= 0.58 AND pr >= 0)::INT + (ls >= 0.20)::INT AS support_count,
  pb >= 0.50 OR pr >= 0 AS peer_ok, coalesce(news_missing_rate, 1) >= 0.95 AND financial_report_join_status IN ('', 'no_event_in_window') AS sparse, r20 >= 20 AND rs >= 70 AND uo >= 0.20 AS heated FROM fa),
fx AS (SELECT *, hard_risk_count >= 2 OR (hard_risk_count >= 1 AND score_q < 0.88) AS hard_block FROM fb)"""
_POLICIES = f"""pol AS (SELECT * FROM (VALUES {', '.join(str(p) for p in entries.grid())}) t(variant, small_q, small_p, buy_q, buy_p, require_support, require_peer, sparse_cap, overheat_cap))"""
_CAPS = "CASE WHEN heated THEN least({c}, overheat_cap) ELSE {c} END"
_CAPPED = _CAPS.format(c="(CASE WHEN sparse THEN least({t}, sparse_cap) ELSE {t} END)")
_SCREEN = f"""{FACTS}, {_POLICIES},
s0 AS (SELECT variant, time_block, return_20d, sparse, heated, sparse_cap, overheat_cap, CASE WHEN NOT hard_block AND (NOT require_peer OR peer_ok) THEN CASE WHEN score_q >= buy_q AND score >= buy_p AND (NOT require_support OR support_count >= 1) THEN 0.80
   WHEN score_q >= small_q AND score >= small_p THEN 0.35 ELSE 0.0 END ELSE 0.0 END::DOUBLE AS t FROM fx, pol),
s1 AS (SELECT variant, time_block, return_20d, {_CAPPED.format(t='t')}::DOUBLE AS target FROM s0),
s2 AS (SELECT *, target >= 0.35 AS active, target * return_20d + (1 - target) * {entries.CASH!r} AS made FROM s1),
scr AS (SELECT variant, time_block, count(*) AS decision_count, count(*) FILTER (active) AS active_count, count(*) FILTER (active) / count(*) AS active_rate, avg((made > 0)::INT) FILTER (active) AS active_pos20, avg(made) FILTER (active) AS active_avg20,
  avg((made > 0)::INT) AS strategy_pos20, avg(made) AS strategy_avg20, avg((made <= -5)::INT) AS strategy_loss_gt5, avg(return_20d) AS hold_avg20, avg(target) AS avg_target_position, sum(made) AS made, count(made) AS n_known FROM s2 GROUP BY 1, 2)"""
_SCREENED = ["active_rate", "active_pos20", "active_avg20", "strategy_pos20", "strategy_avg20", "strategy_loss_gt5", "hold_avg20", "avg_target_position"]


@query(f"WITH {_SCREEN} SELECT variant, time_block, decision_count, active_count, {', '.join(f'round({c}, 6) AS {c}' for c in _SCREENED)} FROM scr")
def l_entry_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole grid of entry policies on each block, without positions carried over."""
    return rounded(entries.screen(entries.facts(signals(spark, sf_dir))).select("variant", "time_block", "decision_count", "active_count", *_SCREENED))


_CHOSEN = f"""{_SCREEN}, ord AS (SELECT time_block, row_number() OVER (ORDER BY time_block DESC) AS nth FROM (SELECT DISTINCT time_block FROM scr)),
tot AS (SELECT variant, sum(active_count) FILTER (nth > {entries.LATE_BLOCKS}) AS prior, sum(active_count) FILTER (nth <= {entries.LATE_BLOCKS}) AS late, sum(made) FILTER (nth > {entries.LATE_BLOCKS}) / sum(n_known) FILTER (nth > {entries.LATE_BLOCKS}) AS av FROM scr JOIN ord USING (time_block) GROUP BY 1),
chosen AS (SELECT variant FROM (SELECT variant, row_number() OVER (ORDER BY round(av, 9) DESC, variant) AS place FROM tot WHERE variant <> 'base_v4_like' AND prior >= {entries.LEAST_PRIOR} AND late >= {entries.LEAST_LATE}) WHERE place < {entries.SURVIVORS} UNION ALL SELECT 'base_v4_like')"""
_REPLAY = f"""{_CHOSEN},
k0 AS (SELECT fx.*, pol.*, CASE WHEN hard_block THEN 'hard_risk_blocks' WHEN score_q >= buy_q AND score >= buy_p AND (NOT require_support OR support_count >= 1) AND (NOT require_peer OR peer_ok) THEN 'buy_threshold_pass'
   WHEN score_q >= small_q AND score >= small_p AND hard_risk_count = 0 AND (NOT require_peer OR peer_ok) THEN 'small_entry_threshold_pass' ELSE 'below_threshold' END AS kind FROM fx, pol WHERE variant IN (SELECT variant FROM chosen)),
k1 AS MATERIALIZED (SELECT variant, code, date, time_block, return_20d, kind, score_q, hard_risk_count, sparse, heated, sparse_cap, overheat_cap, CASE kind WHEN 'buy_threshold_pass' THEN 0.80 WHEN 'small_entry_threshold_pass' THEN 0.35 ELSE 0.0 END::DOUBLE AS wanted,
   row_number() OVER (PARTITION BY variant, code ORDER BY date) AS i FROM k0),
run AS (SELECT variant, code, 0::BIGINT AS i, 0.0::DOUBLE AS before, 0.0::DOUBLE AS target, '' AS reason FROM (SELECT DISTINCT variant, code FROM k1)
 UNION ALL SELECT k.variant, k.code, k.i, run.target, {_CAPPED.format(t="(CASE WHEN k.kind = 'below_threshold' AND run.target > 0 AND k.score_q >= 0.55 AND k.hard_risk_count = 0 THEN least(run.target, 0.30) ELSE k.wanted END)")}::DOUBLE,
  (CASE WHEN k.kind = 'below_threshold' AND run.target > 0 AND k.score_q >= 0.55 AND k.hard_risk_count = 0 THEN 'hold_existing_small' ELSE k.kind END)
  || CASE WHEN k.sparse AND k.wanted > k.sparse_cap THEN ';sparse_news_fin_cap' ELSE '' END || CASE WHEN k.heated AND (CASE WHEN k.sparse THEN least(k.wanted, k.sparse_cap) ELSE k.wanted END) > k.overheat_cap THEN ';overheat_cap' ELSE '' END
  FROM run JOIN k1 k ON k.variant = run.variant AND k.code = run.code AND k.i = run.i + 1),
rep AS (SELECT k.variant, k.code, k.date, k.time_block, run.target, run.before, run.reason, k.return_20d, run.target * k.return_20d + (1 - run.target) * {entries.CASH!r} AS strategy_return_20d,
  CASE WHEN run.target <= 0 THEN CASE WHEN before > 0 THEN '卖出/不买' ELSE '等待不买' END WHEN before <= 0 THEN CASE WHEN run.target >= 0.35 THEN '买入' ELSE '小仓试探' END
   WHEN round(run.target - before, 9) >= 0.15 THEN '加仓' WHEN round(run.target - before, 9) <= -0.15 THEN '减仓' ELSE '持有' END AS action FROM run JOIN k1 k ON k.variant = run.variant AND k.code = run.code AND k.i = run.i)"""


def _replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries.facts(signals(spark, sf_dir))
    return entries.replay(rows, entries.survivors(entries.screen(rows)))


@query(f"WITH RECURSIVE {_REPLAY} SELECT variant, code, date, round(target, 6) AS target, action, reason FROM rep")
def l_entry_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The screen's survivors over each code's dates, with positions carried over."""
    return rounded(_replay(spark, sf_dir).select("variant", "code", "date", "target", "action", "reason"))


@query(f"""WITH RECURSIVE {_REPLAY} SELECT variant, time_block, count(*) AS decision_count, count(DISTINCT code) AS unique_stocks, count(DISTINCT date) AS decision_dates, count(*) FILTER (target >= 0.35) AS active_count, round(avg(target), 6) AS avg_target_position,
 round(avg(strategy_return_20d), 6) AS strategy_avg20, round(stddev_samp(strategy_return_20d), 6) AS strategy_std20, round(avg(strategy_return_20d) - avg(return_20d), 6) AS excess_vs_hold, count(*) FILTER (action IN ('买入', '小仓试探')) AS entries FROM rep GROUP BY 1, 2""")
def l_entry_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replayed policies' record by block."""
    s = F.col("strategy_return_20d")
    # a code counts by its first row of a block, so no row a code is dealt to count them
    out = _replay(spark, sf_dir).groupBy("variant", "time_block").agg(
        F.count("*").alias("decision_count"), F.count_if("opens_block").alias("unique_stocks"), F.count_distinct("date").alias("decision_dates"), F.count_if(F.col("target") >= entries.ACTIVE).alias("active_count"), F.avg("target").alias("avg_target_position"),
        F.avg(s).alias("strategy_avg20"), F.stddev_samp(s).alias("strategy_std20"), (F.avg(s) - F.avg("return_20d")).alias("excess_vs_hold"), F.count_if(F.col("action").isin("买入", "小仓试探")).alias("entries"),
    )
    return rounded(out)


# -- learned positions ------------------------------------------------------------------------


def _binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries.facts(signals(spark, sf_dir))
    heated = (F.coalesce("rsi14", F.lit(50.0)) >= 75) & (F.coalesce("upper_overhang", F.lit(0.0)) >= 0.25)
    rows = rows.withColumns(
        {
            "hard": (F.col("hard_risk_count") >= 2) | heated, "review": F.col("hard_risk_count") == 1, "opp": F.col("score_q") >= 0.7, "opp_strong": F.col("score_q") >= 0.9,
            "kline": F.coalesce(F.col("close_above_ma200") & (F.col("prior_return_20d") > 0), F.lit(False)), "channel_hard": F.col("news_warning_score"), "channel_support": F.col("peer_group_positive_breadth_20d"),
        }
    )
    return rows.withColumn("action_bin", learners.action_bin())


_BINS = f"""{FACTS}, b0 AS (SELECT *, hard_risk_count >= 2 OR (rs >= 75 AND uo >= 0.25) AS hard, hard_risk_count = 1 AS review, score_q >= 0.7 AS opp, score_q >= 0.9 AS opp_strong, coalesce(close_above_ma200 AND prior_return_20d > 0, false) AS kline, coalesce(peer_group_positive_breadth_20d, 0) >= 0.45 AS backed FROM fx),
bn AS (SELECT *, CASE WHEN hard OR nw >= 0.95 THEN 'hard_counter' WHEN opp_strong AND kline AND NOT review THEN 'opp_strong_kline_clean' WHEN opp AND kline AND NOT review THEN 'opp_kline_clean' WHEN opp AND NOT kline AND backed AND NOT review THEN 'opp_only_channel_support'
  WHEN kline AND NOT opp AND backed AND NOT review THEN 'kline_only_channel_support' WHEN opp AND NOT kline AND NOT review THEN 'opp_only_clean' WHEN kline AND NOT opp AND NOT review THEN 'kline_only_clean' WHEN (opp OR kline) AND review THEN 'confirm_with_review' WHEN review THEN 'review_only' ELSE 'low_signal' END AS action_bin FROM b0),
bo AS (SELECT time_block, row_number() OVER (ORDER BY time_block) AS idx FROM (SELECT DISTINCT time_block FROM bn)),
bp AS (SELECT t.time_block AS target_block, action_bin, count(*) AS n_all, count(return_20d) AS n, count(*) FILTER (return_20d > 0) AS up, count(*) FILTER (return_20d <= -5) AS down, sum(return_20d) AS total FROM bn JOIN bo USING (time_block) JOIN bo t ON bo.idx < t.idx GROUP BY 1, 2),
bb AS (SELECT target_block, sum(up) / sum(n_all) AS base_pos, sum(total) / nullif(sum(n), 0) AS base_avg, sum(down) / sum(n_all) AS base_loss FROM bp GROUP BY 1),
br AS (SELECT target_block, action_bin, n AS n_rows, round(up / nullif(n, 0), 6) AS pos_rate, round(total / nullif(n, 0), 6) AS avg_return, round(down / nullif(n, 0), 6) AS loss_rate, base_pos, base_avg, base_loss FROM bp JOIN bb USING (target_block))"""


@query(f"WITH {_BINS} SELECT target_block, action_bin, n_rows, pos_rate, avg_return, loss_rate, round(base_loss, 6) AS base_loss, round(pos_rate - base_pos, 6) AS delta_pos, round(avg_return - base_avg, 6) AS delta_avg FROM br")
def l_position_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each action bin's record over the blocks before, against all rows of these."""
    return rounded(learners.bin_records(_binned(spark, sf_dir)).select("target_block", "action_bin", "n_rows", "pos_rate", "avg_return", "loss_rate", "base_loss", "delta_pos", "delta_avg"))


_FALLBACKS = ", ".join(f"('{k}', '{b}', {v})" for k, values in learners.FALLBACK.items() for b, v in zip(learners.BINS, values))
_MODELS = f"""{_BINS}, dflt AS (SELECT * FROM (VALUES {_FALLBACKS}) t(policy_name, action_bin, fallback)),
md AS (SELECT w.target_block, policy_name, dflt.action_bin, coalesce(n_rows >= {learners.LEAST_BIN}, false) AS is_learned, CASE WHEN NOT coalesce(n_rows >= {learners.LEAST_BIN}, false) THEN fallback
  WHEN policy_name = 'learned_precision_v1' THEN CASE WHEN pos_rate >= 0.68 AND avg_return >= 2 AND loss_rate <= greatest(0.22, base_loss) THEN 0.55 WHEN pos_rate >= 0.60 AND avg_return >= 1 AND loss_rate <= greatest(0.28, base_loss + 0.04) THEN 0.35
    WHEN pos_rate >= 0.53 AND avg_return >= 0 THEN 0.20 WHEN avg_return < 0 OR pos_rate < 0.45 THEN 0.0 ELSE 0.10 END
  WHEN policy_name = 'learned_loss_guard_v1' THEN CASE WHEN loss_rate > greatest(0.30, base_loss + 0.06) OR avg_return < -1 THEN 0.0 WHEN pos_rate >= 0.65 AND avg_return >= 1.5 THEN 0.50 WHEN pos_rate >= 0.57 AND avg_return >= 0.5 THEN 0.30
    WHEN pos_rate >= 0.50 AND avg_return >= -0.25 THEN 0.15 ELSE 0.05 END
  WHEN policy_name = 'learned_balanced_v1' THEN CASE WHEN pos_rate >= 0.64 AND avg_return >= 1.5 AND loss_rate <= greatest(0.30, base_loss + 0.05) THEN 0.55 WHEN pos_rate >= 0.56 AND avg_return >= 0.3 THEN 0.35 WHEN pos_rate >= 0.48 AND avg_return >= -0.5 THEN 0.20
    WHEN avg_return < -1 OR pos_rate < 0.43 THEN 0.0 ELSE 0.10 END
  WHEN pos_rate < base_pos OR avg_return < base_avg THEN CASE WHEN loss_rate > greatest(0.30, base_loss + 0.04) OR avg_return < 0 THEN 0.0 ELSE 0.10 END
  ELSE CASE WHEN pos_rate >= 0.72 AND avg_return >= 2 AND loss_rate <= greatest(0.20, base_loss) THEN 0.55 WHEN pos_rate >= 0.62 AND avg_return >= 1 AND loss_rate <= greatest(0.25, base_loss + 0.03) THEN 0.40 WHEN pos_rate >= 0.55 AND avg_return >= 0.5 THEN 0.25 ELSE 0.10 END END::DOUBLE AS position
 FROM (SELECT DISTINCT target_block FROM br) w CROSS JOIN dflt LEFT JOIN br ON br.target_block = w.target_block AND br.action_bin = dflt.action_bin)"""


@query(f"WITH {_MODELS} SELECT target_block, policy_name, action_bin, is_learned, position FROM md")
def l_position_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each policy holds in each bin, learned where the bin's record is long enough."""
    return learners.position_models(learners.bin_records(_binned(spark, sf_dir))).select("target_block", "policy_name", "action_bin", "is_learned", "position")


@query(f"""WITH {_MODELS}, ps AS (SELECT bn.time_block, policy_name, return_20d, least(0.70, greatest(0.0, CASE WHEN hard THEN 0.0 WHEN review THEN least(position, 0.20) ELSE position END)) AS t FROM bn JOIN md ON md.target_block = bn.time_block AND md.action_bin = bn.action_bin),
pt AS (SELECT *, CASE WHEN t <= 0 THEN 'avoid_or_reduce_by_learned_position_tool' WHEN t >= 0.50 THEN 'trial_buy_or_add_if_user_confirms_by_learned_tool' WHEN t >= 0.35 THEN 'small_buy_or_hold_by_learned_tool' WHEN t >= 0.15 THEN 'hold_tiny_or_wait_for_confirmation_by_learned_tool' ELSE 'wait_or_hold_tiny_position_by_learned_tool' END AS operation_hint FROM ps)
SELECT time_block, policy_name, operation_hint, count(*) AS n_rows, round(avg(t), 6) AS avg_position, round(avg(t * return_20d + (1 - t) * {learners.CASH}), 6) AS cash_adjusted_avg FROM pt GROUP BY 1, 2, 3""")
def l_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The learned positions on the block after those they were learned on."""
    rows = _binned(spark, sf_dir)
    out = learners.positioned(rows, learners.position_models(learners.bin_records(rows)))
    return rounded(out.groupBy("time_block", "policy_name", "operation_hint").agg(F.count("*").alias("n_rows"), F.avg("target_position").alias("avg_position"), F.avg("cash_adjusted_return_20d").alias("cash_adjusted_avg")))


# -- walk-forward fits ------------------------------------------------------------------------

RIDGE_FEATURES = ["prior_return_20d", "drawdown60", "lower_support"]
GUARD_FEATURES = ["relative_strength_rank", "prior_return_20d", "rsi14", "atr20_pct", "drawdown60", "news_warning_score", "peer_relative_to_group_20d", "lower_support"]
_A, _B, _C = RIDGE_FEATURES
_DET = "({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"
# the normal equations of three standardized features, by Cramer's rule
_RIDGE = f"""{SIGNALS}, ro AS (SELECT time_block, row_number() OVER (ORDER BY time_block) AS idx FROM (SELECT DISTINCT time_block FROM sg WHERE {_A} IS NOT NULL AND {_B} IS NOT NULL AND {_C} IS NOT NULL AND return_20d IS NOT NULL)),
rn AS (SELECT t.time_block AS valid_block, {_A} AS a, {_B} AS b, {_C} AS c, return_20d AS y FROM sg JOIN ro USING (time_block) JOIN ro t ON ro.idx < t.idx WHERE {_A} IS NOT NULL AND {_B} IS NOT NULL AND {_C} IS NOT NULL AND return_20d IS NOT NULL),
rs AS (SELECT valid_block, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, stddev_pop(c) AS sc, corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc,
  covar_pop(a, y) / stddev_pop(a) AS ya, covar_pop(b, y) / stddev_pop(b) AS yb, covar_pop(c, y) / stddev_pop(c) AS yc FROM rn GROUP BY 1 HAVING count(*) >= 100),
rt AS (SELECT *, n + {learners.RIDGE} AS q, n * ab AS pab, n * ac AS pac, n * bc AS pbc, n * ya AS ua, n * yb AS ub, n * yc AS uc FROM rs),
rd AS (SELECT *, {_DET.format(a='q', b='pab', c='pac', d='pab', e='q', f='pbc', g='pac', h='pbc', i='q')} AS det FROM rt),
rw AS (SELECT valid_block, n, ma, mb, mc, my, {_DET.format(a='ua', b='pab', c='pac', d='ub', e='q', f='pbc', g='uc', h='pbc', i='q')} / det / sa AS wa, {_DET.format(a='q', b='ua', c='pac', d='pab', e='ub', f='pbc', g='pac', h='uc', i='q')} / det / sb AS wb,
  {_DET.format(a='q', b='pab', c='ua', d='pab', e='q', f='ub', g='pac', h='pbc', i='uc')} / det / sc AS wc FROM rd)"""


def _ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learners.ridge(learners.moments(signals(spark, sf_dir), RIDGE_FEATURES, "return_20d"), RIDGE_FEATURES)


@query(f"WITH {_RIDGE} SELECT valid_block, n, round(my - wa * ma - wb * mb - wc * mc, 6) AS intercept, round(wa, 6) AS w_{_A}, round(wb, 6) AS w_{_B}, round(wc, 6) AS w_{_C} FROM rw")
def l_ridge_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ridge fit for each block on all blocks before it, all from one pass of sums."""
    return rounded(_ridge(spark, sf_dir).select("valid_block", "n", "intercept", *(F.col("weights")[i].alias(f"w_{f}") for i, f in enumerate(RIDGE_FEATURES))))


@query(f"""WITH {_RIDGE}, p AS (SELECT time_block, return_20d AS y, my + wa * ({_A} - ma) + wb * ({_B} - mb) + wc * ({_C} - mc) AS s FROM sg JOIN rw ON rw.valid_block = sg.time_block WHERE return_20d IS NOT NULL AND {_A} IS NOT NULL AND {_B} IS NOT NULL AND {_C} IS NOT NULL)
SELECT time_block, count(*) AS n, round(avg(s), 6) AS mean_score, round(corr(s, y), 6) AS ic, round(sqrt(avg((s - y) * (s - y))), 6) AS rmse, round(avg(y) FILTER (s > 0), 6) AS mean_return_if_positive FROM p GROUP BY 1""")
def l_ridge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the ridge fits do on the block after those they were made on."""
    models = F.broadcast(_ridge(spark, sf_dir).withColumnRenamed("valid_block", "time_block").drop("n"))
    x = F.array(*(F.col(f) for f in RIDGE_FEATURES))
    rows = signals(spark, sf_dir).dropna(subset=[*RIDGE_FEATURES, "return_20d"]).join(models, "time_block")
    rows = rows.select("time_block", F.col("return_20d").alias("y"), learners.linear_score(x, F.col("intercept"), F.col("weights")).alias("s"))
    error = F.col("s") - F.col("y")
    return rounded(rows.groupBy("time_block").agg(F.count("*").alias("n"), F.avg("s").alias("mean_score"), F.corr("s", "y").alias("ic"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.when(F.col("s") > 0, F.col("y"))).alias("mean_return_if_positive")))


def guard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the guard's features and whether a raise would have paid."""
    pays = ((F.col("return_20d") > 0) & (F.col("pool_excess_20d") > 0)).cast("int")
    rows = signals(spark, sf_dir).select("code", "date", "time_block", "return_20d", "pool_excess_20d", pays.alias("allow_raise"), *GUARD_FEATURES)
    return learners.imputed(rows, GUARD_FEATURES, "allow_raise")


@query()
def l_guard_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic guard for each block on all blocks before it: threshold, and what it allows. SQL
    can't iterate to a fit; the tests compare it with numpy."""
    rows = learners.written(guard_rows(spark, sf_dir), "guard")
    models = learners.logistic_blocks(rows, "allow_raise")
    cuts = F.broadcast(learners.thresholds(rows, models, "allow_raise").withColumnRenamed("valid_block", "time_block"))
    scored = learners.guard_scores(rows, models).join(cuts, "time_block", "left").withColumn("allowed", F.col("guard_probability") >= F.coalesce("threshold", F.lit(0.5)))
    share = lambda c: F.avg(F.when(F.col("allowed"), F.col(c)))
    return rounded(scored.groupBy("time_block").agg(F.count("*").alias("n_rows"), F.max("threshold").alias("threshold"), F.avg(F.col("allowed").cast("int")).alias("allow_share"), share("allow_raise").alias("precision"), share("return_20d").alias("allowed_return"), F.avg("return_20d").alias("hold_return")))


# -- guardrails -------------------------------------------------------------------------------


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards from signals: the grade by policy score; what the rules ask is told by the signals."""
    rows = entries.facts(signals(spark, sf_dir))
    c, g = F.col, guardrails
    q, s = c("score_q"), c("score")
    pick = lambda *v: F.when(s >= 0.62, v[0]).when(s >= 0.50, v[1]).when(s >= 0.40, v[2]).otherwise(v[3])
    gaps = (
        ("news_gap", c("news_missing_rate") >= 0.8), ("financial_gap", c("financial_report_event_count") == 0), ("book_skill_gap", c("triggered_skills") == ""),
        ("peer_gap_or_weak", ~c("peer_ok")), ("quant_tool_gap", q < 0.5), ("overheat_or_high_volatility", F.coalesce((c("prior_return_20d") >= 60) | (c("rsi14") >= 80) | (c("atr20_pct") >= 60), F.lit(False))),
    )
    return rows.select(
        "code", "date", pick(g.DIG, g.WATCH, g.ASIDE, g.UNKNOWN).alias("grade"), pick(g.RAISE, g.HOLD, g.LOWER, g.TO_CASH).alias("action"), pick(0.3, 0.2, 0.05, 0.0).alias("weight"), F.lit("").alias("suggestion"), F.when(q >= 0.9, 0.6).when(q >= 0.7, 0.2).otherwise(0.0).alias("target"),
        (F.array_contains("risks", "financial_risk") & (c("support_count") == 0)).alias("financial_guard"), F.when(c("code") % 5 == 0, "financial_report_only").otherwise("full_agent").alias("variant"), F.when(c("code") % 2 == 0, "portfolio_pool").otherwise("single_stock").alias("task_mode"),
        F.coalesce((c("news_opportunity_score") >= 0.6) & (c("news_conflict_intensity_30d") > 0), F.lit(False)).alias("positive_capped"), (c("data_gaps") != "").alias("confirmation_gap"), F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in gaps))).alias("gaps"), (q >= 0.80).alias("strong_quant"),
        F.array_contains("risks", "falling_with_peer_weakness").alias("failure_cases"), (c("hard_risk_count") >= 1).alias("review_queue"), ((c("hard_risk_count") == 1) & (F.coalesce("lower_support", F.lit(0.0)) >= 0.2)).alias("no_downweight"),
        F.when(q >= 0.9, "buy_add").when(q >= 0.7, "small_buy_hold").when(q >= 0.4, "hold").when(q >= 0.2, "reduce_review").otherwise("wait").alias("operation"), (c("code") % 3 != 0).alias("from_label_scorer"), c("hard_block").alias("hard_counter"), F.lit(0.15).alias("floor"), F.when(q >= 0.8, q - 0.6).alias("plan_target"),
    )


_G = guardrails
_UP = f"(grade = '{_G.DIG}' OR action = '{_G.RAISE}')"
_LOW = f"CASE WHEN grade = '{_G.DIG}' THEN '{_G.WATCH}' ELSE grade END"


def _rule(name: str, before: str, test: str, fired: int, **new: str) -> str:
    """One rule as a step from one table of cards to the next."""
    cols = ", ".join(f"CASE WHEN coalesce({test}, false) THEN {new[k]} ELSE {k} END AS {k}" for k in _G._STATE if k in new)
    kept = ", ".join(k for k in _G._STATE if k not in new)
    return f"{name} AS (SELECT * EXCLUDE ({', '.join(_G._STATE)}, fired), {cols}{', ' + kept if kept else ''}, CASE WHEN coalesce({test}, false) THEN list_append(fired, '{_G.RULES[fired]}') ELSE fired END AS fired FROM {before})"


_HELD = lambda weight: {"grade": _LOW, "action": f"CASE WHEN action = '{_G.RAISE}' THEN '{_G.HOLD}' ELSE action END", "weight": f"CASE WHEN action = '{_G.RAISE}' THEN {weight} ELSE weight END"}
_MOST = "(CASE WHEN no_downweight THEN 0.1 ELSE 0.05 END)"
_KEPT = f"CASE WHEN no_downweight AND ({_LOW}) = '{_G.WATCH}' THEN {_MOST} ELSE least(weight, {_MOST}) END"
_RW = f"(CASE WHEN action = '{_G.RAISE}' THEN {_MOST} WHEN action IN ('{_G.HOLD}', '{_G.LOWER}') THEN {_KEPT} ELSE weight END)"
_RA = f"(CASE WHEN action = '{_G.RAISE}' THEN CASE WHEN no_downweight THEN '{_G.HOLD}' ELSE '{_G.LOWER}' END WHEN no_downweight AND ({_LOW}) = '{_G.WATCH}' AND action = '{_G.LOWER}' THEN '{_G.HOLD}' WHEN NOT no_downweight AND action = '{_G.HOLD}' AND weight > {_MOST} THEN '{_G.LOWER}' ELSE action END)"
_F7 = "greatest(0.1, least(0.35, coalesce(plan_target, floor, 0.1)))"
_F8 = "greatest(0.10, least(floor, coalesce(plan_target, floor), 0.25))"


def _floor(f: str, said: str) -> dict[str, str]:
    return {"grade": f"CASE WHEN grade IN ('{_G.DIG}', '{_G.WATCH}') THEN grade ELSE '{_G.WATCH}' END", "action": f"'{_G.HOLD}'", "weight": f"greatest(weight, least({f}, 0.2))", "suggestion": f"'{said}'", "target": f}


_WAIT = "operation = 'wait'"
_GUARDS = [
    ("financial_guard AND (action IN ('%s', '%s', '%s') OR grade = '%s')" % (_G.RAISE, _G.HOLD, _G.LOWER, _G.DIG), {"grade": _LOW, "action": f"'{_G.NO_ACTION}'", "weight": "0.0"}),
    (f"variant = 'financial_report_only' AND {_UP}", _HELD("least(weight, 0.1)")),
    (f"positive_capped AND confirmation_gap AND {_UP}", _HELD("0.1")),
    (f"task_mode = 'portfolio_pool' AND variant = 'full_agent' AND len(gaps) >= 3 AND NOT (strong_quant AND NOT list_has_any(gaps, {list(_G.HARD_GAPS)})) AND {_UP}", _HELD("0.1")),
    (f"failure_cases AND {_UP}", _HELD("least(weight, 0.1)")),
    (f"task_mode = 'single_stock' AND review_queue AND (grade = '{_G.DIG}' OR {_RA} <> action OR {_RW} <> weight)", {"grade": _LOW, "action": _RA, "weight": _RW}),
    (f"operation = 'small_buy_hold' AND NOT hard_counter AND target < {_F7}", _floor(_F7, "试探买入/持有")),
    (f"operation = 'buy_add' AND from_label_scorer AND NOT hard_counter AND target < {_F8}", _floor(_F8, "试探买入/持有复核")),
    (f"from_label_scorer AND operation IN ('wait', 'reduce_review') AND NOT (target <= CASE WHEN {_WAIT} THEN 0.0 ELSE 0.10 END AND weight <= CASE WHEN {_WAIT} THEN 0.0 ELSE 0.05 END)",
     {"grade": f"CASE WHEN {_WAIT} THEN CASE WHEN grade IN ('{_G.UNKNOWN}', '{_G.ASIDE}') THEN grade ELSE '{_G.ASIDE}' END ELSE CASE WHEN grade IN ('{_G.UNKNOWN}', '{_G.WATCH}', '{_G.ASIDE}') THEN grade ELSE '{_G.WATCH}' END END",
      "action": f"CASE WHEN {_WAIT} THEN '{_G.TO_CASH}' ELSE '{_G.LOWER}' END", "weight": f"least(weight, CASE WHEN {_WAIT} THEN 0.0 ELSE 0.05 END)", "suggestion": f"CASE WHEN {_WAIT} THEN '等待不买' ELSE '减仓/卖出复核' END", "target": f"least(target, CASE WHEN {_WAIT} THEN 0.0 ELSE 0.10 END)"}),
]


@query(f"""WITH {FACTS},
g0 AS (SELECT code, date, CASE WHEN score >= 0.62 THEN '{_G.DIG}' WHEN score >= 0.50 THEN '{_G.WATCH}' WHEN score >= 0.40 THEN '{_G.ASIDE}' ELSE '{_G.UNKNOWN}' END AS grade, CASE WHEN score >= 0.62 THEN '{_G.RAISE}' WHEN score >= 0.50 THEN '{_G.HOLD}' WHEN score >= 0.40 THEN '{_G.LOWER}' ELSE '{_G.TO_CASH}' END AS action,
 CASE WHEN score >= 0.62 THEN 0.3 WHEN score >= 0.50 THEN 0.2 WHEN score >= 0.40 THEN 0.05 ELSE 0.0 END::DOUBLE AS weight, '' AS suggestion, CASE WHEN score_q >= 0.9 THEN 0.6 WHEN score_q >= 0.7 THEN 0.2 ELSE 0.0 END::DOUBLE AS target, []::VARCHAR[] AS fired,
 (fr >= 0.70 OR (fe >= 1 AND fu <= -0.35)) AND support_count = 0 AS financial_guard, CASE WHEN code % 5 = 0 THEN 'financial_report_only' ELSE 'full_agent' END AS variant, CASE WHEN code % 2 = 0 THEN 'portfolio_pool' ELSE 'single_stock' END AS task_mode,
 coalesce(news_opportunity_score >= 0.6 AND news_conflict_intensity_30d > 0, false) AS positive_capped, data_gaps <> '' AS confirmation_gap,
 list_filter([CASE WHEN news_missing_rate >= 0.8 THEN 'news_gap' END, CASE WHEN financial_report_event_count = 0 THEN 'financial_gap' END, CASE WHEN triggered_skills = '' THEN 'book_skill_gap' END, CASE WHEN NOT peer_ok THEN 'peer_gap_or_weak' END, CASE WHEN score_q < 0.5 THEN 'quant_tool_gap' END,
   CASE WHEN coalesce(prior_return_20d >= 60 OR rsi14 >= 80 OR atr20_pct >= 60, false) THEN 'overheat_or_high_volatility' END], lambda x: x IS NOT NULL) AS gaps,
 score_q >= 0.80 AS strong_quant, r20 <= -18 AND pr <= -3 AS failure_cases, hard_risk_count >= 1 AS review_queue, hard_risk_count = 1 AND ls >= 0.2 AS no_downweight,
 CASE WHEN score_q >= 0.9 THEN 'buy_add' WHEN score_q >= 0.7 THEN 'small_buy_hold' WHEN score_q >= 0.4 THEN 'hold' WHEN score_q >= 0.2 THEN 'reduce_review' ELSE 'wait' END AS operation, code % 3 <> 0 AS from_label_scorer, hard_block AS hard_counter, 0.15::DOUBLE AS floor, CASE WHEN score_q >= 0.8 THEN score_q - 0.6 END AS plan_target FROM fx),
{', '.join(_rule(f'g{i + 1}', f'g{i}', test, i, **new) for i, (test, new) in enumerate(_GUARDS))}
SELECT code, date, grade, action, round(weight, 6) AS weight, suggestion, round(target, 6) AS target, array_to_string(fired, ';') AS fired FROM g9""")
def f_guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards after nine guardrails, each of which sees what those before it left."""
    out = guardrails.guarded(_cards(spark, sf_dir))
    return rounded(out.select("code", "date", "grade", "action", "weight", "suggestion", "target", F.array_join("fired", ";").alias("fired")))
