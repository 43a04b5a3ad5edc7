"""Queries of evidence by channel: confirmations, conflicts and their rulebooks, row gates, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions.expr import rounded, zscore
from panelyard.operators import channels, policy
from panelyard.operators.policy import GAP
from panelyard.plans.signals import SIGNALS, signals
from panelyard.plans.sql import rank_pct as rank_sql
from panelyard.plans.sql import zscore as z_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _flag(test: str) -> str:
    return f"coalesce({test}, false)"


_COUNTS = {"n_confirmed": channels.CONFIRMED, "n_positive": channels.POSITIVE, "n_hard": channels.HARD}


@query(f"WITH {SIGNALS} SELECT code, date, {', '.join(f'{channels.total(t)} AS {k}' for k, t in _COUNTS.items())}, {', '.join(f'{_flag(t)} AS {k}' for k, t in channels.CONFLICTS.items())} FROM sg")
def f_channel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels that confirm, speak for or speak against a row, and the nine conflict flags."""
    rows = channels.conflict_flags(signals(spark, sf_dir))
    return rows.select("code", "date", *(F.expr(channels.total(t)).alias(k) for k, t in _COUNTS.items()), *channels.CONFLICTS)


@query(f"WITH {SIGNALS} SELECT code, date, {', '.join(f'{_flag(t)} AS {chr(34)}{k}{chr(34)}' for k, t in channels.PORTFOLIO_GATES.items())} FROM sg")
def f_portfolio_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row gates of a portfolio, by name."""
    return signals(spark, sf_dir).select("code", "date", *(F.expr(_flag(t)).alias(k) for k, t in channels.PORTFOLIO_GATES.items()))


_BOOKS = f"""{SIGNALS}, cf0 AS (SELECT * EXCLUDE (pool_excess_20d), {', '.join(f'{_flag(t)} AS {k}' for k, t in channels.CONFLICTS.items())} FROM sg WHERE rev_chip_score_quantile >= 0.80),
cf1 AS (SELECT *, return_20d - avg(return_20d) OVER (PARTITION BY date) AS excess, list_filter([{', '.join(f"CASE WHEN {k} THEN '{k}' END" for k in channels.CONFLICTS)}], lambda x: x IS NOT NULL) AS flags FROM cf0),
cf2 AS (SELECT time_block, return_20d AS r, excess, CASE WHEN r IS NULL OR excess IS NULL THEN 'unknown' WHEN r > 0 AND excess > 0 THEN 'acceptable_conflict_or_alpha' WHEN r <= -5 OR excess <= -5 THEN 'veto_risk' WHEN r > 0 THEN 'market_beta_only' ELSE 'weak_or_negative' END AS label,
  unnest(list_concat(list_transform(flags, lambda f: {{'kind': 'single', 'key': f}}), [{{'kind': 'combo', 'key': CASE WHEN len(flags) = 0 THEN 'no_conflict' ELSE array_to_string(flags, '+') END}}])) AS k FROM cf1),
cfo AS (SELECT time_block, row_number() OVER (ORDER BY time_block) AS idx FROM (SELECT DISTINCT time_block FROM sg)),
cfb AS (SELECT t.time_block AS valid_block, k.kind AS kind, k.key AS key, cf2.time_block, r, excess, label FROM cf2 JOIN cfo USING (time_block) JOIN cfo t ON cfo.idx < t.idx),
cfm AS (SELECT valid_block, kind, key, min(up) AS min_block_pos20 FROM (SELECT valid_block, kind, key, time_block, avg((r > 0)::INT) AS up FROM cfb GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
cfs AS (SELECT valid_block, kind, key, count(*) AS n_rows, avg(r) AS avg20, avg((r > 0)::INT) AS pos20, avg(excess) AS pool_excess20, count(*) FILTER (r <= -5) / count(*) AS loss_gt5_rate, count(*) FILTER (label = 'acceptable_conflict_or_alpha') / count(*) AS acceptable_label_rate, count(*) FILTER (label = 'veto_risk') / count(*) AS veto_label_rate FROM cfb GROUP BY 1, 2, 3 HAVING count(*) >= 30)"""
_BOOK = ["avg20", "pos20", "pool_excess20", "loss_gt5_rate", "min_block_pos20", "acceptable_label_rate", "veto_label_rate"]


@query(f"""WITH {_BOOKS} SELECT valid_block, kind, key, n_rows, {', '.join(f'round({c}, 6) AS {c}' for c in _BOOK)},
 CASE WHEN avg20 > 0 AND pos20 >= 0.55 AND pool_excess20 > 0 AND coalesce(loss_gt5_rate <= 0.25, true) AND coalesce(min_block_pos20 >= 0.40, true) THEN 'acceptable_reversal_friction' WHEN avg20 < 0 OR pos20 <= 0.45 OR pool_excess20 < 0 OR loss_gt5_rate >= 0.30 THEN 'veto_or_downweight' ELSE 'mixed_needs_agent_judgment' END AS rule_status
 FROM cfs JOIN cfm USING (valid_block, kind, key)""")
def l_conflict_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block's books of single conflicts and of their combinations, from the blocks before it."""
    return rounded(channels.conflict_books(signals(spark, sf_dir)).select("valid_block", "kind", "key", "n_rows", *_BOOK, "rule_status"))


# -- the sampler's parts, row gates and profiles ----------------------------------------------

_I = lambda test: f"CAST(coalesce({test}, false) AS INT)"
_Z = lambda c: f"coalesce({c}, 0)"
# fixed values: the parts' thresholds
PARTS = {
    "rel": _Z("relative_strength_rank"),
    "counter": f"{_Z('counter_score')} / 10",
    "above": _I("close_above_ma200"),
    "overheat": _I(f"{_Z('prior_return_20d')} >= 60 OR {_Z('rsi14')} >= 80 OR {_Z('atr20_pct')} >= 8"),
    "news_ok": _I("news_missing_rate < 0.8 OR news_count_30d > 0"),
    "fin_ok": _I("financial_report_event_count > 0"),
    "peer_ok": _I(f"({_Z('peer_group_positive_breadth_20d')} >= 0.50 AND {_Z('peer_relative_to_group_20d')} > -3) OR ({_Z('area_positive_breadth_20d')} >= 0.45 AND {_Z('area_relative_return_20d')} > -5)"),
    "kline_safe": _I(f"{_Z('prior_return_20d')} BETWEEN -15 AND 25 AND {_Z('kline_return_60d')} > -25 AND {_Z('kline_volatility_ratio_20_60')} <= 1.8"),
    "triggered": _I("length(triggered_skills) > 0"),
    "news_risk": _I("news_warning_score > 0"),
    "news_opp": _Z("news_opportunity_score"),
    "fin_risk": _I("financial_quality_risk_score >= 0.6"),
    "fin_miss": _I("financial_surprise_score <= -0.4"),
    "fin_gap": _I(f"contains(data_gaps, '{GAP}')"),
    "medium_trend": f"({_I(_Z('prior_return_20d') + ' BETWEEN -12 AND 18')} + {_I(_Z('kline_return_60d') + ' > -18')} + {_I(_Z('kline_return_120d') + ' > -25')})",
    "cycle_quality": f"({_I(_Z('kline_efficiency_20d') + ' >= 0.15')} + {_I(_Z('kline_reversal_rate_20d') + ' <= 0.55')} + {_I(_Z('chip_range_position') + ' BETWEEN 0.25 AND 0.85')})",
    "deep_fall": _I(f"{_Z('kline_return_60d')} <= -25"),
    "peers": f"({_I(_Z('peer_group_positive_breadth_20d') + ' >= 0.50')} + {_I(_Z('area_positive_breadth_20d') + ' >= 0.45')} + {_I(_Z('peer_relative_to_group_20d') + ' > -3')} + {_I(_Z('area_relative_return_20d') + ' > -3')})",
}
MORE = {
    "confirmation": "news_ok + fin_ok + peer_ok + kline_safe + triggered",
    "risk_gap": "(1 - news_ok) + (1 - fin_ok) + (1 - peer_ok) + (1 - kline_safe) + overheat",
    "few_peers": _I("peers <= 1"),
}
# fixed values: weights of the profiles, under their names
PROFILES: dict[str, list[tuple[str, float]]] = {
    "current_peer_pullback_proxy": [("rel", 0.42), ("counter", 0.20), ("above", 0.15), ("kline_safe", 0.32), ("peer_ok", 0.18), ("overheat", -0.75), ("news_risk", -0.20)],
    "strict_cross_channel": [("rel", 0.35), ("counter", 0.16), ("above", 0.12), ("kline_safe", 0.20), ("peer_ok", 0.22), ("news_ok", 0.18), ("fin_ok", 0.12), ("triggered", 0.06), ("risk_gap", -0.55), ("fin_risk", -0.25)],
    "kline_multiscale_quality": [("rel", 0.30), ("counter", 0.15), ("medium_trend", 0.16), ("cycle_quality", 0.10), ("peer_ok", 0.16), ("overheat", -0.45), ("deep_fall", -0.35)],
    "tushare_peer_quality": [("rel", 0.32), ("counter", 0.16), ("above", 0.10), ("peers", 0.16), ("kline_safe", 0.14), ("overheat", -0.45), ("few_peers", -0.30)],
    "news_financial_quality": [("rel", 0.30), ("counter", 0.12), ("above", 0.12), ("news_ok", 0.18), ("fin_ok", 0.12), ("news_opp", 0.12), ("news_risk", -0.50), ("fin_risk", -0.35), ("fin_miss", -0.20), ("overheat", -0.35)],
    "defensive_regime_quality": [("rel", 0.28), ("counter", 0.20), ("above", 0.12), ("kline_safe", 0.14), ("peer_ok", 0.14), ("confirmation", 0.08), ("overheat", -0.70), ("news_risk", -0.45), ("fin_gap", -0.35)],
}
SAMPLER_GATES = {
    "none": "true", "no_overheat": "overheat <= 0", "news_available": "news_ok >= 1", "news_or_financial_available": "news_ok >= 1 OR fin_ok >= 1", "peer_context_safe": "peer_ok >= 1", "kline_pullback_safe": "kline_safe >= 1",
    "cross_channel_min2": "confirmation >= 2", "cross_channel_min3": "confirmation >= 3", "strict_safety": "confirmation >= 3 AND overheat <= 0 AND news_risk <= 0 AND fin_risk <= 0",
}
_SAMPLER = f"""{SIGNALS}, sp0 AS (SELECT code, date, {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in PARTS.items())} FROM sg), sp AS (SELECT *, {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in MORE.items())} FROM sp0)"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signals(spark, sf_dir).select("code", "date", *(F.expr(v).cast("double").alias(k) for k, v in PARTS.items()))
    return out.select("*", *(F.expr(v).cast("double").alias(k) for k, v in MORE.items()))


@query(f"WITH {_SAMPLER} SELECT code, date, {', '.join(f'{t} AS {chr(34)}{k}{chr(34)}' for k, t in SAMPLER_GATES.items())} FROM sp")
def f_sampler_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row gates of the sampler's search, by name."""
    return _parts(spark, sf_dir).select("code", "date", *(F.expr(t).alias(k) for k, t in SAMPLER_GATES.items()))


@query(f"WITH {_SAMPLER} SELECT code, date, {', '.join(f'round({chr(43).join(f' ({c}) * ({w})' for c, w in v)}, 6) AS {k}' for k, v in PROFILES.items())} FROM sp")
def f_sampler_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampler's six score profiles."""
    return rounded(_parts(spark, sf_dir).select("code", "date", *(policy.linear(v).alias(k) for k, v in PROFILES.items())))


# -- risk flags, decisions, grades ------------------------------------------------------------

_FLAGS = {
    "chase_high": "winner_rate_pct >= 75 AND chip_range_position >= 0.85",
    "extreme_cost_high": "cost_position >= 0.92",
    "extreme_cost_low": "cost_position <= 0.08",
    "upper_overhang_rally": "upper_overhang >= 0.25 AND prior_return_20d >= 10",
    "volume_stall": "prior_return_20d >= 8 AND kline_return_3d <= 0 AND kline_volatility_ratio_3_20 >= 1.3",
    "deep_drawdown_accel": "drawdown60 <= -25 AND kline_return_5d <= -3",
    "peer_weakness": "prior_return_20d - peer_relative_to_group_20d <= -5",
    "chip_loosen_rally": "winner_rate_pct >= 70 AND prior_return_20d >= 15",
}
_FLAGGED = f"""{SIGNALS}, f0 AS (SELECT *, {', '.join(f'{_flag(v)} AS {k}' for k, v in _FLAGS.items())} FROM sg),
f AS (SELECT *, {' + '.join(f'{k}::INT' for k in _FLAGS)} AS risk_flag_count, {' + '.join(f'{k}::INT' for k in _FLAGS if k != 'chip_loosen_rally')} AS risk_flag_count_baseline, concat_ws(';', {', '.join(f"CASE WHEN {k} THEN '{k}' END" for k in _FLAGS)}) AS risk_flag_names FROM f0)"""


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = signals(spark, sf_dir)
    return policy.risk_flags(rows.withColumns({"kline_return_20d": c("prior_return_20d"), "kline_drawdown_60d": c("drawdown60"), "corr_peer_avg_return_20d": c("prior_return_20d") - c("peer_relative_to_group_20d")}))


@query(f"WITH {_FLAGGED} SELECT code, date, {', '.join(_FLAGS)}, risk_flag_count, risk_flag_count_baseline, risk_flag_names FROM f")
def f_risk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight flags on chips, prices and volumes; how many, how many but for the newest, their names."""
    return _flagged(spark, sf_dir).select("code", "date", *_FLAGS, "risk_flag_count", "risk_flag_count_baseline", "risk_flag_names")


_LABELS = policy.GRADES, policy.ACTIONS
#: Blocks in which a case memory speaks against rows of narrow markets.
_MEMORY = "(time_block IN ('H1998_1', 'H1998_2') AND area_positive_breadth_20d <= 0.4)"


@query(f"""
WITH {SIGNALS}, o AS (SELECT *, coalesce(rsi14 >= 70, false) OR coalesce(prior_return_20d >= 12, false) AS overheat_flag, CASE WHEN coalesce({_MEMORY}, false) THEN 0.55 ELSE 0.0 END::DOUBLE AS memory_counter FROM sg),
c AS (SELECT *, round(CAST(greatest(0, least(1, 0.30 * coalesce(relative_strength_rank, 0) + 0.18 * coalesce(close_above_ma200, false)::INT + 0.014 * coalesce(counter_score, 0) + 0.08 * (triggered_skills <> '')::INT + 0.08 * least(coalesce(news_opportunity_score, 0), 1)
 - 0.18 * least(greatest(coalesce(news_warning_score, 0), coalesce(news_risk_event_score_30d, 0), 0), 2) - 0.12 * overheat_flag::INT - 0.16 * memory_counter - 0.016 * contains(data_gaps, '{GAP}')::INT)) AS DECIMAL(18, 9)), 4)::DOUBLE AS confidence_level FROM o),
g AS (SELECT *, CASE WHEN confidence_level >= 0.58 THEN 1 WHEN confidence_level >= 0.44 THEN 2 WHEN confidence_level >= 0.30 THEN 3 ELSE 4 END AS i FROM c)
SELECT code, date, overheat_flag, memory_counter, confidence_level, {list(policy.GRADES)}[i] AS research_grade, {list(policy.ACTIONS)}[i] AS simulated_action, [1.0, 0.6, 0.25, 0.0][i]::DOUBLE AS simulated_weight_change FROM g
""")
def f_agent_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's confidence and the grade, action and weight that it leads to."""
    c = F.col
    df = signals(spark, sf_dir).withColumns({"news_warning_score_30d": c("news_warning_score"), "news_opportunity_event_score_30d": c("news_opportunity_score"), "memory_counter": F.when(F.expr(_flag(_MEMORY)), 0.55).otherwise(0.0)})
    return policy.decision(df).select("code", "date", "overheat_flag", "memory_counter", "confidence_level", "research_grade", "simulated_action", "simulated_weight_change")


@query(f"""
WITH {_FLAGGED}, t AS (SELECT *, CASE WHEN relative_strength_rank >= 0.9 THEN 'strong' WHEN relative_strength_rank >= 0.7 THEN 'middle' WHEN relative_strength_rank >= 0.5 THEN 'weak' ELSE 'none' END AS tier, data_gaps <> '' AS gap, month(date) = 3 AS abstain FROM f),
c AS (SELECT *, round(CAST(greatest(0, least(1, 0.25 + CASE tier WHEN 'strong' THEN 0.35 WHEN 'middle' THEN 0.22 WHEN 'weak' THEN 0.10 ELSE 0 END + coalesce(greatest(-0.15, least(0.25, counter_score * 0.08)), 0) - 0.12 * risk_flag_count - 0.15 * abstain::INT - 0.2 * gap::INT)) AS DECIMAL(18, 9)), 4)::DOUBLE AS confidence FROM t),
g AS (SELECT *, CASE WHEN gap THEN 1 WHEN risk_flag_count >= 3 OR contains(risk_flag_names, 'deep_drawdown_accel') THEN 2 WHEN abstain AND tier IN ('strong', 'middle') THEN 3 WHEN tier = 'strong' AND confidence >= 0.45 THEN 4
 WHEN tier IN ('strong', 'middle') THEN 5 WHEN tier = 'weak' THEN 6 WHEN confidence < 0.25 OR abstain THEN 7 ELSE 8 END AS i FROM c)
SELECT code, date, confidence, ['信息不足', '暂时剔除', '放入观察', '继续深挖', '放入观察', '放入观察', '信息不足', '放入观察'][i] AS grade, [0.0, 0.05, 0.1, 0.7, 0.15, 0.08, 0.0, 0.05][i]::DOUBLE AS weight FROM g
""")
def f_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade and weight by opportunity, risk flags, gaps, regime and confidence."""
    r = F.col("relative_strength_rank")
    tier = F.when(r >= 0.9, "strong").when(r >= 0.7, "middle").when(r >= 0.5, "weak").otherwise("none")
    df = _flagged(spark, sf_dir).withColumns({"opportunity_tier": tier, "score": F.col("counter_score"), "data_missing": F.col("data_gaps") != "", "regime_abstain": F.month("date") == 3})
    return policy.graded(df).select("code", "date", "confidence", "grade", "weight")


# -- portfolio scores and the two modes' metrics -----------------------------------------------

# fixed values: weights of the plain score, and what an overheated row without evidence loses
BASE_SCORE = [("relative_strength_rank", 1.0), ("counter_score", 0.08), ("above", 0.25), ("news_count_30d", 0.03), ("news_opportunity_score", 0.12), ("peer_relative_to_group_20d", 0.05), ("news_risk_event_score_30d", -0.15), ("news_warning_score", -0.15)]
REVERSAL, CHIPS = ("prior_return_20d", "kline_return_60d", "peer_group_avg_return_20d"), ("lower_support", "cost_band_width")
_RET, _RSI = _Z("prior_return_20d"), _Z("rsi14")
_BARE = "2.5 * " + _I(f"({_RET} >= 80 OR {_RSI} >= 85) AND news_count_30d <= 0 AND contains(data_gaps, '{GAP}')")
_PLAIN = " + ".join(f"({w}) * {_I('close_above_ma200') if c == 'above' else _Z(c)}" for c, w in BASE_SCORE)
_REL, _COUNTER, _ABOVE, _PULLBACK = _Z("relative_strength_rank"), f"{_Z('counter_score')} / 10", _I("close_above_ma200"), _I(f"{_RET} BETWEEN -15 AND 25")
# fixed values: the presets' weights
PRESETS = {
    "default_score": f"{_PLAIN} - {_BARE}",
    "balanced_momentum": f"{_PLAIN} - {_BARE} - 0.35 * {_I('atr20_pct > 12')}",
    "pullback_recovery": f"0.55 * {_REL} + 0.20 * {_COUNTER} + 0.15 * {_ABOVE} + 0.45 * {_PULLBACK} - {_BARE}",
    "peer_confirmed_pullback": f"0.42 * {_REL} + 0.20 * {_COUNTER} + 0.15 * {_ABOVE} + 0.32 * {_PULLBACK} + 0.18 * {_I('peer_relative_to_group_20d > 0')} + 0.18 * {_I('peer_group_positive_breadth_20d >= 0.55')} - 0.75 * {_I(f'{_RET} >= 60 OR {_RSI} >= 80')} - 0.20 * {_I('news_warning_score > 0')}",
}
_SCORE = lambda c: f"coalesce({z_sql(c, 'date', ddof=0, least=1)}, 0.0)"
_SCORES = f"""{SIGNALS}, ps0 AS (SELECT *, -({' + '.join(_SCORE(c) for c in REVERSAL)}) / {len(REVERSAL)} AS reversal_ranker_v1 FROM sg),
ps AS (SELECT *, ({_SCORE('reversal_ranker_v1')} + {' + '.join(_SCORE(c) for c in CHIPS)}) / {1 + len(CHIPS)} AS rev_plus_chip_core, {', '.join(f'{v} AS {k}' for k, v in PRESETS.items())} FROM ps0)"""
_RANKED = [*PRESETS, "reversal_ranker_v1", "rev_plus_chip_core"]


@query(f"WITH {_SCORES} SELECT code, date, {', '.join(f'round({k}, 6) AS {k}' for k in _RANKED)} FROM ps")
def f_portfolio_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A portfolio's six score presets: four linear ones, the reversal composite, and that with chips."""
    score = lambda c: F.coalesce(zscore(c, "date", ddof=0, least=1), F.lit(0.0))
    rows = signals(spark, sf_dir).withColumn("reversal_ranker_v1", -sum((score(c) for c in REVERSAL), F.lit(0.0)) / len(REVERSAL))
    rows = rows.withColumn("rev_plus_chip_core", (score("reversal_ranker_v1") + sum((score(c) for c in CHIPS), F.lit(0.0))) / (1 + len(CHIPS)))
    return rounded(rows.select("code", "date", *(F.expr(v).alias(k) for k, v in PRESETS.items()), "reversal_ranker_v1", "rev_plus_chip_core"))


CASH = (1.03 ** (20 / 252) - 1) * 100
_DUAL = f"""{SIGNALS}, du0 AS (SELECT *, CASE WHEN code % 2 = 0 THEN 'portfolio_pool' ELSE 'single_stock' END AS task_mode, CASE WHEN agent_policy_score >= 0.62 THEN 1.0 WHEN agent_policy_score >= 0.5 THEN 0.6 WHEN agent_policy_score >= 0.4 THEN 0.25 ELSE 0.0 END::DOUBLE AS w FROM sg),
du AS (SELECT *, w > 0 AS active, {rank_sql('agent_policy_score', 'task_mode', 'date')} AS rx, {rank_sql('return_20d', 'task_mode', 'date')} AS ry, avg(return_20d) OVER (PARTITION BY task_mode, date) AS pool FROM du0),
dd AS (SELECT time_block, task_mode, date, corr(rx, ry) FILTER (return_20d IS NOT NULL) AS ic, avg(return_20d) FILTER (active) - max(pool) AS excess, list(code ORDER BY code) FILTER (active) AS codes, count(*) FILTER (active) / count(*) AS exposed FROM du GROUP BY 1, 2, 3),
dt AS (SELECT *, lag(codes) OVER (PARTITION BY task_mode ORDER BY date) AS before FROM dd),
dv AS (SELECT time_block, task_mode, avg(ic) AS rank_ic, avg(excess) AS pool_excess_20d, avg(exposed) AS active_exposure, avg(CASE WHEN len(before) > 0 OR len(codes) > 0 THEN 1 - len(list_intersect(coalesce(codes, []), coalesce(before, []))) / greatest(coalesce(len(codes), 0), coalesce(len(before), 0)) END) FILTER (before IS NOT NULL) AS turnover FROM dt GROUP BY 1, 2),
dc AS (SELECT time_block, task_mode, count(*) AS decision_cards, count(*) FILTER (active AND return_20d IS NOT NULL) AS exposure_cards, count(return_20d) AS all_joined_cards, avg(return_20d) FILTER (active) AS avg_return_20d_exposure, avg((return_20d > 0)::INT) FILTER (active) AS positive_20d_rate_exposure,
  stddev_pop(return_20d) FILTER (active) AS std_return_20d_exposure, avg(w * return_20d + (1 - w) * {CASH!r}) AS cash_adjusted_avg_return_20d, avg((w * return_20d + (1 - w) * {CASH!r} > 0)::INT) AS cash_adjusted_positive_20d_rate, stddev_pop(w * return_20d + (1 - w) * {CASH!r}) AS cash_adjusted_std_return_20d, count(*) FILTER (data_gaps <> '') AS data_missing_flag_cards FROM du GROUP BY 1, 2)"""
_DUALS = ["avg_return_20d_exposure", "positive_20d_rate_exposure", "std_return_20d_exposure", "cash_adjusted_avg_return_20d", "cash_adjusted_positive_20d_rate", "cash_adjusted_std_return_20d", "rank_ic", "pool_excess_20d", "active_exposure", "turnover"]


@query(f"""WITH {_DUAL} SELECT time_block, task_mode, decision_cards, exposure_cards, all_joined_cards, data_missing_flag_cards, {', '.join(f'round({c}, 6) AS {c}' for c in _DUALS)},
 CASE WHEN active_exposure < 0.15 THEN true WHEN active_exposure >= 0.30 THEN false WHEN avg_return_20d_exposure IS NULL THEN coalesce(cash_adjusted_avg_return_20d > 0, false) ELSE coalesce(cash_adjusted_avg_return_20d > avg_return_20d_exposure + 0.25, false) END AS defensive_not_alpha FROM dc JOIN dv USING (time_block, task_mode)""")
def m_dual_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both modes' cards by block: returns of exposed and of cash-adjusted cards, rank correlation,
    excess over the pool, exposure and turnover."""
    s = F.col("agent_policy_score")
    rows = signals(spark, sf_dir).withColumns({"task_mode": F.when(F.col("code") % 2 == 0, "portfolio_pool").otherwise("single_stock"), "w": F.when(s >= 0.62, 1.0).when(s >= 0.5, 0.6).when(s >= 0.4, 0.25).otherwise(0.0)})
    return rounded(policy.dual_mode(rows, CASH).select("time_block", "task_mode", "decision_cards", "exposure_cards", "all_joined_cards", "data_missing_flag_cards", *_DUALS, "defensive_not_alpha"))
