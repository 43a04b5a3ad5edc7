"""Evidence by channel: confirmations, positive evidence, hard conflicts, conflict flags and the row
gates and scores made of them. Each is an expression in SQL over the signals' columns; unknown values
take the default that is stated with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.operators.policy import GAP
from panelyard.operators.walkforward import block_index


def _n(name: str, default: float = 0.0) -> str:
    return f"coalesce({name}, {default})"


# fixed values: statuses that say that a report is truly missing
TRUE_MISSING = "financial_report_join_status IN ('feature_table_missing', 'code_not_in_feature_table', 'decision_date_invalid')"
_WARN, _OPP, _LOW, _OVER = _n("news_warning_score"), _n("news_opportunity_score"), _n("lower_support"), "coalesce(upper_overhang, {})"
_BREADTH, _AHEAD = "coalesce(peer_group_positive_breadth_20d, {})", _n("peer_relative_to_group_20d")
_K20, _K60, _ATR = _n("prior_return_20d"), _n("kline_return_60d"), _n("atr20_pct")
_RISK, _SURPRISE = "coalesce(financial_quality_risk_score, {})", _n("financial_surprise_score")
_SKILLED = "length(coalesce(triggered_skills, '')) > 0 AND NOT contains(upper(coalesce(triggered_skills, '')), 'UNKNOWN')"
_WORRY = f"({_WARN} >= 0.55 OR ({_WARN} >= 0.35 AND {_WARN} > {_OPP}))"
_FALLEN = f"({_K20} <= -20 OR {_K60} <= -35 OR {_ATR} >= 12)"

# fixed values: the channels' thresholds
CONFIRMED = {
    "news": f"coalesce(news_missing_rate, 1) < 0.8 AND news_count_30d > 0 AND {_n('news_evidence_quality')} >= 0.5 AND {_OPP} >= {_WARN}",
    "financial": f"{_n('financial_report_event_count')} > 0 AND {_RISK.format(1.0)} < 0.6",
    "peer": f"{_BREADTH.format(0.0)} >= 0.5 AND {_AHEAD} >= -1",
    "chip": f"{_LOW} >= 0.15 AND {_OVER.format(1.0)} <= 1.5",
    "book": _SKILLED,
}
POSITIVE = {
    "news": f"coalesce(news_missing_rate, 1) < 0.75 AND news_count_30d > 0 AND {_n('news_evidence_quality')} >= 0.35 AND {_OPP} >= {_WARN} AND {_OPP} >= 0.30",
    "financial": f"financial_report_join_status = 'event_window_matched' AND {_n('financial_report_event_count')} > 0 AND {_RISK.format(1.0)} < 0.45 AND {_SURPRISE} >= 0",
    "peer": f"{_BREADTH.format(0.0)} >= 0.55 AND {_AHEAD} >= 0",
    "chip": f"{_LOW} >= 0.15 AND {_OVER.format(1.0)} <= 1.5 AND {_n('cost_band_width', 1.0)} <= 1.5",
    "kline": f"{_K20} BETWEEN -12 AND 8 AND {_K60} > -25 AND {_ATR} < 8",
    "book": _SKILLED,
}
HARD = {
    "news": _WORRY,
    "financial": f"{_RISK.format(0.0)} >= 0.55 OR {_SURPRISE} <= -0.35 OR {TRUE_MISSING}",
    "peer": f"{_BREADTH.format(0.5)} <= 0.40 AND {_AHEAD} < 0",
    "chip": f"{_OVER.format(0.0)} >= 1.5 OR {_n('cost_band_width')} >= 1.5",
    "kline": _FALLEN,
}
#: Conflict flags in their order.
CONFLICTS = {
    "peer_weak": HARD["peer"],
    "chip_overhang": HARD["chip"],
    "kline_risk": _FALLEN,
    "news_risk": _WORRY,
    "financial_risk": f"{_RISK.format(0.0)} >= 0.55 OR {_SURPRISE} <= -0.35",
    "financial_true_missing": TRUE_MISSING,
    "bookskill_missing_or_weak": f"NOT ({_SKILLED})",
    "news_missing": "coalesce(news_missing_rate, 1) >= 0.80",
    "financial_no_recent_event": "financial_report_join_status = 'no_event_in_window'",
}
_NO_GAP = f"NOT contains(coalesce(data_gaps, ''), '{GAP}')"


def total(tests: dict[str, str]) -> str:
    """How many hold; null counts as not."""
    return "(" + " + ".join(f"CAST(coalesce({t}, false) AS INT)" for t in tests.values()) + ")"


PORTFOLIO_GATES = {
    "none": "true",
    "peer_relative_positive": "peer_relative_to_group_20d > 0",
    "peer_breadth_above_half": "peer_group_positive_breadth_20d >= 0.50",
    "no_major_data_gap": _NO_GAP,
    "news_risk_low": f"{_WARN} <= 0",
    "peer_and_gap_safe": f"{_BREADTH.format(0.0)} >= 0.50 AND {_AHEAD} > -3 AND {_NO_GAP}",
    "cross_channel_min2": f"{total(CONFIRMED)} >= 2",
    "cross_channel_min3": f"{total(CONFIRMED)} >= 3",
    "positive_confirmation_min1_no_hard": f"{total(POSITIVE)} >= 1 AND {total(HARD)} = 0",
    "positive_confirmation_min2": f"{total(POSITIVE)} >= 2",
    "positive_confirmation_min2_no_hard": f"{total(POSITIVE)} >= 2 AND {total(HARD)} = 0",
    "kline_reversal_friction_confirmed": f"{_FALLEN} AND {total(POSITIVE)} >= 2 AND {_LOW} >= 0.15 AND {_OVER.format(1.0)} <= 1.3 AND NOT ({TRUE_MISSING})",
    "financial_event_quality_pc2": f"{total(POSITIVE)} >= 2 AND financial_report_join_status = 'event_window_matched' AND {_RISK.format(1.0)} < 0.45 AND {_SURPRISE} >= 0",
}


def conflict_flags(rows: DataFrame) -> DataFrame:
    """rows with the nine flags, how many hold, and their names joined, or no_conflict."""
    out = rows.withColumns({k: F.coalesce(F.expr(t), F.lit(False)) for k, t in CONFLICTS.items()})
    names = F.concat_ws("+", *(F.when(F.col(k), F.lit(k)) for k in CONFLICTS))
    return out.withColumns({"n_conflicts": sum((F.col(k).cast("int") for k in CONFLICTS), F.lit(0)), "conflict_combo": F.when(names == "", "no_conflict").otherwise(names)})


def quality_label() -> Column:
    """What became of a row that was taken despite its conflicts."""
    r, excess = F.col("return_20d"), F.col("pool_excess_20d")
    return F.when(r.isNull() | excess.isNull(), "unknown").when((r > 0) & (excess > 0), "acceptable_conflict_or_alpha").when((r <= -5) | (excess <= -5), "veto_risk").when(r > 0, "market_beta_only").otherwise("weak_or_negative")


def conflict_books(rows: DataFrame, least: int = 30, quantile: float = 0.80, block: str = "time_block") -> DataFrame:
    """(valid_block, kind, key, …): of the rows in the score's upper fifth, the record of each
    conflict (single) and each combination of them (combo) over the blocks before valid_block, and
    the status it leads to. Excess is over the mean of the rows taken on that date. Rows are summed
    up by block first."""
    taken = conflict_flags(rows.where(F.col("rev_chip_score_quantile") >= quantile).drop("pool_excess_20d"))
    pool = taken.groupBy("date").agg(F.avg("return_20d").alias("_pool"))
    taken = taken.join(pool, "date").withColumn("pool_excess_20d", F.col("return_20d") - F.col("_pool")).withColumn("label", quality_label())
    single = F.transform(F.array_compact(F.array(*(F.when(F.col(k), F.lit(k)) for k in CONFLICTS))), lambda k: F.struct(F.lit("single").alias("kind"), k.alias("key")))
    keys = F.explode(F.concat(single, F.array(F.struct(F.lit("combo").alias("kind"), F.col("conflict_combo").alias("key")))))
    r = F.col("return_20d")
    parts = taken.select(block, "return_20d", "pool_excess_20d", "label", keys.alias("k")).groupBy(block, "k.kind", "k.key").agg(
        F.count("*").alias("n"), F.count(r).alias("known"), F.sum(r).alias("total"), F.sum("pool_excess_20d").alias("excess"), F.count_if(r > 0).alias("up"), F.count_if(r <= -5).alias("down"),
        F.count_if(F.col("label") == "acceptable_conflict_or_alpha").alias("fine"), F.count_if(F.col("label") == "veto_risk").alias("veto"),
    )
    order = block_index(rows, block)
    later = order.select(F.col(block).alias("valid_block"), F.col("idx").alias("_k"))
    share = lambda a, b: F.sum(a) / F.nullif(F.sum(b), F.lit(0))
    past = parts.join(order, block).join(later, F.col("idx") < F.col("_k")).groupBy("valid_block", "kind", "key").agg(
        F.sum("n").alias("n_rows"), share("total", "known").alias("avg20"), share("up", "known").alias("pos20"), share("excess", "known").alias("pool_excess20"), share("down", "n").alias("loss_gt5_rate"),
        F.min(F.col("up") / F.nullif(F.col("known"), F.lit(0))).alias("min_block_pos20"), share("fine", "n").alias("acceptable_label_rate"), share("veto", "n").alias("veto_label_rate"),
    )
    c = F.col
    good = (c("avg20") > 0) & (c("pos20") >= 0.55) & (c("pool_excess20") > 0) & F.coalesce(c("loss_gt5_rate") <= 0.25, F.lit(True)) & F.coalesce(c("min_block_pos20") >= 0.40, F.lit(True))
    bad = (c("avg20") < 0) | (c("pos20") <= 0.45) | (c("pool_excess20") < 0) | (c("loss_gt5_rate") >= 0.30)
    status = F.when(good, "acceptable_reversal_friction").when(bad, "veto_or_downweight").otherwise("mixed_needs_agent_judgment")
    return past.where(c("n_rows") >= least).withColumn("rule_status", status)
