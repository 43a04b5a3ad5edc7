"""The decision table that policies and walk-forward queries read: the signals under the names that
gates and rulebooks use and whether a row came out well, with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.plans.signals import SIGNALS, signals

SKILLS = ["PPS-Q-017", "PPS-Q-019", "DOW-B-017"]
COLUMNS = """code date industry area volume close time_block return_20d prior_return_20d kline_return_60d relative_strength_rank peer_relative_to_group_20d peer_group_positive_breadth_20d close_above_ma200
atr20_pct drawdown60 news_count_30d news_risk_event_score_30d counter_score pool_excess_20d pool_return_rank_pct data_gaps triggered_skills rsi14
total_score trend_score book_score ma200_slope20 peer_group_above_ma200_rate news_conflict_intensity_30d news_opportunity_score""".split()


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = F.coalesce((F.col("return_20d") > 0) & (F.col("pool_excess_20d") > 0), F.lit(False))
    return signals(spark, sf_dir).select(*COLUMNS, passed.alias("gt_pass"))


DECISIONS = f"""{SIGNALS}, d AS (SELECT {', '.join(COLUMNS)}, coalesce(return_20d > 0 AND pool_excess_20d > 0, false) AS gt_pass FROM sg)"""
