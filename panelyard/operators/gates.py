"""The named gates of a search over splits: a row goes once, to all gates that it passes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET_AVG, TARGET_POS = 8.0, 0.65
SPLITS = ("search", "valid", "test")
LEAST = {"search": 80, "valid": 30, "test": 20}
SEARCH_SHARE = 0.65


class Gate(NamedTuple):
    """A gate and its condition; the same text is SQL in both engines, and null fails."""

    name: str
    sql: str


def _skill(token: str) -> str:
    return f"contains(coalesce(triggered_skills, ''), '{token}')"


# fixed values: names, columns and thresholds of the gates
GATES = [
    Gate("原始放入观察以上", "rating IN ('放入观察', '继续深挖')"),
    *(Gate(f"相对强弱>={t}", f"relative_strength_rank >= {t}") for t in (0.5, 0.6, 0.67, 0.75, 0.8, 0.9)),
    *(Gate(f"20日动量>={t}", f"prior_return_20d >= {t}") for t in (0, 5, 10, 15, 20)),
    *(Gate(f"总分>={t}", f"total_score >= {t}") for t in (5.0, 5.2, 5.4)),
    *(Gate(f"趋势分>={t}", f"trend_score >= {t}") for t in (7, 8)),
    *(Gate(f"触发{s}", _skill(s)) for s in ("PPS-Q-017", "PPS-Q-019", "DOW-B-017", "PPS-Q-009", "DOW-B-004", "CANDLE_MACRO_002")),
    Gate("无30日新闻事件", "coalesce(news_count_30d, 0) = 0"),
    Gate("低新闻风险", "coalesce(news_warning_score, 0) <= 0"),
    Gate("正新闻净重大性", "coalesce(news_net_materiality_30d, 0) > 0"),
    Gate("新闻冲突低", "coalesce(news_conflict_intensity_30d, 0) <= 0"),
    Gate("强于同组20日", "coalesce(peer_relative_to_group_20d, 0) > 0"),
    Gate("同组广度>=60%", "coalesce(peer_group_positive_breadth_20d, 0) >= 0.6"),
    Gate("同组站上200DMA>=60%", "coalesce(peer_group_above_ma200_rate, 0) >= 0.6"),
    Gate("同组新闻风险低", "coalesce(peer_group_news_risk_avg, 0) <= 0"),
    Gate("站上200DMA", "close_above_ma200"),
    Gate("共振:200DMA+强弱前1/3+DOW", f"relative_strength_rank >= 0.67 AND close_above_ma200 AND {_skill('PPS-Q-017')} AND {_skill('PPS-Q-019')} AND {_skill('DOW-B-017')}"),
    Gate("强动量低反证", "prior_return_20d >= 10 AND relative_strength_rank >= 0.67 AND counter_score >= 7"),
    Gate("强趋势排除回撤观察区", f"trend_score >= 8 AND NOT {_skill('DOW-B-004')}"),
    Gate("科创强势门控", "sector_group = 'star_technology' AND relative_strength_rank >= 0.67 AND close_above_ma200"),
    Gate("个股强于同组且新闻风险低", "coalesce(peer_relative_to_group_20d, 0) > 0 AND coalesce(news_warning_score, 0) <= 0"),
]


def split(rows: DataFrame, test: Column) -> DataFrame:
    """rows with split: test, or search up to the date at 65 % of the other dates and valid after it;
    below four dates all is search."""
    days = rows.where(~test).select("date").distinct()
    w = Window.orderBy("date")
    numbered = days.select("date", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy()).alias("n"))  # a row a date
    cut = numbered.agg(F.max(F.when(F.col("i") == F.floor(F.col("n") * SEARCH_SHARE), F.col("date"))).alias("_cut"), F.max("n").alias("_n"))
    both = rows.join(F.broadcast(cut))  # one row
    return both.withColumn("split", F.when(test, "test").when((F.col("_n") < 4) | (F.col("date") <= F.col("_cut")), "search").otherwise("valid")).drop("_cut", "_n")


def metrics(rows: DataFrame) -> DataFrame:
    """(gate, split, …): the record of each gate's rows."""
    passed = F.array_compact(F.array(*(F.when(F.expr(g.sql), F.lit(g.name)) for g in GATES)))
    r = F.col("return_20d")
    out = rows.select("split", "return_20d", F.explode(passed).alias("gate")).groupBy("gate", "split").agg(
        F.count("*").alias("sample_count"), F.avg(r).alias("avg_return_20d"), F.avg((r > 0).cast("int")).alias("positive_20d_rate"), F.stddev_samp(r).alias("std_return_20d"), F.avg((r <= -5).cast("int")).alias("loss_20d_over_5_rate")
    )
    return out.withColumn("stability_score", F.col("avg_return_20d") - 0.5 * F.coalesce("std_return_20d", F.lit(0.0)) - 10 * F.col("loss_20d_over_5_rate"))


def chosen(records: DataFrame) -> DataFrame:
    """A row a gate: its samples, whether targets are hit on validation (search too) and test, score."""
    names = ("sample_count", "avg_return_20d", "positive_20d_rate", "stability_score")
    wide = records.groupBy("gate").agg(*(F.max(F.when(F.col("split") == p, F.col(c))).alias(f"{p}_{c}") for p in SPLITS for c in names))
    hit = lambda p: F.coalesce((F.col(f"{p}_sample_count") >= LEAST[p]) & (F.col(f"{p}_avg_return_20d") >= TARGET_AVG) & (F.col(f"{p}_positive_20d_rate") >= TARGET_POS), F.lit(False))
    known = lambda c, other: F.coalesce(F.col(c), F.lit(float(other)))
    valid = hit("search") & hit("valid")
    score = known("valid_avg_return_20d", -999) + known("valid_positive_20d_rate", 0) * 10 + known("valid_stability_score", -999) * 0.2
    return wide.select("gate", *(F.coalesce(f"{p}_sample_count", F.lit(0)).alias(f"{p}_sample_count") for p in SPLITS), valid.alias("target_hit_on_valid"), (valid & hit("test")).alias("target_hit_on_test"), score.alias("selection_score"))
