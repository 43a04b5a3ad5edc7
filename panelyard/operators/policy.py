"""Row-level policies: gates, risk flags, decisions, grades, labels; and skill tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.expr import clip, count_true, named, rank_pct

GAP = "financial_publish_date_missing"
# fixed values: grades and actions, from the best down
GRADES = ("继续深挖", "放入观察", "暂时剔除", "信息不足")
ACTIONS = ("增加研究暴露", "保持观察", "降低研究暴露", "转入现金")
# fixed values: sample sizes and sizes of means by which a skill is judged
LEAST_TRAIN, LEAST_TEST, STRONG = 30, 10, 3.0
# fixed values: linear score presets as (column, weight)
DEFAULT_PRESET = [("relative_strength_rank", 1.0), ("counter_score", 0.08), ("close_above_ma200", 0.25), ("news_count_30d", 0.03), ("peer_relative_to_group_20d", 0.05), ("news_risk_event_score_30d", -0.15)]
# fixed values: weights of the need for a single review
NEED = [("news_risk_event_score_30d", 0.50), ("atr20_pct", 0.08), ("drawdown60", -0.05), ("news_count_30d", 0.04)]


def on(c: Column) -> Column:
    """A condition, null counts as not."""
    return F.coalesce(c, F.lit(False))


def zero(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def has_skill(skill: str) -> Column:
    return F.array_contains(F.split(F.coalesce("triggered_skills", F.lit("")), ";"), skill)


def adapted_mask(skills: list[str]) -> Column:
    """The adapted strategy: all skills fired on a strong row above its long average."""
    out = on(F.col("prior_return_20d") > 0) & on(F.col("relative_strength_rank") >= 0.67) & on(F.col("close_above_ma200"))
    for skill in skills:
        out = out & has_skill(skill)
    return out


def risk_flags(df: DataFrame) -> DataFrame:
    """Eight flags on chips, prices and volumes, their number, that of the older seven, their names."""
    c = F.col
    flags = {
        "chase_high": (c("winner_rate_pct") >= 75) & (c("chip_range_position") >= 0.85),
        "extreme_cost_high": c("cost_position") >= 0.92,
        "extreme_cost_low": c("cost_position") <= 0.08,
        "upper_overhang_rally": (c("upper_overhang") >= 0.25) & (c("kline_return_20d") >= 10),
        "volume_stall": (c("kline_return_20d") >= 8) & (c("kline_return_3d") <= 0) & (c("kline_volatility_ratio_3_20") >= 1.3),
        "deep_drawdown_accel": (c("kline_drawdown_60d") <= -25) & (c("kline_return_5d") <= -3),
        "peer_weakness": c("corr_peer_avg_return_20d") <= -5,
        "chip_loosen_rally": (c("winner_rate_pct") >= 70) & (c("kline_return_20d") >= 15),
    }
    flags = {k: on(v) for k, v in flags.items()}
    older = [c(k) for k in flags if k != "chip_loosen_rally"]
    return df.withColumns(flags).withColumns({"risk_flag_count": count_true(*(c(k) for k in flags)), "risk_flag_count_baseline": count_true(*older), "risk_flag_names": named({k: c(k) for k in flags}, ";")})


def decision(df: DataFrame) -> DataFrame:
    """A linear confidence and the grade, action and weight it leads to. Warnings and opportunities
    are the larger of two scores; memory_counter is what case memory holds against the row."""
    overheat = on(F.col("rsi14") >= 70) | on(F.col("prior_return_20d") >= 12)
    warning = F.greatest(zero("news_warning_score_30d"), zero("news_risk_event_score_30d"), F.lit(0.0))
    confidence = (
        0.30 * zero("relative_strength_rank") + 0.18 * on(F.col("close_above_ma200")).cast("double") + 0.014 * zero("counter_score") + 0.08 * (F.coalesce("triggered_skills", F.lit("")) != "").cast("double")
        + 0.08 * F.least(F.greatest(zero("news_opportunity_event_score_30d"), F.lit(0.0)), F.lit(1.0)) - 0.18 * F.least(warning, F.lit(2.0)) - 0.12 * overheat.cast("double") - 0.16 * zero("memory_counter")
        - 0.016 * F.coalesce("data_gaps", F.lit("")).contains(GAP).cast("double")
    )
    out = df.withColumns({"overheat_flag": overheat, "confidence_level": F.round(F.round(clip(confidence, 0, 1), 9), 4)})
    pick = lambda *v: F.when(F.col("confidence_level") >= 0.58, v[0]).when(F.col("confidence_level") >= 0.44, v[1]).when(F.col("confidence_level") >= 0.30, v[2]).otherwise(v[3])
    return out.withColumns({"research_grade": pick(*GRADES), "simulated_action": pick(*ACTIONS), "simulated_weight_change": pick(1.0, 0.6, 0.25, 0.0)})


def graded(df: DataFrame, flag_limit: int = 3, critical: str = "deep_drawdown_accel") -> DataFrame:
    """Grade and weight by opportunity tier (strong, middle, weak, none), risk flags, missing data,
    an abstaining regime and confidence; the first rule that holds decides."""
    tier = F.col("opportunity_tier")
    bonus = F.when(tier == "strong", 0.35).when(tier == "middle", 0.22).when(tier == "weak", 0.10).otherwise(0.0)
    base = 0.25 + bonus + F.coalesce(F.greatest(F.lit(-0.15), F.least(F.lit(0.25), F.col("score") * 0.08)), F.lit(0.0)) - 0.12 * F.col("risk_flag_count") - 0.15 * F.col("regime_abstain").cast("double") - 0.2 * F.col("data_missing").cast("double")
    out = df.withColumn("confidence", F.round(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base)), 9), 4))
    upper = tier.isin("strong", "middle")
    dig, watch, aside, unknown = GRADES
    rules = [
        (F.col("data_missing"), unknown, 0.0),
        ((F.col("risk_flag_count") >= flag_limit) | F.col("risk_flag_names").contains(critical), aside, 0.05),
        (F.col("regime_abstain") & upper, watch, 0.1),
        ((tier == "strong") & (F.col("confidence") >= 0.45), dig, 0.7),
        (upper, watch, 0.15),
        (tier == "weak", watch, 0.08),
        ((F.col("confidence") < 0.25) | F.col("regime_abstain"), unknown, 0.0),
    ]
    grade, weight = F, F
    for when, g, w in rules:
        grade, weight = grade.when(when, g), weight.when(when, w)
    return out.withColumns({"grade": grade.otherwise(watch), "weight": weight.otherwise(0.05)})


def outcome_label(soft_gap: Column) -> Column:
    """positive_support over hard_counter over soft_gap over neutral."""
    r, excess, rank = F.col("return_20d"), zero("pool_excess_20d"), F.coalesce("pool_return_rank_pct", F.lit(0.5))
    return F.when(on(r > 0) & (excess >= 2) & (rank >= 0.70), "positive_support").when(on(r <= -5) | (excess <= -5), "hard_counter").when(soft_gap & on(r >= -2) & (excess >= -1.5), "soft_gap").otherwise("neutral")


def linear(preset: list[tuple[str, float]]) -> Column:
    """A weighted sum of columns, null counts as 0."""
    out = F.lit(0.0)
    for name, weight in preset:
        out = out + zero(name) * weight
    return out


def need_score() -> Column:
    """How much a row needs a single review."""
    return linear(NEED) + 0.25 * (F.coalesce("data_gaps", F.lit("")) != "").cast("double") + 0.15 * (F.coalesce("triggered_skills", F.lit("")) != "").cast("double")


def bins(x: str, edges: list[float]) -> Column:
    """Labels of right-closed bins: '(a, b]'; null beyond them."""
    out = F
    for a, b in zip(edges, edges[1:]):
        out = out.when((F.col(x) > a) & (F.col(x) <= b), f"({a}, {b}]")
    return out.otherwise(F.lit(None))


def skill_stats(df: DataFrame, part: str) -> DataFrame:
    """A row for each skill token and part."""
    tokens = F.explode(F.array_distinct(F.filter(F.split(F.coalesce("triggered_skills", F.lit("")), ";"), lambda t: t != ""))).alias("skill")
    return df.select(part, "return_20d", "gt_pass", tokens).groupBy("skill", part).agg(
        F.count("*").alias("trigger_count"), F.avg(F.col("gt_pass").cast("int")).alias("gt_pass_rate"), F.avg("return_20d").alias("avg_return_20d"), F.avg((F.col("return_20d") > 0).cast("int")).alias("positive_20d_rate")
    )


def skill_judgement() -> Column:
    """Whether a skill is worth reusing, of a row with train and test counts and means."""
    test, train = F.col("test_avg_return_20d"), F.col("train_avg_return_20d")
    return (
        F.when(F.coalesce("train_trigger_count", F.lit(0)) < LEAST_TRAIN, "too_few_samples")
        .when(F.coalesce("test_trigger_count", F.lit(0)) < LEAST_TEST, "too_few_test_triggers")
        .when(test * train < 0, "refuted_by_test")
        .when(F.abs(test) >= STRONG, "candidate_for_review")
        .otherwise("weak_direction")
    )


def defensive_not_alpha(exposure: str, invested: str, adjusted: str) -> Column:
    """A portfolio that looks good because it holds little."""
    e, i, a = F.col(exposure), F.col(invested), F.col(adjusted)
    return F.when(e.isNull(), False).when(e < 0.15, True).when(e >= 0.30, False).when(a.isNull(), False).when(i.isNull(), a > 0).otherwise(a > i + 0.25)


def dual_mode(cards: DataFrame, cash: float, block: str = "time_block") -> DataFrame:
    """A row for each block and task mode of cards (code, date, task_mode, w, return_20d,
    agent_policy_score, data_gaps). Exposed are cards with a weight; turnover compares a date's
    exposed codes with those of the mode's date before."""
    day = Window.partitionBy("task_mode", "date")
    r, active = F.col("return_20d"), F.col("w") > 0
    made = F.col("w") * r + (1 - F.col("w")) * cash
    on_ = lambda c: F.when(active, c)
    sums = cards.groupBy(block, "task_mode").agg(
        F.count("*").alias("decision_cards"), F.count(on_(r)).alias("exposure_cards"), F.count(r).alias("all_joined_cards"), F.avg(on_(r)).alias("avg_return_20d_exposure"), F.avg(on_((r > 0).cast("int"))).alias("positive_20d_rate_exposure"),
        F.stddev_pop(on_(r)).alias("std_return_20d_exposure"), F.avg(made).alias("cash_adjusted_avg_return_20d"), F.avg((made > 0).cast("int")).alias("cash_adjusted_positive_20d_rate"), F.stddev_pop(made).alias("cash_adjusted_std_return_20d"), F.count_if(F.col("data_gaps") != "").alias("data_missing_flag_cards"),
    )
    ranked = cards.withColumns({"rx": rank_pct("agent_policy_score", "task_mode", "date"), "ry": rank_pct("return_20d", "task_mode", "date"), "pool": F.avg("return_20d").over(day)})
    daily = ranked.groupBy(block, "task_mode", "date").agg(
        F.corr(F.when(r.isNotNull(), F.col("rx")), "ry").alias("ic"), (F.avg(on_(r)) - F.max("pool")).alias("excess"), F.collect_list(on_(F.col("code"))).alias("codes"), (F.count_if(active) / F.count("*")).alias("exposed")
    )
    before = F.lag("codes").over(Window.partitionBy("task_mode").orderBy("date"))  # a row a date
    larger = F.nullif(F.greatest(F.size("codes"), F.size("before")), F.lit(0))
    moved = daily.withColumn("before", before).withColumn("turnover", F.when(F.col("before").isNotNull(), 1 - F.size(F.array_intersect("codes", "before")) / larger))
    over = moved.groupBy(block, "task_mode").agg(F.avg("ic").alias("rank_ic"), F.avg("excess").alias("pool_excess_20d"), F.avg("exposed").alias("active_exposure"), F.avg("turnover").alias("turnover"))
    out = sums.join(over, [block, "task_mode"])
    return out.withColumn("defensive_not_alpha", F.coalesce(defensive_not_alpha("active_exposure", "avg_return_20d_exposure", "cash_adjusted_avg_return_20d"), F.lit(False)))
