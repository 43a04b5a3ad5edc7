"""Walk-forward evaluation over time blocks: roles, rulebooks from earlier blocks, date gates, summaries.

Rows are first summed up per block (map-side), and blocks, of which there are few, are joined with
their later ones; no row is ever repeated for each block that looks back on it."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.expr import safe_div, share

# fixed values: thresholds of the rulebooks' statuses
GOOD_POS, GOOD_LOSS, GOOD_LEAST_BLOCK = 0.55, 0.25, 0.40
BAD_POS, BAD_LOSS = 0.45, 0.30
POS_LIFT, EXCESS_LIFT, LIFT_LOSS = 0.04, 0.35, 0.30
# fixed values: date gates as (name, feature, side, quantile)
DATE_GATES = [
    ("pool_deep_fall", "pool_avg_prior_return_20d", "<=", 0.25),
    ("pool_strong", "pool_avg_prior_return_20d", ">=", 0.75),
    ("low_news_risk", "pool_avg_news_risk", "<=", 0.35),
    ("high_breadth", "pool_positive_breadth_20d", ">=", 0.65),
    ("low_breadth_rebound", "pool_positive_breadth_20d", "<=", 0.35),
    ("high_dispersion", "pool_return_dispersion_20d", ">=", 0.70),
]
# fixed values: date gates that hold where two others of their own quantiles do
COMPOUND_GATES = [
    ("deep_fall_low_dispersion", ("pool_avg_prior_return_20d", "<=", 0.25), ("pool_return_dispersion_20d", "<=", 0.60)),
    ("low_breadth_low_news_risk", ("pool_positive_breadth_20d", "<=", 0.35), ("pool_avg_news_risk", "<=", 0.35)),
]
# fixed values: formulas as weights of the features' ranks on a date, and those for rebounds
FORMULAS = {
    "质量趋势防守": {"total_score": 0.35, "relative_strength_rank": 0.25, "close_above_ma200": 0.20, "news_risk_event_score_30d": -0.20},
    "同组共振": {"relative_strength_rank": 0.25, "peer_group_positive_breadth_20d": 0.25, "peer_group_above_ma200_rate": 0.25, "news_risk_event_score_30d": -0.25},
    "相对同组强势": {"peer_relative_to_group_20d": 0.40, "relative_strength_rank": 0.25, "total_score": 0.20, "news_risk_event_score_30d": -0.15},
    "低风险观察": {"counter_score": 0.35, "news_risk_event_score_30d": -0.35, "news_conflict_intensity_30d": -0.15, "atr20_pct": -0.15},
    "深跌反弹候选": {"drawdown60": -0.35, "prior_return_20d": -0.25, "counter_score": 0.20, "news_risk_event_score_30d": -0.20},
    "深跌但同组回暖": {"drawdown60": -0.30, "prior_return_20d": -0.20, "peer_group_positive_breadth_20d": 0.25, "peer_group_above_ma200_rate": 0.15, "news_risk_event_score_30d": -0.10},
    "公告风险回避": {"news_risk_event_score_30d": -0.45, "total_score": 0.20, "counter_score": 0.10},
    "公告机会低风险": {"news_opportunity_score": 0.25, "news_risk_event_score_30d": -0.35, "relative_strength_rank": 0.20, "close_above_ma200": 0.20},
    "BookSkill保守": {"book_score": 0.30, "counter_score": 0.30, "trend_score": 0.20, "news_risk_event_score_30d": -0.20},
    "低波动趋势": {"close_above_ma200": 0.30, "ma200_slope20": 0.25, "atr20_pct": -0.25, "news_risk_event_score_30d": -0.20},
    "反弹:同组回暖小组": {"drawdown60": -0.30, "prior_return_20d": -0.20, "peer_group_positive_breadth_20d": 0.25, "peer_group_above_ma200_rate": 0.15, "news_risk_event_score_30d": -0.10},
    "反弹:低波动修复": {"drawdown60": -0.25, "prior_return_20d": -0.20, "atr20_pct": -0.25, "counter_score": 0.20, "news_risk_event_score_30d": -0.10},
    "反弹:低新闻风险": {"drawdown60": -0.25, "prior_return_20d": -0.20, "news_risk_event_score_30d": -0.35, "counter_score": 0.20},
    "反弹:趋势未破坏": {"drawdown60": -0.20, "prior_return_20d": -0.20, "close_above_ma200": 0.25, "ma200_slope20": 0.20, "news_risk_event_score_30d": -0.15},
}
# fixed values: targets of a formula on the search's validation dates
TARGET_AVG, TARGET_POS, LEAST_DATES = 8.0, 0.65, 20


def block_index(df: DataFrame, block: str = "time_block") -> DataFrame:
    """(block, idx): the distinct blocks in order, from 1; a row a block."""
    return df.select(block).distinct().withColumn("idx", F.row_number().over(Window.orderBy(block)))


def rolling_roles(df: DataFrame, block: str = "time_block") -> DataFrame:
    """(target_block, block, role): for each block from the third on, the block before it is valid
    and those before that are train."""
    one = block_index(df, block)
    two = one.select(F.col(block).alias("target_block"), F.col("idx").alias("k")).where("k >= 3")
    role = F.when(F.col("idx") == F.col("k"), "target").when(F.col("idx") == F.col("k") - 1, "valid").otherwise("train")
    return one.join(two, F.col("idx") <= F.col("k")).select("target_block", block, role.alias("role"))


def rule_blocks(df: DataFrame, rules: dict[str, Column], block: str = "time_block") -> DataFrame:
    """Sums for each rule (and base, which takes all rows) and block: the parts of rulebooks."""
    fired = F.array_compact(F.array(F.lit("base"), *(F.when(c, F.lit(k)) for k, c in rules.items())))
    rows = df.where("return_20d is not null").select(block, "return_20d", "pool_excess_20d", F.explode(fired).alias("rule"))
    return rows.groupBy("rule", block).agg(
        F.count("*").alias("n_rows"),
        F.sum("return_20d").alias("return_sum"),
        F.sum("pool_excess_20d").alias("excess_sum"),
        F.count_if(F.col("return_20d") > 0).alias("n_pos"),
        F.count_if(F.col("return_20d") <= -5).alias("n_loss"),
    )


def rulebooks(parts: DataFrame, least_rows: int, block: str = "time_block") -> DataFrame:
    """(valid_block, rule, …, rule_status): each rule's record over the blocks before valid_block."""
    order = block_index(parts, block)
    later = order.select(F.col(block).alias("valid_block"), F.col("idx").alias("k"))
    past = parts.join(order, block).join(later, F.col("idx") < F.col("k"))
    out = past.groupBy("valid_block", "rule").agg(
        F.sum("n_rows").alias("n_rows"),
        F.count("*").alias("n_blocks"),
        (F.sum("return_sum") / F.sum("n_rows")).alias("avg20"),
        (F.sum("excess_sum") / F.sum("n_rows")).alias("pool_excess20"),
        (F.sum("n_pos") / F.sum("n_rows")).alias("pos20"),
        (F.sum("n_loss") / F.sum("n_rows")).alias("loss_gt5_rate"),
        F.min(F.col("n_pos") / F.col("n_rows")).alias("min_block_pos20"),
    )
    good = (F.col("avg20") > 0) & (F.col("pos20") >= GOOD_POS) & (F.col("pool_excess20") > 0) & (F.col("loss_gt5_rate") <= GOOD_LOSS) & (F.col("min_block_pos20") >= GOOD_LEAST_BLOCK)
    bad = (F.col("avg20") < 0) | (F.col("pos20") <= BAD_POS) | (F.col("pool_excess20") < 0) | (F.col("loss_gt5_rate") >= BAD_LOSS)
    status = F.when(F.col("n_rows") < least_rows, "insufficient_sample").when(good, "acceptable_reversal_friction").when(bad, "veto_or_downweight").otherwise("mixed_needs_agent_judgment")
    return out.withColumn("rule_status", status)


def promotions(books: DataFrame, least_rows: int) -> DataFrame:
    """(valid_block, rule, pos_lift, excess_lift, promote_status): rules against the base row."""
    base = books.where("rule = 'base'").select("valid_block", F.col("pos20").alias("base_pos"), F.col("pool_excess20").alias("base_excess"))
    both = books.where("rule <> 'base'").join(base, "valid_block").withColumns({"pos_lift": F.col("pos20") - F.col("base_pos"), "excess_lift": F.col("pool_excess20") - F.col("base_excess")})
    status = (
        F.when(F.col("n_rows") < least_rows, "observe_too_thin")
        .when((F.col("pos_lift") >= POS_LIFT) & (F.col("excess_lift") >= EXCESS_LIFT) & (F.col("loss_gt5_rate") <= LIFT_LOSS), "promote_candidate")
        .when((F.col("pos_lift") <= 0) | (F.col("excess_lift") <= 0), "rejected_for_promote")
        .otherwise("observe_context_probe")
    )
    return both.withColumn("promote_status", status)


def date_features(df: DataFrame) -> DataFrame:
    """A row for each date: what its pool looked like."""
    return df.groupBy("date").agg(
        F.avg("prior_return_20d").alias("pool_avg_prior_return_20d"),
        F.avg("news_risk_event_score_30d").alias("pool_avg_news_risk"),
        share(F.col("prior_return_20d") > 0, over_all=False).alias("pool_positive_breadth_20d"),
        F.stddev_samp("prior_return_20d").alias("pool_return_dispersion_20d"),
    )


def rounded_half_away(x: np.ndarray, digits: int) -> np.ndarray:
    """As expr.half_away, for arrays."""
    y = x * 10.0**digits
    return np.where(np.abs(y) < 2.0**52, np.sign(y) * np.floor(np.abs(y) + 0.5) / 10.0**digits, x)


def best_by_formula(df: DataFrame, n: int, formulas: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(formula, date, rank, return_20d): the n best rows of a date by each formula, of rows with a
    known return, ties by code. A score is a weighted sum of the features' average ranks on the date;
    unknown values rank as 0. A date's rows are dealt once, as a few numbers a row, and only the best
    leave the task: no window a feature sorts them, and no row is repeated for each formula."""
    formulas = formulas or FORMULAS
    features = sorted({f for weights in formulas.values() for f in weights})
    known = df.where("return_20d is not null").select("date", "code", "return_20d", *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features))
    shape = pa.schema([("formula", pa.string()), ("date", pa.date32()), ("rank", pa.int32()), ("return_20d", pa.float64())])

    def best(rows: pa.Table) -> pa.Table:
        column = lambda c: rows.column(c).to_numpy()
        size, place, parts = rows.num_rows, {}, []
        for f in features:
            x = column(f)
            order = np.sort(x)
            first = np.searchsorted(order, x) + 1
            place[f] = (first + (np.searchsorted(order, x, "right") - first) / 2) / size
        code, returns = column("code"), column("return_20d")
        for name, weights in formulas.items():
            score = rounded_half_away(sum((place[f] * w for f, w in weights.items()), np.zeros(size)), 9)
            top = np.flatnonzero(score >= np.partition(score, -n)[-n]) if size > n else np.arange(size)
            top = top[np.lexsort((code[top], -score[top]))][:n]
            parts.append(pa.table([pa.array([name] * len(top), pa.string()), rows.column("date").combine_chunks().take(pa.array(top)), pa.array(np.arange(1, len(top) + 1, dtype=np.int32)), pa.array(returns[top])], schema=shape))
        return pa.concat_tables(parts)

    return known.groupBy("date").applyInArrow(best, "formula string, date date, rank int, return_20d double")


def gated_dates(days: DataFrame, search: Column) -> DataFrame:
    """(date, gate): the dates that each gate lets pass; thresholds are quantiles of the search
    dates' features. all_dates passes every date."""
    single = [(name, [(f, side, q)]) for name, f, side, q in DATE_GATES] + [(name, list(parts)) for name, *parts in COMPOUND_GATES]
    tests = [(name, i, *part) for name, parts in single for i, part in enumerate(parts)]
    cuts = days.where(search).agg(*(F.percentile(f, F.lit(q)).alias(f"{name}_{i}") for name, i, f, _, q in tests))  # one row
    both = days.join(F.broadcast(cuts))

    def holds(name: str) -> Column:
        parts = [F.col(f) <= F.col(f"{n}_{i}") if side == "<=" else F.col(f) >= F.col(f"{n}_{i}") for n, i, f, side, _ in tests if n == name]
        return reduce(lambda a, b: a & b, parts)

    passes = [F.when(holds(name), F.lit(name)) for name, _ in single]
    return both.select("date", F.explode(F.array_compact(F.array(F.lit("all_dates"), *passes))).alias("gate"))


def grid_metrics(ranked: DataFrame, top_ns: list[int], gates: DataFrame, part: Column) -> DataFrame:
    """(formula, gate, top_n, part): the mean of each date's best top_n rows, summed up over the
    gate's dates. ranked has formula, date, rank and return_20d; nothing beyond the largest top_n
    is joined."""
    best = ranked.where(F.col("rank") <= max(top_ns))
    cut = best.select("formula", "date", "rank", "return_20d", F.explode(F.array(*map(F.lit, top_ns))).alias("top_n")).where("rank <= top_n")
    day = cut.groupBy("formula", "top_n", "date").agg(F.avg("return_20d").alias("day"), F.count_if(F.col("return_20d") > 0).alias("n_pos"), F.count("return_20d").alias("n"))
    out = day.join(gates, "date").withColumn("part", part).groupBy("formula", "gate", "top_n", "part").agg(
        F.count("*").alias("decision_dates"),
        F.avg("day").alias("avg_return_20d"),
        (F.sum("n_pos") / F.sum("n")).alias("positive_20d_rate"),
        F.stddev_samp("day").alias("std_return_20d"),
    )
    return out.withColumn("stability_score", safe_div("avg_return_20d", "std_return_20d"))


def selection(grid: DataFrame) -> DataFrame:
    """valid and test metrics side by side, the selection score and whether targets are hit."""
    names = ["decision_dates", "avg_return_20d", "positive_20d_rate", "std_return_20d", "stability_score"]
    wide = grid.groupBy("formula", "gate", "top_n").agg(*(F.max(F.when(F.col("part") == p, F.col(n))).alias(f"{p}_{n}") for p in ("valid", "test") for n in names))
    known = lambda c, other: F.coalesce(F.col(c), F.lit(float(other)))
    score = known("valid_avg_return_20d", -999) + known("valid_positive_20d_rate", 0) * 8 + known("valid_stability_score", -999) * 0.3 - known("valid_std_return_20d", 999) * 0.05

    def hit(part: str) -> Column:
        return F.coalesce((F.col(f"{part}_avg_return_20d") >= TARGET_AVG) & (F.col(f"{part}_positive_20d_rate") >= TARGET_POS) & (F.col(f"{part}_decision_dates") >= LEAST_DATES), F.lit(False))

    thin = F.coalesce(F.col("valid_decision_dates"), F.lit(0)) < LEAST_DATES
    return wide.withColumns({"selection_score": F.when(thin, F.lit(-9999.0)).otherwise(score), "target_hit_on_valid": hit("valid"), "target_hit_on_test": hit("valid") & hit("test")})


def families(folds: DataFrame, least_folds: int = 4) -> DataFrame:
    """Formula families over folds (block), kept from least_folds folds on."""
    out = folds.groupBy("formula", "gate", "top_n").agg(
        F.count("*").alias("folds"), F.avg((F.col("avg_return_20d") > 0).cast("int")).alias("hit_rate"), F.avg("avg_return_20d").alias("avg_return_20d"), F.avg("positive_20d_rate").alias("positive_20d_rate"), F.avg("stability_score").alias("stability_score"), F.avg("decision_dates").alias("avg_decision_dates")
    )
    known = lambda c, other: F.coalesce(F.col(c), F.lit(float(other)))
    score = known("avg_return_20d", -999) + known("positive_20d_rate", 0) * 8 + known("stability_score", -999) * 0.3 + known("hit_rate", 0) * 6
    return out.where(F.col("folds") >= least_folds).withColumn("selection_score", score)


def turnover_status(prior_net: str, last_net: str, prior_pos: str, last_pos: str, prior_ic: str, last_ic: str, concentration: str) -> Column:
    """Whether a candidate's earlier and latest blocks agree."""
    ok = lambda net, pos, ic: F.coalesce((F.col(net) > 0) & (F.col(pos) >= 0.60) & (F.col(ic) >= 0.03), F.lit(False))
    spread = F.col(concentration).isNull() | (F.col(concentration) <= 0.25)
    before, last = ok(prior_net, prior_pos, prior_ic), ok(last_net, last_pos, last_ic)
    return (
        F.when(F.col(prior_net).isNull() | F.col(last_net).isNull(), "observe_insufficient_blocks")
        .when(before & last & spread, "accepted_cost_recheck_candidate")
        .when(last, "observe_latest_positive_prior_weak")
        .when(before, "observe_prior_positive_latest_weak")
        .otherwise("rejected_or_diagnostic_only")
    )


def maturity(df: DataFrame, as_of: Column, days: int = 28) -> DataFrame:
    """A row a block: rows whose outcome is known, still open, or dated after as_of."""
    future = F.col("date") > as_of
    status = F.when(future, "future_date").when(F.date_add("date", days) > as_of, "gt_pending").when(F.col("return_20d").isNotNull(), "evaluated").otherwise("gt_pending")
    return df.withColumn("status", status).groupBy("time_block").agg(
        F.count("*").alias("row_count"),
        F.count_distinct("code").alias("stock_count"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        *(F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("evaluated", "gt_pending", "future_date")),
        (F.count_if(F.col("status") != "evaluated") > 0).alias("is_provisional"),
    )
