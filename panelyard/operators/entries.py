"""Entry policies: a static screen of the whole grid, and a replay of its survivors with positions.

A policy compares two scores with thresholds and a few facts, so rows count only by the cell that
their thresholds and facts put them in: the screen sums rows up by cell once and then meets the
grid, and no row meets a policy. Survivors are replayed over each code's dates. What a row would
hold without a position is decided alone; a row that may only keep a small position keeps what the
last row of another kind left, which is one running value in a window that spills, no loop."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyard.functions.expr import count_true

CASH = (1.03 ** (20 / 252) - 1) * 100
ACTIVE, KEPT, KEPT_FROM = 0.35, 0.30, 0.55
SURVIVORS, LEAST_PRIOR, LEAST_LATE, LATE_BLOCKS = 12, 50, 25, 2
# fixed values: the grid's axes, and what a policy can hold
SMALL_Q, SMALL_P, BUY_Q, BUY_P, CAPS = (0.70, 0.78, 0.82, 0.86), (0.45, 0.54, 0.62), (0.90, 0.94), (0.62, 0.72), (0.60, 0.35)
TARGETS = (0.80, 0.60, 0.35, 0.0)
# fixed values: the names of risks and supports
RISKS = ("news_warning", "financial_risk", "peer_weak", "overheat", "falling_with_peer_weakness")
SUPPORTS = ("news_opportunity", "financial_low_risk_event", "peer_support", "chip_support")

_POLICY = "variant string, small_q double, small_p double, buy_q double, buy_p double, require_support boolean, require_peer boolean, sparse_cap double, overheat_cap double"


def grid() -> list[tuple]:
    """The base policy and all combinations of the axes; a strict peer rule with a low sparse cap
    also caps overheated rows low."""
    out = [("base_v4_like", 0.70, 0.45, 0.90, 0.62, False, False, 0.60, 0.60)]
    for sq, sp, bq, bp, support, peer, cap in product(SMALL_Q, SMALL_P, BUY_Q, BUY_P, (False, True), (False, True), CAPS):
        name = f"sq{sq:.2f}_sp{sp:.2f}_bq{bq:.2f}_bp{bp:.2f}_sup{int(support)}_peer{int(peer)}_scap{cap:.2f}"
        out.append((name, sq, sp, bq, bp, support, peer, cap, 0.35 if peer and cap <= 0.35 else 0.60))
    return out


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(grid(), _POLICY)


def _or(name: str, default: float) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(default))


def facts(rows: DataFrame) -> DataFrame:
    """rows with risks and supports (their names in order) and what policies ask of them."""
    warning, opportunity = _or("news_warning_score", 0.0), _or("news_opportunity_score", 0.0)
    risk, events, surprise = _or("financial_quality_risk_score", 0.0), _or("financial_report_event_count", 0.0), _or("financial_surprise_score", 0.0)
    breadth, ahead = _or("peer_group_positive_breadth_20d", 0.5), _or("peer_relative_to_group_20d", 0.0)
    r20, r60, rsi, over, under = _or("prior_return_20d", 0.0), _or("kline_return_60d", 0.0), _or("rsi14", 50.0), _or("upper_overhang", 0.0), _or("lower_support", 0.0)
    risks = (
        warning >= 0.67, (risk >= 0.70) | ((events >= 1) & (surprise <= -0.35)), (ahead <= -4) & (breadth <= 0.40),
        ((r20 >= 25) & (rsi >= 75) & (over >= 0.25)) | ((r60 >= 45) & (rsi >= 78)), (r20 <= -18) & (ahead <= -3),
    )
    supports = ((opportunity >= 0.33) & (warning < 0.5), (events >= 1) & (risk <= 0.4) & (surprise >= 0), (breadth >= 0.58) & (ahead >= 0), under >= 0.20)
    names = lambda tests, said: F.array_compact(F.array(*(F.when(t, F.lit(s)) for t, s in zip(tests, said))))
    q = _or("rev_chip_score_quantile", 0.5)
    out = rows.withColumns({"score_q": q, "score": _or("agent_policy_score", 0.0), "risks": names(risks, RISKS), "supports": names(supports, SUPPORTS), "hard_risk_count": count_true(*risks), "support_count": count_true(*supports)})
    return out.withColumns(
        {
            "hard_block": (F.col("hard_risk_count") >= 2) | ((F.col("hard_risk_count") >= 1) & (q < 0.88)),
            "peer_ok": (breadth >= 0.50) | (ahead >= 0),
            "sparse": (_or("news_missing_rate", 1.0) >= 0.95) & F.coalesce("financial_report_join_status", F.lit("")).isin("", "no_event_in_window"),
            "heated": (r20 >= 20) & (rsi >= 70) & (over >= 0.20),
        }
    )


def _capped(target: Column) -> Column:
    first = F.when(F.col("sparse"), F.least(target, F.col("sparse_cap"))).otherwise(target)
    return F.when(F.col("heated"), F.least(first, F.col("overheat_cap"))).otherwise(first)


def _level(x: str, edges: tuple[float, ...]) -> Column:
    """The largest edge that x reaches, or none."""
    return F.array_max(F.array(*(F.when(F.col(x) >= e, F.lit(e)) for e in edges)))


def cells(rows: DataFrame, block: str = "time_block") -> DataFrame:
    """rows with facts, summed up by block and cell: counts and sums of returns, and for each target
    that a policy can hold how many rows it would make a gain or lose 5 % or more with."""
    q, p = tuple(sorted({*SMALL_Q, *BUY_Q})), tuple(sorted({*SMALL_P, *BUY_P}))
    r = F.col("return_20d")
    made = lambda t: t * r + (1 - t) * CASH
    tests = {"gain": lambda x: x > 0, "loss": lambda x: x <= -5}
    sums = [F.count_if(test(made(t))).alias(f"{name}_{i}") for i, t in enumerate(TARGETS) for name, test in tests.items()]
    keys = [F.coalesce(_level("score_q", q), F.lit(0.0)).alias("q"), F.coalesce(_level("score", p), F.lit(0.0)).alias("p"), (F.col("support_count") >= 1).alias("supported"), "hard_block", "peer_ok", "sparse", "heated"]
    return rows.groupBy(block, *keys).agg(F.count("*").alias("n"), F.count(r).alias("n_known"), F.sum(r).alias("total"), F.count_if(r > 0).alias("n_up"), *sums)


def screen(rows: DataFrame, block: str = "time_block") -> DataFrame:
    """Per policy and block its record without positions carried over."""
    spark = rows.sparkSession
    at = cells(rows, block).join(F.broadcast(policies(spark)))  # 385 policies meet some hundred cells
    open_ = ~F.col("hard_block") & (~F.col("require_peer") | F.col("peer_ok"))
    buy = (F.col("q") >= F.col("buy_q")) & (F.col("p") >= F.col("buy_p")) & open_ & (~F.col("require_support") | F.col("supported"))
    small = (F.col("q") >= F.col("small_q")) & (F.col("p") >= F.col("small_p")) & open_
    at = at.withColumn("target", _capped(F.when(buy, 0.80).when(small, 0.35).otherwise(0.0)))
    pick = lambda name: F.coalesce(*(F.when(F.col("target") == t, F.col(f"{name}_{i}")) for i, t in enumerate(TARGETS)))
    at = at.withColumns({"active": F.col("target") >= ACTIVE, "made": F.col("target") * F.coalesce("total", F.lit(0.0)) + (1 - F.col("target")) * CASH * F.col("n_known"), "gains": pick("gain"), "losses": pick("loss")})
    on = lambda c: F.sum(F.when(F.col("active"), F.col(c)).otherwise(0))
    share = lambda a, b: a / F.nullif(b, F.lit(0))
    known, n = F.sum("n_known"), F.sum("n")
    return at.groupBy("variant", block).agg(
        n.alias("decision_count"), on("n").alias("active_count"), share(on("n"), n).alias("active_rate"), share(on("gains"), on("n_known")).alias("active_pos20"), share(on("made"), on("n_known")).alias("active_avg20"),
        share(F.sum("gains"), known).alias("strategy_pos20"), share(F.sum("made"), known).alias("strategy_avg20"), share(F.sum("losses"), known).alias("strategy_loss_gt5"),
        share(F.sum("total"), known).alias("hold_avg20"), share(F.sum(F.col("target") * F.col("n")), n).alias("avg_target_position"), F.sum("made").alias("made"), known.alias("n_known"),
    )


def survivors(screened: DataFrame, most: int = SURVIVORS, block: str = "time_block") -> DataFrame:
    """The base policy and the best by average return before the last LATE_BLOCKS blocks, of those
    that were active often enough both before and in them."""
    order = F.dense_rank().over(Window.orderBy(F.desc(block)))
    late = F.col("_nth") <= LATE_BLOCKS
    both = screened.join(screened.select(block).distinct().withColumn("_nth", order), block)
    of = lambda test, c: F.sum(F.when(test, F.col(c)).otherwise(0))
    sums = both.groupBy("variant").agg(of(~late, "active_count").alias("prior"), of(late, "active_count").alias("late"), (of(~late, "made") / of(~late, "n_known")).alias("avg"))
    place = F.row_number().over(Window.orderBy(F.desc(F.round("avg", 9)), "variant")).alias("place")
    best = sums.where((F.col("variant") != "base_v4_like") & (F.col("prior") >= LEAST_PRIOR) & (F.col("late") >= LEAST_LATE)).select("variant", place).where(F.col("place") < most)
    return best.unionByName(screened.sparkSession.createDataFrame([("base_v4_like", 0)], "variant string, place int"))


def action(before: Column, target: Column) -> Column:
    """What a change of position means; fixed values of the labels."""
    change = F.round(target - before, 9)
    return (
        F.when((target <= 0) & (before > 0), "卖出/不买").when(target <= 0, "等待不买").when((before <= 0) & (target >= ACTIVE), "买入").when(before <= 0, "小仓试探")
        .when(change >= 0.15, "加仓").when(change <= -0.15, "减仓").otherwise("持有")
    )


def decided(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """rows for each chosen policy with kind, keeps (may only keep a small position) and first, what
    they would hold without one."""
    at = rows.join(F.broadcast(chosen.select("variant").join(policies(rows.sparkSession), "variant")))  # a dozen policies
    peer = ~F.col("require_peer") | F.col("peer_ok")
    buy = ~F.col("hard_block") & (F.col("score_q") >= F.col("buy_q")) & (F.col("score") >= F.col("buy_p")) & (~F.col("require_support") | (F.col("support_count") >= 1)) & peer
    small = (F.col("score_q") >= F.col("small_q")) & (F.col("score") >= F.col("small_p")) & (F.col("hard_risk_count") == 0) & peer
    kind = F.when(F.col("hard_block"), "hard_risk_blocks").when(buy, "buy_threshold_pass").when(small, "small_entry_threshold_pass").when((F.col("score_q") >= KEPT_FROM) & (F.col("hard_risk_count") == 0), "keeps").otherwise("below_threshold")
    wanted = F.when(F.col("kind") == "buy_threshold_pass", 0.80).when(F.col("kind") == "small_entry_threshold_pass", 0.35).otherwise(0.0)
    out = at.withColumn("kind", kind).withColumns({"keeps": F.col("kind") == "keeps", "wanted": wanted})
    return out.withColumn("first", _capped(F.col("wanted")))


def replay(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Each chosen policy over each code's dates: target, action, reason, cash-adjusted return, and
    whether the row is the code's first in its block."""
    at, keeps = decided(rows, chosen), F.col("keeps")
    w = Window.partitionBy("variant", "code").orderBy("date")
    left = F.coalesce(F.last(F.when(~keeps, F.col("first")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    at = at.withColumn("target", F.when(keeps, F.least(left, F.lit(KEPT))).otherwise(F.col("first")))
    before = F.coalesce(F.lag("target").over(w), F.lit(0.0))
    reason = F.when(keeps, F.when(F.col("target") > 0, "hold_existing_small").otherwise("below_threshold")).otherwise(F.col("kind"))
    sparse = F.when(F.col("sparse"), F.least("wanted", "sparse_cap")).otherwise(F.col("wanted"))
    reason = F.concat(reason, F.when(sparse < F.col("wanted"), ";sparse_news_fin_cap").otherwise(""), F.when(F.col("first") < sparse, ";overheat_cap").otherwise(""))
    made = F.col("target") * F.col("return_20d") + (1 - F.col("target")) * CASH
    opens = ~F.lag("time_block").over(w).eqNullSafe(F.col("time_block"))  # a code's dates of a block follow each other
    return at.select("variant", "code", "date", "time_block", "target", action(before, F.col("target")).alias("action"), reason.alias("reason"), "return_20d", made.alias("strategy_return_20d"), opens.alias("opens_block"))
