"""Named gates, flags, triggers, scores and ratings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.expr import all_of, clip, count_true, named

#: Named row gates over (ret, ret3, volume, rank): conjunctions; null fails.
GATES: dict[str, list[tuple[str, str, float]]] = {
    "all": [],
    "positive_momentum": [("ret", ">", 0)],
    "negative_momentum": [("ret", "<", 0)],
    "strong_momentum": [("ret", ">=", 5)],
    "oversold": [("ret", "<=", -5)],
    "trend_up": [("ret3", ">", 0)],
    "trend_down": [("ret3", "<", 0)],
    "pullback_in_uptrend": [("ret", "<", 0), ("ret3", ">", 0)],
    "rebound_in_downtrend": [("ret", ">", 0), ("ret3", "<", 0)],
    "liquid": [("volume", ">=", 200)],
    "liquid_momentum": [("volume", ">=", 200), ("ret", ">", 0)],
    "leaders": [("rank", ">=", 0.8)],
    "laggards": [("rank", "<=", 0.2)],
    "middle": [("rank", ">=", 0.4), ("rank", "<=", 0.6)],
    "leaders_not_overheated": [("rank", ">=", 0.8), ("ret", "<", 10)],
}
#: Weights of the sub-scores; negative ones count as none.
WEIGHTS = {"trend": 0.4, "momentum": 0.3, "liquidity": 0.2, "position": 0.1}


def gates(names: dict[str, list[tuple[str, str, float]]] | None = None) -> dict[str, Column]:
    return {k: all_of(v) for k, v in (names or GATES).items()}


def normalized(weights: dict[str, float]) -> dict[str, float]:
    kept = {k: max(0.0, w) for k, w in weights.items()}
    total = sum(kept.values())
    return {k: w / total for k, w in kept.items()} if total else kept


def conflicts() -> dict[str, Column]:
    return {"peer": (F.col("ret") > 0) & (F.col("peer_mean") < 0), "trend": (F.col("ret") > 0) & (F.col("ret3") < 0), "volume": (F.col("ret") > 0) & (F.col("volume") < 150), "breadth": (F.col("ret") > 0) & (F.col("peer_breadth") < 0.5)}


def flagged(df: DataFrame) -> DataFrame:
    """Conflict flags with their count, their combination's name, and positive confirmations."""
    own = conflicts()
    good = count_true(F.col("ret") > 0, F.col("ret3") > 0, F.col("peer_mean") > 0, F.col("peer_breadth") >= 0.5)
    return df.withColumns({"n_conflicts": count_true(*own.values()), "combo": named({k: F.coalesce(c, F.lit(False)) for k, c in own.items()}), "n_confirm": good, "overheated": F.coalesce((F.col("rank") >= 0.8) & (F.col("ret") >= 15), F.lit(False))})


def triggers() -> Column:
    """The triggers that fire: (rule, effect, strength), strongest first."""

    def one(rule: str, effect: str, x: str, over: float, up: bool = True) -> Column:
        fires = F.col(x) >= over if up else F.col(x) <= over
        strength = F.least(F.lit(1.0), 0.5 + F.abs(F.col(x) - over) / max(abs(over), 1.0))
        return F.when(fires, F.struct((-F.round(strength, 6)).alias("order"), F.lit(rule).alias("rule"), F.lit(effect).alias("effect")))

    rules = F.array(one("breakout", "plus", "ret", 8), one("trend", "plus", "ret3", 10), one("breakdown", "minus", "ret", -8, False), one("downtrend", "minus", "ret3", -10, False), one("crowded", "minus", "rank", 0.95))
    return F.array_sort(F.filter(rules, lambda r: r.isNotNull()))


def scored(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """A 0-10 score of weighted sub-scores and triggers, capped at 4 by a minus trigger and at 8
    by three plus ones, and a rating."""
    w = normalized(weights or WEIGHTS)
    parts = {"trend": clip(5 + F.coalesce("ret3", F.lit(0.0)) / 4, 0, 10), "momentum": clip(5 + F.coalesce("ret", F.lit(0.0)) / 2, 0, 10), "liquidity": clip(F.col("volume") / 50, 0, 10), "position": 10 * F.coalesce("rank", F.lit(0.5))}
    out = df.withColumn("fired", triggers())
    plus, minus = F.size(F.filter("fired", lambda r: r["effect"] == "plus")), F.size(F.filter("fired", lambda r: r["effect"] == "minus"))
    base = sum((parts[k] * v for k, v in w.items()), F.lit(0.0)) + 0.5 * plus - 0.5 * minus
    capped = F.when(minus > 0, F.least(base, F.lit(4.0))).when(plus >= 3, F.least(base, F.lit(8.0))).otherwise(base)
    known = count_true(F.col("ret").isNotNull(), F.col("ret3").isNotNull(), F.col("fwd").isNotNull())
    out = out.withColumns({"score": clip(capped, 0, 10), "rules": F.array_join(F.transform("fired", lambda r: r["rule"]), "+")})
    rating = F.when(known <= 1, "incomplete").when(F.col("score") >= 7, "strong").when(F.col("score") >= 5, "watch").when(F.col("score") >= 2, "weak").otherwise("avoid")
    return out.withColumn("rating", rating).drop("fired")


def binned(x: str, edges: list[float]) -> Column:
    """How many edges x exceeds; -1 for null."""
    return F.when(F.col(x).isNull(), -1).otherwise(count_true(*(F.col(x) > e for e in edges)))


def quadrant(ret: str, excess: str) -> Column:
    return F.when(F.col(ret).isNull() | F.col(excess).isNull(), "unknown").when((F.col(ret) > 0) & (F.col(excess) > 0), "good").when(F.col(ret) > 0, "lucky").when(F.col(excess) > 0, "resilient").otherwise("bad")


def positions(df: DataFrame) -> DataFrame:
    """Target positions over time. A code's target is its tier, or at weak scores the smaller of
    tier and the last target; as targets only shrink between strong dates, that is the smallest
    tier since the last strong one, so a running minimum gives the state."""
    w = Window.partitionBy("code").orderBy("date")
    tier = F.when(F.col("ret") <= -15, 0.0).when(F.col("score") >= 7, 0.8).when(F.col("score") >= 5, 0.5).when(F.col("score") >= 2, 0.2).otherwise(0.0)
    out = df.withColumn("tier", tier).withColumn("free", F.col("score") >= 5)
    out = out.withColumn("spell", F.sum(F.col("free").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    low = F.min("tier").over(Window.partitionBy("code", "spell").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("target", F.when(F.col("spell") == 0, 0.0).otherwise(low))
    before = F.coalesce(F.lag("target").over(w), F.lit(0.0))
    change = F.col("target") - before
    action = F.when((before == 0) & (change > 0), "buy").when(change > 0, "add").when((F.col("target") == 0) & (change < 0), "sell").when(change < 0, "reduce").otherwise("hold")
    return out.withColumn("action", action).drop("tier", "free", "spell")
