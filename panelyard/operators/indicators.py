"""Trailing indicators on daily bars: one window spec, so one exchange for all of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.expr import clip, pct_change, safe_div
from panelyard.functions.windows import by_code, full, last_n


def mean(x: str, n: int) -> Column:
    return full(F.avg(x).over(last_n(n)), x, n)


def trend(bars: DataFrame) -> DataFrame:
    """Averages, trailing returns, slope, volume ratio, RSI, ATR, bands and drawdown."""
    w = by_code()
    change = F.col("close") - F.lag("close").over(w)
    before = F.lag("close").over(w)
    reach = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    out = bars.withColumns({"up": F.greatest(change, F.lit(0.0)), "down": F.greatest(-change, F.lit(0.0)), "reach": reach, **{f"ma{n}": mean("close", n) for n in (5, 20, 60, 120)}})
    out = out.withColumns({"up": F.when(before.isNotNull(), F.col("up")), "down": F.when(before.isNotNull(), F.col("down"))})
    spread = full(F.stddev_samp("close").over(last_n(20)), "close", 20)
    gain, loss = mean("up", 14), mean("down", 14)
    return out.withColumns(
        {
            "ret20": pct_change("close", 20, w),
            "ma60_slope": F.col("ma60") - F.lag("ma60", 20).over(w),
            "volume_ratio": safe_div("volume", mean("volume", 20)),
            "rsi14": F.when(loss > 0, 100 - 100 / (1 + gain / loss)),
            "atr20": mean("reach", 20),
            "bb_upper": F.col("ma20") + 2 * spread,
            "bb_lower": F.col("ma20") - 2 * spread,
            "drawdown60": 100 * (F.col("close") / full(F.max("close").over(last_n(60)), "close", 60) - 1),
        }
    ).drop("up", "down", "reach")


def shape(bars: DataFrame, n: int = 20) -> DataFrame:
    """Range position and width, consistency, efficiency, reversals, crossings, volatility, z."""
    w = by_code()
    step = F.col("close") - F.lag("close").over(w)
    out = bars.withColumn("step", step).withColumn("sign", F.signum("step")).withColumn("r", pct_change("close", 1, w))
    out = out.withColumn("gap", F.signum(F.col("close") - mean("close", n)))
    out = out.withColumn("side", F.last(F.when(F.col("gap") != 0, F.col("gap")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    turn = ((F.col("sign") * F.lag("sign").over(w)) < 0).cast("int")
    flip = (F.col("side") != F.lag("side").over(w)).cast("int")
    out = out.withColumn("turn", F.coalesce(turn, F.lit(0))).withColumn("flip", F.coalesce(flip, F.lit(0)))
    low, high = full(F.min("low").over(last_n(n)), "low", n), full(F.max("high").over(last_n(n)), "high", n)
    average, spread = mean("close", n), full(F.stddev_pop("close").over(last_n(n)), "close", n)
    enough = F.count("*").over(last_n(n)) == n
    path = full(F.sum(F.abs("step")).over(last_n(n)), "step", n)
    return out.select(
        "code",
        "date",
        safe_div(F.col("close") - low, high - low).alias("range_position"),
        safe_div(high - low, average).alias("range_width"),
        F.when(enough, F.avg((F.coalesce("r", F.lit(0.0)) > 0).cast("int")).over(last_n(n))).alias("consistency"),
        safe_div(F.abs(F.col("close") - F.lag("close", n).over(w)), path).alias("efficiency"),
        F.when(enough, F.sum("turn").over(last_n(n))).alias("reversals"),
        F.when(enough, F.sum("flip").over(last_n(n))).alias("crossings"),
        full(F.stddev_pop("r").over(last_n(n)), "r", n).alias("volatility"),
        safe_div(F.col("close") - average, spread).alias("reversion_z"),
    )


def streaks(bars: DataFrame, limit: int = 5) -> DataFrame:
    """Signed length of the current run of rises or falls; a flat or unknown day is 0."""
    w = by_code()
    sign = F.coalesce(F.signum(F.col("close") - F.lag("close").over(w)), F.lit(0.0)).cast("int")
    out = bars.select("code", "date", "close", sign.alias("sign"))
    new = (F.col("sign") == 0) | (F.coalesce(F.lag("sign").over(w), F.lit(0)) != F.col("sign"))
    out = out.withColumn("island", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.row_number().over(Window.partitionBy("code", "island").orderBy("date"))
    out = out.withColumn("streak", F.col("sign") * length)
    return out.select("code", "date", "streak", (clip(F.col("streak").cast("double"), -limit, limit) / limit).alias("streak_share"))


def extremes(bars: DataFrame, n: int = 20) -> DataFrame:
    """Extremes of the n rows before today, consecutive falls, retracement in the 60-row range."""
    w = by_code()
    prior, wide = w.rowsBetween(-n, -1), last_n(60)
    fall = F.coalesce((F.col("close") < F.lag("close").over(w)).cast("int"), F.lit(0))
    out = bars.withColumn("fall", fall)
    high, low = F.max("high").over(wide), F.min("low").over(wide)
    return out.select(
        "code",
        "date",
        F.max("high").over(prior).alias("prior_high"),
        F.min("low").over(prior).alias("prior_low"),
        (F.sum("fall").over(last_n(4)) == 4).alias("four_falls"),
        F.when(F.count("*").over(wide) == 60, safe_div(high - F.col("close"), high - low)).alias("retracement"),
    )


def breakouts(bars: DataFrame, n: int = 20, horizons: tuple[int, ...] = (5, 20, 60)) -> DataFrame:
    """Closes above the n rows before, with what followed."""
    w = by_code()
    top = F.when(F.count("close").over(w.rowsBetween(-n, -1)) == n, F.max("close").over(w.rowsBetween(-n, -1)))
    out = bars.withColumn("top", top).withColumns({f"fwd_ret_{h}": 100 * (F.lead("close", h).over(w) / F.col("close") - 1) for h in horizons})
    return out.where("close > top").select("code", "date", "close", "top", *(f"fwd_ret_{h}" for h in horizons))


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Recursive averages, seeded with the first close. Each value needs the one before, which no
    window function gives; a code's bars (one a day) are folded in one Arrow group."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        ema = lambda x, n: x.ewm(span=n, adjust=False).mean()
        dif = ema(rows["close"], fast) - ema(rows["close"], slow)
        dea = ema(dif, signal)
        return pd.DataFrame({"code": rows["code"], "date": rows["date"], "dif": dif, "dea": dea, "hist": 2 * (dif - dea)})

    return bars.select("code", "date", "close").dropna().groupBy("code").applyInPandas(fold, "code long, date date, dif double, dea double, hist double")
