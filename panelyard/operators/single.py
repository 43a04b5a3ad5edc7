"""Checks of single names: breakouts, candles, trend, module scores; factors, as-of records in list
order, context vectors, applicable cases and weights that learn from failures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.expr import count_true, zscore

# fixed values: look-back and holding days of a breakout, days a code needs, lengths of averages
BREAKOUT, HOLDING, LEAST_DAYS, LENGTHS = 20, (5, 20, 60), 80, (20, 60, 120)
# fixed values: least totals of the two better ratings, and the score of an absent module
DEEP, WATCH, ABSENT = 6.5, 4.5, 3


def defaulted(df: DataFrame, name: str, value) -> Column:
    """A column, or a constant where the table has none of that name."""
    return (F.col(name) if name in df.columns else F.lit(value)).alias(name)


def breakouts(bars: DataFrame) -> DataFrame:
    """Per code: closes above the highest of the BREAKOUT days before that have the longest holding
    time ahead of them, the mean 20-day return after them in % and its rate of gains. Codes of fewer than
    LEAST_DAYS days have no row."""
    w = Window.partitionBy("code").orderBy("date")
    before = w.rowsBetween(-BREAKOUT, -1)
    ahead = {f"r{d}": 100 * (F.lead("close", d).over(w) / F.col("close") - 1) for d in HOLDING}
    rows = bars.select("code", "date", "close", F.max("close").over(before).alias("high"), F.count("*").over(before).alias("n"), *(c.alias(k) for k, c in ahead.items()))
    signal = (F.col("n") == BREAKOUT) & (F.col("close") > F.col("high")) & F.col(f"r{max(HOLDING)}").isNotNull()
    at = lambda c: F.when(signal, c)
    out = rows.groupBy("code").agg(F.count("*").alias("days"), F.count(at(F.lit(1))).alias("n_signals"), F.avg(at(F.col("r20"))).alias("mean_20d"), (100 * F.avg(at((F.col("r20") > 0).cast("int")))).alias("win_rate"))
    return out.where(F.col("days") >= LEAST_DAYS).drop("days")


def last_candle(bars: DataFrame) -> DataFrame:
    """Signals of each code's last day: shadows of over twice the body, and a gain."""
    last = bars.groupBy("code").agg(F.max_by(F.struct("open", "high", "low", "close"), "date").alias("b"), F.max("date").alias("date")).select("code", "date", "b.*")
    body, top, foot = F.abs(F.col("close") - F.col("open")), F.greatest("close", "open"), F.least("close", "open")
    return last.select("code", "date", (F.col("high") - top > body * 2).alias("long_upper"), (foot - F.col("low") > body * 2).alias("long_lower"), (F.col("close") > F.col("open")).alias("gain"))


def trend(bars: DataFrame) -> DataFrame:
    """Per code the last close against its averages: a score of 4 and one for each that it is above,
    the change over the last n rows, and closeness to the low of 20 days. Only the last rows are dealt."""
    w = Window.partitionBy("code").orderBy(F.desc("date"))
    rows = bars.select("code", "date", "close", F.row_number().over(w).alias("back")).where(F.col("back") <= max(LENGTHS) + 1)
    up_to = lambda n, c: F.when(F.col("back") <= n, c)
    parts = [F.max("date").alias("date"), F.max("back").alias("n"), F.max(F.when(F.col("back") == 1, F.col("close"))).alias("close"), F.min(up_to(20, F.col("close"))).alias("low")]
    parts += [F.avg(up_to(n, F.col("close"))).alias(f"ma{n}") for n in LENGTHS] + [F.max(F.when(F.col("back") == n, F.col("close"))).alias(f"c{n}") for n in LENGTHS]
    g = rows.groupBy("code").agg(*parts)
    above = [(F.col("n") >= n) & (F.col("close") > F.col(f"ma{n}")) for n in LENGTHS]
    change = [F.when(F.col("n") > n, 100 * (F.col("close") / F.col(f"c{n}") - 1)).alias(f"change{n}") for n in LENGTHS]
    return g.select("code", "date", (4 + count_true(*above)).alias("score"), *change, ((F.col("n") > 20) & (F.col("close") < F.col("low") * 1.02)).alias("near_low"))


def valuation_score(pe: Column, pb: Column) -> Column:
    """5 with both ratios (zero counts as none), else 4; 3 without either."""
    known = count_true(pe != 0, pb != 0)
    return F.when(known == 2, 5).when(pe.isNull() & pb.isNull(), ABSENT).otherwise(4)


def financial_score(text: Column, topics: list[str]) -> Column:
    """5 where a report speaks of each topic (a pattern), else 4; 3 without a report."""
    known = count_true(*(text.rlike(t) for t in topics))
    return F.when(F.coalesce(text, F.lit("")) == "", ABSENT).when(known == len(topics), 5).otherwise(4)


def rating(scores: list[Column], counter: Column, gap: Column, veto: Column) -> tuple[Column, Column]:
    """The mean of the module scores, ten less the counter items, and 5 or (with a data gap) 3; and
    the rating it leads to: a veto first, then the gap, then the total."""
    complete = F.when(gap, 3).otherwise(5)
    total = (sum((F.coalesce(s, F.lit(ABSENT)) for s in scores), F.lit(0)) + F.greatest(F.lit(0), 10 - counter) + complete) / (len(scores) + 2)
    total = F.round(total, 2)
    return total, F.when(veto, "drop").when(gap, "insufficient").when(total >= DEEP, "dig_deeper").when(total >= WATCH, "watch").otherwise("insufficient")


def signed_buckets(title: Column, weight: Column, negative: Column, buckets: dict[str, list[str]]) -> dict[str, Column]:
    """Aggregates by bucket: the weights of events with one of its words, negative ones subtracted."""
    signed = F.when(negative, -weight).otherwise(weight)
    return {k: F.sum(F.when(title.rlike("|".join(words)), signed).otherwise(0.0)) for k, words in buckets.items()}


def last_listed(decisions: DataFrame, records: DataFrame, value: str) -> DataFrame:
    """For each (code, date) the value of the record that is last in list order (pos) of those
    published by that day, whatever their dates are: one running maximum a code, no range join."""
    known = records.select("code", F.col("date"), F.struct("pos", value).alias("r"), F.lit(0).alias("asked"))
    asked = decisions.select("code", "date", F.lit(None).cast(known.schema["r"].dataType).alias("r"), F.lit(1).alias("asked"))
    w = Window.partitionBy("code").orderBy("date", "asked").rowsBetween(Window.unboundedPreceding, 0)
    return known.unionByName(asked).withColumn("r", F.max("r").over(w)).where("asked = 1").select("code", "date", F.col("r.pos").alias("pos"), F.col(f"r.{value}").alias(value))


def cost_factors(low: str = "c5", lower: str = "c15", mid: str = "c50", upper: str = "c85", high: str = "c95", close: str = "close") -> dict[str, Column]:
    """Shape of the cost distribution by its percentiles, and where the close lies in it."""
    c = F.col
    base, span = F.greatest(c(mid), F.lit(1e-6)), F.nullif(c(high) - c(low), F.lit(0.0))
    return {
        "concentration": (c(upper) - c(lower)) / base,
        "band_width": span / base,
        "overhang": (c(high) - c(mid)) / base,
        "support": (c(mid) - c(low)) / base,
        "position": (c(close) - c(low)) / span,
        "over_median": (c(close) - c(mid)) / base,
    }


def inverse(ratio: Column) -> Column:
    """Yield of a price ratio; null unless it is positive."""
    return F.when(ratio > 0, 1 / ratio)


def small(size: Column) -> Column:
    """Minus the logarithm of a size of at least 1."""
    return -F.log(F.greatest(size, F.lit(1.0)))


def context_vectors(df: DataFrame, features: list[str], flipped: set[str], group: str = "industry", top: int = 12) -> DataFrame:
    """(code, date, v): standard scores by date (population spread, null 0), those of flipped with the
    other sign, then marks of the `top` largest groups, all over the vector's length."""
    most = df.groupBy(F.coalesce(group, F.lit("UNKNOWN")).alias(group)).count().orderBy(F.desc("count"), group).limit(top)
    names = most.agg(F.array_sort(F.collect_list(group)).alias("names"))  # `top` names
    z = [(-1 if f in flipped else 1) * F.coalesce(zscore(f, "date", ddof=0, least=1), F.lit(0.0)) for f in features]
    rows = df.select("code", "date", F.coalesce(group, F.lit("UNKNOWN")).alias("g"), F.array(*z).alias("z")).join(F.broadcast(names), F.lit(True))
    raw = F.concat("z", F.transform("names", lambda n: (n == F.col("g")).cast("double")))
    length = F.sqrt(F.aggregate(F.transform("raw", lambda x: x * x), F.lit(0.0), lambda a, x: a + x))
    return rows.select("code", "date", raw.alias("raw")).withColumn("l", length).select("code", "date", F.transform("raw", lambda x: F.when(F.col("l") == 0, x).otherwise(x / F.col("l"))).alias("v"))


def applicability(wanted: Column, tags: Column, broad: list[str], meta: Column, least: int = 2) -> Column:
    """How far a case's tags meet those of a request: applicable with `least` in common, one of
    them not broad, unless the case is meta; partial with one in common or for meta cases."""
    both = F.array_intersect(wanted, tags)
    own = F.array_except(both, F.array(*map(F.lit, broad)))
    return F.when((F.size(both) >= least) & (F.size(own) > 0) & ~meta, "applicable").when((F.size(both) == 1) | ((F.size(both) > 0) & meta), "partial").otherwise("none")


def moved(weights: dict[str, float], stats: DataFrame, moves: list[tuple[str, str, Column]], step: float = 0.03, floor: float = 0.05) -> DataFrame:
    """(module, weight): for each (source, target, condition on the one row of stats) a step of
    weight goes from source, which keeps `floor`, to target; then they are normalized."""
    names = list(weights)
    row = stats.withColumns({f"w_{k}": F.lit(float(v)) for k, v in weights.items()})
    for source, target, when in moves:
        part = F.when(when, F.least(F.lit(step), F.greatest(F.lit(0.0), F.col(f"w_{source}") - floor))).otherwise(0.0)
        row = row.withColumn("part", part).withColumns({f"w_{source}": F.col(f"w_{source}") - F.col("part"), f"w_{target}": F.col(f"w_{target}") + F.col("part")})
    whole = sum((F.col(f"w_{k}") for k in names), F.lit(0.0))
    return row.select(F.inline(F.array(*(F.struct(F.lit(k).alias("module"), (F.col(f"w_{k}") / whole).alias("weight")) for k in names))))


def diverse(df: DataFrame, score: str, n: int, block: str = "block") -> DataFrame:
    """n codes of each date, those first that no earlier date of the block took, then the best of the
    others. What was taken carries over, so a block (a span of dates) is one group."""

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["date", score, "code"], ascending=[True, False, True])
        used: set = set()
        keep = []
        for _, day in rows.groupby("date", sort=True):
            first = day[~day["code"].isin(used)].head(n)
            rest = day.drop(first.index).head(n - len(first))
            used.update(first["code"], rest["code"])
            keep += [*first.index, *rest.index]
        return rows.loc[keep]

    rows = df.where(F.col(score).isNotNull()).select(block, "code", "date", score)
    return rows.groupBy(block).applyInPandas(take, rows.schema)
