"""Timeline epochs: block by block, choose a candidate on the blocks so far, see how it does on the
next, and lock it only if it held.

A candidate is a formula, a number of picks, a row filter and a date gate whose threshold is fitted
on the blocks of the step in which it was chosen; a locked one keeps its threshold. Rows are only
touched once, to pick each date's best rows for each formula and filter. All steps and thresholds
are then summed up from these daily picks, and the chain of choices, of which each depends on what
was locked before, is a fold over the steps of one small row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.expr import rank_pct
from panelyard.operators.walkforward import block_index

CASH = (1.03 ** (20 / 252) - 1) * 100
TARGET, DELTA = 0.60, 0.20
#: Dates that a candidate needs to be promoted, and a block to count; for monthly dates.
LEAST_DATES, LEAST_BLOCK = 5, 3
DEEP = -2.0
Z = 1.28
# fixed values: the formulas' features and weights
FORMULAS = {
    "original": {"relative_strength_rank": 1.0},
    "risk_low": {"counter_score": 0.35, "atr20_pct": -0.25, "relative_strength_rank": 0.20, "above": 0.20},
    "low_vol_trend": {"above": 0.30, "kline_return_60d": 0.25, "atr20_pct": -0.25, "news_risk_event_score_30d": -0.20},
}
FILTERS = {"none": "true", "low_atr_3": "coalesce(atr20_pct, 999) <= 30", "counter_7": "coalesce(counter_score, 0) >= 7", "peer_positive": "coalesce(peer_relative_to_group_20d, -999) > 0"}
# fixed values: candidates as (formula, picks, date gate, filter); the first is the baseline
SPECS = [
    ("original", 3, "all_dates", "none"), ("original", 3, "locked_pool_deep_drawdown", "none"), ("original", 10, "all_dates", "counter_7"), ("risk_low", 3, "all_dates", "counter_7"), ("risk_low", 5, "all_dates", "none"),
    ("risk_low", 5, "low_market_breadth_q80", "none"), ("risk_low", 5, "low_market_breadth_q80", "counter_7"), ("risk_low", 5, "low_market_breadth_q80", "low_atr_3"), ("low_vol_trend", 3, "all_dates", "peer_positive"),
    ("low_vol_trend", 5, "all_dates", "peer_positive"), ("low_vol_trend", 3, "low_market_breadth_q80", "peer_positive"), ("low_vol_trend", 5, "low_market_breadth_q80", "peer_positive"),
]
NAMES = [f"{f}_Top{n}_{g}_{r}" for f, n, g, r in SPECS]


def daily_picks(rows: DataFrame) -> DataFrame:
    """(spec, date, day): the mean return of each candidate's picks, on dates that have any."""
    kinds = sorted({(f, r) for f, _, _, r in SPECS})
    passed = F.array_compact(F.array(*(F.when(F.expr(FILTERS[r]), F.struct(F.lit(f).alias("formula"), F.lit(r).alias("filter"))) for f, r in kinds)))
    known = rows.where("return_20d IS NOT NULL").withColumn("above", F.col("close_above_ma200").cast("int"))
    features = sorted({x for w in FORMULAS.values() for x in w})
    long = known.select("date", "code", "return_20d", *features, F.explode(passed).alias("k")).select("*", "k.*")
    ranks = {x: F.coalesce(rank_pct(x, "formula", "filter", "date"), F.lit(0.5)) for x in features}
    score = F.lit(None).cast("double")
    for name, weights in FORMULAS.items():
        score = F.when(F.col("formula") == name, sum((w * F.col(f"_{x}") for x, w in weights.items()), F.lit(0.0))).otherwise(score)
    scored = long.withColumns({f"_{x}": c for x, c in ranks.items()}).withColumn("score", F.round(score, 9))
    place = F.row_number().over(Window.partitionBy("formula", "filter", "date").orderBy(F.desc("score"), "code"))
    best = scored.select("formula", "filter", "date", "return_20d", place.alias("place")).where(F.col("place") <= max(n for _, n, _, _ in SPECS))
    specs = [F.when((F.col("formula") == f) & (F.col("filter") == r) & (F.col("place") <= n), F.lit(i)) for i, (f, n, _, r) in enumerate(SPECS)]
    return best.select("date", "return_20d", F.explode(F.array_compact(F.array(*specs))).alias("spec")).groupBy("spec", "date").agg(F.avg("return_20d").alias("day"))


def date_facts(rows: DataFrame, block: str = "time_block") -> DataFrame:
    """(date, idx, prior, breadth) of dates that have a known outcome; idx counts blocks."""
    days = rows.where("return_20d IS NOT NULL").groupBy("date", block).agg(F.avg("prior_return_20d").alias("prior"), F.avg((F.col("prior_return_20d") > 0).cast("int")).alias("breadth"))
    return days.join(block_index(days, block), block)


def records(picks: DataFrame, days: DataFrame) -> DataFrame:
    """(step, spec, fitted, …): each candidate with the threshold fitted on the blocks up to fitted,
    its score over the blocks up to step and its record on the block after."""
    last = days.agg(F.max("idx").alias("last"))  # one row
    steps = last.select(F.explode(F.sequence(F.lit(1), F.col("last") - 1)).alias("step"))
    pairs = steps.select("step", F.explode(F.sequence(F.lit(1), "step")).alias("fitted"))
    cuts = days.join(steps, F.col("idx") <= F.col("step")).groupBy("step").agg(F.percentile("breadth", F.lit(0.80)).alias("cut")).withColumnRenamed("step", "fitted")
    gate = F.element_at(F.array(*(F.lit(g) for _, _, g, _ in SPECS)), F.col("spec") + 1)
    day = picks.join(days.select("date", "idx", "prior", "breadth"), "date").withColumn("gate", gate)
    at = day.join(F.broadcast(pairs.join(cuts, "fitted")), F.col("idx") <= F.col("step") + 1)
    at = at.where((F.col("gate") == "all_dates") | ((F.col("gate") == "locked_pool_deep_drawdown") & (F.col("prior") <= DEEP)) | ((F.col("gate") == "low_market_breadth_q80") & (F.col("breadth") <= F.col("cut"))))
    d = F.col("day")
    block = at.groupBy("step", "spec", "fitted", "idx").agg(F.count("*").alias("n"), F.sum(d).alias("s"), F.sum(d * d).alias("q"), F.count_if(d > 0).alias("up"), F.count_if(d <= -5).alias("down"))
    # every candidate stands in every block, with or without picks
    every = pairs.crossJoin(picks.sparkSession.range(len(SPECS)).select(F.col("id").cast("int").alias("spec"))).join(days.groupBy("idx").agg(F.count("*").alias("scheduled")), F.col("idx") <= F.col("step") + 1)  # a few thousand rows of block numbers
    block = every.join(block, ["step", "spec", "fitted", "idx"], "left").fillna(0, ["n", "s", "q", "up", "down"])
    base = block.where("spec = 0 AND fitted = step").select("step", "idx", F.col("n").alias("base_n"), (F.col("s") / F.nullif(F.col("n"), F.lit(0))).alias("base_avg"))
    block = block.join(base, ["step", "idx"])
    n, rate, avg = F.col("n"), F.col("up") / F.nullif(F.col("n"), F.lit(0)), F.col("s") / F.nullif(F.col("n"), F.lit(0))
    wilson = (rate + Z * Z / (2 * n) - Z * F.sqrt((rate * (1 - rate) + Z * Z / (4 * n)) / n)) / (1 + Z * Z / n)
    train, valid = F.col("idx") <= F.col("step"), F.col("idx") == F.col("step") + 1
    counted = train & (n >= LEAST_BLOCK)
    delta = F.when(counted & (F.col("base_n") >= LEAST_BLOCK), avg - F.col("base_avg"))
    on = lambda c, when=train: F.sum(F.when(when, c).otherwise(0))
    sums = block.groupBy("step", "spec", "fitted").agg(
        on(n).alias("n"), on(F.col("s")).alias("s"), on(F.col("q")).alias("q"), on(F.col("up")).alias("up"), on(F.col("down")).alias("down"), on(F.col("scheduled")).alias("scheduled"),
        F.min(F.when(counted, wilson)).alias("min_wilson"), F.min(F.when(counted, rate)).alias("min_pos"), F.avg(F.when(counted, rate)).alias("mean_pos"), F.min(F.when(counted, avg)).alias("min_avg"), F.count_if(counted).alias("n_blocks"),
        F.min(delta).alias("min_delta"), F.avg(delta).alias("mean_delta"), F.max(F.when(valid, n)).alias("valid_n"), F.max(F.when(valid, rate)).alias("valid_pos"), F.max(F.when(valid, avg)).alias("valid_avg"), F.max(F.when(valid, avg - F.col("base_avg"))).alias("valid_delta"),
    )
    return sums.withColumn("score", F.round(selection_score(), 6))


def selection_score() -> Column:
    """Robust over blocks, better than the baseline in each, and with cash on dates without picks."""
    c, zero = F.col, lambda x: F.coalesce(x, F.lit(0.0))
    known = F.nullif(c("n"), F.lit(0))
    avg, pos, loss = c("s") / known, c("up") / known, c("down") / known
    spread = F.sqrt(F.greatest(c("q") / known - avg * avg, F.lit(0.0)))
    idle = c("scheduled") - c("n")
    mean = (c("s") + idle * CASH) / c("scheduled")
    cash_spread = F.sqrt(F.greatest((c("q") + idle * CASH * CASH) / c("scheduled") - mean * mean, F.lit(0.0)))
    stability = avg - 0.5 * spread - 10 * loss
    cash_stability = mean - 0.5 * cash_spread - 10 * c("down") / c("scheduled")
    out = zero(c("min_wilson")) * 180 + zero(c("min_pos")) * 60 + zero(c("mean_pos")) * 25 + zero(pos) * 10 + zero(c("min_delta")) * 1.8 + zero(c("mean_delta")) * 0.8 + zero(c("min_avg")) * 0.8 + zero(avg) * 0.4 + zero(stability) * 0.6 - zero(loss) * 35
    out = out + (c("up") + idle) / c("scheduled") * 70 + cash_stability * 0.8
    narrow = c("spec").isin([i for i, s in enumerate(SPECS) if s[2] == "low_market_breadth_q80"])
    low_vol = c("spec").isin([i for i, s in enumerate(SPECS) if s[0] == "low_vol_trend"])
    five = c("spec").isin([i for i, s in enumerate(SPECS) if s[1] == 5])
    when = lambda test, x: F.when(F.coalesce(test, F.lit(False)), x).otherwise(0.0)
    enough = c("n") >= LEAST_DATES
    out = out + when(narrow & enough & (pos >= 0.65), 18.0) + when(narrow & ~five, -28.0) + when(narrow & five, 8.0) + when(low_vol & enough & (stability >= 0), 10.0)
    out = out - when(~enough, (LEAST_DATES - c("n")) * 4.0) - when(c("n_blocks") < F.least(F.lit(2), c("step")), 35.0) - when(c("min_pos") < TARGET, 180.0) - when(c("min_delta") < -2, 180.0) - when(c("min_delta") < -5, 120.0)
    return out


def chain(records_: DataFrame) -> DataFrame:
    """(step, spec, fitted, promoted, …): the choices, one after another."""
    c = F.col
    promoted = F.coalesce((c("valid_n") >= LEAST_DATES) & (c("valid_pos") >= TARGET) & (c("valid_delta") >= 0), F.lit(False))
    option = F.struct("score", "min_wilson", "min_pos", (c("up") / F.nullif(c("n"), F.lit(0))).alias("pos"), (-c("spec")).alias("order"), "spec", "fitted", promoted.alias("promoted"), "valid_n", "valid_pos", "valid_avg", "valid_delta")
    steps = records_.groupBy("step").agg(F.collect_list(option).alias("options"))
    whole = steps.agg(F.array_sort(F.collect_list(F.struct("step", "options"))).alias("steps"))  # steps * candidates * fits: small by blocks
    kind = "struct<step int, spec int, fitted int, score double, promoted boolean, valid_n bigint, valid_pos double, valid_avg double, valid_delta double, was_locked boolean>"
    start = F.struct(F.lit(0).alias("spec"), F.lit(0).alias("fitted"), F.array().cast(f"array<{kind}>").alias("out"))

    def move(state: Column, step: Column) -> Column:
        locked = lambda o: (o["spec"] == state["spec"]) & (o["fitted"] == F.when(state["fitted"] == 0, step["step"]).otherwise(state["fitted"]))
        able = F.filter(step["options"], lambda o: locked(o) | ((o["spec"] != state["spec"]) & (o["fitted"] == step["step"])))
        # the locked candidate comes first among equals
        best = F.array_max(F.transform(able, lambda o: F.struct(o["score"], o["min_wilson"], o["min_pos"], o["pos"], F.when(locked(o), 1).otherwise(0).alias("first"), o["order"], o.alias("o"))))["o"]
        row = F.struct(step["step"].cast("int").alias("step"), best["spec"].alias("spec"), best["fitted"].cast("int").alias("fitted"), best["score"].alias("score"), best["promoted"].alias("promoted"), best["valid_n"].alias("valid_n"), best["valid_pos"].alias("valid_pos"), best["valid_avg"].alias("valid_avg"), best["valid_delta"].alias("valid_delta"), locked(best).alias("was_locked"))
        return F.struct(F.when(best["promoted"], best["spec"]).otherwise(0).alias("spec"), F.when(best["promoted"] & (best["spec"] != 0), best["fitted"].cast("int")).otherwise(0).alias("fitted"), F.concat(state["out"], F.array(row)).alias("out"))

    done = whole.select(F.aggregate("steps", start, move, lambda s: s["out"]).alias("out"))
    return done.select(F.inline("out"))

