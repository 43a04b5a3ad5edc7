"""Learned gates and rules: each step is one grouped pass over the panel for all candidates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions.expr import rank_pct
from panelyard.operators.quantiles import columns, exact

FORMULAS: dict[str, dict[str, float]] = {
    "momentum": {"ret": 1.0},
    "reversal": {"ret": -1.0},
    "trend": {"ret3": 1.0},
    "trend_reversal": {"ret3": 0.6, "ret": -0.4},
    "liquid_momentum": {"ret": 0.6, "volume": 0.4},
    "illiquid_reversal": {"ret": -0.5, "volume": -0.5},
    "blend": {"ret": 0.4, "ret3": 0.4, "volume": 0.2},
}


def formula_grid(df: DataFrame, sizes: tuple[int, ...] = (3, 5), formulas: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Mean forward return, rate of gains and stability of the top n of each formula per part: the
    panel is exploded once to (formula, score) rows, all cells are one job."""
    formulas = formulas or FORMULAS
    shares = sorted({c for f in formulas.values() for c in f})
    df = df.withColumns({f"p_{c}": F.coalesce(rank_pct(c, "date"), F.lit(0.5)) for c in shares})
    scores = F.array(*(F.struct(F.lit(k).alias("formula"), sum((F.col(f"p_{c}") * w for c, w in f.items()), F.lit(0.0)).alias("score")) for k, f in formulas.items()))
    from pyspark.sql import Window

    long = df.where("fwd is not null").select("code", "date", "part", "fwd", F.inline(scores))
    w = Window.partitionBy("formula", "date").orderBy(F.desc(F.round("score", 9)), "code")
    ranked = long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(sizes))
    cells = ranked.withColumn("top", F.explode(F.array(*map(F.lit, sizes)))).where("rank <= top")
    daily = cells.groupBy("formula", "top", "part", "date").agg(F.avg("fwd").alias("r"))
    loss = F.avg((F.col("r") <= -5).cast("int"))
    return daily.groupBy("formula", "top", "part").agg(F.count("*").alias("n_dates"), F.avg("r").alias("mean_ret"), F.avg((F.col("r") > 0).cast("int")).alias("pos_rate"), (F.avg("r") - 0.5 * F.stddev_pop("r") - 10 * loss).alias("stability"))


def candidates(df: DataFrame, features: list[str], quantiles: tuple[float, ...] = (0.2, 0.35, 0.5, 0.65, 0.8), least: int = 30, y: str = "fwd") -> DataFrame:
    """Every (feature, op, quantile) rule with its sample and score; a row at a threshold meets both
    >= and <=. Features with fewer than three values have none.

    Thresholds, a few a feature, are exact and found by counting. They part a feature's values into
    zones (below, at, between, above); rows are summed up by zone, and rules are sums of zones."""
    known = df.where(F.col(y).isNotNull()).select(F.col(y).alias("y"), *(F.col(f).cast("double").alias(f) for f in features))
    found = exact(known.select(*features), columns(features), {i: [i] for i in range(len(features))}, list(quantiles))
    # three values at least: one lies between the least and the greatest
    ends = known.agg(F.avg("y").alias("y"), *(g(f).alias(f"{n}_{i}") for i, f in enumerate(features) for n, g in (("lo", F.min), ("hi", F.max)))).first()
    between = [F.coalesce(F.bool_or((F.col(f) > ends[f"lo_{i}"]) & (F.col(f) < ends[f"hi_{i}"])), F.lit(False)).alias(f"m_{i}") for i, f in enumerate(features) if i in found]
    several = known.agg(F.lit(0).alias("none"), *between).first()
    cuts = {i: found[i][1] for i in found if several[f"m_{i}"]}
    zones = {i: sorted(set(c)) for i, c in cuts.items()}
    told = [(i, features[i], q, t, zones[i].index(t)) for i, c in cuts.items() for q, t in enumerate(c)]
    middle = ends["y"] or 0.0

    shape = pa.schema([("i", pa.int32()), ("zone", pa.int32()), *((c, pa.float64()) for c in ("n", "s", "ss", "up", "down"))])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {i: np.zeros((5, 2 * len(t) + 1)) for i, t in zones.items()}
        for batch in batches:
            r = batch.column("y").to_numpy(zero_copy_only=False)
            off = r - middle
            for i, t in zones.items():
                x = batch.column(features[i]).to_numpy(zero_copy_only=False)
                at = (np.searchsorted(t, x) + np.searchsorted(t, x, "right"))[~np.isnan(x)]
                for k, w in enumerate((None, off, off * off, r > 0, r <= -5)):
                    sums[i][k] += np.bincount(at, None if w is None else w[~np.isnan(x)], sums[i].shape[1])
        for i, parts in sums.items():
            n = parts.shape[1]
            yield pa.record_batch([pa.array(np.full(n, i, np.int32)), pa.array(np.arange(n, dtype=np.int32)), *map(pa.array, parts)], schema=shape)

    parts = known.mapInArrow(summed, "i int, zone int, n double, s double, ss double, up double, down double").groupBy("i", "zone").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss", "up", "down")))
    rules = df.sparkSession.createDataFrame(told, "i int, feature string, q int, threshold double, place int").withColumn("op", F.explode(F.array(F.lit(">="), F.lit("<="))))
    at = 2 * F.col("place") + 1
    meets = ((F.col("op") == ">=") & (F.col("zone") >= at)) | ((F.col("op") == "<=") & (F.col("zone") <= at))
    n, mean = F.sum("n"), F.sum("s") / F.sum("n")
    stats = parts.join(F.broadcast(rules), "i").where(meets).groupBy("feature", "q", "threshold", "op").agg(
        n.cast("long").alias("n"), (F.lit(middle) + mean).alias("mean_fwd"), (F.sum("up") / n).alias("pos_rate"), F.sqrt(F.greatest(F.sum("ss") / n - mean * mean, F.lit(0.0))).alias("spread"), (F.sum("down") / n).alias("loss_rate")
    )
    stability = F.col("mean_fwd") - 0.5 * F.col("spread") - 10 * F.col("loss_rate")
    return stats.where((F.col("n") >= least) & (F.col("n") > 0)).withColumn("score", F.col("mean_fwd") + 10 * F.col("pos_rate") + 0.3 * stability - 0.05 * F.abs("spread"))


def mask(rule: list[tuple[str, str, float]]) -> Column:
    """Rows that meet all conditions; null meets none."""
    return reduce(lambda a, b: a & b, (F.coalesce((F.col(f) >= t) if op == ">=" else (F.col(f) <= t), F.lit(False)) for f, op, t in rule), F.lit(True))


def greedy(df: DataFrame, features: list[str], depth: int = 3, least: int = 30, y: str = "fwd") -> list[tuple[str, str, float]]:
    """The best condition on all rows, then the best on those that are left, and so on: one job a
    depth, of which the driver sees the best row. Equal scores go by the features' order."""
    rule: list[tuple[str, str, float]] = []
    place = F.coalesce(*(F.when(F.col("feature") == f, F.lit(i)) for i, f in enumerate(features)))
    for _ in range(depth):
        top = candidates(df.where(mask(rule)), features, least=least, y=y).orderBy(F.desc(F.round("score", 9)), place, "q", F.desc("op")).first()
        if top is None:
            break
        rule.append((top["feature"], top["op"], top["threshold"]))
    return rule


def additive_bins(train: DataFrame, score: DataFrame, features: list[str], bins: int = 5, smooth: float = 20.0, keep: int = 16) -> DataFrame:
    """A score that adds, per feature, how far its bin's smoothed rate of gains is from the base.
    Fitted on train, applied to score; the rules are bins * features rows."""
    rows = train.where("fwd is not null")
    long = rows.unpivot(["fwd"], features, "feature", "x").where("x is not null")
    cuts = long.groupBy("feature").agg(F.percentile("x", F.array(*(F.lit(i / bins) for i in range(1, bins)))).alias("cuts"))
    base = rows.agg(F.avg((F.col("fwd") > 0).cast("int")).alias("base"))

    def bin_of(x: Column, at: Column) -> Column:
        return F.size(F.filter(at, lambda c: x > c))

    known = long.join(F.broadcast(cuts), "feature").withColumn("bin", bin_of(F.col("x"), F.col("cuts")))
    rules = known.groupBy("feature", "bin").agg(F.count("*").alias("n"), F.sum((F.col("fwd") > 0).cast("int")).alias("k")).join(F.broadcast(base), F.lit(True))
    rules = rules.withColumn("edge", (F.col("k") + smooth * F.col("base")) / (F.col("n") + smooth) - F.col("base"))
    told = rules.orderBy(F.desc(F.round(F.abs("edge"), 9)), "feature", "bin").limit(keep).select("feature", "bin", "edge")
    wide = score.unpivot(["code", "date"], features, "feature", "x").where("x is not null").join(F.broadcast(cuts), "feature")
    hit = wide.withColumn("bin", bin_of(F.col("x"), F.col("cuts"))).join(F.broadcast(told), ["feature", "bin"], "left")
    return hit.groupBy("code", "date").agg(F.sum(F.coalesce("edge", F.lit(0.0))).alias("score"), F.count("edge").alias("n_rules"))


def exposure(train: DataFrame, all_dates: DataFrame) -> DataFrame:
    """Exposure per date from the regime: 1, 0.5 or 0 by quantiles of breadth that train gives."""
    cut = train.agg(F.percentile("breadth", F.lit(0.35)).alias("low"), F.percentile("breadth", F.lit(0.65)).alias("high"))
    both = all_dates.join(F.broadcast(cut), F.lit(True))
    return both.withColumn("scale", F.when(F.col("breadth") >= F.col("high"), 1.0).when(F.col("breadth") >= F.col("low"), 0.5).otherwise(0.0)).drop("low", "high")


def fitted_logistic(train: DataFrame, score: DataFrame, features: list[str]) -> DataFrame:
    """Median imputation and scaling fitted on train only, then logistic regression of a gain."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    filled = [f"{f}_" for f in features]
    stages = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="v"), StandardScaler(inputCol="v", outputCol="x", withMean=True), LogisticRegression(featuresCol="x", labelCol="y", regParam=0.01)]
    model = Pipeline(stages=stages).fit(train.where("fwd is not null").withColumn("y", (F.col("fwd") > 0).cast("double")))
    return model.transform(score).select("code", "date", vector_to_array("probability")[1].alias("probability"))


def fitted_trees(train: DataFrame, score: DataFrame, features: list[str]) -> DataFrame:
    """Gradient-boosted trees of the forward return (seeded)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    filled = [f"{f}_" for f in features]
    stages = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="x"), GBTRegressor(featuresCol="x", labelCol="fwd", maxIter=10, maxDepth=3, seed=7)]
    model = Pipeline(stages=stages).fit(train.where("fwd is not null"))
    return model.transform(score).select("code", "date", "prediction")
