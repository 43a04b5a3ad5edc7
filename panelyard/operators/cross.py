"""Cross-sections: peers, neutral scores, alerts, rank correlations and selections per date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.expr import clip, col, others_mean, rank_pct, zscore


def neutral(x: str, *keys: str) -> Column:
    return col(x) - F.avg(x).over(Window.partitionBy(*keys))


def peers(df: DataFrame, x: str = "ret") -> DataFrame:
    """Leave-one-out peers in the industry, in both conventions for the denominator."""
    w = Window.partitionBy("date", "industry")
    rest = F.sum(F.when(F.col(x) > 0, 1).when(F.col(x).isNotNull(), 0)).over(w) - F.coalesce((F.col(x) > 0).cast("int"), F.lit(0))
    known = F.count(x).over(w)
    return df.withColumns(
        {
            "peer_count": F.count("*").over(w) - 1,
            "peer_mean": others_mean(x, "date", "industry"),
            "peer_mean_rows": others_mean(x, "date", "industry", rows=True),
            "peer_breadth": F.when(F.col(x).isNotNull() & (known > 1), rest / (known - 1)),
        }
    ).withColumn("peer_relative", F.col(x) - F.col("peer_mean"))


def rank_ic(df: DataFrame, x: str, y: str, *keys: str, least: int = 20, distinct: int = 5) -> DataFrame:
    """Pearson correlation of average ranks within keys, for groups that are large and varied."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.select(*keys, rank_pct(x, *keys).alias("rx"), rank_pct(y, *keys).alias("ry"), F.col(x).alias("vx"))
    out = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("vx").alias("d"), F.corr("rx", "ry").alias("ic"))
    return out.where((F.col("n") >= least) & (F.col("d") >= distinct)).drop("d")


def top_n(df: DataFrame, score: str, n: int, *keys: str) -> DataFrame:
    """The n best per group, ties by code."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), "code")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_share(df: DataFrame, score: str, share: float, *keys: str) -> DataFrame:
    """The best max(1, ceil(n * share)) per group, ties by code."""
    w = Window.partitionBy(*keys)
    k = F.greatest(F.lit(1), F.ceil(F.count("*").over(w) * share))
    return df.withColumn("rank", F.row_number().over(w.orderBy(F.desc_nulls_last(score), "code"))).withColumn("k", k).where("rank <= k").drop("k")


def turnover(picks: DataFrame, *keys: str) -> DataFrame:
    """One-way turnover of each date's codes against the date before: 1 - common / larger."""
    sets = picks.groupBy(*keys, "date").agg(F.collect_set("code").alias("codes"))
    w = Window.partitionBy(*keys).orderBy("date") if keys else Window.orderBy("date")
    before = F.coalesce(F.lag("codes").over(w), F.array().cast("array<long>"))
    larger = F.greatest(F.size("codes"), F.size("before"))
    out = sets.withColumn("before", before)
    return out.select(*keys, "date", F.size("codes").alias("n"), F.when(larger == 0, 0.0).otherwise(1 - F.size(F.array_intersect("codes", "before")) / larger).alias("turnover"))


def long_short(df: DataFrame, x: str, y: str, least: int = 10, tail: float = 0.1) -> DataFrame:
    """Mean y of the top against the bottom tail of x's ranks per date."""
    ranked = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("p", rank_pct(x, "date"))
    out = ranked.groupBy("date").agg(F.count("*").alias("n"), F.avg(F.when(F.col("p") >= 1 - tail, F.col(y))).alias("top"), F.avg(F.when(F.col("p") <= tail, F.col(y))).alias("bottom"))
    return out.where(F.col("n") >= least).withColumn("spread", F.col("top") - F.col("bottom"))


def held(df: DataFrame, score: str, enter: int, leave: int) -> DataFrame:
    """Holdings with hysteresis: a code enters at rank <= enter and stays while its rank is <= leave.

    A code's state depends on its own earlier ranks alone: it holds if, since its last rank beyond
    leave, it has been at rank <= enter. So no sequential state is needed."""
    w = Window.partitionBy("date").orderBy(F.desc_nulls_last(score), "code")
    ranked = df.withColumn("rank", F.row_number().over(w))
    own = Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("rank") > leave, False).when(F.col("rank") <= enter, True)
    return ranked.withColumn("held", F.coalesce(F.last(mark, ignorenulls=True).over(own), F.lit(False)))


def alerts(df: DataFrame) -> DataFrame:
    """Attention against a code's own past and its peers, with scores, a label and a reason; for
    rows (code, date, industry, n, risk, gain)."""
    own = Window.partitionBy("code").orderBy("date").rowsBetween(-3, -1)
    spike = F.col("n") / F.greatest(F.avg("n").over(own), F.lit(1.0))
    out = df.withColumns({"attention": rank_pct("n", "date"), "spike": F.coalesce(spike, F.lit(1.0)), "gap": F.col("n") - others_mean("n", "date", "industry", rows=True)})
    out = out.withColumns({"warning": clip(0.6 * F.col("risk") / F.col("n") + 0.4 * F.col("attention"), 0, 1), "opportunity": clip(0.6 * F.col("gain") / F.col("n") + 0.4 * F.col("attention"), 0, 1)})
    label = F.when((F.col("warning") >= 0.6) & (F.col("warning") > F.col("opportunity")), "warning").when(F.col("opportunity") >= 0.6, "opportunity").otherwise("quiet")
    reason = F.concat_ws("+", F.when(F.col("spike") >= 1.5, F.lit("spike")), F.when(F.col("gap") > 0, F.lit("above_peers")), F.when(F.col("attention") >= 0.9, F.lit("top_attention")))
    return out.withColumns({"label": label, "reason": reason})


def composite(df: DataFrame, parts: dict[str, float], *keys: str) -> DataFrame:
    """Weighted sum of rank shares (null counts as 0.5)."""
    total = sum((F.coalesce(rank_pct(c, *keys), F.lit(0.5)) * w for c, w in parts.items()), F.lit(0.0))
    return df.withColumn("score", total)


def reversal(df: DataFrame, features: list[str]) -> DataFrame:
    """Minus the mean z of the features, standardized again, as a rank share."""
    mean_z = sum((zscore(f, "date") for f in features), F.lit(0.0)) / len(features)
    out = df.withColumn("raw", -mean_z)
    out = out.withColumn("reversal", zscore("raw", "date"))
    return out.withColumn("reversal_rank", rank_pct("reversal", "date")).drop("raw")
