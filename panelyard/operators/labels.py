"""Forward returns, maturity and outcome classes: labels, joined to features only for scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions.windows import by_code

HORIZONS = (5, 10, 20)


def forward(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """fwd_ret_h in %, all null unless the longest horizon has come; gt_status says which."""
    w = by_code()
    ripe = F.lead("close", max(horizons)).over(w).isNotNull()
    out = bars.withColumn("ripe", ripe).withColumns({f"fwd_ret_{h}": F.when(ripe, 100 * (F.lead("close", h).over(w) / F.col("close") - 1)) for h in horizons})
    return out.withColumn("gt_status", F.when(F.col("ripe"), "evaluated").otherwise("insufficient_future_data")).drop("ripe")


def outcome(rating: Column, ret: Column) -> Column:
    """Whether a rating came true: strong ones need a rise, weak ones none, others small moves."""
    return F.when(ret.isNull(), F.lit(None).cast("boolean")).when(rating == "strong", ret > 0).when(rating == "weak", ret <= 0).otherwise(F.abs(ret) <= 5)


def maturity(df: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """gt_maturity: evaluated, pending until days have passed, or a future date."""
    age = F.datediff(as_of, "date")
    return df.withColumn("gt_maturity", F.when(age < 0, "future_date").when(age < days, "gt_pending").otherwise("evaluated"))
