"""Financial statements as maps of metrics: yoy against the period a year before, ratios, risk,
surprise, materiality and missing rate. A row is (code, period, interface, metrics); all scores are
expressions over the map, so a new metric needs no new column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.expr import clip, half_away

# fixed values: what a statement of each interface should hold, and whose changes are a surprise
FIELDS = {
    "income": ["total_revenue", "operate_profit", "total_profit", "n_income"],
    "cashflow": ["c_fr_sale_sg", "n_cashflow_act"],
    "balancesheet": ["total_assets", "total_liab", "total_hldr_eqy_exc_min_int"],
}
SURPRISING = ("n_income", "n_income_attr_p", "operate_profit", "total_profit", "total_revenue", "revenue", "n_cashflow_act", "c_fr_sale_sg")


def _metric(name: str) -> Column:
    return F.col("metrics")[name]


def with_changes(rows: DataFrame, periods: int = 4) -> DataFrame:
    """rows with each metric's change against the same interface of periods before, in percent of
    its size, as <metric>_yoy in the map; metrics that lack either value or were as good as zero
    have none. Periods are whole numbers in order."""
    # a code's statements stand together, so they are read and dealt once
    before = Window.partitionBy("code", "interface").orderBy("period").rangeBetween(-periods, -periods)
    prior = F.when(F.col("code").isNotNull() & F.col("interface").isNotNull() & F.col("period").isNotNull(), F.first("metrics").over(before))
    out = rows.withColumn("_prior", F.coalesce(prior, F.create_map().cast("map<string,double>")))
    usable = F.map_filter("metrics", lambda k, v: v.isNotNull() & F.col("_prior")[k].isNotNull() & (F.abs(F.col("_prior")[k]) >= 1e-9))
    change = F.transform_values(usable, lambda k, v: half_away((v - F.col("_prior")[k]) / F.abs(F.col("_prior")[k]) * 100, 4))
    changes = F.transform_keys(change, lambda k, v: F.concat(k, F.lit("_yoy")))
    return out.withColumn("metrics", F.map_concat(F.map_filter("metrics", lambda k, v: v.isNotNull()), changes)).drop("_prior")


def with_ratios(rows: DataFrame) -> DataFrame:
    """Balance sheets with liabilities and equity over assets, where assets are positive."""
    assets = _metric("total_assets")
    of = lambda name: F.when((F.col("interface") == "balancesheet") & (assets > 0), half_away(_metric(name) / assets, 4))
    ratios = F.map_from_arrays(F.array(F.lit("liab_to_assets"), F.lit("equity_to_assets")), F.array(of("total_liab"), of("total_hldr_eqy_exc_min_int")))
    return rows.withColumn("metrics", F.map_concat("metrics", F.map_filter(ratios, lambda k, v: v.isNotNull())))


def _added(test: Column, value: float) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), value).otherwise(0.0)


def risk() -> Column:
    """Falls of 30 % or more add up to a quarter each; losses, cash drains and high debts add more."""
    falls = F.filter(F.map_entries("metrics"), lambda e: e["key"].endswith("_yoy") & (e["value"] <= -30))
    base = F.aggregate(falls, F.lit(0.0), lambda a, e: a + F.least(F.lit(0.25), F.abs(e["value"]) / 400))
    loss = F.exists(F.array(*(F.coalesce(_metric(c), F.lit(0.0)) for c in ("n_income_attr_p", "n_income", "total_profit", "operate_profit"))), lambda x: x < 0)
    debts = _metric("liab_to_assets")
    more = (
        F.when(F.col("interface") == "income", _added(loss, 0.25))
        .when(F.col("interface") == "cashflow", _added(_metric("n_cashflow_act") < 0, 0.3) + _added(_metric("n_cashflow_act_yoy") <= -50, 0.2))
        .when(F.col("interface") == "balancesheet", _added(debts >= 0.85, 0.45) + _added((debts >= 0.75) & (debts < 0.85), 0.25) + _added(_metric("total_hldr_eqy_exc_min_int") < 0, 0.5))
        .otherwise(0.0)
    )
    return clip(base + more, 0, 1)


def surprise() -> Column:
    """The mean of the changes of profits, sales and cash, each within a whole; none on balance sheets."""
    moved = F.filter(F.map_entries("metrics"), lambda e: e["key"].endswith("_yoy") & F.exists(F.array(*map(F.lit, SURPRISING)), lambda p: e["key"].startswith(p)))
    parts = F.transform(moved, lambda e: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), e["value"] / 100)))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.when((F.col("interface") == "balancesheet") | (F.size(parts) == 0), 0.0).otherwise(clip(total / F.size(parts), -1, 1))


def scored(rows: DataFrame) -> DataFrame:
    """rows with n_metrics, risk, surprise, materiality and missing_rate."""
    size = F.size(F.map_keys("metrics"))
    expected = F.lit(None).cast("array<string>")
    for name, fields in FIELDS.items():
        expected = F.when(F.col("interface") == name, F.array(*map(F.lit, fields))).otherwise(expected)
    missing = F.size(F.filter(expected, lambda k: F.col("metrics")[k].isNull())) / F.size(expected)
    out = rows.withColumns({"n_metrics": size, "risk": risk(), "surprise": surprise()})
    materiality = clip(F.greatest(0.35 + 0.3 * F.least(F.col("n_metrics") / 8, F.lit(1.0)), "risk", F.abs("surprise")), 0, 1)
    return out.withColumns({"materiality": materiality, "missing_rate": F.coalesce(missing, F.lit(1.0))})
