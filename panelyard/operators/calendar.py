"""Decision calendars: trading-day index, weekday schedules, rebalance dates, blocks, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trading_days(bars: DataFrame) -> DataFrame:
    """(date, idx): the distinct dates, numbered. A calendar is short (one row a day), so its
    single-partition window stays small at any number of codes."""
    return bars.select("date").distinct().withColumn("idx", F.row_number().over(Window.orderBy("date")))


def iso_week(date: str = "date") -> tuple[Column, Column]:
    return F.expr(f"extract(YEAROFWEEK FROM {date})").alias("iso_year"), F.weekofyear(date).alias("iso_week")


def weekday_schedule(bars: DataFrame, weekday: int) -> DataFrame:
    """One date a week: the weekday (0 = Monday), else the latest earlier, else the first later."""
    year, week = iso_week()
    days = bars.select("date").distinct().select("date", year, week, F.weekday("date").alias("d"))
    near = F.when(F.col("d") == weekday, 0).when(F.col("d") < weekday, weekday - F.col("d")).otherwise(10 + F.col("d"))
    first = F.row_number().over(Window.partitionBy("iso_year", "iso_week").orderBy(near))
    return days.withColumn("rn", first).where("rn = 1").select("iso_year", "iso_week", "date")


def frequency(df: DataFrame) -> DataFrame:
    """Marks of each date's schedules."""
    _, week = iso_week()
    return df.withColumns({"tuesday": F.weekday("date") == 1, "friday": F.weekday("date") == 4, "even_week": week % 2 == 0})


def rebalance_dates(bars: DataFrame, every: int = 10) -> DataFrame:
    """(date, every_nth, month_first) for the distinct dates."""
    days = trading_days(bars)
    first = F.row_number().over(Window.partitionBy(F.trunc("date", "month")).orderBy("date")) == 1
    return days.select("date", ((F.col("idx") - 1) % every == 0).alias("every_nth"), first.alias("month_first"))


def half_year(date: str = "date") -> Column:
    """Block name such as H1997_1."""
    return F.concat(F.lit("H"), F.year(date), F.lit("_"), F.when(F.month(date) <= 6, "1").otherwise("2"))


def split(df: DataFrame, share: float = 0.65) -> DataFrame:
    """train up to the date at share of the distinct dates, else valid."""
    days = trading_days(df)
    cut = days.agg(F.floor(F.max("idx") * share).cast("int").alias("cut"))
    marked = days.join(F.broadcast(cut), F.lit(True)).select("date", F.when(F.col("idx") <= F.col("cut") + 1, "train").otherwise("valid").alias("part"))
    return df.join(marked, "date")


def folds(df: DataFrame, start: float = 0.4, chunks: int = 4, least: int = 8) -> DataFrame:
    """(fold, date, role): the later dates in chunks, each after a training span that grows."""
    days = trading_days(df)
    ends = days.agg(F.max("idx").alias("n")).withColumn("first", F.greatest(F.floor(F.col("n") * start), F.lit(least)).cast("int"))
    size = F.ceil((F.col("n") - F.col("first")) / chunks).cast("int")
    table = ends.withColumn("size", size).select("first", "size", F.explode(F.sequence(F.lit(1), F.lit(chunks))).alias("fold"))
    lo = F.col("first") + (F.col("fold") - 1) * F.col("size")
    role = F.when(F.col("idx") <= lo, "train").when(F.col("idx") <= lo + F.col("size"), "valid")
    return days.join(F.broadcast(table), F.lit(True)).withColumn("role", role).where("role is not null").select("fold", "date", "role")
