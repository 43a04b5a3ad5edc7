"""Deduplication, quotas, samples and capped selections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row per key: the first in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def title_key(title: str, length: int = 40) -> Column:
    """The start of a title without white space: with a date, a record's natural key."""
    return F.left(F.regexp_replace(F.col(title), r"\s+", ""), F.lit(length))


def content_key(text: str) -> Column:
    """A SHA-256 of the whole text without white space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", "").cast("binary"), 256)


def stable_order(*parts: str, salt: str = "") -> Column:
    """A place in a stable pseudo-random order: the first 16 hex digits of a SHA-256."""
    joined = F.concat_ws("|", F.lit(salt), *(F.col(p).cast("string") for p in parts))
    return F.substr(F.sha2(joined.cast("binary"), 256), F.lit(1), F.lit(16))


def content_id(*parts: str) -> Column:
    return F.substr(F.sha1(F.concat_ws("|", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts)).cast("binary")), F.lit(1), F.lit(16))


def hashed_sample(df: DataFrame, n: int, strata: list[str], parts: list[str], salt: str = "") -> DataFrame:
    """n rows of each stratum in the stable order."""
    w = Window.partitionBy(*strata).orderBy(stable_order(*parts, salt=salt), *parts)
    return df.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n)


def shortlist(df: DataFrame, score: str, group: str, cap: int = 2, share: float = 0.3, low: int = 3, high: int = 12) -> DataFrame:
    """Per date max(low, min(high, share of the pool)) rows: at most cap of a group first, then the
    best of the rest."""
    day = Window.partitionBy("date")
    best = (F.desc_nulls_last(score), "code")
    out = df.withColumn("in_group", F.row_number().over(Window.partitionBy("date", group).orderBy(*best)))
    out = out.withColumn("want", F.greatest(F.lit(low), F.least(F.lit(high), F.round(F.count("*").over(day) * share).cast("int"))))
    out = out.withColumn("extra", (F.col("in_group") > cap).cast("int"))
    out = out.withColumn("place", F.row_number().over(day.orderBy("extra", *best)))
    return out.where("place <= want").drop("in_group", "want")


def capped(df: DataFrame, score: str, per_code: int, per_date: int, limit: int, block: str = "block") -> DataFrame:
    """Greedy choice in order of score, each step bound by what was chosen before (at most per_code
    of a code, per_date of a date and limit in all), separately per block. The order matters, so a
    block is one group; a block should be a span of dates, so its size is bound by codes and dates."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([score, "code", "date"], ascending=[False, True, True])
        codes: dict = {}
        dates: dict = {}
        keep = []
        for i, (code, date) in enumerate(zip(rows["code"], rows["date"])):
            if codes.get(code, 0) < per_code and dates.get(date, 0) < per_date:
                codes[code], dates[date] = codes.get(code, 0) + 1, dates.get(date, 0) + 1
                keep.append(i)
                if len(keep) == limit:
                    break
        return rows.iloc[keep]

    rows = df.where(F.col(score).isNotNull()).select(block, "code", "date", score)
    return rows.groupBy(block).applyInPandas(choose, rows.schema)


def evenly_spaced(days: DataFrame, n: int) -> DataFrame:
    """n of the numbered dates at equal distances, the first and last included."""
    last = days.agg(F.max("idx").alias("m"))
    at = last.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.lit(1) + F.round(i * (F.col("m") - 1) / (n - 1))).cast("int"))).alias("idx"))
    return days.join(F.broadcast(at.distinct()), "idx")


def cooled(df: DataFrame, strength: str, major: Column) -> DataFrame:
    """Major rows all; of the others the strongest per code and ISO week."""
    week = F.expr("extract(YEAROFWEEK FROM date)") * 100 + F.weekofyear("date")
    minor = first_by(df.where(~major).withColumn("_week", week), ["code", "_week"], F.desc(strength), "date").drop("_week")
    return df.where(major).unionByName(minor)
