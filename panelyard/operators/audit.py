"""Integrity: leakage, time safety, purity, coverage and contracts, as plans with few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORBIDDEN = ("fwd", "fwd_ret_5", "fwd_ret_10", "fwd_ret_20", "gt_pass", "gt_status")


def paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """All field paths of a schema, nested ones too."""
    out = []
    for f in schema.fields:
        out.append(prefix + f.name)
        kind = f.dataType
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if isinstance(kind, T.StructType):
            out += paths(kind, f"{prefix}{f.name}.")
    return out


def forbidden(df: DataFrame, names: tuple[str, ...] = FORBIDDEN) -> list[str]:
    """Label fields that a feature frame must not have, found at plan time."""
    return [p for p in paths(df.schema) if p.rsplit(".", 1)[-1] in names]


def features_only(df: DataFrame, allowed: list[str]) -> DataFrame:
    out = df.select(*allowed)
    if found := forbidden(out):
        raise ValueError(f"labels among the features: {found}")
    return out


def coverage(df: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """(keys, column, n, known, rate) for each column."""
    sums = df.groupBy(*keys).agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in columns))
    long = sums.unpivot([*keys, "n"], columns, "column", "known")
    return long.withColumn("rate", F.col("known") / F.col("n"))


def late_rows(df: DataFrame, known: str, at: str) -> DataFrame:
    """Rows that use what was not known yet; a sound join has none."""
    return df.where(F.col(known) > F.col(at))


def purity(df: DataFrame, part: str, limit: float = 0.5) -> DataFrame:
    """Per part its span and its largest code's share; impure if that exceeds the limit."""
    per = df.groupBy(part, "code").agg(F.count("*").alias("k"), F.min("date").alias("lo"), F.max("date").alias("hi"))
    out = per.groupBy(part).agg(F.sum("k").alias("n"), F.min("lo").alias("first_date"), F.max("hi").alias("last_date"), (F.max("k") / F.sum("k")).alias("top_share"))
    return out.withColumn("pure", F.col("top_share") < limit)
