"""Window specs that the operators share, so that stacked indicators need one exchange."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_code(*more: str) -> WindowSpec:
    return Window.partitionBy("code", *more).orderBy("date")


def last_n(n: int) -> WindowSpec:
    return by_code().rowsBetween(-(n - 1), 0)


def full(value: Column, x: str | Column, n: int) -> Column:
    """value over the last n rows, null until there are n non-null x."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.count(x).over(last_n(n)) == n, value)
