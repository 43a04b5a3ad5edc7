"""Column expressions with the panel's semantics: null-safe, never NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

TINY = 1e-12


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(x: str | Column) -> Column:
    """A double; null for what is no number, and for NaN."""
    return F.nullif(col(x).try_cast("double"), F.lit(float("nan")))


def safe_div(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is null or as good as zero."""
    return F.when(F.abs(col(b)) > TINY, col(a) / col(b))


def clip(x: str | Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(col(x).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), col(x))))


def pct_change(x: str, n: int, w: WindowSpec) -> Column:
    return 100 * (col(x) / F.lag(x, n).over(w) - 1)


def rank_pct(x: str | Column, *keys: str) -> Column:
    """Average rank over the number of non-nulls within keys; null for null."""
    x = col(x)
    w = Window.partitionBy(*keys).orderBy(x.asc_nulls_last())
    # ranks of the first and last of equal values: no window has a partition a value
    return F.when(x.isNotNull(), (F.rank().over(w) + (F.count(x).over(w) - F.rank().over(w)) / 2) / F.count(x).over(Window.partitionBy(*keys)))


def zscore(x: str | Column, *keys: str, ddof: int = 1, least: int = 5) -> Column:
    """Standard score within keys: 0 for groups of fewer than least rows or without spread."""
    x, w = col(x), Window.partitionBy(*keys)
    spread = (F.stddev_samp(x) if ddof else F.stddev_pop(x)).over(w)
    return F.when((F.count("*").over(w) >= least) & (spread > TINY), (x - F.avg(x).over(w)) / spread).otherwise(F.lit(0.0))


def winsorized(x: str | Column, *keys: str, tail: float = 0.01) -> Column:
    x, w = col(x), Window.partitionBy(*keys)
    low, high = F.percentile(x, F.lit(tail)).over(w), F.percentile(x, F.lit(1 - tail)).over(w)
    return F.when(x.isNotNull(), F.greatest(low, F.least(high, x)))


def others_mean(x: str | Column, *keys: str, rows: bool = False) -> Column:
    """Mean of the group's other rows. rows: over the row count less one, 0 where that is none;
    else over the non-null count less one, null where that is none."""
    x, w = col(x), Window.partitionBy(*keys)
    n = (F.count("*") if rows else F.count(x)).over(w) - 1
    out = F.when(n > 0, (F.sum(x).over(w) - F.coalesce(x, F.lit(0.0))) / n)
    return F.coalesce(out, F.lit(0.0)) if rows else F.when(x.isNotNull(), out)


def share(condition: Column, over_all: bool = True) -> Column:
    """Share of rows that meet a condition: of all rows (null counts as not), or of known ones."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int") if over_all else condition.cast("int"))


def all_of(rules: list[tuple[str, str, float]]) -> Column:
    """A mask of (column, operator, threshold) rules; null fails."""
    ops = {">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__", "==": "__eq__"}
    return reduce(lambda a, b: a & b, (F.coalesce(getattr(F.col(c), ops[o])(t), F.lit(False)) for c, o, t in rules), F.lit(True))


def named(conditions: dict[str, Column], separator: str = "+") -> Column:
    """The names of the conditions that hold, in order, joined by a separator."""
    return F.concat_ws(separator, *(F.when(c, F.lit(k)) for k, c in conditions.items()))


def count_true(*conditions: Column) -> Column:
    return reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(False)).cast("int") for c in conditions), F.lit(0))


def half_away(x: str | Column, digits: int) -> Column:
    """x rounded as SQL's round() does it for doubles: x * 10 ** digits to the nearest whole, halves
    away from zero. F.round goes by the shortest decimal of x, so halves fall otherwise."""
    y = col(x) * F.lit(10.0**digits)
    whole = F.signum(y) * F.floor(F.abs(y) + 0.5)
    return F.when(F.abs(y) < 2.0**52, whole / F.lit(10.0**digits)).otherwise(col(x))  # larger ones are whole


def rounded(df, digits: int = 6):
    """Doubles rounded at the output boundary."""
    return df.select(*(half_away(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))
