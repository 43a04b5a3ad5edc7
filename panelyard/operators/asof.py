"""As-of joins under explicit availability rules.

Both sides are bucketed by code and matched on time with plain joins, so nothing is collected per
code. The windowed join cuts time into buckets as long as its window, so a decision looks into two
of them at most, and a hot code is split by time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLOSE = "interval 15 hours"
FAR_PAST = "1900-01-01"


def available(ts: Column, policy: str) -> Column:
    """When a dated event may be known: as stamped, at that day's close, or on the next day."""
    rules = {"stamped": ts, "same_close": F.date_trunc("day", ts) + F.expr(CLOSE), "next_day": F.date_trunc("day", ts) + F.expr("interval 1 day")}
    return F.coalesce(rules[policy], F.lit(FAR_PAST).cast("timestamp_ntz"))


def asof(left: DataFrame, right: DataFrame, at: str = "at", known: str = "known") -> DataFrame:
    """left (code, at, ...) with the latest right row (code, known, ...) at or before at, else nulls.
    One sort of the union by (code, time): right rows come before left rows of the same time."""
    values = [c for c in right.columns if c not in ("code", known)]
    extra = [c for c in left.columns if c not in ("code", at)]
    a = left.select("code", F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*extra).alias("_l") if extra else F.lit(None).alias("_l"))
    b = right.select("code", F.col(known).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(known), *values).alias("_r"))
    w = Window.partitionBy("code").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_r", F.last("_r", ignorenulls=True).over(w))
    return both.where("_side = 1").select("code", F.col("_t").alias(at), *([F.col(f"_l.{c}") for c in extra]), F.col(f"_r.{known}").alias(known), *(F.col(f"_r.{v}") for v in values))


def windowed(decisions: DataFrame, events: DataFrame, days: int, aggregates: dict[str, Column]) -> DataFrame:
    """Per decision (code, date) the aggregates of its events with event_date in the last days and
    available_at up to 15:00 of the date, and join_status. Unmatched decisions stay.

    The join is on (code, bucket of days + 1 days); the window lies in a decision's bucket and the
    one before it."""
    bucket = lambda day: F.floor(F.unix_date(day) / (days + 1))
    keyed = decisions.select("code", "date").distinct().withColumn("close", F.col("date").cast("timestamp_ntz") + F.expr(CLOSE))
    both = F.array_distinct(F.array(bucket(F.date_sub("date", days)), bucket(F.col("date"))))
    spread = keyed.withColumn("_bucket", F.explode(both))
    inside = F.col("event_date").between(F.date_sub("date", days), F.col("date")) & (F.col("available_at") <= F.col("close"))
    found = spread.join(events.withColumn("_bucket", bucket(F.col("event_date"))), ["code", "_bucket"]).where(inside)
    sums = found.groupBy("code", "date").agg(*(c.alias(k) for k, c in aggregates.items()), F.count("*").alias("matched"))
    codes = events.select("code").distinct().withColumn("listed", F.lit(True))
    out = decisions.join(sums, ["code", "date"], "left").join(codes, "code", "left")
    status = F.when(F.col("date").isNull(), "decision_date_invalid").when(F.col("listed").isNull(), "code_not_in_feature_table").when(F.col("matched").isNull(), "no_event_in_window").otherwise("event_window_matched")
    return out.withColumn("join_status", status).drop("listed", "matched")
