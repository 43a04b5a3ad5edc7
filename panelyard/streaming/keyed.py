"""Keyed state with timers, contexts that age, and decisions joined with events as streams. Each
has its batch counterpart, which the tests and the queries' SQL hold it to.

State that can't matter any more goes by itself: positions after KEEP without a decision, a week's
pick at the week's end, both by event-time timers behind the watermark; join state by its interval."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panelyard.sources.folders import scratch

KEPT, ACTIVE, STEP = 0.30, 0.35, 0.15
KEEP_DAYS = 400
MAJOR = 3
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def action(before: float, target: float) -> str:
    """What a change of position means; fixed values of the labels."""
    change = round(target - before, 9)
    if target <= 0:
        return "卖出/不买" if before > 0 else "等待不买"
    if before <= 0:
        return "买入" if target >= ACTIVE else "小仓试探"
    return "加仓" if change >= STEP else "减仓" if change <= -STEP else "持有"


KEEP = KEEP_DAYS * 86_400_000_000


class Positions(StatefulProcessor):
    """A code's last target. Rows are (code, at, first, keeps): a row that keeps holds the smaller
    of the last target and KEPT, any other its own first. A code without a decision for KEEP_DAYS is
    closed: its state goes, and a row with action expired tells of it if it held anything."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "target double, us long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.last.get()
        before, seen = known or (0.0, None)
        new = seen
        for us, first, keeps in sorted(((r["us"], r["first"], r["keeps"]) for r in rows), key=lambda r: r[0]):
            if new is not None and us <= new:
                continue  # a date that was decided on, or is earlier than one that was
            target = min(before, KEPT) if keeps else float(first)
            yield Row(code=key[0], us=us, target=target, action=action(before, target))
            before, new = target, us
        if new != seen:
            if known:
                self.handle.deleteTimer((seen + KEEP) // 1000)
            self.last.update((before, new))
            self.handle.registerTimer((new + KEEP) // 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        target, us = self.last.get()
        self.last.clear()
        if target > 0:
            yield Row(code=key[0], us=us + KEEP, target=0.0, action="expired")

    def close(self) -> None:
        pass


def positions(decisions: DataFrame, delay: str = "1 day") -> DataFrame:
    """(code, at, target, action) of a stream of (code, at, first, keeps)."""
    # times as microseconds, which know no time zone; rows, not a frame for each code
    rows = decisions.withWatermark("at", delay).withColumn("us", F.unix_micros("at"))
    out = rows.groupBy("code").transformWithState(Positions(), "code long, us long, target double, action string", "Append", "EventTime")
    return out.select("code", F.timestamp_micros("us").alias("at"), "target", "action")


def cooled(triggers: DataFrame, delay: str = "1 day") -> DataFrame:
    """Triggers (code, id, at, priority, strength) after the cooldown, from a stream: major ones pass
    at once, of the others of a code and week the strongest (then the earliest, then the least id)
    passes when the week is over. The best so far is the state of code and week, and goes with it."""
    zone = triggers.sparkSession.conf.get("spark.sql.session.timeZone")
    # weeks of the session's clock; windows count from a Thursday in UTC
    rows = triggers.withColumn("_clock", F.from_utc_timestamp("at", zone)).withWatermark("_clock", delay)
    major = F.coalesce(F.col("priority") >= MAJOR, F.lit(False))
    week = F.window("_clock", "7 days", "7 days", "4 days")
    order = F.struct("strength", (-F.unix_micros("at")).alias("us"), (-F.col("id")).alias("id"), "priority")  # nulls are last
    best = rows.where(~major).groupBy("code", week).agg(F.max(order).alias("b"))
    rest = best.select("code", (-F.col("b.id")).alias("id"), F.timestamp_micros(-F.col("b.us")).alias("at"), "b.priority", "b.strength")
    return rows.where(major).select("code", "id", "at", "priority", "strength").unionByName(rest)


def matched(decisions: DataFrame, events: DataFrame, days: int = 30, delay: str = "1 day") -> DataFrame:
    """Decisions (code, at) with the events (code, event_id, available_at) known in the days before
    them, from two streams; a decision without any comes once, with null event_id, when no event can
    come any more."""
    left = decisions.select("code", F.col("at").alias("at")).withWatermark("at", delay)
    right = events.select(F.col("code").alias("_code"), "event_id", "available_at").withWatermark("available_at", delay)
    inside = (F.col("code") == F.col("_code")) & (F.col("available_at") <= F.col("at")) & (F.col("available_at") >= F.col("at") - F.expr(f"interval {days} days"))
    return left.join(right, inside, "leftOuter").select("code", "at", "event_id", "available_at")


class DailyContext:
    """A static table that a stream is joined with, read anew once it is older than ttl seconds."""

    def __init__(self, load: Callable[[], DataFrame], ttl: float = 24 * 3600, clock: Callable[[], float] = time.time):
        self.load, self.ttl, self.clock = load, ttl, clock
        self.table: DataFrame | None = None
        self.since = 0.0
        self.loads = 0

    def get(self) -> DataFrame:
        if self.table is None or self.clock() - self.since >= self.ttl:
            self.table, self.since = self.load(), self.clock()
            self.loads += 1
        return self.table


def with_context(stream: DataFrame, context: DailyContext, keys: list[str], path: str, checkpoint: str, **trigger) -> None:
    """Run a stream: each batch is joined with the context as it is at its time, and its rows become
    the batch's part of the table at path; a batch that runs again replaces its part."""

    def add(batch: DataFrame, number: int) -> None:
        batch.join(context.get(), keys, "left").write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start().awaitTermination()


def with_store(spark: SparkSession, run: Callable[[], None]) -> None:
    """Run with the state store that timers need, and leave the session as it was. A store for each
    partition is opened and committed in each batch at a fixed cost, so there are no more of them
    than keep the cores busy; their rows lie outside of the heap and on disk."""
    stores = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    own = {
        "spark.sql.streaming.stateStore.providerClass": STORE,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",  # a commit writes what changed
        "spark.sql.shuffle.partitions": str(max(1, stores)),
    }
    before = {name: spark.conf.get(name, None) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        run()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def run_to_table(stream: DataFrame, name: str, checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """Run a stream over what is there and read the rows it appended; given paths go on where a run
    before left off."""
    spark = stream.sparkSession
    path, checkpoint = path or scratch(spark, name), checkpoint or scratch(spark, f"{name}-state")
    with_store(spark, lambda: stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(path)


def run_in_parts(sources: list[tuple[DataFrame, Column]], build: Callable[..., DataFrame], name: str) -> DataFrame:
    """Replay tables as streams in the order of their parts (a column that tells each row's part):
    each part is written as files of its own and is one batch, and the query is started anew from
    its checkpoint for each. build makes the query of the streams; its appended rows come back."""
    spark = sources[0][0].sparkSession
    out, checkpoint = scratch(spark, name), scratch(spark, f"{name}-state")
    tables = [(rows.withColumn("_part", part), scratch(spark, f"{name}-source")) for rows, part in sources]
    order = sorted({r[0] for rows, _ in tables for r in rows.select("_part").distinct().collect()})  # years, weeks
    result: DataFrame | None = None
    for value in order:
        for rows, path in tables:
            rows.where(F.col("_part") == value).drop("_part").write.mode("append").parquet(path)
        streams = [spark.readStream.schema(rows.drop("_part").schema).parquet(path) for rows, path in tables]
        result = run_to_table(build(*streams), name, checkpoint, out)
    return result if result is not None else spark.createDataFrame([], build(*(rows.drop("_part") for rows, _ in tables)).schema)
