"""The event watch as a stream: late-data guard, deduplication, windowed grades, an append-only
ledger, and per-code state. Each has the batch result as its counterpart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelyard.sources.folders import scratch

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """The events files of a folder as a stream; event time is a timestamp in UTC."""
    raw = spark.readStream.schema(SCHEMA).option("pathGlobFilter", pattern).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def grade(amplitude: Column, errors: Column) -> Column:
    return F.when(errors >= 3, "alarm").when(amplitude >= 90, "watch").otherwise("calm")


def graded(events: DataFrame, size: str = "1 day", delay: str = "2 hours") -> DataFrame:
    """Per tumbling window: events, errors, range of values, grade. Late events beyond delay and
    repeated event ids within it are left out."""
    unique = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    sums = unique.groupBy(F.window("ts", size)).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.min("value").alias("low"), F.max("value").alias("high"))
    return sums.select(F.col("window.start").alias("start"), "n", "n_errors", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), grade(F.col("high") - F.col("low"), F.col("n_errors")).alias("grade"))


def appended(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is available, append its rows to a Parquet ledger, read that."""
    spark = stream.sparkSession
    path, checkpoint = scratch(spark, name), scratch(spark, f"{name}-state")
    run = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_lengths(events: DataFrame) -> DataFrame:
    """Keyed state across batches: how many events of each user were seen, and the last time. Times
    within a batch are sorted, so the result doesn't depend on how the input is cut in batches."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, pd.Timestamp(0))
        for frame in frames:
            n += len(frame)
            last = max(last, frame["ts"].max())
        state.update((n, last))
        yield pd.DataFrame({"code": [key[0]], "n": [n], "last": [last]})

    out = events.select(F.col("user_id").alias("code"), "ts")
    return out.groupBy("code").applyInPandasWithState(update, "code long, n long, last timestamp", "n long, last timestamp", "update", GroupStateTimeout.NoTimeout)


def latest_states(stream: DataFrame) -> DataFrame:
    """Run a keyed-state stream and keep the last update of each code: each batch is appended to a
    table with its number."""
    spark = stream.sparkSession
    path, checkpoint = scratch(spark, "states"), scratch(spark, "states-log")

    def add(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(path)
    return rows.groupBy("code").agg(F.max_by("n", "batch").alias("n"), F.max_by("last", "batch").alias("last"))
