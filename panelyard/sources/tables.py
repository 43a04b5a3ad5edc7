"""Canonical tables: daily bars, the monthly panel, event streams; and plain file scans and sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.functions.expr import pct_change
from panelyard.functions.windows import by_code
from panelyard.sources.folders import cached

BAR_SCHEMA = T.StructType([T.StructField("code", T.LongType()), T.StructField("date", T.DateType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume", "amount"))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, date, open, high, low, close, volume, amount) per supplier and ship date, written
    once for all queries over the same files."""
    return cached(spark, "bars", [f"{sf_dir}/lineitem.parquet"], lambda: _bars(spark, sf_dir))


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums are decimal, so they do not depend on the order of rows."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    exact = lambda c: F.sum(F.col(c).cast("decimal(18,4)")).cast("double")
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 0").withColumn("unit", unit)
    return (
        rows.groupBy(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("date"))
        .agg(
            F.min_by("unit", F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("open"),
            F.max("unit").alias("high"),
            F.min("unit").alias("low"),
            exact("l_quantity").alias("volume"),
            exact("l_extendedprice").alias("amount"),
        )
        .withColumn("close", F.col("amount") / F.col("volume"))
        .select("code", "date", "open", "high", "low", "close", "volume", "amount")
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, industry, area): a supplier's nation and region."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("code"), F.col("n_name").alias("industry"), F.col("r_name").alias("area"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly rows of each code: close, volume, ret (trailing %), ret3, fwd (forward %), industry,
    area. fwd is a label; nothing derives features from it. Written once, as bars() is."""
    inputs = [f"{sf_dir}/{name}.parquet" for name in ("lineitem", "supplier", "nation", "region")]
    return cached(spark, "panel", inputs, lambda: _panel(spark, sf_dir))


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = bars(spark, sf_dir)
    total = lambda c: F.sum(F.col(c).cast("decimal(18,4)")).cast("double")
    month = day.groupBy("code", F.trunc("date", "month").alias("date")).agg(total("amount").alias("amount"), total("volume").alias("volume"), F.count("*").alias("days"))
    w = by_code()
    month = month.withColumn("close", F.col("amount") / F.col("volume"))
    month = month.withColumns({"ret": pct_change("close", 1, w), "ret3": pct_change("close", 3, w), "fwd": 100 * (F.lead("close", 1).over(w) / F.col("close") - 1)})
    return month.join(universe(spark, sf_dir), "code", "left").select("code", "date", "industry", "area", "close", "volume", "days", "ret", "ret3", "fwd")


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, event_id, event_type, ts, event_date, value, k): k from the JSON props."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("code"), "event_id", "event_type", "ts", F.to_date("ts").alias("event_date"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


# -- files ------------------------------------------------------------------------------------


#: What a file of daily bars must have.
REQUIRED = ("date", "open", "high", "low", "close", "volume", "amount")


def csv_bars(spark: SparkSession, path: str | list[str], aliases: dict[str, str] | None = None, skip_unreadable: bool = False) -> DataFrame:
    """Daily bars from CSV (one file, a folder or a glob, gzip by name) under one declared schema:
    bad numbers become null, rows without date or close are dropped, and a missing required column
    is an error. Damaged files are an error too unless skip_unreadable."""
    read = spark.read.option("header", True).option("ignoreCorruptFiles", skip_unreadable).csv(path)
    named = read.withColumnsRenamed(aliases or {})
    if missing := sorted(set(REQUIRED) - set(named.columns)):
        raise ValueError(f"missing columns: {missing}")
    return conformed(named).dropna(subset=["date", "close"])


def conformed(rows: DataFrame) -> DataFrame:
    """Text columns of daily bars as their declared types; other columns stay."""
    day = F.coalesce(*(F.try_to_timestamp("date", F.lit(form)) for form in ("yyyy-MM-dd", "yyyyMMdd"))).cast("date")
    return rows.withColumns({"date": day} | {c: F.col(c).try_cast("double") for c in REQUIRED[1:]})


def sharded_csv(spark: SparkSession, pattern: str) -> DataFrame:
    """Files of one trading day each (a glob), with ts_code (such as 000001.SZ) and trade_date
    (yyyyMMdd): code, date and the other columns as text."""
    rows = spark.read.option("header", True).csv(pattern)
    rest = [c for c in rows.columns if c not in ("ts_code", "trade_date")]
    return rows.select(F.substring_index("ts_code", ".", 1).alias("code"), F.to_date("trade_date", "yyyyMMdd").alias("date"), *rest)


def union_by_key(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """The tables' rows, columns by name (null where absent); of rows with one key that of the
    first table stays, within a table that with the least values."""
    whole = tables[0].withColumn("_table", F.lit(0))
    for i, df in enumerate(tables[1:], 1):
        whole = whole.unionByName(df.withColumn("_table", F.lit(i)), allowMissingColumns=True)
    rest = [c for c in whole.columns if c not in (*keys, "_table")]
    first = F.min(F.struct("_table", *rest)).alias("_first")
    return whole.groupBy(*keys).agg(first).select(*keys, *(F.col(f"_first.{c}").alias(c) for c in rest))


def keyed_csv(spark: SparkSession, folder: str, codes: list[str] | None = None, aliases: dict[str, str] | None = None, skip_unreadable: bool = False) -> DataFrame:
    """A folder with a file per code; the code is the file's name. With codes, only the files that
    have their names are opened; codes without a file have no rows."""
    name = r"([^/]+?)\.csv(\.gz)?$"
    paths = f"{folder}/*.csv*"
    if codes is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        there = [str(f.getPath()) for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
        found = ((re.search(name, path), path) for path in there)
        paths = [path for m, path in found if m and m[1] in set(codes)]
        if not paths:
            return spark.createDataFrame([], T.StructType([*(f for f in BAR_SCHEMA if f.name != "code"), T.StructField("code", T.StringType())]))
    return csv_bars(spark, paths, aliases, skip_unreadable).withColumn("code", F.regexp_extract(F.input_file_name(), name, 1))


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a multi-line JSON file: a list, or an object with records or events."""
    whole = spark.read.option("multiLine", True).schema(f"{schema}, records array<struct<{_fields(schema)}>>, events array<struct<{_fields(schema)}>>").json(path)
    nested = whole.select(F.inline(F.coalesce("records", "events")))
    flat = whole.where("records is null and events is null").drop("records", "events")
    return flat.unionByName(nested)


def _fields(schema: str) -> str:
    return ", ".join(":".join(f.strip().split(" ", 1)) for f in schema.split(","))


def ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    """Append rows to a ledger of JSON lines."""
    rows.write.mode("append").json(path)


def write_csv(rows: DataFrame, path: str, gzip: bool = False) -> None:
    rows.write.mode("overwrite").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def load_status(rows: DataFrame, source: str) -> DataFrame:
    """One row on a source: ok or empty, its rows and days."""
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct("date").alias("n_days")).select(F.lit(source).alias("source"), F.when(F.col("n_rows") > 0, "ok").otherwise("empty").alias("status"), "n_rows", "n_days")
