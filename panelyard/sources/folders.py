"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Changes when what cached() keeps is built otherwise.
VERSION = 3


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; a temporary folder only where that is unset in local
    mode (tests)."""
    return f"{_base(spark)}/{name}-{uuid.uuid4().hex}"


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="panelyard-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base.rstrip("/")


def fingerprint(spark: SparkSession, inputs: list[str]) -> str:
    """A hash of the inputs' files: their paths, sizes and times of change."""
    facts = [str(VERSION)]
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, inputs):
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        facts += sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files)
    return hashlib.sha256("\n".join(facts).encode()).hexdigest()[:24]


def cached(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """What build gives, as a table that is written once for each state of the input files. It is
    written beside its place and moved there, so a table in its place is whole."""
    place = f"{_base(spark)}/{name}-{fingerprint(spark, inputs)}"
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        beside = f"{place}-{uuid.uuid4().hex}"
        build().write.parquet(beside)
        if not files.exists(path) and not files.rename(spark._jvm.org.apache.hadoop.fs.Path(beside), path) and not files.exists(path):
            raise OSError(f"{beside} can't be moved to {place}")
    return spark.read.parquet(place)
