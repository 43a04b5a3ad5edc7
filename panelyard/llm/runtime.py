"""What the operators share: the folder for written intermediate tables, and batch sizes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 1024
BATCH_BYTES = 8 << 20
#: Paths of the tables that written() made, in order.
_PATHS: list[str] = []


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a run of very long texts fits a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    except Exception:  # a release without that setting
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Only where it is
    unset in local mode (tests in one JVM) a temporary one is made and removed at exit."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="panelyard-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and outlives lost executors."""
    path = table_path(df.sparkSession, name)
    _PATHS.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path) -> None:
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def removed(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more, and let Spark clean their shuffles."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            _delete(spark, spark._jvm.org.apache.hadoop.fs.Path(file).getParent())
    swept(spark)


def tables_so_far() -> int:
    return len(_PATHS)


def removed_since(spark: SparkSession, mark: int, keep: int = 1) -> None:
    """Delete the tables written after tables_so_far() gave mark, but for the last keep of them."""
    for path in _PATHS[mark : len(_PATHS) - keep]:
        _delete(spark, spark._jvm.org.apache.hadoop.fs.Path(path))
    del _PATHS[mark : len(_PATHS) - keep]
    swept(spark)


def settled() -> None:
    """At the end of a task: give freed memory back. Python workers live on, and what they hold
    counts beside the next task's needs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def swept(spark: SparkSession) -> None:
    """Shuffle files go once their plans are garbage on both sides of the gateway."""
    gc.collect()
    spark._jvm.System.gc()


def width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
