"""What the operators of this folder share: the shared folder, written tables, distributed prefix sums."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Words of op1 and op8: runs of anything but these six ASCII characters.
SPACES = "\\x20\\x09-\\x0D"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``. Where that is unset: below the warehouse on a cluster; in local mode,
    as in tests, in a temporary folder, which goes when the driver ends."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local["):
        base = tempfile.mkdtemp(prefix="ashlar-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    _MADE.append(f"{(base or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/ashlar-{uuid.uuid4().hex}")
    return _MADE[-1]


#: Folders of this driver, in the order in which they were asked for.
_MADE: list[str] = []


def made() -> int:
    """How many folders there are so far."""
    return len(_MADE)


def sweep(spark: SparkSession, since: int) -> None:
    """Delete the folders that were asked for after the first ``since``: what was read from them must have been written elsewhere."""
    while len(_MADE) > since:
        discard(spark, _MADE.pop())


def ship(spark: SparkSession) -> None:
    """Let Python workers that are started from now on import this package from where the driver has it.

    Batches of rows for them are kept small, as texts may be long: a worker holds a batch at a time. (Where the session was
    started with other sizes, these stay.) Workers are used
    again by later tasks, so their allocators are set to give large blocks back when they are freed.
    """
    for name, value in (("maxRecordsPerBatch", "1000"), ("maxBytesPerBatch", str(8 << 20))):
        if f"spark.sql.execution.arrow.{name}" not in _chosen(spark):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", value)
    env = spark.sparkContext.environment
    for name, value in (("ARROW_DEFAULT_MEMORY_POOL", "system"), ("MALLOC_ARENA_MAX", "2"), ("MALLOC_MMAP_THRESHOLD_", str(4 << 20)), ("MALLOC_TRIM_THRESHOLD_", str(16 << 20))):
        env.setdefault(name, value)
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO not in parts:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *parts])


def _chosen(spark: SparkSession) -> set[str]:
    """Settings that the session was started with."""
    return {name for name, _ in spark.sparkContext.getConf().getAll()}


def stored(df: DataFrame, at: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet at ``at`` (in the shared folder) and read it back: lineage ends here."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def discard(spark: SparkSession, at: str) -> None:
    """Delete a folder through Spark's file system layer."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Ask the driver's JVM to collect garbage, on which Spark deletes shuffle files that no plan can reach."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def release() -> None:
    """Give memory that a task of a Python worker no longer holds back to the system: workers are used again."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prefix_sums(df: DataFrame, order: list[Column], value: str, into: str, at: str, group: str | None = None) -> DataFrame:
    """Add ``into``: the sum of ``value`` over the rows before, in ``order`` (within ``group`` if given).

    Range-partitioned: rows are dealt out in order and written, each partition is summed, the sums of earlier
    partitions (a row for each partition, or for each partition and group that it holds) are added. No task sees
    more than its range, however many rows one group has. ``order`` must start with the group and is total up to rows
    that are equal in all of it.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("_part", F.spark_partition_id()), at)
    own = Window.partitionBy("_part", *([group] if group else [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_part", *([group] if group else [])).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group if group else F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_part").alias("_p"), *([F.col(group).alias("_g")] if group else []), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    keys = F.col("_part") == F.col("_p")
    if group:
        keys = keys & F.col(group).eqNullSafe(F.col("_g"))
    out = ranged.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0))).join(sums, keys, "left")
    return out.withColumn(into, (F.col("_own") + F.col("_before")).cast("long")).drop("_own", "_before", "_part", "_p", "_g")
