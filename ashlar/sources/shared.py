"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``. Where that is unset: below the warehouse on a cluster; in local mode
    in a temporary folder, which goes when the driver ends."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local["):
        base = tempfile.mkdtemp(prefix="ashlar-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{(base or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/ashlar-{uuid.uuid4().hex}"


def stored(df: DataFrame, at: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet and read it back: lineage ends here, and lost executors lose nothing."""
    at = at or shared_dir(df.sparkSession)
    df.write.mode("overwrite").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
