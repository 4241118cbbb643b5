"""Continuous ingest of new files: the stateless reports of :mod:`ashlar.operators.inspect` over a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import family_of, format_of
from ..operators.stats import entropy_udf

FILES = "path string, modificationTime timestamp, length long, content binary"


def formats(spark: SparkSession, root: str) -> DataFrame:
    """A streaming row for each new file below ``root``: path, length, format, family, entropy."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(root)
    return files.select("path", "modificationTime", "length", format_of(F.col("content")).alias("format"), family_of(F.col("content")).alias("family"), entropy_udf()(F.col("content")).alias("entropy"))


def run_once(rows: DataFrame, table: str, checkpoint: str) -> None:
    """Take in what has come since the last run, and stop. Files that were taken in are never read again."""
    rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def counts(rows: DataFrame) -> DataFrame:
    """Files of each format in windows of an hour by modification time; late ones are waited for a day."""
    return rows.withWatermark("modificationTime", "1 day").groupBy(F.window("modificationTime", "1 hour"), "format").agg(F.count(F.lit(1)).alias("n"))
