"""Where Python workers find this package."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Let workers that are started from now on import this package from where the driver has it (else ship it with --py-files)."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO not in parts:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *parts])
