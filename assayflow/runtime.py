"""Lets Python workers import this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def ship() -> None:
    """Put the package's folder on the workers' path, as the driver has it; a cluster may instead have
    the package installed or get it with --py-files."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
