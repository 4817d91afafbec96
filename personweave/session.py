"""What Python workers need."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> None:
    """Lets Python workers of a local session import this package; a cluster gets it by --py-files."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    have = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
