"""What a session needs so that Python workers find this package."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import the package from where the driver did.

    On a cluster whose machines do not share that folder, install the package or pass it with ``--py-files``.
    """
    env = spark.sparkContext.environment
    have = [x for x in env.get("PYTHONPATH", "").split(":") if x]
    if ROOT not in have:
        env["PYTHONPATH"] = ":".join([*have, ROOT])
    return spark
