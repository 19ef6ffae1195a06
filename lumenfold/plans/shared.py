"""Cutting lineage through the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where that is unset and Spark is local."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = sc.getConf().get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            where = "file://" + tempfile.mkdtemp(prefix="lumenfold-")
        sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written once in the shared folder and read again: cuts its lineage without computing it twice."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver ends."""
    root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{root}/{name}"
