"""A folder for written tables that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def working_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; under an own folder only where that is unset and Spark runs within one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/trailmark-{name}-{uuid.uuid4().hex}"


def tasks(spark: SparkSession) -> int:
    """Partitions for work that is more than the bytes it starts from tell (small tables whose product is large), so that all cores have a part of it."""
    return 4 * max(spark.sparkContext.defaultParallelism, 2)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: what follows starts from it, not from the whole plan again."""
    path = working_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
