"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset and Spark runs within one process (tests), under an own folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else None
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/trailmark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a stable table with no lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def renamed_aside(df: DataFrame, keep: tuple[str, ...], added: tuple[str, ...]) -> DataFrame:
    """Rename columns of df (other than keep) that clash with the names an operator adds, as Spark compares them (without case)."""
    taken = {c.lower() for c in added}
    out = df
    for c in df.columns:
        if c not in keep and c.lower() in taken:
            new, n = f"{c}_in", 1
            while new.lower() in taken or new.lower() in {x.lower() for x in out.columns}:
                n += 1
                new = f"{c}_in{n}"
            out = out.withColumnRenamed(c, new)
    return out
