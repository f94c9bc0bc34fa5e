"""Steps of iterative plans in the shared folder, which cuts their lineage and survives lost executors."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_root(spark) -> str:
    """spark.checkpoint.dir; where that is unset, a local folder if Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:/tmp/checkpoints"
    return root.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """The table written to the folder of spark.checkpoint.dir and read again."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """The table marked for broadcast if it has at most so many rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def freed(spark) -> None:
    """Lets Spark delete the shuffle files of finished jobs, which it does when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()
