"""Tables in the folder all executors share, and batches of documents."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder, spark.checkpoint.dir; where that is unset, a local one if Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:/tmp/checkpoints"
    path = f"{root.rstrip('/')}/corpus-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a table that ``written`` made and nothing reads any more."""
    spark = df.sparkSession
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        if "/corpus-" in path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs, which it does when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            jvm = spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session has ended; the folder is the cluster's to clear
            return


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def batched(docs: DataFrame, per_partition: int = 1) -> DataFrame:
    """doc_id, text and ``src``, the batch a row belongs to by its hash: even, whatever keys or copies there are.

    Several passes of one query over the batches share one exchange of the text.
    """
    n = per_partition * partitions(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), F.lit(n)).cast("int").alias("src"),
    )
