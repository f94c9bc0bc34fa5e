"""Assertions that arrive as a stream: once each, and folding of the groups they touch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistema.operators import fold
from epistema.plans.storage import exists


def once(stream: DataFrame, key: str = "assertion_id", delay: str = "1 hour", time: str = "arrived") -> DataFrame:
    """Without rows delivered again within ``delay``; later ones are met by ``append``."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def append(held: DataFrame, batch: DataFrame, key: str = "assertion_id") -> DataFrame:
    return batch.dropDuplicates([key]).join(held.select(key), key, "left_anti")


def run(stream: DataFrame, folder: str, ontology: DataFrame, checkpoint: str, available: bool = True):
    """Appends each batch to <folder>/assertions and writes a new version of beliefs with the touched groups folded again.

    A batch that is run again after a failure finds its rows there and adds none. The version is named in
    <folder>/current, written last.
    """
    spark = stream.sparkSession
    schema = stream.drop("arrived").schema

    def held() -> DataFrame:
        return spark.read.schema(schema).parquet(f"{folder}/assertions") if exists(spark, f"{folder}/assertions") else spark.createDataFrame([], schema)

    def each(batch: DataFrame, number: int) -> None:
        fresh = append(held(), batch.select(schema.names))
        fresh.write.mode("overwrite").parquet(f"{folder}/batches/{number}")
        fresh = spark.read.schema(schema).parquet(f"{folder}/batches/{number}")
        fresh.write.mode("append").parquet(f"{folder}/assertions")
        touched = batch.select("subject_id", "predicate").distinct()
        name = version(spark, folder)
        old = spark.read.parquet(f"{folder}/{name}") if name else fold.fold(spark.createDataFrame([], schema), ontology)
        new = f"beliefs-{number}-{uuid.uuid4().hex}"
        fold.refold(old, held(), touched, ontology).write.parquet(f"{folder}/{new}")
        spark.createDataFrame([(number, new)], "number long, name string").coalesce(1).write.mode("append").parquet(f"{folder}/current")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available else writer.trigger(processingTime="2 seconds")).start()


def version(spark: SparkSession, folder: str) -> str | None:
    if not exists(spark, f"{folder}/current"):
        return None
    return spark.read.parquet(f"{folder}/current").agg(F.max_by("name", "number")).first()[0]
