"""Redaction: what goes with an episode, an entity, or an entity's predicate, and folding again without it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistema.operators import fold as folding
from epistema.operators import relational as rel


def closure(assertions: DataFrame, episodes: DataFrame | None = None, entity: str | None = None, predicate: str | None = None) -> DataFrame:
    """(kind, id) of all that is redacted: assertions, and statements that nothing else supports."""
    if episodes is not None:
        gone = assertions.join(episodes.select("episode_id").distinct(), "episode_id", "left_semi")
    else:
        hit = (F.col("subject_id") == entity) | (F.col("object") == entity)
        gone = assertions.filter(hit & (F.col("predicate") == predicate) if predicate else hit)
    ids = gone.select("assertion_id")
    rest = assertions.join(ids, "assertion_id", "left_anti").select("statement_id").distinct()
    lone = gone.select("statement_id").distinct().join(rest, "statement_id", "left_anti")
    return ids.select(F.lit("assertion").alias("kind"), F.col("assertion_id").cast("string").alias("id")).unionByName(lone.select(F.lit("statement").alias("kind"), F.col("statement_id").alias("id")))


def execute(assertions: DataFrame, beliefs: DataFrame, ontology: DataFrame, closed: DataFrame, at: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Assertions without the closure, and beliefs with the groups it touches folded again."""
    ids = closed.filter("kind = 'assertion'").select("id")
    gone = assertions.join(ids, F.col("assertion_id").cast("string") == F.col("id"), "left_semi")
    left = assertions.join(ids, F.col("assertion_id").cast("string") == F.col("id"), "left_anti")
    return left, folding.refold(beliefs, left, gone.select("subject_id", "predicate"), ontology, at)


def tombstones(episodes: DataFrame, redacted: DataFrame, now: int) -> DataFrame:
    marked = episodes.join(redacted.select("episode_id").distinct().withColumn("__gone", F.lit(True)), "episode_id", "left")
    return marked.withColumn("content", F.when(F.col("__gone"), "[redacted]").otherwise(F.col("content"))).withColumn("redacted_at", F.when(F.col("__gone"), F.lit(now))).drop("__gone")


unsupported = rel.only_supported_by
