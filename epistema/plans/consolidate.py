"""Derived episodes of clusters of episodes, made once for each set of members.

A cluster is a component of episodes that support the same statements. Its key is a fingerprint of its member set, which
is an aggregate, so no cluster's members are gathered. A run makes derived episodes for sets without one, links each to its members, and
is done once its row in ``runs`` is written, last; what a broken run wrote is not read, and the next run makes it again. That row holds a
fingerprint of the links between episodes: equal links have equal clusters, so a later run of the extractor that finds them has nothing to make.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epistema.functions.scalars import content_id
from epistema.operators import graph, temporal
from epistema.operators import relational as rel
from epistema.plans.storage import exists, settled

DERIVED = "episode_id string, extractor_id string, fingerprint string, text string, n_members long, uncertainty double, made_at long, run string"
LINKS = "from_episode string, to_episode string, rel string, run string"
RUNS = "run string, extractor_id string, links string"
DAY = 86_400_000_000


def fingerprint(member: Column) -> Column:
    """Aggregate over a group's members, whatever their order; members must be distinct."""
    text = member.cast("string")
    return F.sha2(F.concat_ws("|", F.lit("members"), F.count("*").cast("string"), F.sum(F.xxhash64(text).cast("decimal(20,0)")).cast("string"), F.bit_xor(F.xxhash64(text, F.lit(1))).cast("string")), 256)


class Consolidation:
    """Derived episodes and links below ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _held(self, name: str, schema: str) -> DataFrame:
        if not exists(self.spark, f"{self.root}/runs"):
            return self.spark.createDataFrame([], schema)
        if not exists(self.spark, f"{self.root}/{name}"):  # all runs found nothing to make
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").join(F.broadcast(self._runs().select("run")), "run", "left_semi")  # a row a run

    def _runs(self) -> DataFrame:
        if not exists(self.spark, f"{self.root}/runs"):
            return self.spark.createDataFrame([], RUNS)
        return self.spark.read.schema(RUNS).parquet(f"{self.root}/runs")

    def _done(self, run: str, extractor: str, links: str) -> None:
        self.spark.createDataFrame([(run, extractor, links)], RUNS).coalesce(1).write.mode("append").parquet(f"{self.root}/runs")

    def derived(self) -> DataFrame:
        return self._held("derived", DERIVED).drop("run")

    def links(self) -> DataFrame:
        """from_episode (derived), to_episode (member), rel."""
        return self._held("links", LINKS).drop("run")

    def run(self, assertions: DataFrame, episodes: DataFrame, beliefs: DataFrame, extractor: str, now: int, quoted: int = 5, sentences: int = 1) -> int:
        """Makes what is missing and returns how many derived episodes that are.

        The text of a cluster is the first sentences of its ``quoted`` least members. Its uncertainty is that of the beliefs about entities that two or more of its
        members speak of, with the age of their oldest member.
        """
        supported, run = settled(rel.support_links(assertions)), uuid.uuid4().hex
        seen = supported.agg(F.concat_ws("|", F.count("*").cast("string"), *(F.bit_xor(F.xxhash64("u", "v", F.lit(i))).cast("string") for i in range(2)))).first()[0]
        if self._runs().filter((F.col("extractor_id") == extractor) & (F.col("links") == seen)).limit(1).count():
            return 0
        member = settled(graph.components(supported, written=True).withColumnsRenamed({"id": "episode_id", "component": "cluster"}))
        sets = member.groupBy("cluster").agg(fingerprint(F.col("episode_id")).alias("fingerprint"), F.count("*").alias("n_members")).filter("n_members >= 2")
        done = self.derived().filter(F.col("extractor_id") == extractor).select("fingerprint")
        pending = settled(sets.join(done, "fingerprint", "left_anti"))
        made = pending.count()
        if not made:
            self._done(run, extractor, seen)
            return 0
        member = settled(member.join(pending.select("cluster"), "cluster", "left_semi"))
        order = Window.partitionBy("cluster").orderBy("episode_id")
        heads = member.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= quoted)
        lead = F.array_join(F.slice(F.split("content", r"(?<=[.!?。])\s+"), 1, sentences), " ")
        texts = heads.join(episodes.select("episode_id", "content"), "episode_id").select("cluster", F.struct("r", lead.alias("lead")).alias("x"))
        texts = texts.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["lead"]), "\n").alias("text"))  # at most ``quoted``
        spoke = assertions.join(member, "episode_id").select("cluster", F.explode(F.array("subject_id", "object")).alias("entity"), "episode_id")
        shared = spoke.groupBy("cluster", "entity").agg(F.min("episode_id").alias("a"), F.max("episode_id").alias("b")).filter("a <> b").select("cluster", F.col("entity").alias("subject_id"))
        ages = member.join(episodes.select("episode_id", "ingested_at"), "episode_id").groupBy("cluster").agg(F.greatest(F.lit(0.0), (F.lit(now) - F.min("ingested_at")) / float(DAY)).alias("age_days"))
        doubt = temporal.uncertainty(shared.join(beliefs, "subject_id"), ages, "cluster").select("cluster", "uncertainty")
        ident = content_id("derived", F.lit(extractor), F.col("fingerprint"))
        rows = pending.join(texts, "cluster", "left").join(doubt, "cluster", "left")
        rows.select(ident.alias("episode_id"), F.lit(extractor).alias("extractor_id"), "fingerprint", F.coalesce("text", F.lit("")).alias("text"), "n_members", F.coalesce("uncertainty", F.lit(0.0)).alias("uncertainty"), F.lit(now).cast("long").alias("made_at"), F.lit(run).alias("run")).write.mode("append").parquet(f"{self.root}/derived")
        links = member.join(pending.select("cluster", "fingerprint"), "cluster")
        links.select(ident.alias("from_episode"), F.col("episode_id").cast("string").alias("to_episode"), F.lit("summarizes").alias("rel"), F.lit(run).alias("run")).write.mode("append").parquet(f"{self.root}/links")
        self._done(run, extractor, seen)
        return made
