"""One object over the tables of a space, with the questions and writes of the store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistema.operators import fold, graph, pack, redact, temporal
from epistema.operators import relational as rel
from epistema.plans import rebuild, retrieval
from epistema.schema import ontology


@dataclass
class Engine:
    """log: declarations; episodes, surfaces: see the operators. Reads are DataFrames; writes give a new engine."""

    spark: SparkSession
    log: DataFrame
    episodes: DataFrame
    surfaces: DataFrame

    def __post_init__(self) -> None:
        self.truth = rebuild.rebuild(self.log, ontology(self.spark))

    @property
    def beliefs(self) -> DataFrame:
        objects = self.truth.assertions.select("statement_id", "object").distinct()
        return self.truth.beliefs.join(objects, "statement_id")

    def declare(self, rows: DataFrame) -> Engine:
        return Engine(self.spark, self.log.unionByName(rows), self.episodes, self.surfaces)

    def remember(self, rows: DataFrame) -> Engine:
        return Engine(self.spark, self.log, self.episodes.unionByName(rows), self.surfaces)

    def as_of(self, valid: int, known: int) -> DataFrame:
        return temporal.beliefs_as_of(self.truth.assertions, self.truth.ontology, valid, known)

    def entity(self, name: str) -> DataFrame:
        """Beliefs of an entity's whole group, by any name of it."""
        asked = self.spark.createDataFrame([(name,)], "entity_id string")
        return temporal.beliefs_of(asked, self.beliefs, self.truth.merges).drop("entity_id")

    def timeline(self, name: str, a: int, b: int) -> DataFrame:
        return temporal.timeline(self.truth.beliefs, self.truth.assertions, name, a, b)

    def difference(self, a: int, b: int) -> DataFrame:
        return temporal.difference(self.truth.beliefs, a, b)

    def why(self, statement: str) -> DataFrame:
        return temporal.why(self.truth.beliefs, self.truth.assertions).filter(F.col("statement_id") == statement)

    def contradictions(self) -> DataFrame:
        return temporal.contradictions(self.truth.beliefs, self.truth.assertions)

    def edges(self, valid: int | None = None, floor: float = 0.0) -> DataFrame:
        b = self.beliefs.filter(F.col("status").isin("active", "superseded") & rel.confident(floor))
        b = b.filter(rel.valid_at(valid)) if valid is not None else b
        return b.select(F.col("subject_id").alias("src"), F.col("object").alias("dst"), "predicate", "statement_id").distinct()

    def traverse(self, seeds: list[str], depth: int = 2, direction: str = "both", most: int = 256, now: int = 0, day: int = 86_400_000_000) -> tuple[DataFrame, DataFrame, bool]:
        """Nodes with depth and salience (that of the last activity as a subject, at ``now``), edges looked at, and whether ``most`` nodes ended the walk."""
        nodes, edges, truncated = graph.bounded(self.edges(), self.spark.createDataFrame([(s,) for s in seeds], "node string"), depth, most, direction)
        active = pack.decay(self.truth.assertions, now, day).select(F.col("subject_id").alias("node"), "salience")
        return nodes.join(active, "node", "left").fillna(0.5, "salience"), edges, truncated

    def search(self, query: str, spec: retrieval.Spec | None = None) -> DataFrame:
        docs = rebuild.indexed(self.episodes, self.beliefs, self.surfaces)
        return retrieval.search(retrieval.Corpus(docs, self.edges(), facts=retrieval.facts(self.truth.beliefs, self.truth.assertions)), query, spec)

    def brief(self) -> DataFrame:
        return pack.entity_brief(self.beliefs, self.surfaces)

    def navigate(self, link: str) -> DataFrame:
        return self.brief().filter(F.col("subject_id") == link.rsplit("/", 1)[-1])

    def stats(self) -> DataFrame:
        b = self.truth.beliefs
        return b.agg(F.countDistinct("statement_id").alias("statements"), F.countDistinct("subject_id").alias("entities"), F.countDistinct(F.when(F.col("status") == "contradicted", F.col("statement_id"))).alias("contradicted"))

    def redact(self, episodes: DataFrame | None = None, entity: str | None = None, predicate: str | None = None) -> tuple[DataFrame, DataFrame]:
        closed = redact.closure(self.truth.assertions, episodes, entity, predicate)
        return redact.execute(self.truth.assertions, self.truth.beliefs, self.truth.ontology, closed)

    def refold(self, touched: DataFrame) -> DataFrame:
        return fold.refold(self.truth.beliefs, self.truth.assertions, touched, self.truth.ontology)
