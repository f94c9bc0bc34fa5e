"""Hybrid retrieval and contexts for a table of questions.

All questions go through each channel together: the kept index is read once for the terms of all, walks and
communities carry the question with each row, and ranks, filters and budgets are windows of a question. What grows with
the data is read by term, by node or by candidate; what grows with the questions is limited for each by ``limit``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epistema.functions import scalars as sc
from epistema.operators import graph, pack, rank, text
from epistema.plans.index import Index
from epistema.plans.storage import settled
from epistema.schema import TIME_MAX, TIME_MIN

CHANNELS = {
    "lexical": ("word", "trigram"),
    "lexical_vector": ("word", "trigram", "tfidf"),
    "dense": ("dense",),
    "graph": ("graph",),
    "community": ("community",),
    "hybrid": ("word", "trigram", "tfidf", "dense", "graph", "community"),
}


@dataclass
class Base:
    """What is searched. index: of (kind, id, text) with vectors fitted; statements (statement_id, subject_id, predicate, object, entity: whether the object is one);
    beliefs as the fold gives them; entities (entity_id, type, surface, salience); episodes (episode_id, content, kind, ingested_at, redacted_at);
    assertions; communities (node, label); vectors (id, embedding) of entities; ontology.
    """

    index: Index
    statements: DataFrame
    beliefs: DataFrame
    entities: DataFrame
    episodes: DataFrame
    assertions: DataFrame
    ontology: DataFrame
    communities: DataFrame | None = None
    vectors: DataFrame | None = None

    def edges(self) -> DataFrame:
        """Edges between entities whose statement has an active or superseded belief, or none at all."""
        known = self.beliefs.groupBy("statement_id").agg(F.max(F.col("status").isin("active", "superseded")).alias("good"))
        rows = self.statements.filter("entity").join(known, "statement_id", "left").filter("good is null or good")
        return rows.select(F.col("subject_id").alias("src"), F.col("object").alias("dst"), "predicate", "statement_id")


@dataclass
class Asked:
    """How questions are answered. filters: arguments of ``rank.drop_reason``."""

    mode: str = "hybrid"
    limit: int = 20
    fusion: str = "rrf"
    weights: dict[str, float] | None = None
    filters: dict = field(default_factory=dict)
    corroborate: bool = True


def _top(hits: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "kind", "id")
    return hits.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= n).drop("__r")


def channels(base: Base, questions: DataFrame, asked: Asked) -> DataFrame:
    """query, channel, kind, id, score for questions (query, text and, for dense, embedding): four times the limit of each channel.

    Seeds of graph and community are the entities among the first limit / 2 word hits. The graph gives entities within two steps, in
    a budget of 2 * limit nodes, and the statements of the edges walked; the communities give the seeds' fellow members. Seeds keep their score.
    """
    wanted, most = CHANNELS[asked.mode], max(4 * asked.limit, asked.limit)
    of = lambda df, channel: df.select("query", F.lit(channel).alias("channel"), "kind", F.col("id").cast("string").alias("id"), F.col("score").cast("double").alias("score"))
    out, word = [], None
    if {"word", "graph", "community"} & set(wanted):
        word = settled(_top(base.index.search(questions, "word"), most))
    if "word" in wanted:
        out.append(of(word, "word"))
    if "trigram" in wanted:
        out.append(of(_top(base.index.search(questions, "gram"), most), "trigram"))
    if "tfidf" in wanted:
        out.append(of(_top(base.index.similar(questions), most), "tfidf"))
    if "dense" in wanted and base.vectors is not None and "embedding" in questions.columns:
        near = text.nearest_all(base.vectors, questions.filter("embedding is not null").select("query", "embedding"), most)
        out.append(of(near.withColumn("kind", F.lit("entity")), "dense"))
    elif asked.mode == "dense":
        raise ValueError("dense retrieval needs vectors and questions with an embedding")
    if "graph" in wanted or ("community" in wanted and base.communities is not None):
        seeds = settled(_top(word, max(1, asked.limit // 2)).filter("kind = 'entity'"))
        own = seeds.select("query", "kind", "id", "score")
        if "graph" in wanted:
            found = graph.walks(base.edges(), seeds.select("query", F.col("id").alias("node")), 2, 2 * asked.limit)
            nodes = found.nodes.filter("depth > 0").select("query", F.lit("entity").alias("kind"), F.col("node").alias("id"), F.lit(0.5).alias("score"))
            told = found.edges.select("query", F.lit("statement").alias("kind"), F.col("statement_id").alias("id"), F.lit(0.4).alias("score")).distinct()
            out += [of(x, "graph") for x in (nodes, told, own)]
        if "community" in wanted and base.communities is not None:
            at = base.communities.select(F.col("node").alias("id"), "label")
            labels = seeds.join(at, "id").select("query", "label").distinct()
            fellows = labels.join(at, "label").join(own.select("query", "id"), ["query", "id"], "left_anti")
            out += [of(x, "community") for x in (fellows.select("query", F.lit("entity").alias("kind"), "id", F.lit(0.4).alias("score")), own)]
    return rank.channel_ranks(reduce(DataFrame.unionByName, out), most)


def facts(base: Base, candidates: DataFrame) -> DataFrame:
    """What filters and reranking ask of each candidate (kind, id).

    Statements: the latest belief, the best trust of its support, and when it was recorded. Entities and episodes: from their statements,
    those of an entity as subject or object, those that an episode supports: trust and distinct episodes of all of them; their time is open, their
    confidence 1, they have no predicate, and an entity has its type and salience. Predicate filters concern statements, type filters entities.
    """
    kinds = candidates.select("kind", "id").distinct()
    of = lambda kind: kinds.filter(F.col("kind") == kind)
    tier = lambda n, s: F.when(F.sum(n) > 0, "trusted").when(F.sum(s) > 0, "semi_trusted").otherwise("untrusted")
    now = settled(base.beliefs.groupBy("statement_id").agg(F.max_by(F.struct("confidence", "valid_from", "valid_to", "status", "distinct_episodes", "n_trusted", "n_semi_trusted"), "valid_from").alias("b")).select("statement_id", "b.*"))
    made = base.assertions.groupBy("statement_id").agg(F.max("recorded_at").alias("recorded_at"), F.max("retracted_at").alias("retracted_at"))
    told = of("statement").join(base.statements.select(F.col("statement_id").alias("id"), "predicate"), "id").join(now.withColumnRenamed("statement_id", "id"), "id", "left").join(made.withColumnRenamed("statement_id", "id"), "id", "left")
    told = told.select("kind", "id", "predicate", F.lit(None).cast("string").alias("entity_type"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("valid_from", F.lit(TIME_MIN)).alias("valid_from"), F.coalesce("valid_to", F.lit(TIME_MAX)).alias("valid_to"), F.coalesce("recorded_at", F.lit(0)).alias("recorded_at"), "retracted_at",
                       F.when(F.col("n_trusted") > 0, "trusted").when(F.col("n_semi_trusted") > 0, "semi_trusted").otherwise("untrusted").alias("trust"), F.coalesce("distinct_episodes", F.lit(0)).cast("long").alias("distinct_episodes"), F.lit(0.5).alias("salience"))
    touched = base.statements.select(F.col("subject_id").alias("id"), "statement_id").unionByName(base.statements.filter("entity").select(F.col("object").alias("id"), "statement_id"))
    held = base.assertions.select(F.col("episode_id").cast("string").alias("id"), "statement_id")
    rest = []
    for kind, links in (("entity", touched), ("episode", held)):
        own = of(kind).join(links.distinct(), "id")
        trust = own.join(now, "statement_id").groupBy("id").agg(tier("n_trusted", "n_semi_trusted").alias("trust"))
        spoke = own.join(base.assertions.select("statement_id", "episode_id").distinct(), "statement_id").groupBy("id").agg(F.countDistinct("episode_id").alias("distinct_episodes"))
        rest.append(of(kind).join(trust, "id", "left").join(spoke, "id", "left"))
    both = rest[0].unionByName(rest[1]).join(base.entities.select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), F.col("type").alias("entity_type"), "salience"), ["kind", "id"], "left")
    both = both.select("kind", "id", F.lit(None).cast("string").alias("predicate"), "entity_type", F.lit(1.0).alias("confidence"), F.lit(TIME_MIN).alias("valid_from"), F.lit(TIME_MAX).alias("valid_to"), F.lit(TIME_MIN).alias("recorded_at"), F.lit(None).cast("long").alias("retracted_at"), F.coalesce("trust", F.lit("trusted")).alias("trust"), F.coalesce("distinct_episodes", F.lit(0)).alias("distinct_episodes"), F.when(F.col("kind") == "episode", 1.0).otherwise(F.col("salience")).alias("salience"))
    return told.unionByName(both)


def search(base: Base, questions: DataFrame, asked: Asked | None = None) -> DataFrame:
    """Every candidate of each question with its fused score, order, and why it was dropped (null: kept)."""
    asked = asked or Asked()
    ranked = settled(channels(base, questions, asked))
    fused = {"rrf": rank.rrf, "compatible": rank.rrf_compatible}.get(asked.fusion, lambda r: rank.weighted(r, asked.weights))(ranked)
    fused = fused.join(facts(base, ranked), ["kind", "id"], "left").withColumn("distinct_episodes", F.coalesce("distinct_episodes", F.lit(0)))
    fused = fused.withColumn("drop_reason", rank.drop_reason(**asked.filters) if asked.filters else F.lit(None).cast("string"))
    fused = settled(rank.corroborated(fused) if asked.corroborate else fused)
    kept = rank.truncated(rank.final_order(fused.filter("drop_reason is null")).drop("drop_reason"), asked.limit)
    gone = fused.filter("drop_reason is not null").withColumn("final_order", F.lit(None).cast("int"))
    return kept.unionByName(gone.select(kept.columns))


def _first(df: DataFrame, n: int, *order: Column | str, keys: tuple[str, ...] = ("query",)) -> DataFrame:
    """The first n rows of each key, with their position."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).filter(F.col("position") < n)


def lines(base: Base, questions: DataFrame, asked: Asked | None = None) -> DataFrame:
    """context_id (the query), layer, position, line: what ``pack.packed`` chooses from, for questions (query, text, broad: whether 20 recent episodes count, else 5).

    Profile: the 30 surest active beliefs of 0.5 or more whose predicate is marked for it; the same for all questions, as are recent episodes and
    summaries. Beliefs: those of the statements among the first 10 candidates. Neighbourhood: up to 30 edges at the first 5 entities. Summaries name their source.
    """
    asked = asked or Asked(limit=10)
    found = search(base, questions, asked).filter("drop_reason is null")
    name = base.entities.select("entity_id", "surface", "type")
    subject = name.select(F.col("entity_id").alias("subject_id"), F.col("surface").alias("s"), F.col("type").alias("t"))
    obj = name.select(F.col("entity_id").alias("object"), F.col("surface").alias("o"))
    label = lambda df: df.join(subject, "subject_id", "left").join(obj, "object", "left").withColumn("s", F.coalesce("s", "subject_id")).withColumn("o", F.coalesce("o", "object"))
    said = base.beliefs.select("statement_id", "valid_from", "valid_to", "status", "confidence", "distinct_episodes").join(base.statements.select("statement_id", "subject_id", "predicate", "object"), "statement_id")
    when = F.when(sc.validity(F.col("valid_from"), F.col("valid_to")) == "open", "").otherwise(F.concat(F.lit(" ["), sc.validity(F.col("valid_from"), F.col("valid_to")), F.lit("]")))

    marked = base.ontology.filter("profile").select(F.col("name").alias("predicate"))
    profile = said.filter("status = 'active' and confidence >= 0.5").join(F.broadcast(marked), "predicate").orderBy(F.desc("confidence"), "statement_id", "valid_from").limit(30)
    profile = label(profile).select(F.lit("profile").alias("layer"), F.concat("s", F.lit(" "), "predicate", F.lit(": "), "o", when).alias("line"), (-F.col("confidence")).alias("k1"), F.concat_ws("|", "statement_id", F.col("valid_from").cast("string")).alias("k2"))

    recent = base.episodes.filter("redacted_at is null and content <> ''")
    asks = questions.select("query", F.coalesce("broad", F.lit(False)).alias("broad") if "broad" in questions.columns else F.lit(False).alias("broad"))
    episodes = recent.orderBy(F.desc("ingested_at"), "episode_id").limit(20)
    episodes = episodes.select(F.lit("episodes").alias("layer"), F.col("content").alias("line"), (-F.col("ingested_at")).cast("double").alias("k1"), F.col("episode_id").cast("string").alias("k2"))
    summaries = recent.filter("kind = 'derived'").orderBy(F.desc("ingested_at"), "episode_id").limit(5)
    summaries = summaries.select(F.lit("summaries").alias("layer"), F.concat("content", F.lit("\n  sources: "), F.col("episode_id").cast("string")).alias("line"), (-F.col("ingested_at")).cast("double").alias("k1"), F.col("episode_id").cast("string").alias("k2"))
    # at most 55 rows that every question gets
    shared = settled(reduce(DataFrame.unionByName, [profile, episodes, summaries]))
    shared = shared.withColumn("position", F.row_number().over(Window.partitionBy("layer").orderBy("k1", "k2")) - 1)
    shared = asks.join(F.broadcast(shared), (F.col("layer") != "episodes") | F.col("broad") | (F.col("position") < 5)).select(F.col("query").alias("context_id"), "layer", "position", "line")

    top = found.filter("kind = 'statement'").select("query", F.col("id").alias("statement_id"), "final_order")
    now = said.groupBy("statement_id").agg(F.max_by(F.struct("subject_id", "predicate", "object", "valid_from", "valid_to", "status", "confidence", "distinct_episodes"), "valid_from").alias("b")).select("statement_id", "b.*")
    beliefs = label(top.join(now, "statement_id"))
    line = F.concat("s", F.lit(" "), "predicate", F.lit(" "), "o", when, F.lit(" ("), "status", F.lit(", "), F.format_number("confidence", 2), F.lit(", "), F.col("distinct_episodes").cast("string"), F.lit(" episodes)"))
    beliefs = beliefs.select(F.col("query").alias("context_id"), F.lit("beliefs").alias("layer"), F.col("final_order").alias("position"), line.alias("line"))

    near = _first(found.filter("kind = 'entity'"), 5, "final_order").select("query", F.col("id").alias("node"))
    told = base.statements.filter("entity").join(now.filter("status in ('active', 'superseded')").select("statement_id", "confidence"), "statement_id")
    edges = near.join(told, (F.col("node") == F.col("subject_id"))).unionByName(near.join(told, F.col("node") == F.col("object"))).drop("node").distinct()
    edges = _first(edges, 30, F.desc("confidence"), "statement_id")
    edges = edges.select(F.col("query").alias("context_id"), F.lit("neighborhood").alias("layer"), "position", F.concat("subject_id", F.lit(" -["), "predicate", F.lit("]-> "), "object", F.lit(" ("), F.format_number("confidence", 2), F.lit(")")).alias("line"))
    return reduce(DataFrame.unionByName, [x.withColumn("position", F.col("position").cast("long")) for x in (shared, beliefs, edges)])


def contexts(base: Base, questions: DataFrame, budget: int, asked: Asked | None = None) -> DataFrame:
    """context_id, layer, position, line, tokens: the context of each question within a budget of tokens."""
    return pack.packed(settled(lines(base, questions, asked)), budget)
