"""Hybrid retrieval: channels, facts, fusion, filters, rerank, limit."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epistema.operators import blocks, graph, rank, text
from epistema.plans.storage import settled, small

MODES = {
    "lexical": ("word",),
    "lexical_vector": ("word", "trigram", "tfidf"),
    "dense": ("dense",),
    "graph": ("word", "graph"),
    "community": ("word", "community"),
    "hybrid": ("word", "trigram", "tfidf", "dense", "graph", "community"),
}


@dataclass
class Spec:
    """What to search by, and how to combine it."""

    mode: str = "hybrid"
    fusion: str = "rrf"
    weights: dict[str, float] | None = None
    rerank: tuple[str, ...] = ("corroboration",)
    filters: dict = field(default_factory=dict)
    limit: int = 20
    over: int = 4
    depth: int = 2


@dataclass
class Corpus:
    """Tables to search: documents (kind, id, text), edges (src, dst, predicate), communities (node, label), vectors (id, embedding), facts (kind, id, ...)."""

    documents: DataFrame
    edges: DataFrame | None = None
    communities: DataFrame | None = None
    vectors: DataFrame | None = None
    facts: DataFrame | None = None


def _hits(df: DataFrame, channel: str, query: str) -> DataFrame:
    return df.select(F.lit(query).alias("query"), F.lit(channel).alias("channel"), "kind", F.col("id").cast("string").alias("id"), F.col("score").cast("double").alias("score"))


def _lexical(docs: DataFrame, tokens: Column, terms: list[str], keep: Column | None = None) -> DataFrame:
    """BM25 with the statistics of all documents, whichever of them are hits."""
    keyed = docs.withColumn("__key", F.struct("kind", "id"))
    return text.bm25_of(keyed, tokens, terms, "__key", keep).select("__key.kind", "__key.id", "score")


@dataclass
class Grams:
    """Runs of three characters of all documents: texts as ``blocks.numbered`` gives them, and their blocks, both written once."""

    texts: DataFrame
    held: DataFrame

    def of(self, terms: list[str]) -> DataFrame:
        """term, doc, tf of some terms."""
        return blocks.opened(self.held.filter(F.col("term").isin(*terms)), "term", places=False)

    def bm25(self, terms: list[str], keep: Column) -> DataFrame:
        """kind, id, score of the documents that ``keep`` and hold all terms."""
        sized = self.texts.select("doc", "kind", "id", F.greatest(F.lit(0), F.length("text") - 2).alias("length"), keep.alias("keep"))
        n, mean = sized.agg(F.count("*"), F.avg("length")).first()
        met = self.of(terms)
        df = F.broadcast(met.groupBy("term").agg(F.count("*").alias("df")))  # a row for each term of the query
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (text.K1 + 1) / (F.col("tf") + text.K1 * (1 - text.B + text.B * F.col("length") / (mean or 1.0)))
        scored = met.join(df, "term").join(sized.filter("keep"), "doc").groupBy("doc", "kind", "id").agg(F.count("*").alias("met"), F.round(F.sum(part), 6).alias("score"))
        return scored.filter(F.col("met") == len(terms)).select("kind", "id", "score")

    def cosine(self, terms: list[str]) -> DataFrame:
        """kind, id, score of the TF-IDF vectors of the documents with that of the terms.

        A document's norm is a sum over all its terms: idf is joined with the rows of blocks, which are fewer than postings, and added up there.
        """
        n = self.texts.count()
        idf = self.held.groupBy("term").agg(F.sum("n").alias("df")).select("term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1).alias("idf"))
        idf = settled(idf)
        squares = small(idf.select("term", (F.col("idf") * F.col("idf")).alias("square")), 200_000)
        norm = blocks.sums(self.held.join(squares, "term"), "square").select("doc", F.greatest(F.sqrt("total"), F.lit(1e-12)).alias("norm"))
        asked = idf.filter(F.col("term").isin(*terms))
        own = asked.agg(F.sqrt(F.sum(F.col("idf") * F.col("idf")))).first()[0] or 1.0
        met = self.of(terms).join(F.broadcast(asked), "term").join(norm, "doc")
        scored = met.groupBy("doc").agg(F.round(F.sum(F.col("idf") / F.col("norm") * (F.col("idf") / own)), 6).alias("score"))
        return scored.join(self.texts.select("doc", "kind", "id"), "doc").select("kind", "id", "score")


def grams(docs: DataFrame) -> Grams:
    texts = blocks.numbered(docs.select("kind", "id", "text"))
    return Grams(texts, settled(blocks.blocks(texts, ("gram",), places=False)))


def channels(corpus: Corpus, query: str, spec: Spec, vector: list[float] | None = None) -> DataFrame:
    """Hits of every channel of the mode, ``over`` times the limit of each."""
    spark, docs, wanted, out = corpus.documents.sparkSession, corpus.documents, MODES[spec.mode], []
    plain = [w for w in "".join(c.lower() if c.isalnum() else " " for c in query).split()]
    word = _lexical(docs, text.words(F.col("text")), plain) if plain else None
    if "word" in wanted and word is not None:
        out.append(_hits(word, "word", query))
    runs = sorted({w[i : i + 3] for w in query.lower().split() for i in range(len(w) - 2)})
    held = grams(docs) if runs and {"trigram", "tfidf"} & set(wanted) else None
    if "trigram" in wanted and runs:
        good = reduce(lambda a, b: a & b, [F.contains(F.col("text"), F.lit(w)) for w in query.lower().split() if len(w) >= 3], F.lit(True))
        out.append(_hits(held.bm25(runs, good), "trigram", query))
    if "tfidf" in wanted and runs:
        out.append(_hits(held.cosine(runs), "tfidf", query))
    if "dense" in wanted and corpus.vectors is not None and vector is not None:
        out.append(_hits(text.nearest(corpus.vectors.withColumnRenamed("id", "vec_id"), vector, spec.over * spec.limit).select(F.lit("entity").alias("kind"), F.col("vec_id").alias("id"), "score"), "dense", query))
    if word is not None and ("graph" in wanted or "community" in wanted):
        seeds = word.filter("kind = 'entity'").orderBy(F.desc("score"), "id").limit(max(1, spec.limit // 2)).select(F.col("id").alias("node"))
        if "graph" in wanted and corpus.edges is not None:
            nodes, _ = graph.traverse(corpus.edges, seeds, spec.depth, most=2 * spec.limit)
            out.append(_hits(nodes.filter("depth > 0").select(F.lit("entity").alias("kind"), F.col("node").alias("id"), F.lit(0.5).alias("score")), "graph", query))
        if "community" in wanted and corpus.communities is not None:
            labels = corpus.communities.join(seeds, "node", "left_semi").select("label").distinct()
            out.append(_hits(corpus.communities.join(labels, "label").select(F.lit("entity").alias("kind"), F.col("node").alias("id"), F.lit(0.4).alias("score")), "community", query))
    if not out:
        return spark.createDataFrame([], "query string, channel string, kind string, id string, score double")
    return reduce(DataFrame.unionByName, out)


def search(corpus: Corpus, query: str, spec: Spec | None = None, vector: list[float] | None = None) -> DataFrame:
    """Every candidate with its fused score, order, and why it was dropped (null: kept)."""
    spec = spec or Spec()
    ranked = rank.channel_ranks(channels(corpus, query, spec, vector), spec.over * spec.limit)
    fused = {"rrf": rank.rrf, "compatible": rank.rrf_compatible}.get(spec.fusion, lambda r: rank.weighted(r, spec.weights))(ranked)
    if corpus.facts is not None:
        fused = fused.join(corpus.facts, ["kind", "id"], "left")
        fused = fused.withColumn("drop_reason", rank.drop_reason(**spec.filters)) if spec.filters else fused.withColumn("drop_reason", F.lit(None).cast("string"))
        if "corroboration" in spec.rerank:
            fused = rank.corroborated(fused.fillna({"distinct_episodes": 0}))
    else:
        fused = fused.withColumn("drop_reason", F.lit(None).cast("string"))
    kept = rank.truncated(rank.final_order(fused.filter("drop_reason is null")).drop("drop_reason"), spec.limit)
    dropped = fused.filter("drop_reason is not null").withColumn("final_order", F.lit(None).cast("int"))
    return kept.unionByName(dropped.select(kept.columns))


def facts(beliefs: DataFrame, assertions: DataFrame) -> DataFrame:
    """Facts of statements for filters and rerank: latest belief, trust from its support, first record."""
    last = beliefs.groupBy("statement_id", "predicate").agg(F.max_by(F.struct("valid_from", "valid_to", "confidence", "distinct_episodes", "n_trusted", "n_semi_trusted", "n_untrusted"), "valid_from").alias("b"))
    made = assertions.groupBy("statement_id").agg(F.min("recorded_at").alias("recorded_at"), F.max("retracted_at").alias("retracted_at"))
    trust = F.when(F.col("b.n_trusted") > 0, "trusted").when(F.col("b.n_semi_trusted") > 0, "semi_trusted").otherwise("untrusted")
    return last.join(made, "statement_id").select(F.lit("statement").alias("kind"), F.col("statement_id").alias("id"), "predicate", F.lit(None).cast("string").alias("entity_type"), "b.valid_from", "b.valid_to", "b.confidence", "b.distinct_episodes", trust.alias("trust"), "recorded_at", "retracted_at")
