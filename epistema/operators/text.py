"""Word and trigram indexes with BM25, TF-IDF vectors, dense vectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epistema.plans.storage import settled

K1, B = 1.2, 0.75


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bound(value: Column, f) -> Column:
    """f(value), with the value computed once: an expression in a lambda's body would be computed for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _runs(text: Column, n: int) -> Column:
    # characters are split once, as a substring at a place costs the way there
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    made = lambda cs: F.when(F.size(cs) >= n, F.transform(F.sequence(F.lit(1), F.size(cs) - n + 1), lambda i: F.array_join(F.slice(cs, i, F.lit(n)), ""))).otherwise(F.array().cast("array<string>"))
    return bound(chars, made)


def grams(text: Column, n: int = 3) -> Column:
    """All runs of n characters, lower case; shorter texts have none."""
    return _runs(F.lower(text), n)


def occurrences(text: str, part: str) -> Column:
    """How often a column's texts hold another column's parts (not empty), at each place where one begins."""

    @F.pandas_udf("int")
    def count(texts: pd.Series, parts: pd.Series) -> pd.Series:
        def of(t: str, p: str) -> int:
            if not any(p.startswith(p[k:]) for k in range(1, len(p))):
                return t.count(p)  # it can't overlap itself
            n, at = 0, t.find(p)
            while at >= 0:
                n, at = n + 1, t.find(p, at + 1)
            return n

        return pd.Series([of(t, p) for t, p in zip(texts, parts, strict=True)], dtype="int32")

    return count(text, part)


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct runs of n characters of the text with n - 1 marks on both sides."""
    mark = "\u0001" * (n - 1)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(_runs(F.concat(F.lit(mark), text, F.lit(mark)), n)))


def postings(docs: DataFrame, tokens: Column, key: str = "doc_id") -> DataFrame:
    """key, term, tf and the document's length."""
    split = docs.select(key, tokens.alias("__t")).withColumn("length", F.size("__t"))
    return split.select(key, "length", F.explode("__t").alias("term")).groupBy(key, "term", "length").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, query: list[str], n_docs: int, mean_length: float, key: str = "doc_id") -> DataFrame:
    """Documents with all the terms of a query: key, score. The query's terms filter the index before anything is shuffled."""
    terms = sorted(set(query))
    met = index.filter(F.col("term").isin(*terms))
    df = F.broadcast(met.groupBy("term").agg(F.count("*").alias("df")))  # a row for each term of the query
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean_length))
    return met.join(df, "term").groupBy(key).agg(F.count("*").alias("__n"), F.round(F.sum(part), 6).alias("score")).filter(F.col("__n") == len(terms)).drop("__n")


def _is(term: str):
    return lambda w: w == F.lit(term)


def bm25_of(docs: DataFrame, tokens: Column, query: list[str], key: str = "doc_id", keep: Column | None = None) -> DataFrame:
    """As ``bm25`` over ``postings``, of documents that are not indexed: key, score. keep: of those with all terms, which ones count as hits.

    Each text is split once and its query terms counted in place; numbers are written, not texts, and one aggregate of them gives all statistics,
    so nothing is shuffled.
    """
    terms = sorted(set(query))
    count = lambda own: F.struct(F.size(own).alias("length"), *(F.size(F.filter(own, _is(t))).alias(f"tf{i}") for i, t in enumerate(terms)))
    rows = docs.select(F.col(key).alias("__key"), (F.lit(True) if keep is None else keep).alias("__keep"), bound(tokens, count).alias("c"))
    rows = settled(rows.select("__key", "__keep", "c.*"))
    seen = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(terms)))).first()
    n, mean = seen.n, seen.mean or 1.0
    total, met = F.lit(0.0), F.col("__keep")
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), seen[f"df{i}"] or 0
        total = total + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / mean))
        met = met & (tf > 0)
    return rows.filter(met).select(F.col("__key").alias(key), F.round(total, 6).alias("score"))


def size(docs: DataFrame, tokens: Column) -> tuple[int, float]:
    """Number of documents and their mean length in tokens."""
    row = docs.select(F.size(tokens).alias("n")).agg(F.count("*").alias("n"), F.avg("n").alias("m")).first()
    return row.n, row.m or 1.0


def frequencies(docs: DataFrame, tokens: Column, n_docs: int) -> DataFrame:
    """term, df and idf ln((1 + n) / (1 + df)) + 1."""
    one = docs.select(F.explode(F.array_distinct(tokens)).alias("term"))
    return one.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1)


def tfidf(docs: DataFrame, tokens: Column, n_docs: int, key: str = "doc_id") -> DataFrame:
    """key, term, weight: idf of the distinct terms of a document over the length of that vector."""
    one = docs.select(key, F.explode(F.array_distinct(tokens)).alias("term"))
    weighted = one.join(frequencies(docs, tokens, n_docs).select("term", "idf"), "term")
    norm = weighted.groupBy(key).agg(F.greatest(F.sqrt(F.sum(F.col("idf") * F.col("idf"))), F.lit(1e-12)).alias("norm"))
    return weighted.join(norm, key).select(key, "term", (F.col("idf") / F.col("norm")).alias("weight"))


def cosine(vectors: DataFrame, query: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cosine of every vector with a query's (term, weight): a join on terms, as both are sparse."""
    q = query.select("term", F.col("weight").alias("__q"))
    return vectors.join(q, "term").groupBy(key).agg(F.round(F.sum(F.col("weight") * F.col("__q")), 6).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where lengths differ or a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k vectors of highest score 1 - distance, then of least key."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(key, F.round(1 - distance(F.col(column), q), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def nearest_all(vectors: DataFrame, queries: DataFrame, k: int, most: int = 2_000) -> DataFrame:
    """query, id, score: the k vectors (id, embedding) of highest score 1 - distance for each query (query, embedding), then of least id.

    At most ``most`` queries are sent to all tasks at once; each batch of vectors keeps its own k for each query, so k rows a batch and query are shuffled.
    """
    spark, kinds = vectors.sparkSession, dict(vectors.dtypes)
    asked = [(r.query, r.embedding) for r in queries.limit(most + 1).collect()]
    if len(asked) > most:
        raise ValueError(f"more than {most} queries at once")
    names, matrix = np.array([q for q, _ in asked]), np.array([v for _, v in asked], float)
    sent = spark.sparkContext.broadcast((names, matrix))

    def run(batches):
        names, matrix = sent.value
        for pdf in batches:
            if not len(pdf) or not len(names):
                continue
            own = np.stack(pdf.embedding.to_numpy()).astype(float)
            ids = pdf.id.to_numpy()
            for q, v in zip(names, matrix, strict=True):
                score = np.round(1 - np.sqrt(((own - v) ** 2).sum(1)), 6)
                at = np.lexsort((ids, -score))[:k]
                yield pd.DataFrame({"query": q, "id": ids[at], "score": score[at]})

    found = vectors.select("id", "embedding").mapInPandas(run, f"query {dict(queries.dtypes)['query']}, id {kinds['id']}, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= k).drop("__r")


def unit(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def bits(v: Column, width: int) -> Column:
    """Signs of a vector as words of 32 bits: array of BIGINT."""
    word = lambda w: F.aggregate(F.slice(v, w * 32 + 1, F.lit(32)), F.lit(0).cast("bigint"), lambda s, x: s * 2 + F.when(x > 0, 1).otherwise(0).cast("bigint"))
    return F.transform(F.sequence(F.lit(0), F.lit((width + 31) // 32 - 1)), word)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def embedding_text(kind: Column, canonical: Column, aliases: Column) -> Column:
    """Text by which an entity is embedded."""
    return F.concat(kind, F.lit(": "), canonical, F.array_join(F.transform(F.array_sort(aliases), lambda a: F.concat(F.lit(" alias "), a)), ""))
