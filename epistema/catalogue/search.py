"""Queries on text, vectors, graphs, resolution, ranking, packing and notes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistema import fixtures as fx
from epistema.catalogue import query
from epistema.catalogue.core import BELIEF, DECLARED, beliefs, visible
from epistema.fixtures import AT, DAY, FOLD, VALID, with_
from epistema.functions import scalars as sc
from epistema.operators import extract, graph, pack, rank, resolve, text
from epistema.operators import relational as rel
from epistema.schema import ONTOLOGY, ontology
from epistema.sources import html

_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
_CHARS = "string_split(lower({0}), '')"
_GRAMS = "CASE WHEN length({0}) >= 3 THEN list_transform(range(1, length({0}) - 1), lambda i: substring(lower({0}), i, 3)) ELSE [] END"
TERMS = ["the", "of"]


@query("a18_doc_frequency", f"SELECT term, count(*) AS df, round(ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1, 6) AS idf FROM (SELECT unnest(list_distinct({_WORDS})) AS term FROM documents) GROUP BY 1")
def _(spark, d):
    docs = fx.table(spark, d, "documents")
    return text.frequencies(docs, text.words(F.col("text")), docs.count()).select("term", "df", F.round("idf", 6).alias("idf"))


@query(
    "r1_j13_word_bm25",
    f"""WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS m FROM t),
p AS (SELECT doc_id, len(w) AS length, term, len(list_filter(w, lambda x: x = term)) AS tf FROM t, (VALUES ('the'), ('of')) q(term) WHERE list_contains(w, term)),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / m))), 6) AS score FROM p JOIN f USING (term), s GROUP BY doc_id HAVING count(*) = 2""",
)
def _(spark, d):
    docs = fx.table(spark, d, "documents")
    return text.bm25_of(docs, text.words(F.col("text")), TERMS)


@query("r2_trigram_match", "SELECT doc_id FROM documents WHERE contains(lower(text), 'ation')")
def _(spark, d):
    docs = fx.table(spark, d, "documents")
    need = ["ati", "tio", "ion"]
    have = reduce(lambda a, b: a & b, [F.array_contains(text.grams(F.col("text")), g) for g in need])
    return docs.filter(have & F.contains(F.lower("text"), F.lit("ation"))).select("doc_id")


@query("r3_index_rows", with_("assertions") + "SELECT 'episode' AS kind, CAST(doc_id AS VARCHAR) AS id, text FROM documents WHERE doc_id % 9 <> 0 UNION ALL SELECT DISTINCT 'statement', statement_id, concat_ws(' ', subject_id, predicate, object) FROM assertions UNION ALL SELECT 'entity', CAST(p_partkey AS VARCHAR), p_name FROM part")
def _(spark, d):
    from epistema.plans.rebuild import indexed

    eps = fx.table(spark, d, "documents").select(F.col("doc_id").alias("episode_id"), F.col("text").alias("content"), F.when(F.col("doc_id") % 9 == 0, 1).alias("redacted_at"))
    return indexed(eps, fx.assertions(spark, d), fx.table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("surface")))


_TFIDF = """WITH g AS (SELECT p_partkey, unnest(list_distinct(%s)) AS term FROM part), f AS (SELECT term, ln((1.0 + (SELECT count(*) FROM part)) / (1.0 + count(*))) + 1 AS idf FROM g GROUP BY 1),
v AS (SELECT p_partkey, term, idf / sqrt(sum(idf * idf) OVER (PARTITION BY p_partkey)) AS weight FROM g JOIN f USING (term))
""" % _GRAMS.format("p_name")


@query("r4_r5_tfidf_cosine", _TFIDF + "SELECT a.p_partkey, round(sum(a.weight * b.weight), 6) AS score FROM v a JOIN v b ON a.term = b.term AND b.p_partkey = 1 GROUP BY 1")
def _(spark, d):
    parts = fx.table(spark, d, "part")
    v = text.tfidf(parts, text.grams(F.col("p_name")), parts.count(), "p_partkey")
    return text.cosine(v, v.filter("p_partkey = 1"), "p_partkey")


_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


@query("r6_o2_dense_knn", f"SELECT vec_id, round(1 - sqrt(list_sum(list_transform(list_zip(embedding, q), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))), 6) AS score FROM embeddings, (SELECT {_Q} AS q) ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    e = fx.table(spark, d, "embeddings")
    return text.nearest(e, list(e.filter("vec_id = 0").first().embedding), 10)


@query("r7_r10_cosine", f"SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, q), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE)))), 5) AS score FROM embeddings, (SELECT {_Q} AS q)")
def _(spark, d):
    e = fx.table(spark, d, "embeddings")
    q = F.array(*(F.lit(float(x)) for x in e.filter("vec_id = 0").first().embedding))
    return e.select("vec_id", F.round(text.similarity(F.col("embedding"), q), 5).alias("score"))


@query("r8_binary_hamming", f"SELECT vec_id, CAST(list_sum(list_transform(list_zip(embedding, q), lambda p: CAST((p[1] > 0) <> (p[2] > 0) AS INTEGER))) AS BIGINT) AS hamming FROM embeddings, (SELECT {_Q} AS q)")
def _(spark, d):
    e = fx.table(spark, d, "embeddings")
    q = [float(x) for x in e.filter("vec_id = 0").first().embedding]
    return e.select("vec_id", text.hamming(text.bits(F.col("embedding"), len(q)), text.bits(F.array(*map(F.lit, q)), len(q))).alias("hamming"))


@query("r9_embedding_text", "SELECT p_brand, concat('Concept: ', p_brand, list_aggregate(list_transform(list_sort(list(DISTINCT p_name)), lambda a: concat(' alias ', a)), 'string_agg', '')) AS text FROM part GROUP BY 1")
def _(spark, d):
    return fx.table(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_name").alias("a")).select("p_brand", text.embedding_text(F.lit("Concept"), F.col("p_brand"), F.col("a")).alias("text"))


@query("r27_vector_upsert", "SELECT vec_id, label + (vec_id % 2 = 0)::INT AS label FROM embeddings WHERE vec_id % 5 <> 4")
def _(spark, d):
    e = fx.table(spark, d, "embeddings").select("vec_id", "label").withColumn("version", F.lit(0))
    new = e.filter("vec_id % 2 = 0").withColumn("label", F.col("label") + 1).withColumn("version", F.lit(1))
    return rel.latest(e.unionByName(new), ["vec_id"], "version").filter("vec_id % 5 <> 4").select("vec_id", "label")


# fusion

_CH = """h AS (SELECT doc_id % 5 AS query, ch AS channel, 'episode' AS kind, CAST(doc_id AS VARCHAR) AS id, (CASE ch WHEN 'a' THEN n_chars WHEN 'b' THEN (n_chars * 7919) % 1009 ELSE (doc_id * 31) % 97 END)::DOUBLE AS score
 FROM documents, (VALUES ('a'), ('b'), ('c')) c(ch) WHERE NOT (ch = 'b' AND doc_id % 2 = 0) AND NOT (ch = 'c' AND doc_id % 3 > 0)),
r AS (SELECT *, row_number() OVER (PARTITION BY query, channel ORDER BY score DESC, kind, id) - 1 AS rank FROM h)"""


def channels(spark, d: str) -> DataFrame:
    docs = fx.table(spark, d, "documents")
    i, n = F.col("doc_id"), F.col("n_chars")
    one = lambda c, s, keep: docs.filter(keep).select((i % 5).alias("query"), F.lit(c).alias("channel"), F.lit("episode").alias("kind"), i.cast("string").alias("id"), s.cast("double").alias("score"))
    return one("a", n, F.lit(True)).unionByName(one("b", (n * 7919) % 1009, i % 2 == 1)).unionByName(one("c", (i * 31) % 97, i % 3 == 0))


@query("r15_u3_rrf_fuse", f"WITH {_CH} SELECT query, kind, id, round(sum(1.0 / (61.0 + rank)), 6) AS fused, count(*) AS n_channels FROM r GROUP BY 1, 2, 3")
def _(spark, d):
    return rank.rrf(rank.channel_ranks(channels(spark, d)))


@query("r16_rrf_compatible", f"WITH {_CH} SELECT query, kind, id, count(*) AS n_channels, round(CASE count(*) WHEN 1 THEN 1 / 61.0 WHEN 2 THEN 1 / 61.0 + 1 / 62.0 ELSE 1 / 61.0 + 1 / 62.0 + 1 / 63.0 END, 6)::DOUBLE AS fused FROM r GROUP BY 1, 2, 3")
def _(spark, d):
    return rank.rrf_compatible(rank.channel_ranks(channels(spark, d)))


@query("r17_weighted_fuse", f"WITH {_CH}, o AS (SELECT query, kind, id, min(score) AS lo, max(score) AS hi, count(*) AS n_channels FROM r GROUP BY 1, 2, 3) SELECT query, kind, id, n_channels, round(sum((score - lo) / greatest(hi - lo, 2.220446049250313e-16) / n_channels), 6) AS fused FROM r JOIN o USING (query, kind, id) GROUP BY 1, 2, 3, 4")
def _(spark, d):
    return rank.weighted(rank.channel_ranks(channels(spark, d)))


_FUSED = f"{_CH}, u AS (SELECT query, kind, id, round(sum(1.0 / (61.0 + rank)), 6) AS fused FROM r GROUP BY 1, 2, 3)"


@query("r18_corroboration_rerank", f"WITH {_FUSED} SELECT query, kind, id, round(fused * (1 + ln(1.0 + CAST(id AS BIGINT) % 4)), 6) AS fused FROM u")
def _(spark, d):
    f = rank.rrf(rank.channel_ranks(channels(spark, d))).withColumn("distinct_episodes", F.col("id").cast("long") % 4)
    return rank.corroborated(f).select("query", "kind", "id", "fused")


@query("o3_o4_rank_truncate", f"WITH {_FUSED}, o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY fused DESC, id) - 1 AS final_order FROM u) SELECT query, id, CAST(final_order AS INTEGER) AS final_order, CASE WHEN final_order >= 20 THEN concat('truncated_at_', final_order) END AS drop_reason FROM o")
def _(spark, d):
    return rank.truncated(rank.final_order(rank.rrf(rank.channel_ranks(channels(spark, d)))), 20).select("query", "id", "final_order", "drop_reason")


@query("p9_filter_reasons", with_("assertions") + f"""SELECT assertion_id, CASE WHEN claimed_from > {VALID} OR claimed_to < {VALID - DAY} THEN 'outside_valid_window' WHEN recorded_at > {AT} OR coalesce(retracted_at <= {AT}, false) THEN 'not_known' WHEN confidence < 0.6 THEN 'below_confidence'
 WHEN trust IN ('untrusted') THEN 'excluded_trust' WHEN predicate NOT IN ('knows', 'works_on', 'born_in') THEN 'predicate_filtered' WHEN assertion_id % 3 = 0 THEN 'type_filtered' END AS drop_reason FROM assertions""")
def _(spark, d):
    rows = fx.assertions(spark, d).withColumnsRenamed({"claimed_from": "valid_from", "claimed_to": "valid_to"}).withColumn("entity_type", F.when(F.col("assertion_id") % 3 == 0, "Place").otherwise("Person"))
    return rows.select("assertion_id", rank.drop_reason(VALID - DAY, VALID, AT, 0.6, ["untrusted"], ["knows", "works_on", "born_in"], ["Person"]).alias("drop_reason"))


@query("r19_mmr_rerank", None)
def _(spark, d):
    e = fx.table(spark, d, "embeddings")
    items = e.select((F.col("vec_id") % 8).alias("query"), F.col("vec_id").alias("id"), (1.0 / (1 + F.col("vec_id"))).alias("fused"))
    return rank.mmr(rank.final_order(items.withColumn("kind", F.lit("entity"))).filter("final_order < 40").select("query", "id", "fused"), e.select(F.col("vec_id").alias("id"), "embedding"), 0.7, 0.95)


@query("r13_r14_r22_hybrid_search", None)
def _(spark, d):
    from epistema.plans import retrieval

    b = beliefs(spark, d)
    docs = fx.table(spark, d, "documents").select(F.lit("episode").alias("kind"), F.col("doc_id").cast("string").alias("id"), "text")
    docs = docs.unionByName(fx.table(spark, d, "part").select(F.lit("entity").alias("kind"), F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("text")))
    return retrieval.search(retrieval.Corpus(docs, fx.edges(spark, d), facts=retrieval.facts(b, visible(spark, d))), "small ring", retrieval.Spec(mode="hybrid", limit=20)).select("kind", "id", "fused", "n_channels", "final_order", "drop_reason")


# graph

_WALK = "both_ AS (SELECT src AS a, dst AS b, src, dst, predicate FROM edges UNION ALL SELECT dst, src, src, dst, predicate FROM edges)"


@query(
    "g1_g3_bfs_depth3",
    with_("edges", extra=_WALK + """,
n0 AS (SELECT 'c:' || c_custkey AS node FROM customer WHERE c_custkey < 5), n1 AS (SELECT DISTINCT b AS node FROM both_ WHERE a IN (SELECT node FROM n0) EXCEPT SELECT node FROM n0),
n2 AS (SELECT DISTINCT b AS node FROM both_ WHERE a IN (SELECT node FROM n1) EXCEPT (SELECT node FROM n0 UNION SELECT node FROM n1)),
n3 AS (SELECT DISTINCT b AS node FROM both_ WHERE a IN (SELECT node FROM n2) EXCEPT (SELECT node FROM n0 UNION SELECT node FROM n1 UNION SELECT node FROM n2))""")
    + "SELECT node, 0 AS depth FROM n0 UNION ALL SELECT node, 1 FROM n1 UNION ALL SELECT node, 2 FROM n2 UNION ALL SELECT node, 3 FROM n3",
)
def _(spark, d):
    seeds = fx.table(spark, d, "customer").filter("c_custkey < 5").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("node"))
    return graph.traverse(fx.edges(spark, d), seeds, 3)[0].select("node", "depth")


@query("g2_adjacency_filtered", with_(*FOLD) + f"SELECT DISTINCT b.subject_id AS src, s.object AS dst, b.predicate FROM beliefs b JOIN (SELECT DISTINCT statement_id, object FROM assertions) s USING (statement_id) WHERE status IN ('active', 'superseded') AND confidence >= 0.3 AND valid_from <= {VALID} AND valid_to >= {VALID}")
def _(spark, d):
    s = fx.assertions(spark, d).select("statement_id", "object").distinct()
    b = beliefs(spark, d).filter(F.col("status").isin("active", "superseded") & rel.confident(0.3) & rel.valid_at(VALID))
    return b.join(s, "statement_id").select(F.col("subject_id").alias("src"), F.col("object").alias("dst"), "predicate").distinct()


@query("g9_neighbours_directed", with_("edges") + "SELECT dst AS node, predicate, 'out' AS direction FROM edges WHERE src = 'n:3' UNION SELECT src, predicate, 'in' FROM edges WHERE dst = 'n:3'")
def _(spark, d):
    return graph.neighbours(fx.edges(spark, d), "n:3")


@query("g5_g7_communities", None)
def _(spark, d):
    e = fx.edges(spark, d).withColumn("weight", F.when(F.col("predicate") == "buys_from", 0.5).otherwise(1.0))
    return graph.members(graph.communities(e)).select("label", "size", F.array_join("members", ",").alias("members"))


@query("g4_ordered_communities", None)
def _(spark, d):
    return graph.communities(fx.edges(spark, d).withColumn("weight", F.lit(1.0)))


@query("g10_shortest_path", None)
def _(spark, d):
    path = graph.shortest_path(fx.edges(spark, d), "c:0", "r:0")
    return spark.createDataFrame(list(enumerate(path)), "step int, node string")


@query("g11_primary_episodes", with_("assertions") + "SELECT DISTINCT object AS label, episode_id FROM assertions WHERE predicate = 'knows'")
def _(spark, d):
    return fx.assertions(spark, d).filter("predicate = 'knows'").select(F.col("object").alias("label"), "episode_id").distinct()


# resolution

_PAD = "chr(1) || chr(1) || p_name || chr(1) || chr(1)"
_SH = f"list_distinct(list_transform(range(1, length({_PAD}) - 1), lambda i: substring({_PAD}, i, 3)))"


@query("e1_normalize", "SELECT p_partkey, trim(regexp_replace(lower(concat(' ', p_name, '  ', p_type)), '\\s+', ' ', 'g')) AS normalized FROM part")
def _(spark, d):
    return fx.table(spark, d, "part").select("p_partkey", resolve.normal(F.concat(F.lit(" "), "p_name", F.lit("  "), "p_type")).alias("normalized"))


@query("e2_u2_shingle_jaccard", f"WITH n AS (SELECT DISTINCT p_name FROM part), s AS (SELECT p_name, {_SH} AS s FROM n) SELECT a.p_name AS a, b.p_name AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard FROM s a JOIN s b ON a.p_name < b.p_name AND split_part(a.p_name, ' ', 1) = split_part(b.p_name, ' ', 1)")
def _(spark, d):
    n = fx.table(spark, d, "part").select("p_name").distinct().withColumn("first", F.substring_index("p_name", " ", 1))
    a, b = n.select(F.col("p_name").alias("a"), "first"), n.select(F.col("p_name").alias("b"), "first")
    return a.join(b, "first").filter("a < b").select("a", "b", F.round(rel.jaccard(text.shingles(F.col("a")), text.shingles(F.col("b"))), 6).alias("jaccard"))


@query("a17_e5_shingle_entropy", f"WITH n AS (SELECT DISTINCT p_name FROM part), c AS (SELECT p_name, unnest(string_split(array_to_string({_SH}, ''), '')) AS c FROM n), k AS (SELECT p_name, c, count(*) AS k FROM c GROUP BY 1, 2), t AS (SELECT p_name, k / sum(k) OVER (PARTITION BY p_name) AS p FROM k) SELECT p_name, round(-sum(p * log2(p)), 5) AS entropy FROM t GROUP BY 1")
def _(spark, d):
    return fx.table(spark, d, "part").select("p_name").distinct().select("p_name", F.round(resolve.entropy(text.shingles(F.col("p_name"))), 5).alias("entropy"))


@query("e3_e4_e6_j15_minhash_candidates", None)
def _(spark, d):
    return resolve.candidates(fx.table(spark, d, "part").select(F.col("p_partkey").alias("key_id"), resolve.normal(F.col("p_name")).alias("normalized")))


@query("e7_graph_context", with_("edges") + "SELECT a.src AS a, b.src AS b, CASE WHEN a.dst = b.dst THEN 1.0 ELSE 0.0 END::DOUBLE AS ctx FROM edges a JOIN edges b ON a.src LIKE 'n:%' AND b.src LIKE 'n:%' AND a.src < b.src")
def _(spark, d):
    e = fx.edges(spark, d).filter("predicate = 'part_of'")
    n = e.select(F.col("src").alias("a"))
    return resolve.context(e, n.join(n.withColumnRenamed("a", "b"), F.col("a") < F.col("b")))


@query(
    "e8_e9_resolution_decide",
    f"""WITH n AS (SELECT DISTINCT p_name FROM part), s AS (SELECT p_name, {_SH} AS s FROM n),
p AS (SELECT a.p_name AS mention, b.p_name AS entity, greatest(0, least(1, (a.p_name = b.p_name)::INT + len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))))) AS score FROM s a JOIN s b ON split_part(a.p_name, ' ', 1) = split_part(b.p_name, ' ', 1) AND a.p_name <> b.p_name),
m AS (SELECT mention, arg_min(entity, (-score, entity)) AS entity, max(score) AS score FROM p WHERE score > 0 GROUP BY 1)
SELECT mention, CASE WHEN score <= 0.25 THEN 'new' WHEN score >= 0.75 THEN 'link' ELSE 'candidate' END AS decision, CASE WHEN score >= 0.75 THEN 'lexical' ELSE 'new' END AS method, CASE WHEN score > 0.25 THEN entity END AS entity, round(score, 6)::DOUBLE AS score FROM m""",
)
def _(spark, d):
    n = fx.table(spark, d, "part").select("p_name").distinct().withColumn("first", F.substring_index("p_name", " ", 1))
    p = n.select(F.col("p_name").alias("mention"), "first").join(n.select(F.col("p_name").alias("entity"), "first"), "first").filter("mention <> entity")
    p = p.withColumn("score", resolve.score(F.lit(True), F.col("mention"), F.col("entity"))).select("mention", F.col("mention").alias("mention_normalized"), "entity", F.col("entity").alias("normalized"), "score")
    return resolve.decide(p)


@query("e10_resolve_all", None)
def _(spark, d):
    return resolve.resolve_all(fx.table(spark, d, "part").select(F.col("p_partkey").alias("mention_id"), F.lit("Concept").alias("type"), F.col("p_name").alias("surface")))


# scalars


@query("x2_number_text", "SELECT event_id, CASE WHEN v = 0 THEN '0' WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE 'fraction' END AS number FROM (SELECT event_id, floor(value) * (event_id % 3) AS v FROM events)")
def _(spark, d):
    return fx.table(spark, d, "events").select("event_id", sc.number_text((F.floor("value") * (F.col("event_id") % 3)).cast("double")).alias("number"))


@query("x3_token_estimate", "SELECT doc_id, CAST(greatest(1, floor(length(text) / 4)) AS BIGINT) AS tokens FROM documents")
def _(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", sc.tokens(F.col("text")).alias("tokens"))


@query("x4_x5_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, epoch_ms(date_trunc('day', o_orderdate)) + 43200000 AS noon FROM orders")
def _(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ms"))
    return o.select("o_orderkey", sc.short_date(F.col("ms")).alias("day"), sc.noon(sc.short_date(F.col("ms"))).alias("noon"))


@query("x6_validity_text", with_("assertions") + "SELECT assertion_id, CASE WHEN claimed_to = 9223372036854775806 THEN concat('since ', claimed_from) ELSE concat(claimed_from, ' to ', claimed_to) END AS validity FROM assertions")
def _(spark, d):
    return fx.assertions(spark, d).select("assertion_id", sc.validity(F.col("claimed_from"), F.col("claimed_to")).alias("validity"))


@query("x8_expand_score", with_("assertions") + f"SELECT assertion_id, round(confidence * greatest(confidence, 0.5) / (1 + greatest(({AT} - recorded_at) / {float(DAY)}, 0.0) / 365.0), 6) AS score FROM assertions")
def _(spark, d):
    return fx.assertions(spark, d).select("assertion_id", F.round(sc.expand_score(F.col("confidence"), (F.lit(AT) - F.col("recorded_at")) / float(DAY)), 6).alias("score"))


@query("x10_context_prefix", "SELECT p_brand, concat('[2024-01-01 · note · mentions: ', array_to_string(list_sort(list(DISTINCT p_name))[1:8], ', '), CASE WHEN count(DISTINCT p_name) > 8 THEN ', ...' ELSE '' END, ']') AS prefix FROM part GROUP BY 1")
def _(spark, d):
    return fx.table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("m")).select("p_brand", sc.context_prefix(F.lit("2024-01-01"), F.lit("note"), F.col("m")).alias("prefix"))


@query("x14_b4_entity_links", "SELECT c_custkey, concat('kb://main/entity/c:', c_custkey) AS link, concat('c:', c_custkey) AS entity FROM customer")
def _(spark, d):
    c = fx.table(spark, d, "customer").select("c_custkey", sc.entity_link(F.lit("main"), F.concat(F.lit("c:"), F.col("c_custkey").cast("string"))).alias("link"))
    return c.withColumn("entity", sc.link_entity(F.col("link")))


@query("x15_x16_hashes", "SELECT p_brand, sha256(concat('set:', array_to_string(list_sort(list(DISTINCT p_name)), ','))) AS hash FROM part GROUP BY 1")
def _(spark, d):
    return fx.table(spark, d, "part").groupBy("p_brand").agg(sc.set_hash(F.collect_list("p_name"), "set:").alias("hash"))


@query("x12_fnv1a", "SELECT p_partkey, lower(lpad(to_hex(list_reduce(list_prepend(14695981039346656037::UBIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::UBIGINT)), lambda h, b: ((xor(h, b)::HUGEINT * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT)), 16, '0')) AS hash FROM part")
def _(spark, d):
    return fx.table(spark, d, "part").select("p_partkey", sc.fnv1a(F.col("p_name")).alias("hash"))


@query("x1_content_normalize", "SELECT page_id, sha256(regexp_replace(regexp_replace(concat(url, chr(13), chr(10), ' '), '\\r\\n?', chr(10), 'g'), '\\s+$', '')) AS hash FROM pages")
def _(spark, d):
    return fx.table(spark, d, "pages").select("page_id", sc.content_hash(F.concat("url", F.lit("\r\n "))).alias("hash"))


@query("x17_question_keywords", "SELECT doc_id, array_to_string(list_sort(list_filter(['Anston', 'der', 'la', 'the'], lambda k: contains(text, k))), ' ') AS keywords FROM documents")
def _(spark, d):
    ks = ["Anston", "der", "la", "the"]
    found = F.array_sort(F.array_compact(F.array(*(F.when(F.contains("text", F.lit(k)), k) for k in ks))))
    return fx.table(spark, d, "documents").select("doc_id", F.array_join(found, " ").alias("keywords"))


# notes, claims, chunks, packing

_HTML = "regexp_replace(html, '<!--.*?(-->|$)', '', 'gs')"


@query("s4_strip_comments", f"SELECT page_id, sha256({_HTML}) AS hash FROM pages")
def _(spark, d):
    return fx.table(spark, d, "pages").select("page_id", F.sha2(html.strip_comments(F.col("html")), 256).alias("hash"))


@query(
    "s2_s5_html_to_text",
    f"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace({_HTML}, '<script\\b.*?(</script\\s*>|$)', ' ', 'gis'), '<style\\b.*?(</style\\s*>|$)', ' ', 'gis'), '<[/!?a-zA-Z][^>]*>', ' ', 'gs'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\r\\n\\f\\v]+', ' ', 'g')) AS text FROM pages""",
)
def _(spark, d):
    return fx.table(spark, d, "pages").select("page_id", html.to_text(F.col("html")).alias("text"))


@query("s2_html_to_text_whole", None)
def _(spark, d):
    return fx.table(spark, d, "pages").select("page_id", html.to_text_whole("html").alias("text"))


@query("s3_front_matter", "SELECT page_id, concat('title = ', page_id) AS front, html AS body FROM pages")
def _(spark, d):
    note = F.concat(F.lit("<!-- +++\ntitle = "), F.col("page_id").cast("string"), F.lit("\n+++ -->"), F.col("html"))
    return fx.table(spark, d, "pages").select("page_id", html.front_matter(note).alias("s")).select("page_id", "s.front", "s.body")


#: What is wrong with claim n of the fixture, by divisors of n, in the order of checks; 29, 31 and 37 are spans in characters, spans of other bytes, and surfaces in other case.
_FAULTS = {"confidence_out_of_range": (19,), "unknown_predicate": (17,), "subject_type": (43,), "object_type": (23, 41), "subject_not_verbatim": (13, 31), "span_out_of_bounds": (41,)}


def responses(spark, d: str) -> DataFrame:
    """Claims about texts with wide characters; quotes place their mentions, but in every third claim spans do."""
    a = fx.assertions(spark, d)
    n, lit = F.col("assertion_id"), lambda x: F.lit(x).cast("string")
    every = lambda k: n % k == 0
    content = F.concat_ws(" ", F.lit("Zoë 日本:"), "subject_id", "predicate", "object")
    size = F.length("subject_id").cast("long")
    spans = every(29) | every(31) | every(37) | every(3)
    start = F.when(every(29), 8).when(every(31), 0).otherwise(13).cast("long")  # the subject is character 8, byte 13
    subject = F.struct(F.when(every(13), "nobody").when(every(37), F.upper("subject_id")).otherwise(F.col("subject_id")).alias("surface"), F.when(every(43), "Place").otherwise("Person").alias("entity_type"), F.when(~spans, content).alias("quote"), F.when(spans, F.array(start, start + size)).alias("span"))
    kind = F.when(every(23), "Nonsense").when(F.col("predicate") == "works_on", "Project").when(F.col("predicate") == "knows", "Person").when(F.col("predicate") == "born_in", "Place").otherwise("Organization")
    literal = every(41)
    obj = F.struct(F.when(literal, "literal").otherwise("entity").alias("kind"), F.when(~literal, F.struct(F.col("object").alias("surface"), kind.alias("entity_type"), content.alias("quote"))).alias("mention"), F.when(literal, lit("text")).alias("literal_type"), F.when(literal, F.col("object")).alias("value"))
    claim = F.struct(F.when(every(17), "unheard_of").otherwise(F.col("predicate")).alias("predicate"), subject.alias("subject"), obj.alias("object"), F.lit("affirm").alias("polarity"), (F.col("confidence") + F.when(every(19), 1.0).otherwise(0.0)).alias("confidence"))
    return a.select("assertion_id", "episode_id", "extractor_id", "recorded_at", "trust", content.alias("content"), F.to_json(F.struct(F.array(claim).alias("claims"))).alias("raw_response"))


_WRONG = ", ".join(f"CASE WHEN ({' OR '.join(f'assertion_id % {k} = 0' for k in ks)}){'' if name in ('confidence_out_of_range', 'unknown_predicate') else ' AND assertion_id % 17 <> 0'} THEN '{name}' END" for name, ks in _FAULTS.items())
# a claim for which two of the spans' rules hold takes the first: characters before other bytes before other case
_WRONG = _WRONG.replace("assertion_id % 31 = 0", "assertion_id % 31 = 0 AND assertion_id % 29 <> 0 OR assertion_id % 37 = 0 AND assertion_id % 29 = 0")


@query("v1_v3_validate_claims", with_("assertions") + f"SELECT assertion_id, concat_ws(',', {_WRONG}) AS errors FROM assertions")
def _(spark, d):
    return extract.checked(extract.claims(responses(spark, d)), ontology(spark)).select("assertion_id", F.array_join("errors", ",").alias("errors"))


@query("f17_extraction_projection", with_("assertions") + f"SELECT subject_id, predicate, object, count(*) AS n FROM assertions WHERE concat_ws(',', {_WRONG}) = '' GROUP BY 1, 2, 3")
def _(spark, d):
    valid, _bad = extract.quarantine(extract.checked(extract.claims(responses(spark, d)), ontology(spark)))
    return extract.project(valid).groupBy("subject_id", "predicate", "object").agg(F.count("*").alias("n"))


_NAME = "substring(text, p + 1, 12)"
_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query(
    "v2_x11_mention_spans",
    f"""WITH m AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN translate(name, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE name END AS surface, length(name) AS k FROM (SELECT doc_id, text, {_NAME} AS name, p FROM (SELECT *, length(text) // 2 AS p FROM documents))),
b AS (SELECT *, hex(encode(text)) AS h, hex(encode(surface)) AS hs, hex(encode(translate(text, {_ASCII}))) AS l, hex(encode(translate(surface, {_ASCII}))) AS ls, strlen(surface) AS size FROM m),
q AS (SELECT *, instr(text, name) AS quote_at, instr(name, surface) AS i, instr(translate(name, {_ASCII}), translate(surface, {_ASCII})) AS j FROM b),
r AS (SELECT doc_id, p, k, h, size, surface, name, CASE WHEN doc_id % 4 = 3 AND surface <> '' THEN strlen(substring(text, 1, quote_at - 1)) + strlen(substring(name, 1, CASE WHEN i > 0 THEN i ELSE j END - 1)) END AS quoted,
  substring(h, 2 * p + 1, 2 * k) = hs AND p + k <= strlen(text) AS bytes, surface = name AND p < length(text) AS chars, substring(l, 2 * p + 1, 2 * k) = ls AND p + k <= strlen(text) AS but_case, strlen(substring(text, 1, p)) AS byte_of FROM q)
SELECT doc_id, CAST(CASE WHEN doc_id % 4 = 3 THEN quoted WHEN bytes THEN p WHEN chars THEN byte_of WHEN but_case THEN p END AS BIGINT) AS start,
  CASE WHEN doc_id % 4 = 3 THEN CASE WHEN quoted IS NOT NULL THEN name END WHEN bytes OR chars THEN surface WHEN but_case THEN decode(unhex(substring(h, 2 * p + 1, 2 * k))) END AS repaired FROM r""",
)
def _(spark, d):
    docs = fx.table(spark, d, "documents").withColumn("p", F.floor(F.length("text") / 2).cast("int"))
    docs = docs.withColumn("name", F.col("text").substr(F.col("p") + 1, F.lit(12)))
    n = F.col("doc_id") % 4
    surface = F.when(n == 0, F.translate("name", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(F.col("name"))
    span = F.array(F.col("p").cast("long"), (F.col("p") + F.length("name")).cast("long"))
    found = docs.select("doc_id", extract.place(F.col("text"), surface, F.when(n == 3, F.col("name")), span).alias("at"))
    return found.select("doc_id", "at.start", "at.repaired")


@query("o7_v4_few_shot", None)
def _(spark, d):
    return extract.few_shot(fx.table(spark, d, "part").select(F.col("p_name").alias("text")).distinct(), "small red ring", 5)


@query("x9_l3_chunks", None)
def _(spark, d):
    return extract.chunks(fx.table(spark, d, "documents").select(F.col("doc_id").alias("episode_id"), F.col("text").alias("content")), 1000)


@query("s16_prompt", None)
def _(spark, d):
    rows = [("prompt", extract.prompt(ONTOLOGY, "text")), ("grammar", extract.grammar(ONTOLOGY)), ("schema", str(extract.response_schema(ONTOLOGY)))]
    return spark.createDataFrame(rows, "kind string, value string")


@query("k1_k2_k3_context_pack", None)
def _(spark, d):
    c = fx.table(spark, d, "conversations")
    layer = F.when(F.col("turn") == 0, "profile").when(F.col("role") == "user", "beliefs").otherwise("episodes")
    return pack.packed(c.select(F.col("conv_id").alias("context_id"), layer.alias("layer"), F.col("turn").alias("position"), F.col("text").alias("line")), 600)


@query("k4_usable_summaries", "SELECT conv_id, count(*) AS n FROM conversations WHERE turn > 0 GROUP BY 1")
def _(spark, d):
    s = fx.table(spark, d, "conversations").select("conv_id", F.when(F.col("turn") > 0, F.array("turn")).otherwise(F.array().cast("array<bigint>")).alias("sources"), F.lit(0.5).alias("confidence"))
    return pack.usable_summaries(s).groupBy("conv_id").agg(F.count("*").alias("n"))


@query("l2_compaction", with_("assertions") + f"SELECT assertion_id, recorded_at < {VALID} AS compacted FROM assertions")
def _(spark, d):
    return pack.compacted(fx.assertions(spark, d).withColumnRenamed("recorded_at", "ingested_at"), VALID).select("assertion_id", "compacted")


@query("l4_consolidation_pending", "SELECT conv_id AS cluster_id FROM conversations WHERE conv_id % 3 <> 0 GROUP BY 1")
def _(spark, d):
    c = fx.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("cluster_id")).agg(F.collect_list(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))).alias("members"))
    done = c.filter("cluster_id % 3 = 0").withColumn("member_hash", sc.set_hash(F.col("members")))
    return pack.pending(c, done).select("cluster_id")


@query("b1_b5_entity_brief", with_(*FOLD) + "SELECT subject_id, count(*) AS n_beliefs, CAST(sum((status = 'contradicted')::INT) AS BIGINT) AS n_contradicted, CAST(sum((distinct_episodes = 1)::INT) AS BIGINT) AS n_single FROM beliefs GROUP BY 1")
def _(spark, d):
    a = fx.assertions(spark, d)
    b = beliefs(spark, d).join(a.select("statement_id", "object").distinct(), "statement_id")
    return pack.entity_brief(b, a.select(F.col("subject_id").alias("entity_id"), F.upper("subject_id").alias("surface")).distinct()).select("subject_id", "n_beliefs", "n_contradicted", "n_single")


@query("q1_token_check", "SELECT 'b' AS name")
def _(spark, d):
    t = spark.createDataFrame([], "name string, secret_hash string, caps array<string>, space_id string, expires_at long, revoked boolean")
    t = pack.issue(pack.issue(t, "a", "one", ["read"], "s", None), "b", "two", ["read"], "s", None)
    return pack.verify(pack.revoke(t, "a"), "two", AT).select("name")


@query("stream_dedup_refold", fx.refolded() + f"SELECT {', '.join(BELIEF)} FROM beliefs")
def _(spark, d):
    import uuid

    from epistema.plans import storage
    from epistema.streaming import ingest

    root = storage.shared_root(spark) + f"/stream-{uuid.uuid4().hex}"
    a = fx.assertions(spark, d)
    a.withColumn("batch", F.col("assertion_id") % 3).write.partitionBy("batch").parquet(f"{root}/in")
    stream = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1000).parquet(f"{root}/in").select(a.columns)
    ingest.run(stream, root, ontology(spark), f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/{ingest.version(spark, root)}")


# lookups, lists and settings


@query("f23_key_lookup", "SELECT p_partkey FROM part WHERE trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) = 'small ring' AND p_type = 'ECONOMY'")
def _(spark, d):
    keys = fx.table(spark, d, "part").withColumn("normalized", resolve.normal(F.col("p_name")))
    return keys.filter((F.col("normalized") == "small ring") & (F.col("p_type") == "ECONOMY")).select("p_partkey")


@query("f22_reverse_lookup", with_("assertions") + "SELECT DISTINCT statement_id, subject_id AS subject_surface, predicate, CASE WHEN object LIKE 'obj:%' THEN 'entity' ELSE 'text' END AS object_kind, object AS object_surface FROM assertions")
def _(spark, d):
    s = fx.assertions(spark, d).select("statement_id", "subject_id", "predicate", "object").distinct()
    return s.select("statement_id", F.col("subject_id").alias("subject_surface"), "predicate", F.when(F.col("object").startswith("obj:"), "entity").otherwise("text").alias("object_kind"), F.col("object").alias("object_surface"))


@query("f15_f16_declarations", fx.refolded(DECLARED.format("'mentors'") + " WHERE predicate = 'works_on'", predicates="('mentors', 'functional', 'interval', 'supersede', 'false', 1.0)") + "SELECT statement_id, valid_from, valid_to, status FROM beliefs")
def _(spark, d):
    from epistema.plans import rebuild

    a = fx.assertions(spark, d).filter("predicate = 'works_on'")
    log = a.select(F.col("assertion_id").alias("seq"), F.lit("add_statement").alias("op"), "subject_id", F.lit("mentors").alias("predicate"), "object", "polarity", F.col("claimed_from").alias("valid_from"), F.col("claimed_to").alias("valid_to"), F.col("recorded_at").alias("at"), "trust")
    mentors = spark.createDataFrame([("mentors", "entity", "Person", "functional", "interval", "supersede", False, None, False, 1.0)], ontology(spark).schema)
    return rebuild.rebuild(log, rebuild.predicates(ontology(spark), mentors)).beliefs.select("statement_id", "valid_from", "valid_to", "status")


@query("r20_r21_graph_distance", with_("edges") + "SELECT node AS id, CAST(row_number() OVER (ORDER BY depth, node) - 1 AS INTEGER) AS final_order FROM (SELECT dst AS node, 1 AS depth FROM edges WHERE src = 'n:3' UNION SELECT src, 1 FROM edges WHERE dst = 'n:3' UNION SELECT 'n:3', 0)")
def _(spark, d):
    nodes, _scanned = graph.traverse(fx.edges(spark, d), spark.createDataFrame([("n:3",)], "node string"), 1)
    items = nodes.select(F.lit("q").alias("query"), F.col("node").alias("id"), F.lit(0.5).alias("salience"))
    return rank.chain(items, lambda df: rank.graph_distance(df, nodes.withColumnRenamed("node", "id"))).select("id", "final_order")


@query("r23_explain_lines", f"WITH {_CH}, u AS (SELECT query, kind, id, round(sum(1.0 / (61.0 + rank)), 6) AS fused, count(*) AS n FROM r GROUP BY 1, 2, 3) SELECT query, id, concat(kind, ':', id, ' fused=', printf('%.6f', fused), ' channels=', n) AS line FROM u")
def _(spark, d):
    return rank.rrf(rank.channel_ranks(channels(spark, d))).select("query", "id", rank.explain_line().alias("line"))


@query("r26_statements_for_entities", with_("assertions") + "SELECT DISTINCT concat_ws(' ', subject_id, predicate, object) AS triple FROM assertions WHERE subject_id IN ('user:1', 'user:2')")
def _(spark, d):
    ids = spark.createDataFrame([("user:1",), ("user:2",)], "entity_id string")
    found = rel.touching(fx.assertions(spark, d).select("subject_id", "predicate", "object").distinct(), ids)
    return found.select(F.concat_ws(" ", "subject_id", "predicate", "object").alias("triple"))


@query("r11_r12_expansion_channels", None)
def _(spark, d):
    from epistema.plans import retrieval

    n = fx.table(spark, d, "nation").select(F.lit("entity").alias("kind"), F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("id"), F.regexp_replace("n_name", "_", " ").alias("text"))
    e = fx.edges(spark, d).filter("predicate = 'part_of'")
    labels = e.select(F.col("src").alias("node"), F.col("dst").alias("label"))
    corpus = retrieval.Corpus(n, e, labels)
    return retrieval.channels(corpus, "nation 3", retrieval.Spec(mode="graph")).unionByName(retrieval.channels(corpus, "nation 3", retrieval.Spec(mode="community")))


@query("r24_search_entities", "SELECT p_partkey AS id FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'ring') AND list_contains(string_split(lower(p_name), ' '), 'small')")
def _(spark, d):
    p = fx.table(spark, d, "part")
    n, mean = text.size(p, text.words(F.col("p_name")))
    return text.bm25(text.postings(p, text.words(F.col("p_name")), "p_partkey"), ["small", "ring"], n, mean, "p_partkey").select(F.col("p_partkey").alias("id"))


@query("r28_ranking_rebuild", "SELECT 'word' AS part, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(list_filter(regexp_split_to_array(lower(p_name), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) FROM part)")
def _(spark, d):
    from epistema.plans.rebuild import ranking

    parts = ranking(fx.table(spark, d, "part").select(F.lit("entity").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("text")))
    return parts["word"].agg(F.lit("word").alias("part"), F.count("*").alias("n"))


@query("b6_entity_cards", "SELECT c_nationkey AS entity_id, count(*) AS n, min(c_name) AS first FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, d):
    return fx.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("entity_id")).agg(F.count("*").alias("n"), F.min("c_name").alias("first")).orderBy(F.desc("n"), "entity_id").limit(10)


@query("p8_type_filter", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def _(spark, d):
    types = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "c_mktsegment string")
    return fx.table(spark, d, "customer").join(types, "c_mktsegment", "left_semi").select("c_custkey")


@query("s13_backup", "SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    import uuid

    from epistema.plans import storage
    from epistema.sources import ledger

    folder = storage.shared_root(spark) + f"/backup-{uuid.uuid4().hex}"
    ledger.backup({"region": fx.table(spark, d, "region")}, folder)
    return spark.read.parquet(f"{folder}/region")


@query("s17_settings", "SELECT 'schema_version' AS key, '10' AS value")
def _(spark, d):
    from epistema.sources import ledger

    return ledger.ensure_version(spark, spark.createDataFrame([("schema_version", "9")], "key string, value string"), 10)


@query("l4_cluster_summaries", None)
def _(spark, d):
    c = fx.table(spark, d, "conversations")
    clusters = c.groupBy(F.col("conv_id").alias("cluster_id")).agg(F.collect_set("turn").alias("members"))
    texts = c.groupBy(F.col("turn").alias("episode_id")).agg(F.min("text").alias("content"))
    return pack.summaries(clusters, texts)


@query("q3_stage_machine", None)
def _(spark, d):
    return spark.createDataFrame([(s, o, pack.step(s, o)) for s in ("queued", "extracted", "validated", "projected") for o in ("ok", "fail")], "stage string, outcome string, next string")
