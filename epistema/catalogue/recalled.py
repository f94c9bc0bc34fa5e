"""Queries that answer a table of questions: hybrid search with facts, walks, contexts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistema import fixtures as fx
from epistema.catalogue import query
from epistema.catalogue.core import beliefs
from epistema.fixtures import AT, DAY, FOLD, VALID, with_
from epistema.plans import index, recall
from epistema.plans.storage import settled, shared_root
from epistema.schema import ontology

#: Questions by number.
ASKED = [(1, "user 7"), (2, "knows"), (3, "obj 3 works"), (4, "the"), (5, "user obj"), (6, "zqzq")]
FILTERS = {"valid_from": VALID - 4 * DAY, "valid_to": VALID, "known_at": AT, "floor": 0.3, "exclude": ["untrusted"], "predicates": ["knows", "works_on", "employed_by"], "types": ["Person"]}


def base(spark, d: str) -> recall.Base:
    """The tables of the fixture, and an index of its texts, statements and names."""
    made = fx.assertions(spark, d)
    told = settled(made.select("statement_id", "subject_id", "predicate", "object").distinct().withColumn("entity", F.lit(True)))
    names = told.select(F.col("subject_id").alias("entity_id"), F.lit("Person").alias("type")).unionByName(told.select(F.col("object").alias("entity_id"), F.lit("Concept").alias("type"))).distinct()
    names = settled(names.select("entity_id", "type", F.translate("entity_id", ":", " ").alias("surface"), F.lit(0.5).alias("salience")))
    docs = fx.table(spark, d, "documents")
    episodes = docs.select(F.col("doc_id").alias("episode_id"), F.col("text").alias("content"), F.when(F.col("doc_id") % 10 == 0, "derived").otherwise("note").alias("kind"), F.col("doc_id").alias("ingested_at"), F.when(F.col("doc_id") % 9 == 0, 1).alias("redacted_at"))
    rows = episodes.filter("redacted_at is null").select(F.lit("episode").alias("kind"), F.col("episode_id").cast("string").alias("id"), F.col("content").alias("text"))
    rows = rows.unionByName(told.select(F.lit("statement").alias("kind"), F.col("statement_id").alias("id"), F.concat_ws(" ", "subject_id", "predicate", "object").alias("text")))
    rows = rows.unionByName(names.select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), F.col("surface").alias("text")))
    kept = index.rebuild(spark, f"{shared_root(spark)}/index-{uuid.uuid4().hex}", rows, buckets=8)
    groups = names.select(F.col("entity_id").alias("node"), F.concat(F.lit("g"), F.substring("entity_id", -1, 1)).alias("label"))
    return recall.Base(kept, told, settled(beliefs(spark, d)), names, episodes, settled(made), ontology(spark), groups)


def asked(spark) -> DataFrame:
    return spark.createDataFrame(ASKED, "query long, text string")


_Q = "asked(query, text) AS (VALUES " + ", ".join(f"({q}, '{s}')" for q, s in ASKED) + "), tokens AS (SELECT query, unnest(range(len(t))) AS phrase, unnest(t) AS token FROM (SELECT query, string_split(lower(text), ' ') AS t FROM asked))"
_ROWS = """told AS (SELECT DISTINCT statement_id, subject_id, predicate, object FROM assertions),
names AS (SELECT DISTINCT subject_id AS entity_id, 'Person' AS type FROM told UNION SELECT DISTINCT object, 'Concept' FROM told),
rows_ AS (SELECT 'episode' AS kind, CAST(doc_id AS VARCHAR) AS id, lower(text) AS text FROM documents WHERE doc_id % 9 <> 0
  UNION ALL SELECT 'statement', statement_id, lower(concat_ws(' ', subject_id, predicate, object)) FROM told UNION ALL SELECT 'entity', entity_id, replace(entity_id, ':', ' ') FROM names)"""
_SPLIT = "list_filter(regexp_split_to_array({0}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_TRI = "CASE WHEN length(text) >= 3 THEN list_transform(range(1, length(text) - 1), lambda i: substring(text, i, 3)) ELSE [] END"
_SCORED = """SELECT query, '{0}' AS channel, kind, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
FROM {0}_met JOIN (SELECT query, phrase, count(*) AS df FROM {0}_met GROUP BY 1, 2) USING (query, phrase) JOIN (SELECT query, count(*) AS phrases FROM {0}_asked GROUP BY 1) USING (query), (SELECT count(*) AS n, avg(length) AS mean FROM {0}_rows)
GROUP BY query, kind, id, phrases HAVING count(*) = phrases"""
_CHANNELS = f"""word_rows AS (SELECT kind, id, w, len(w) AS length FROM (SELECT kind, id, {_SPLIT.format('text')} AS w FROM rows_)),
word_asked AS (SELECT * FROM (SELECT query, phrase, {_SPLIT.format('token')} AS p FROM tokens) WHERE len(p) > 0),
word_met AS (SELECT * FROM (SELECT query, phrase, kind, id, length, len(list_filter(range(1, length - len(p) + 2), lambda i: w[i : i + len(p) - 1] = p)) AS tf FROM word_asked, word_rows) WHERE tf > 0),
trigram_rows AS (SELECT kind, id, text, greatest(0, length(text) - 2) AS length FROM rows_),
trigram_asked AS (SELECT query, phrase, token AS p FROM tokens WHERE length(token) >= 3),
trigram_met AS (SELECT * FROM (SELECT query, phrase, kind, id, length, CASE WHEN p IN ('the-the', 'zqzq') THEN len(list_filter(range(1, length(text) - length(p) + 2), lambda i: substring(text, i, length(p)) = p)) ELSE len(string_split(text, p)) - 1 END AS tf FROM trigram_asked, trigram_rows WHERE contains(text, p)) WHERE tf > 0),
t AS (SELECT kind, id, unnest(list_distinct({_TRI})) AS term FROM rows_),
f AS (SELECT term, ln((1.0 + (SELECT count(*) FROM rows_)) / (1.0 + count(*))) + 1 AS idf FROM t GROUP BY 1),
v AS (SELECT kind, id, term, idf / sqrt(sum(idf * idf) OVER (PARTITION BY kind, id)) AS weight FROM t JOIN f USING (term)),
a AS (SELECT query, term, idf / sqrt(sum(idf * idf) OVER (PARTITION BY query)) AS own FROM (SELECT query, unnest(list_distinct({_TRI})) AS term FROM (SELECT query, lower(text) AS text FROM asked)) JOIN f USING (term)),
every_ AS ({_SCORED.format('word')} UNION ALL {_SCORED.format('trigram')} UNION ALL SELECT query, 'tfidf', kind, id, round(sum(weight * own), 6) FROM v JOIN a USING (term) GROUP BY 1, 3, 4),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, channel ORDER BY score DESC, kind, id) - 1 AS rank FROM every_) WHERE rank < 80),
fused AS (SELECT query, kind, id, round(sum(1.0 / (61.0 + rank)), 6) AS fused, count(*) AS n_channels FROM ranked GROUP BY 1, 2, 3)"""
_FACTS = """latest AS (SELECT statement_id, arg_max(struct_pack(confidence, valid_from, valid_to, distinct_episodes, n_trusted, n_semi_trusted), valid_from) AS b FROM beliefs GROUP BY 1),
made AS (SELECT statement_id, max(recorded_at) AS recorded_at, max(retracted_at) AS retracted_at FROM assertions GROUP BY 1),
touched AS (SELECT DISTINCT 'entity' AS kind, subject_id AS id, statement_id FROM told UNION SELECT DISTINCT 'entity', object, statement_id FROM told UNION SELECT DISTINCT 'episode', CAST(episode_id AS VARCHAR), statement_id FROM assertions),
trusts AS (SELECT kind, id, CASE WHEN sum(b.n_trusted) > 0 THEN 'trusted' WHEN sum(b.n_semi_trusted) > 0 THEN 'semi_trusted' ELSE 'untrusted' END AS trust FROM touched JOIN latest USING (statement_id) GROUP BY 1, 2),
spoken AS (SELECT kind, touched.id, count(DISTINCT episode_id) AS distinct_episodes FROM touched JOIN assertions USING (statement_id) GROUP BY 1, 2),
facts AS (
  SELECT 'statement' AS kind, statement_id AS id, predicate, NULL::VARCHAR AS entity_type, coalesce(b.confidence, 0.0) AS confidence, coalesce(b.valid_from, -9223372036854775807) AS valid_from, coalesce(b.valid_to, 9223372036854775806) AS valid_to,
    coalesce(recorded_at, 0) AS recorded_at, retracted_at, CASE WHEN b.n_trusted > 0 THEN 'trusted' WHEN b.n_semi_trusted > 0 THEN 'semi_trusted' ELSE 'untrusted' END AS trust, coalesce(b.distinct_episodes, 0) AS distinct_episodes
  FROM told LEFT JOIN latest USING (statement_id) LEFT JOIN made USING (statement_id)
  UNION ALL SELECT kind, id, NULL::VARCHAR, type, 1.0, -9223372036854775807, 9223372036854775806, -9223372036854775807, NULL::BIGINT, coalesce(trust, 'trusted'), coalesce(distinct_episodes, 0)
  FROM (SELECT kind, id FROM rows_ WHERE kind <> 'statement') LEFT JOIN trusts USING (kind, id) LEFT JOIN spoken USING (kind, id) LEFT JOIN (SELECT 'entity' AS kind, entity_id AS id, type FROM names) USING (kind, id))"""
_DROPS = f"""judged AS (SELECT query, kind, id, n_channels, round(fused * (1 + ln(1.0 + coalesce(distinct_episodes, 0))), 6) AS fused,
  CASE WHEN valid_from > {FILTERS['valid_to']} OR valid_to < {FILTERS['valid_from']} THEN 'outside_valid_window' WHEN recorded_at > {AT} OR coalesce(retracted_at <= {AT}, false) THEN 'not_known' WHEN confidence < {FILTERS['floor']} THEN 'below_confidence'
    WHEN trust IN ('untrusted') THEN 'excluded_trust' WHEN predicate NOT IN ('knows', 'works_on', 'employed_by') THEN 'predicate_filtered' WHEN entity_type NOT IN ('Person') THEN 'type_filtered' END AS why
  FROM fused LEFT JOIN facts USING (kind, id))
SELECT query, kind, id, fused, n_channels, final_order, CASE WHEN final_order >= 20 THEN concat('truncated_at_', final_order) END AS drop_reason FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY fused DESC, CASE kind WHEN 'statement' THEN 0 WHEN 'episode' THEN 1 ELSE 2 END, id) - 1 AS final_order FROM judged WHERE why IS NULL)
UNION ALL SELECT query, kind, id, fused, n_channels, NULL::BIGINT, why FROM judged WHERE why IS NOT NULL"""
_SEARCH = with_(*FOLD, extra=",\n".join((_Q, _ROWS, _CHANNELS, _FACTS, _DROPS)))


@query("r13_r14_search_with_facts", _SEARCH)
def _(spark, d):
    found = recall.search(base(spark, d), asked(spark), recall.Asked("lexical_vector", filters=FILTERS))
    return found.select("query", "kind", "id", "fused", "n_channels", "final_order", "drop_reason")


@query("r13_r22_hybrid_all_channels", None)
def _(spark, d):
    vectors = fx.table(spark, d, "embeddings").select(F.concat(F.lit("user:"), F.col("vec_id").cast("string")).alias("id"), "embedding")
    near = fx.table(spark, d, "embeddings").filter("vec_id in (1, 2)").select(F.col("vec_id").cast("long").alias("query"), "embedding")
    own = base(spark, d)
    own.vectors = vectors
    found = recall.search(own, asked(spark).join(near, "query", "left"), recall.Asked("hybrid"))
    return found.select("query", "kind", "id", "fused", "n_channels", "final_order", "drop_reason")


@query("k5_contexts_of_questions", None)
def _(spark, d):
    return recall.contexts(base(spark, d), asked(spark).withColumn("broad", F.col("query") == 1), 3000)


_WHEN = "CASE WHEN valid_from <= -9223372036854775807 AND valid_to >= 9223372036854775806 THEN '' ELSE concat(' [', CASE WHEN valid_from <= -9223372036854775807 THEN concat('until ', valid_to) WHEN valid_to >= 9223372036854775806 THEN concat('since ', valid_from) ELSE concat(valid_from, ' to ', valid_to) END, ']') END"
_LINES = f"""found AS (SELECT * FROM (SELECT query, kind, id, row_number() OVER (PARTITION BY query ORDER BY fused DESC, CASE kind WHEN 'statement' THEN 0 WHEN 'episode' THEN 1 ELSE 2 END, id) - 1 AS final_order
  FROM (SELECT query, kind, id, round(fused * (1 + ln(1.0 + coalesce(distinct_episodes, 0))), 6) AS fused FROM fused LEFT JOIN facts USING (kind, id))) WHERE final_order < 10),
said AS (SELECT b.*, t.object, replace(t.subject_id, ':', ' ') AS s, replace(t.object, ':', ' ') AS o, {_WHEN} AS span FROM beliefs b JOIN (SELECT statement_id, object, subject_id FROM told) t USING (statement_id)),
now_ AS (SELECT * FROM said QUALIFY row_number() OVER (PARTITION BY statement_id ORDER BY valid_from DESC) = 1),
profile AS (SELECT 'profile' AS layer, concat(s, ' ', predicate, ': ', o, span) AS line, -confidence AS k1, concat(statement_id, '|', valid_from) AS k2 FROM said WHERE status = 'active' AND confidence >= 0.5 AND predicate IN (SELECT name FROM ontology WHERE profile) ORDER BY confidence DESC, statement_id, valid_from LIMIT 30),
recent AS (SELECT 'episodes' AS layer, text AS line, -doc_id::DOUBLE AS k1, doc_id::VARCHAR AS k2 FROM documents WHERE doc_id % 9 <> 0 AND text <> '' ORDER BY doc_id DESC LIMIT 20),
derived AS (SELECT 'summaries' AS layer, concat(text, chr(10), '  sources: ', doc_id) AS line, -doc_id::DOUBLE AS k1, doc_id::VARCHAR AS k2 FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 10 = 0 AND text <> '' ORDER BY doc_id DESC LIMIT 5),
shared AS (SELECT layer, line, row_number() OVER (PARTITION BY layer ORDER BY k1, k2) - 1 AS position FROM (SELECT * FROM profile UNION ALL SELECT * FROM recent UNION ALL SELECT * FROM derived)),
top5 AS (SELECT query, id AS node FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY final_order) AS r FROM found WHERE kind = 'entity') WHERE r <= 5),
edges_ AS (SELECT DISTINCT query, statement_id, subject_id, predicate, object, confidence FROM top5 JOIN now_ ON node = subject_id OR node = object WHERE status IN ('active', 'superseded'))
SELECT query AS context_id, layer, position, line FROM asked, shared WHERE layer <> 'episodes' OR query = 1 OR position < 5
UNION ALL SELECT query, 'beliefs', final_order, concat(s, ' ', predicate, ' ', o, span, ' (', status, ', ', printf('%.2f', confidence), ', ', distinct_episodes, ' episodes)') FROM found JOIN now_ ON kind = 'statement' AND id = statement_id
UNION ALL SELECT query, 'neighborhood', position, concat(subject_id, ' -[', predicate, ']-> ', object, ' (', printf('%.2f', confidence), ')') FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY confidence DESC, statement_id) - 1 AS position FROM edges_) WHERE position < 30"""


@query("k5_context_lines", with_(*FOLD, extra=",\n".join((_Q, _ROWS, _CHANNELS.replace("rank < 80", "rank < 40"), _FACTS, _LINES))))
def _(spark, d):
    return recall.lines(base(spark, d), asked(spark).withColumn("broad", F.col("query") == 1), recall.Asked("lexical_vector", limit=10))
