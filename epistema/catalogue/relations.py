"""Relational queries: joins, aggregates, windows, order, sets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epistema import fixtures as fx
from epistema.catalogue import query
from epistema.catalogue.core import beliefs, visible
from epistema.fixtures import AT, FOLD, VALID, with_
from epistema.functions import scalars as sc
from epistema.operators import graph
from epistema.operators import pack
from epistema.operators import relational as rel
from epistema.plans.storage import settled
from epistema.sources import ledger


@query("j1_beliefs_join_statements", with_(*FOLD) + "SELECT b.statement_id, b.valid_from, s.object FROM beliefs b JOIN (SELECT DISTINCT statement_id, object FROM assertions) s USING (statement_id)")
def _(spark, d):
    s = fx.assertions(spark, d).select("statement_id", "object").distinct()
    return beliefs(spark, d).join(s, "statement_id").select("statement_id", "valid_from", "object")


@query("j2_a5_statements_left_beliefs", with_(*FOLD) + "SELECT s.statement_id, s.recorded_at, s.retracted_at, count(b.statement_id) AS n_beliefs FROM (SELECT statement_id, max(recorded_at) AS recorded_at, max(retracted_at) AS retracted_at FROM assertions GROUP BY 1) s LEFT JOIN beliefs b USING (statement_id) GROUP BY ALL")
def _(spark, d):
    s = fx.assertions(spark, d).groupBy("statement_id").agg(F.max("recorded_at").alias("recorded_at"), F.max("retracted_at").alias("retracted_at"))
    n = beliefs(spark, d).groupBy("statement_id").agg(F.count("*").alias("n"))
    return s.join(n, "statement_id", "left").select("statement_id", "recorded_at", "retracted_at", F.coalesce("n", F.lit(0)).cast("long").alias("n_beliefs"))


@query("j3_semi_exists", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(spark, d):
    o = fx.table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return fx.table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("j4_uncached_episodes", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(spark, d):
    return fx.table(spark, d, "documents").join(fx.table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


_SYNC = """WITH f AS (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 3 = 0 THEN concat(doc_id, 'v2') ELSE concat(doc_id, 'v1') END) AS hash FROM documents),
ev AS (SELECT doc_id AS path, sha256(concat(doc_id, 'v1')) AS hash FROM documents WHERE doc_id % 2 = 0), old AS (SELECT doc_id AS path, sha256(concat(doc_id, CASE WHEN doc_id % 3 = 0 THEN 'v2' ELSE 'v0' END)) AS hash FROM documents WHERE doc_id % 5 = 0)
SELECT f.path, f.hash, CASE WHEN ev.hash IS NOT NULL THEN CASE WHEN ev.hash = f.hash THEN 'unchanged' ELSE 'modified' END WHEN old.hash IS NOT NULL THEN CASE WHEN old.hash = f.hash THEN 'unchanged' ELSE 'modified' END ELSE 'new' END AS state
FROM f LEFT JOIN ev USING (path) LEFT JOIN old USING (path)"""


@query("j6_s8_sync_classify", _SYNC)
def _(spark, d):
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("path"))
    h = lambda v: F.sha2(F.concat(F.col("path").cast("string"), v), 256).alias("hash")
    third = F.col("path") % 3 == 0
    files = docs.select("path", h(F.when(third, "v2").otherwise("v1")))
    events = docs.filter("path % 2 = 0").select("path", h(F.lit("v1")), F.lit(1).alias("seq"))
    return rel.classify(files, events, docs.filter("path % 5 = 0").select("path", h(F.when(third, "v2").otherwise("v0"))))


@query("j7_cosupport_pairs", with_("assertions") + "SELECT DISTINCT a.episode_id AS u, b.episode_id AS v FROM assertions a JOIN assertions b ON a.statement_id = b.statement_id AND a.episode_id < b.episode_id WHERE a.predicate = 'born_in' AND b.predicate = 'born_in'")
def _(spark, d):
    return rel.support_pairs(fx.assertions(spark, d).filter("predicate = 'born_in'"))


@query(
    "j9_source_policy_asof",
    with_("policies", extra="sup AS (SELECT l_orderkey, l_linenumber, concat('s:', l_suppkey) AS source_id, " + f"{VALID} - (l_orderkey % 25 - 5) * 86400000000 AS moment FROM lineitem)")
    + "SELECT l_orderkey, l_linenumber, moment, (SELECT arg_max(CASE WHEN effective_to IS NULL OR effective_to > moment THEN trust END, effective_from) FROM policies p WHERE p.source_id = sup.source_id AND effective_from <= moment) AS policy_trust FROM sup",
)
def _(spark, d):
    rows = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("source_id"), (F.lit(VALID) - (F.col("l_orderkey") % 25 - 5) * 86_400_000_000).alias("moment"))
    return rel.as_of(rows, fx.policies(spark, d), "source_id", "moment").select("l_orderkey", "l_linenumber", "moment", "policy_trust")


@query("j10_correlated_scalars", "SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_customers, (SELECT min(s_name) FROM supplier WHERE s_nationkey = n_nationkey) AS first_supplier FROM nation")
def _(spark, d):
    c = fx.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    s = fx.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_name").alias("first_supplier"))
    return fx.table(spark, d, "nation").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select("n_nationkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_customers"), "first_supplier")


@query("j11_in_list_fetch", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def _(spark, d):
    ids = fx.table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return fx.table(spark, d, "orders").join(ids, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("j12_not_in_array", "SELECT p_partkey FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3')")
def _(spark, d):
    gone = spark.createDataFrame([(["Brand#1", "Brand#2", "Brand#3"],)], "a array<string>").select(F.explode("a").alias("p_brand"))
    return fx.table(spark, d, "part").join(gone, "p_brand", "left_anti").select("p_partkey")


@query("j14_mention_roles", with_("assertions") + "SELECT assertion_id, s.surface AS subject_surface, o.surface AS object_surface FROM assertions a JOIN (SELECT assertion_id, upper(subject_id) AS surface FROM assertions) s USING (assertion_id) LEFT JOIN (SELECT assertion_id, upper(object) AS surface FROM assertions WHERE assertion_id % 2 = 0) o USING (assertion_id)")
def _(spark, d):
    a = fx.assertions(spark, d)
    m = a.select("assertion_id", F.lit("subject").alias("role"), F.upper("subject_id").alias("surface")).unionByName(a.filter("assertion_id % 2 = 0").select("assertion_id", F.lit("object").alias("role"), F.upper("object").alias("surface")))
    s, o = (m.filter(F.col("role") == r).select("assertion_id", F.col("surface").alias(f"{r}_surface")) for r in ("subject", "object"))
    return a.select("assertion_id").join(s, "assertion_id").join(o, "assertion_id", "left")


@query("j16_either_role", with_("assertions") + "SELECT DISTINCT statement_id FROM assertions WHERE subject_id = 'user:8' OR object = 'obj:3'")
def _(spark, d):
    ids = spark.createDataFrame([("user:8",), ("obj:3",)], "entity_id string")
    return rel.touching(fx.assertions(spark, d).select("statement_id", "subject_id", "object").distinct(), ids).select("statement_id")


@query("a1_count_filtered", with_("assertions") + "SELECT count(*) AS n FROM assertions WHERE polarity < 0")
def _(spark, d):
    return fx.assertions(spark, d).filter("polarity < 0").agg(F.count("*").alias("n"))


@query("a2_a3_space_overview", with_(*FOLD) + "SELECT predicate, count(DISTINCT statement_id) AS statements, count(DISTINCT subject_id) AS entities, count(DISTINCT CASE WHEN status = 'contradicted' THEN statement_id END) AS contradicted FROM beliefs GROUP BY 1")
def _(spark, d):
    return beliefs(spark, d).groupBy("predicate").agg(F.countDistinct("statement_id").alias("statements"), F.countDistinct("subject_id").alias("entities"), F.countDistinct(F.when(F.col("status") == "contradicted", F.col("statement_id"))).alias("contradicted"))


@query("a4_b2_top_entities", with_("assertions") + "SELECT entity_id, count(DISTINCT predicate) AS n_predicates FROM (SELECT subject_id AS entity_id, predicate FROM assertions UNION ALL SELECT object, predicate FROM assertions) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(spark, d):
    return pack.top_entities(fx.assertions(spark, d), 20)


@query("a6_g6_edge_weights", with_("assertions") + "SELECT subject_id AS src, object AS dst, round(avg(confidence), 6) AS weight FROM assertions GROUP BY 1, 2")
def _(spark, d):
    return graph.weights(fx.assertions(spark, d))


@query("a7_u1_shared_entities", with_("assertions") + "SELECT entity_id, count(DISTINCT episode_id) AS n FROM (SELECT subject_id AS entity_id, episode_id FROM assertions UNION SELECT object, episode_id FROM assertions) GROUP BY 1 HAVING count(DISTINCT episode_id) >= 2")
def _(spark, d):
    a = fx.assertions(spark, d)
    both = a.select(F.col("subject_id").alias("entity_id"), "episode_id").union(a.select("object", "episode_id")).distinct()
    return both.groupBy("entity_id").agg(F.count("*").alias("n")).filter("n >= 2")


@query("a11_a14_calibration_gate", "SELECT source, round(greatest(0.1, least(2.0, 0.8 * p * (1 - f))), 6) AS calibration, p >= 0.9 AND r >= 0.7 AND f <= 0.0 AS passes FROM (SELECT source, avg((lang = 'en')::INT)::DOUBLE AS p, avg((n_chars > 100)::INT)::DOUBLE AS r, avg((n_chars < 50)::INT)::DOUBLE AS f FROM documents GROUP BY 1)")
def _(spark, d):
    from epistema.operators.extract import calibration, gate

    rate = lambda c: F.avg(c.cast("int"))
    rows = fx.table(spark, d, "documents").groupBy("source").agg(rate(F.col("lang") == "en").alias("p"), rate(F.col("n_chars") > 100).alias("r"), rate(F.col("n_chars") < 50).alias("f"))
    return rows.select("source", F.round(calibration(F.col("p"), F.col("f")), 6).alias("calibration"), gate(F.col("p"), F.col("r"), F.col("f")).alias("passes"))


@query("a12_u4_extraction_metrics", "WITH e AS (SELECT DISTINCT lower(role) AS a, conv_id AS b FROM conversations WHERE turn < 3), w AS (SELECT DISTINCT lower(role) AS a, conv_id AS b FROM conversations WHERE turn > 1), n AS (SELECT (SELECT count(*) FROM e) AS got, (SELECT count(*) FROM w) AS want, (SELECT count(*) FROM (SELECT * FROM e INTERSECT SELECT * FROM w)) AS both_) SELECT round(both_ / got, 6) AS precision, round(both_ / want, 6) AS recall, round(2 * (both_ / got) * (both_ / want) / (both_ / got + both_ / want), 6) AS f1 FROM n")
def _(spark, d):
    from epistema.operators.extract import metrics

    c = fx.table(spark, d, "conversations").select(F.col("role").alias("a"), F.col("conv_id").cast("string").alias("b"), "turn")
    return metrics(c.filter("turn < 3"), c.filter("turn > 1"), ["a", "b"])


@query("a13_fabrication_rate", "SELECT round(avg(CASE WHEN contains(text, lang) THEN 0.0 ELSE 1.0 END), 6)::DOUBLE AS fabrication_rate, count(*) AS n FROM documents")
def _(spark, d):
    from epistema.operators.extract import fabrication

    return fabrication(fx.table(spark, d, "documents"), "lang", "text")


@query("a15_job_states", "SELECT CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' THEN 'leased' ELSE 'queued' END AS state, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    s = F.col("o_orderstatus")
    return fx.table(spark, d, "orders").groupBy(F.when(s == "F", "done").when(s == "P", "leased").otherwise("queued").alias("state")).agg(F.count("*").alias("n"))


@query("a16_alias_collection", "SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_name)), '|') AS aliases FROM part GROUP BY 1")
def _(spark, d):
    return fx.table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_name")), "|").alias("aliases"))


@query("a19_gate_scores", "SELECT role AS category, turn % 2 AS arm, count(*) AS n, round(avg((contains(lower(text), 'the'))::INT), 6)::DOUBLE AS found, round(avg(greatest(1, floor(length(text) / 4))), 6) AS mean_tokens FROM conversations GROUP BY 1, 2")
def _(spark, d):
    return (
        fx.table(spark, d, "conversations")
        .groupBy(F.col("role").alias("category"), (F.col("turn") % 2).alias("arm"))
        .agg(F.count("*").alias("n"), F.round(F.avg(F.contains(F.lower("text"), F.lit("the")).cast("int")), 6).alias("found"), F.round(F.avg(sc.tokens(F.col("text"))), 6).alias("mean_tokens"))
    )


@query("w4_f24_latest_locator_state", "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY 1")
def _(spark, d):
    return rel.latest(fx.table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn")


@query("w5_sequence_numbers", "SELECT doc_id, source, CAST(100 + row_number() OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS seq FROM documents")
def _(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "source")
    return rel.numbered(docs, docs.select("source").distinct().withColumn("seq", F.lit(100)), "source", ["doc_id"])


@query("w7_running_budget", "SELECT conv_id, turn, used FROM (SELECT conv_id, turn, CAST(sum(greatest(1, floor(length(text) / 4))) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS used FROM conversations) WHERE used <= 300")
def _(spark, d):
    return pack.filled(fx.table(spark, d, "conversations"), 300, ["conv_id"], ["turn"], "text").select("conv_id", "turn", "used")


@query("w8_occurrence_chain", "SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS predecessor FROM conversations")
def _(spark, d):
    return rel.predecessors(fx.table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn", "turn")


@query("o1_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(spark, d):
    return fx.table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("o5_channel_overfetch", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS INTEGER) AS rank FROM orders QUALIFY rank < 8")
def _(spark, d):
    return graph.ranked(fx.table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).filter("rank < 8").select("o_custkey", "o_orderkey", "rank")


@query("o6_b3_p11_topic_search", "SELECT p_brand AS entity_id, min(p_name) AS surface FROM part WHERE contains(lower(p_name), 'ring') GROUP BY 1 ORDER BY 2, 1 LIMIT 10")
def _(spark, d):
    return pack.topic(fx.table(spark, d, "part").select(F.col("p_brand").alias("entity_id"), F.col("p_name").alias("surface")), "ring", 10)


@query("o8_lease_claim", "SELECT o_orderkey AS job_id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 10")
def _(spark, d):
    jobs = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("state"), F.lit(0).alias("attempts"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created_at"), F.lit(None).cast("long").alias("lease_until"))
    return pack.claim(jobs, 10, AT, 1000).filter("state = 'leased'").select("job_id")


@query("p10_live_entities", "SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 3")
def _(spark, d):
    return fx.table(spark, d, "customer").withColumn("merged_into", F.when(F.col("c_custkey") % 7 == 3, 0)).filter("merged_into is null").select("c_custkey")


@query("p12_scope_authorisation", with_("assertions") + "SELECT assertion_id FROM assertions WHERE trust = 'trusted' AND predicate = 'knows'")
def _(spark, d):
    scopes = spark.createDataFrame([("trusted", ["read"], None, ["knows"]), ("untrusted", ["write"], None, None), ("semi_trusted", ["read"], 1, None)], "space_id string, caps array<string>, expires_at long, predicates array<string>")
    return rel.authorised(fx.assertions(spark, d).withColumnRenamed("trust", "space_id"), scopes, "read", AT).select("assertion_id")


@query("p13_p14_best_surface", "SELECT c_nationkey AS entity_id, arg_min(c_name, (CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, c_name)) AS surface FROM customer GROUP BY 1")
def _(spark, d):
    k = F.col("c_custkey") % 3
    keys = fx.table(spark, d, "customer").select(F.col("c_nationkey").alias("entity_id"), F.col("c_name").alias("surface"), F.when(k == 0, "user_declared").when(k == 1, "extracted").otherwise("other").alias("origin"))
    return rel.best_surface(keys)


@query("p15_x13_literal_text", "SELECT event_id, json_extract_string(props, '$.k') AS value FROM events")
def _(spark, d):
    return fx.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("value"))


@query("s9_ledger_dedup_content", "SELECT source AS space_id, sha256(regexp_replace(text, '\\s+$', '')) AS content_hash FROM documents d WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM documents h WHERE h.doc_id % 2 = 0 AND h.source = d.source AND sha256(regexp_replace(h.text, '\\s+$', '')) = sha256(regexp_replace(d.text, '\\s+$', ''))) GROUP BY 1, 2")
def _(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", F.col("source").alias("space_id"), F.col("text").alias("content"))
    held = docs.filter("doc_id % 2 = 0").withColumn("content_hash", sc.content_hash(F.col("content"))).withColumn("seq", F.col("doc_id"))
    return ledger.insert_content(held, docs.filter("doc_id % 2 = 1")).select("space_id", "content_hash")


@query("s10_event_identity", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'insert' WHEN event_id % 3 = 1 THEN 'noop' ELSE 'conflict' END AS outcome FROM events")
def _(spark, d):
    e = fx.table(spark, d, "events").select("event_id", F.lit("s").alias("space_id"), F.col("event_type").alias("source_id"), F.col("event_id").alias("occurrence_id"), F.sha2(F.col("props"), 256).alias("content_hash"))
    held = e.filter("event_id % 3 > 0").withColumn("content_hash", F.when(F.col("event_id") % 3 == 1, F.col("content_hash")).otherwise(F.lit("x"))).drop("event_id")
    return ledger.insert_events(held, e).select("event_id", "outcome")


@query("s11_jsonl_export", """SELECT concat('{"row":{"r_name":"', r_name, '","r_regionkey":', r_regionkey, '},"table":"region"}') AS value FROM region UNION ALL SELECT concat('{"row":{"n_name":"', n_name, '","n_nationkey":', n_nationkey, ',"n_regionkey":', n_regionkey, '},"table":"nation"}') FROM nation""")
def _(spark, d):
    return ledger.export({n: fx.table(spark, d, n) for n in ("region", "nation")})


@query("s12_jsonl_import", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, d):
    lines = ledger.export({n: fx.table(spark, d, n) for n in ("region", "nation")})
    return ledger.load(lines, {"nation": "n_nationkey int, n_name string, n_regionkey int"})["nation"]


@query("s14_point_lookup", "SELECT doc_id, source FROM documents WHERE doc_id = 42")
def _(spark, d):
    return ledger.lookup(fx.table(spark, d, "documents"), doc_id=42).select("doc_id", "source")


@query("s15_truth_snapshot", None)
def _(spark, d):
    return ledger.snapshot({"assertions": visible(spark, d), "beliefs": beliefs(spark, d)})


@query("g8_episode_clusters", with_("assertions", extra="pairs AS (SELECT DISTINCT statement_id, episode_id FROM assertions WHERE predicate = 'born_in' AND subject_id IN ('user:1', 'user:2', 'user:3')),\nl AS (SELECT DISTINCT a.episode_id AS u, b.episode_id AS v FROM pairs a JOIN pairs b USING (statement_id)),\nwalk AS (SELECT u, v FROM l UNION SELECT w.u, l.v FROM walk w JOIN l ON w.v = l.u)") + "SELECT u AS id, min(v) AS component FROM walk GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    a = fx.assertions(spark, d).filter("predicate = 'born_in' and subject_id in ('user:1', 'user:2', 'user:3')")
    return graph.components(rel.support_links(a))


@query("g8_episode_clusters_all", None)
def _(spark, d):
    return graph.components(rel.support_links(fx.assertions(spark, d)))


@query("u6_conservation", "SELECT CAST(0 AS BIGINT) AS lost")
def _(spark, d):
    b = settled(beliefs(spark, d).select("statement_id", "valid_from", "confidence"))  # else folded three times
    kept, dropped = b.filter("confidence >= 0.3"), b.filter("confidence < 0.3")
    return rel.lost(b, kept.unionByName(dropped)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lost"))


@query("q2_job_transitions", "SELECT o_orderstatus, 'queued' AS state, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 UNION ALL SELECT o_orderstatus, 'done', count(*) FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def _(spark, d):
    o = fx.table(spark, d, "orders")
    jobs = o.select("o_orderstatus", F.when(F.col("o_orderstatus") == "P", "leased").otherwise("done").alias("state"), F.lit(1).alias("attempts"), F.lit(5).cast("long").alias("lease_until"))
    return pack.reclaim(jobs, AT).groupBy("o_orderstatus", "state").agg(F.count("*").alias("n"))


@query("w6_rank_in_channel", "SELECT l_suppkey, l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) - 1 AS INTEGER) AS rank FROM lineitem QUALIFY rank < 3")
def _(spark, d):
    order = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    return fx.table(spark, d, "lineitem").withColumn("rank", F.row_number().over(order) - 1).filter("rank < 3").select("l_suppkey", "l_orderkey", "l_linenumber", "rank")
