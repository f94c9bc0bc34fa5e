"""Ledger tables derived from the driver's tables, for Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epistema.functions.scalars import content_id
from epistema.schema import ONTOLOGY, TIME_MAX

#: Transaction time and valid time at which the queries ask, in microseconds (2024-01-20 and 2024-01-15).
AT, VALID = 1705708800000000, 1705276800000000
DAY = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    predicate = F.when(kind == "click", "works_on").when(kind == "view", "knows").when(kind == "signup", "born_in").otherwise("employed_by")
    e = e.select("event_id", "user_id", "event_type", us.alias("us"), k.alias("k"), predicate.alias("predicate"))
    subject, obj = F.concat(F.lit("user:"), F.col("user_id").cast("string")), F.concat(F.lit("obj:"), (F.col("k") % 5).cast("string"))
    e = e.withColumn("subject_id", subject).withColumn("object", obj)
    deny = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("assertion_id"),
        "subject_id",
        "predicate",
        "object",
        content_id("s", F.col("subject_id"), F.col("predicate"), F.col("object")).alias("statement_id"),
        F.floor(F.col("event_id") / 3).cast("long").alias("episode_id"),
        F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("x"), (F.col("event_id") % 2).cast("string"))).alias("extractor_id"),
        F.when(deny, -1).otherwise(1).alias("polarity"),
        F.col("us").alias("claimed_from"),
        F.when(deny, F.col("us") + DAY // 2).when(F.col("event_id") % 4 == 0, TIME_MAX).otherwise(F.col("us") + 3 * DAY).alias("claimed_to"),
        F.round(0.5 + (F.col("k") % 50) / 100.0, 2).alias("confidence"),
        F.col("us").alias("recorded_at"),
        F.when(F.col("event_id") % 29 == 0, F.col("us") + 2 * DAY).alias("retracted_at"),
        F.when(F.col("user_id") % 10 < 7, "trusted").when(F.col("user_id") % 10 < 9, "semi_trusted").otherwise("untrusted").alias("trust"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges (src, dst, predicate) between customers, suppliers, nations and regions."""
    c, s, n = (table(spark, sf_dir, x) for x in ("customer", "supplier", "nation"))
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    name = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    buys = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(name("c:", "o_custkey").alias("src"), name("s:", "l_suppkey").alias("dst"), F.lit("buys_from").alias("predicate"))
    out = c.select(name("c:", "c_custkey").alias("src"), name("n:", "c_nationkey").alias("dst"), F.lit("located_in").alias("predicate"))
    out = out.unionByName(s.select(name("s:", "s_suppkey").alias("src"), name("n:", "s_nationkey").alias("dst"), F.lit("located_in").alias("predicate")))
    out = out.unionByName(n.select(name("n:", "n_nationkey").alias("src"), name("r:", "n_regionkey").alias("dst"), F.lit("part_of").alias("predicate")))
    return out.unionByName(buys).distinct()


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trust policies of sources: two half-open intervals for each supplier."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("source_id"), (F.col("s_suppkey") % 2).alias("odd"))
    first = s.select("source_id", F.when(F.col("odd") == 0, "trusted").otherwise("semi_trusted").alias("trust"), F.lit(VALID - 10 * DAY).alias("effective_from"), F.when(F.col("odd") == 1, VALID).alias("effective_to"))
    second = s.select("source_id", F.lit("untrusted").alias("trust"), F.lit(VALID).alias("effective_from"), F.lit(None).cast("long").alias("effective_to"))
    return first.unionByName(second)


def _ontology_sql() -> str:
    rows = ", ".join(f"('{r[0]}', '{r[3]}', '{r[4]}', '{r[5]}', {str(r[8]).lower()}, {r[9]})" for r in ONTOLOGY)
    return f"ontology(name, cardinality, temporality, invalidation, profile, prior) AS (VALUES {rows})"


#: Expressions by name, in the order in which they may refer to each other.
SQL = {
    "ontology": _ontology_sql(),
    "assertions": f"""assertions AS (
  SELECT event_id AS assertion_id, subject_id, predicate, object, sha256(concat_ws('|', 's', subject_id, predicate, object)) AS statement_id,
    CAST(floor(event_id / 3) AS BIGINT) AS episode_id, CASE WHEN event_id % 11 <> 0 THEN concat('x', event_id % 2) END AS extractor_id,
    CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS polarity, us AS claimed_from,
    CASE WHEN event_type = 'error' THEN us + {DAY // 2} WHEN event_id % 4 = 0 THEN {TIME_MAX} ELSE us + {3 * DAY} END AS claimed_to,
    round(0.5 + (k % 50) / 100.0, 2)::DOUBLE AS confidence, us AS recorded_at, CASE WHEN event_id % 29 = 0 THEN us + {2 * DAY} END AS retracted_at,
    CASE WHEN user_id % 10 < 7 THEN 'trusted' WHEN user_id % 10 < 9 THEN 'semi_trusted' ELSE 'untrusted' END AS trust
  FROM (SELECT *, concat('user:', user_id) AS subject_id, concat('obj:', k % 5) AS object,
      CASE event_type WHEN 'click' THEN 'works_on' WHEN 'view' THEN 'knows' WHEN 'signup' THEN 'born_in' ELSE 'employed_by' END AS predicate
    FROM (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)))""",
    "visible": f"visible AS (SELECT * FROM assertions WHERE recorded_at <= {AT} AND (retracted_at IS NULL OR retracted_at > {AT}))",
    "islands": """islands AS (
  SELECT subject_id, predicate, statement_id, polarity, min(claimed_from) AS s, max(claimed_to) AS e
  FROM (SELECT *, sum(CASE WHEN reach IS NULL OR claimed_from > reach THEN 1 ELSE 0 END) OVER (PARTITION BY statement_id, polarity ORDER BY claimed_from, claimed_to ROWS UNBOUNDED PRECEDING) AS island
    FROM (SELECT *, max(claimed_to) OVER (PARTITION BY statement_id, polarity ORDER BY claimed_from, claimed_to ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM visible))
  GROUP BY subject_id, predicate, statement_id, polarity, island)""",
    "held": """met AS (
  SELECT a.subject_id, a.predicate, a.statement_id, a.s, a.e, d.s AS ds, d.e AS de FROM islands a JOIN islands d ON a.statement_id = d.statement_id AND a.polarity = 1 AND d.polarity = -1 AND d.s <= a.e AND d.e >= a.s),
held AS (
  SELECT subject_id, predicate, statement_id, coalesce(lag(de) OVER (PARTITION BY statement_id, s, e ORDER BY ds) + 1, s) AS s, ds - 1 AS e FROM met
  QUALIFY coalesce(lag(de) OVER (PARTITION BY statement_id, s, e ORDER BY ds) + 1, s) <= ds - 1
  UNION ALL SELECT subject_id, predicate, statement_id, max(de) + 1, e FROM met GROUP BY subject_id, predicate, statement_id, s, e HAVING max(de) < e
  UNION ALL SELECT subject_id, predicate, statement_id, s, e FROM islands a WHERE polarity = 1 AND NOT EXISTS (SELECT 1 FROM met m WHERE m.statement_id = a.statement_id AND m.s = a.s AND m.e = a.e))""",
    "support": """support AS (
  SELECT statement_id, CAST(sum(affirm) AS BIGINT) AS affirm_count, CAST(sum(deny) AS BIGINT) AS deny_count, count(*) AS distinct_episodes,
    CAST(sum(CASE WHEN trust = 'trusted' THEN 1 ELSE 0 END) AS BIGINT) AS n_trusted, CAST(sum(CASE WHEN trust = 'semi_trusted' THEN 1 ELSE 0 END) AS BIGINT) AS n_semi_trusted,
    CAST(sum(CASE WHEN trust = 'untrusted' THEN 1 ELSE 0 END) AS BIGINT) AS n_untrusted, max(top) AS raw, sum(extracted) AS n_extracted
  FROM (SELECT statement_id, episode_id, sum(CASE WHEN polarity > 0 THEN 1 ELSE 0 END) AS affirm, sum(CASE WHEN polarity < 0 THEN 1 ELSE 0 END) AS deny, max(confidence) AS top, min(trust) AS trust, count(extractor_id) AS extracted
    FROM visible GROUP BY statement_id, episode_id) GROUP BY statement_id)""",
    "beliefs": """ruled AS (
  SELECT h.*, o.prior, CASE WHEN cardinality = 'multi' THEN 'independent' WHEN temporality = 'static' THEN 'contradiction' WHEN invalidation = 'supersede' THEN 'supersede' ELSE 'independent' END AS rule
  FROM held h JOIN ontology o ON h.predicate = o.name),
near AS (
  SELECT *, lag(statement_id) OVER w AS ps, lag(s) OVER w AS pt, lead(statement_id) OVER w AS ns, lead(s) OVER w AS nt FROM ruled WHERE rule = 'supersede' WINDOW w AS (PARTITION BY subject_id, predicate ORDER BY s, statement_id)),
bad AS (
  SELECT DISTINCT a.statement_id FROM ruled a JOIN ruled b ON a.rule = 'contradiction' AND b.rule = 'contradiction' AND a.subject_id = b.subject_id AND a.predicate = b.predicate AND a.statement_id <> b.statement_id AND a.s <= b.e AND b.s <= a.e),
statuses AS (
  SELECT subject_id, predicate, statement_id, s, e, 'active' AS status, prior FROM ruled WHERE rule = 'independent'
  UNION ALL SELECT subject_id, predicate, statement_id, s, e, CASE WHEN statement_id IN (SELECT statement_id FROM bad) THEN 'contradicted' ELSE 'active' END, prior FROM ruled WHERE rule = 'contradiction'
  UNION ALL SELECT subject_id, predicate, statement_id, s, CASE WHEN status = 'superseded' THEN nt - 1 ELSE e END, status, prior FROM (
    SELECT *, CASE WHEN coalesce(ps <> statement_id AND pt = s, false) OR coalesce(ns <> statement_id AND nt = s, false) THEN 'contradicted' WHEN coalesce(ns <> statement_id AND e >= nt, false) THEN 'superseded' ELSE 'active' END AS status FROM near)),
beliefs AS (
  SELECT b.subject_id, b.predicate, b.statement_id, b.s AS valid_from, b.e AS valid_to, b.status,
    round(CASE WHEN n_extracted = 0 THEN 1.0 ELSE greatest(0.0, least(1.0, raw * prior * 0.8 * greatest(0.5, least(1.0, 1 - exp(-0.3 * greatest(distinct_episodes, 1)))) * greatest(0.3, least(1.0, (n_trusted * 1.0 + n_semi_trusted * 0.7 + n_untrusted * 0.3) / distinct_episodes)))) END::DOUBLE, 6) AS confidence,
    affirm_count, deny_count, distinct_episodes, n_trusted, n_semi_trusted, n_untrusted
  FROM statuses b JOIN support USING (statement_id))""",
    "edges": """edges AS (
  SELECT concat('c:', c_custkey) AS src, concat('n:', c_nationkey) AS dst, 'located_in' AS predicate FROM customer
  UNION SELECT concat('s:', s_suppkey), concat('n:', s_nationkey), 'located_in' FROM supplier
  UNION SELECT concat('n:', n_nationkey), concat('r:', n_regionkey), 'part_of' FROM nation
  UNION SELECT concat('c:', o_custkey), concat('s:', l_suppkey), 'buys_from' FROM orders JOIN lineitem ON o_orderkey = l_orderkey)""",
    "policies": f"""policies AS (
  SELECT concat('s:', s_suppkey) AS source_id, CASE WHEN s_suppkey % 2 = 0 THEN 'trusted' ELSE 'semi_trusted' END AS trust, {VALID - 10 * DAY} AS effective_from, CASE WHEN s_suppkey % 2 = 1 THEN {VALID} END AS effective_to FROM supplier
  UNION ALL SELECT concat('s:', s_suppkey), 'untrusted', {VALID}, NULL FROM supplier)""",
}
FOLD = ("ontology", "assertions", "visible", "islands", "held", "support", "beliefs")


def with_(*names: str, extra: str = "") -> str:
    """WITH clause of the named expressions."""
    parts = [SQL[n] for n in SQL if n in names] + ([extra] if extra else [])
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def refolded(assertions: str | None = None, visible: str = "SELECT * FROM assertions", predicates: str = "") -> str:
    """WITH clause of the fold over other assertions: a query on ``raw``, the fixture's; all that is recorded counts unless ``visible`` says otherwise."""
    parts = {n: SQL[n] for n in SQL if n in FOLD}
    if assertions is not None:
        parts["assertions"] = parts["assertions"].replace("assertions AS (", "raw AS (", 1) + f",\nassertions AS ({assertions})"
    if predicates:
        parts["ontology"] = parts["ontology"][:-1] + f", {predicates})"
    parts["visible"] = f"visible AS ({visible})"
    return "WITH RECURSIVE " + ",\n".join(parts.values()) + "\n"
