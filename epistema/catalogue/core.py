"""Fold and temporal queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistema import fixtures as fx
from epistema.catalogue import query
from epistema.fixtures import AT, DAY, FOLD, VALID, with_
from epistema.operators import fold, intervals, redact, temporal
from epistema.operators import relational as rel
from epistema.schema import ontology

BELIEF = ["subject_id", "predicate", "statement_id", "valid_from", "valid_to", "status", "confidence", "affirm_count", "deny_count", "distinct_episodes", "n_trusted", "n_semi_trusted", "n_untrusted"]
_ALL = ", ".join(BELIEF)


def beliefs(spark, d: str) -> DataFrame:
    return fold.fold(fx.assertions(spark, d), ontology(spark), AT)


def visible(spark, d: str) -> DataFrame:
    return fx.assertions(spark, d).filter(fold.visible_at(AT))


@query("p1_visible_assertions", with_("assertions", "visible") + "SELECT assertion_id, statement_id, recorded_at, retracted_at FROM visible")
def _(spark, d):
    return visible(spark, d).select("assertion_id", "statement_id", "recorded_at", "retracted_at")


@query("p2_valid_point", with_("assertions", "visible") + f"SELECT assertion_id, subject_id, predicate, object FROM visible WHERE claimed_from <= {VALID} AND claimed_to >= {VALID}")
def _(spark, d):
    return visible(spark, d).filter(rel.valid_at(VALID, "claimed_from", "claimed_to")).select("assertion_id", "subject_id", "predicate", "object")


@query("p3_valid_range", with_("assertions") + f"SELECT assertion_id, claimed_from, claimed_to FROM assertions WHERE claimed_from <= {VALID + DAY} AND claimed_to >= {VALID}")
def _(spark, d):
    return fx.assertions(spark, d).filter(rel.valid_within(VALID, VALID + DAY, "claimed_from", "claimed_to")).select("assertion_id", "claimed_from", "claimed_to")


@query("p4_known_at", with_("assertions") + f"SELECT assertion_id, retracted_at FROM assertions WHERE recorded_at <= {VALID} AND coalesce(retracted_at > {VALID}, true)")
def _(spark, d):
    return fx.assertions(spark, d).filter(fold.visible_at(VALID)).select("assertion_id", "retracted_at")


@query("p5_p6_p7_confidence_trust_predicate", with_("assertions") + "SELECT assertion_id, confidence, trust, predicate FROM assertions WHERE confidence >= 0.7 AND trust NOT IN ('untrusted') AND predicate IN ('knows', 'works_on')")
def _(spark, d):
    return fx.assertions(spark, d).filter(rel.confident(0.7) & rel.trusted(["untrusted"]) & rel.allowed(["knows", "works_on"])).select("assertion_id", "confidence", "trust", "predicate")


@query("w1_interval_coalesce", with_("assertions", "visible", "islands") + "SELECT statement_id, polarity, s AS start, e AS \"end\" FROM islands")
def _(spark, d):
    rows = visible(spark, d).select("statement_id", "polarity", F.col("claimed_from").alias("start"), F.col("claimed_to").alias("end"))
    return intervals.coalesce(rows, ["statement_id", "polarity"])


@query("f2_interval_clip_denials", with_("assertions", "visible", "islands", "held") + "SELECT statement_id, s AS start, e AS \"end\" FROM held WHERE predicate = 'employed_by'")
def _(spark, d):
    return fold.held(visible(spark, d).filter("predicate = 'employed_by'")).select("statement_id", "start", "end")


@query("j8_interval_overlap", with_("assertions", "visible", "islands", "held") + "SELECT DISTINCT a.subject_id, a.predicate, a.statement_id FROM held a JOIN held b ON a.subject_id = b.subject_id AND a.predicate = b.predicate AND a.statement_id <> b.statement_id AND a.s <= b.e AND b.s <= a.e")
def _(spark, d):
    return intervals.overlapping(fold.held(visible(spark, d)), fold.GROUP, "statement_id")


@query("f1_fold_all_predicates", with_(*FOLD) + f"SELECT {_ALL} FROM beliefs")
def _(spark, d):
    return beliefs(spark, d).select(BELIEF)


for _key, _names in {"f3_fold_independent": ("works_on", "knows"), "f4_w2_fold_supersede": ("employed_by",), "f5_f6_fold_contradiction": ("born_in",)}.items():

    @query(_key, with_(*FOLD) + f"SELECT {_ALL} FROM beliefs WHERE predicate IN ({', '.join(repr(n) for n in _names)})")
    def _(spark, d, names=_names):
        return fold.fold(fx.assertions(spark, d).filter(rel.allowed(list(names))), ontology(spark), AT).select(BELIEF)


@query("f7_group_fetch", with_("assertions") + "SELECT subject_id, predicate, count(DISTINCT statement_id) AS n_statements, count(*) AS n_assertions FROM assertions GROUP BY ALL")
def _(spark, d):
    return fx.assertions(spark, d).groupBy(*fold.GROUP).agg(F.countDistinct("statement_id").alias("n_statements"), F.count("*").alias("n_assertions"))


@query("f8_refold_touched", with_(*FOLD) + f"SELECT {_ALL} FROM beliefs")
def _(spark, d):
    a = fx.assertions(spark, d)
    touched = a.filter("assertion_id % 10 = 0").select(*fold.GROUP)
    stale = fold.fold(a.filter("assertion_id % 10 <> 0"), ontology(spark), AT)
    return fold.refold(stale, a, touched, ontology(spark), AT).select(BELIEF)


@query("a8_belief_support", with_("assertions", "visible", "support") + "SELECT statement_id, affirm_count, deny_count, distinct_episodes, n_trusted, n_semi_trusted, n_untrusted FROM support")
def _(spark, d):
    return fold.support(visible(spark, d)).select("statement_id", "affirm_count", "deny_count", "distinct_episodes", "n_trusted", "n_semi_trusted", "n_untrusted")


@query("a9_belief_confidence", with_(*FOLD) + "SELECT statement_id, max(confidence) AS confidence FROM beliefs GROUP BY statement_id")
def _(spark, d):
    return beliefs(spark, d).groupBy("statement_id").agg(F.max("confidence").alias("confidence"))


@query("f11_beliefs_as_of_bitemporal", with_(*FOLD) + f"SELECT {_ALL} FROM beliefs WHERE valid_from <= {VALID} AND valid_to >= {VALID}")
def _(spark, d):
    return temporal.beliefs_as_of(fx.assertions(spark, d), ontology(spark), VALID, AT).select(BELIEF)


@query(
    "f12_contradiction_details",
    with_(*FOLD)
    + """SELECT subject_id, predicate, statement_id, coalesce(array_to_string(list_sort(list(DISTINCT episode_id) FILTER (WHERE polarity = 1)), ','), '') AS affirmed_by,
 coalesce(array_to_string(list_sort(list(DISTINCT episode_id) FILTER (WHERE polarity = -1)), ','), '') AS denied_by
FROM visible WHERE statement_id IN (SELECT statement_id FROM beliefs WHERE status = 'contradicted') GROUP BY subject_id, predicate, statement_id""",
)
def _(spark, d):
    return temporal.contradictions(beliefs(spark, d), visible(spark, d))


@query("f13_retract", with_("assertions") + f"SELECT assertion_id, CASE WHEN object = 'obj:1' AND retracted_at IS NULL THEN {AT} ELSE retracted_at END AS retracted_at FROM assertions")
def _(spark, d):
    return fx.assertions(spark, d).select("assertion_id", F.when((F.col("object") == "obj:1") & F.col("retracted_at").isNull(), F.lit(AT)).otherwise(F.col("retracted_at")).alias("retracted_at"))


@query("f21_ontology_rules", with_("ontology") + "SELECT name, CASE WHEN cardinality = 'multi' THEN 'independent' WHEN temporality = 'static' THEN 'contradiction' WHEN invalidation = 'supersede' THEN 'supersede' ELSE 'independent' END AS rule, prior::DOUBLE AS prior FROM ontology")
def _(spark, d):
    return ontology(spark).select("name", fold.rule(F.col("cardinality"), F.col("temporality"), F.col("invalidation")).alias("rule"), "prior")


@query("t1_timeline", with_(*FOLD) + f"SELECT b.predicate, b.statement_id, valid_from, valid_to, status, b.confidence, r.recorded_at FROM beliefs b LEFT JOIN (SELECT statement_id, max(recorded_at) AS recorded_at FROM assertions GROUP BY 1) r USING (statement_id) WHERE subject_id = 'user:8' AND valid_from <= {VALID + DAY} AND valid_to >= {VALID - DAY}")
def _(spark, d):
    return temporal.timeline(beliefs(spark, d), fx.assertions(spark, d), "user:8", VALID - DAY, VALID + DAY)


@query(
    "t2_u5_belief_diff",
    with_(
        *FOLD,
        extra=f"""x AS (SELECT statement_id, arg_max(status, (valid_from, status)) AS status, max(valid_from) AS vf FROM beliefs WHERE valid_from <= {VALID - 5 * DAY} AND valid_to >= {VALID - 5 * DAY} GROUP BY 1),
y AS (SELECT statement_id, arg_max(status, (valid_from, status)) AS status, max(valid_from) AS vf FROM beliefs WHERE valid_from <= {VALID} AND valid_to >= {VALID} GROUP BY 1)""",
    )
    + """SELECT * FROM (SELECT coalesce(x.statement_id, y.statement_id) AS statement_id, CASE WHEN x.statement_id IS NULL THEN 'added' WHEN y.statement_id IS NULL THEN 'removed' WHEN x.status <> y.status OR x.vf <> y.vf THEN 'changed' END AS change, x.status AS status_before, y.status AS status_after
FROM x FULL JOIN y ON x.statement_id = y.statement_id) WHERE change IS NOT NULL""",
)
def _(spark, d):
    return temporal.difference(beliefs(spark, d), VALID - 5 * DAY, VALID)


@query(
    "t3_why_statement",
    with_(*FOLD)
    + """SELECT statement_id, status, valid_from, raw, affirmed, denied, episodes FROM (SELECT statement_id, arg_max(status, valid_from) AS status, max(valid_from) AS valid_from FROM beliefs GROUP BY 1)
JOIN (SELECT statement_id, arg_min(confidence, (recorded_at, assertion_id)) AS raw, CAST(sum(CASE WHEN polarity > 0 THEN 1 ELSE 0 END) AS BIGINT) AS affirmed, CAST(sum(CASE WHEN polarity < 0 THEN 1 ELSE 0 END) AS BIGINT) AS denied, array_to_string(list_sort(list(DISTINCT episode_id)), ',') AS episodes FROM visible GROUP BY 1) USING (statement_id)""",
)
def _(spark, d):
    return temporal.why(beliefs(spark, d), visible(spark, d))


@query("t4_content_ids", "SELECT doc_id, sha256(concat_ws('|', 'episode', source, doc_id)) AS id FROM documents")
def _(spark, d):
    from epistema.functions.scalars import content_id

    return fx.table(spark, d, "documents").select("doc_id", content_id("episode", F.col("source"), F.col("doc_id").cast("string")).alias("id"))


@query("w3_latest_belief", with_(*FOLD) + "SELECT statement_id, max(valid_from) AS valid_from, arg_max(status, valid_from) AS status FROM beliefs GROUP BY 1")
def _(spark, d):
    return rel.latest(beliefs(spark, d).select("statement_id", "valid_from", "status"), ["statement_id"], "valid_from")


@query(
    "f10_f14_merge_closure",
    """WITH RECURSIVE ev AS (SELECT c_custkey AS loser, CAST(floor(c_custkey / 2) AS BIGINT) AS winner, c_custkey % 7 = 0 AS undone FROM customer WHERE c_custkey > 0),
m AS (SELECT loser, winner FROM ev WHERE NOT undone), walk AS (SELECT loser AS entity_id, winner AS canonical FROM m UNION ALL SELECT w.entity_id, m.winner FROM walk w JOIN m ON w.canonical = m.loser)
SELECT entity_id, min(canonical) AS canonical FROM walk GROUP BY 1""",
)
def _(spark, d):
    key = F.col("c_custkey")
    events = fx.table(spark, d, "customer").filter("c_custkey > 0").select(key.alias("loser"), F.floor(key / 2).cast("long").alias("winner"), F.lit(1).alias("decided_at"), F.when(key % 7 == 0, 2).alias("undone_at"))
    return temporal.merge_closure(temporal.merges_in_force(events))


#: Assertions that declarations make: an episode each, certain, from no extractor.
DECLARED = "SELECT assertion_id, subject_id, {0} AS predicate, object, sha256(concat_ws('|', 's', subject_id, {0}, object)) AS statement_id, assertion_id AS episode_id, NULL::VARCHAR AS extractor_id, polarity, claimed_from, claimed_to, 1.0 AS confidence, recorded_at, NULL::BIGINT AS retracted_at, trust FROM raw"


@query("f18_reproject", fx.refolded(DECLARED.format("predicate")) + f"SELECT {_ALL} FROM beliefs")
def _(spark, d):
    from epistema.plans.rebuild import rebuild

    a = fx.assertions(spark, d)
    log = a.select(F.col("assertion_id").alias("seq"), F.lit("add_statement").alias("op"), "subject_id", "predicate", "object", "polarity", F.col("claimed_from").alias("valid_from"), F.col("claimed_to").alias("valid_to"), F.col("recorded_at").alias("at"), "trust")
    return rebuild(log, ontology(spark)).beliefs.select(BELIEF)


_EP = "SELECT DISTINCT episode_id FROM assertions WHERE episode_id % 50 = 0"


@query("j5_unsupported_statements", with_("assertions") + f"SELECT DISTINCT statement_id FROM assertions a WHERE episode_id IN ({_EP}) AND NOT EXISTS (SELECT 1 FROM assertions b WHERE b.statement_id = a.statement_id AND b.episode_id NOT IN ({_EP}))")
def _(spark, d):
    a = fx.assertions(spark, d)
    return redact.unsupported(a, a.filter("episode_id % 50 = 0"))


@query(
    "f19_redaction_closure",
    with_("assertions")
    + """SELECT 'assertion' AS kind, CAST(assertion_id AS VARCHAR) AS id FROM assertions WHERE subject_id = 'user:8' AND predicate = 'knows'
UNION ALL SELECT DISTINCT 'statement', statement_id FROM assertions WHERE subject_id = 'user:8' AND predicate = 'knows'""",
)
def _(spark, d):
    return redact.closure(fx.assertions(spark, d), entity="user:8", predicate="knows")


@query("f20_redaction_refold", with_(*FOLD).replace("events0", "events").replace("FROM assertions WHERE recorded_at", "FROM assertions WHERE episode_id % 50 <> 0 AND recorded_at") + f"SELECT {_ALL} FROM beliefs")
def _(spark, d):
    a = fx.assertions(spark, d)
    closed = redact.closure(a, a.filter("episode_id % 50 = 0"))
    return redact.execute(a, beliefs(spark, d), ontology(spark), closed, AT)[1].select(BELIEF)


@query(
    "a10_uncertainty_score",
    with_(*FOLD, extra=f"ages AS (SELECT subject_id, ({AT} - min(recorded_at)) / {float(DAY)} AS age FROM visible GROUP BY 1)")
    + """SELECT subject_id, total, round(0.4 * c / total + 0.25 * si / total + 0.15 * greatest(0, least(1, age / 365.0)) + 0.2 * u / total, 6) AS uncertainty FROM (
 SELECT subject_id, count(*) AS total, sum((status = 'contradicted')::INT) AS c, sum((distinct_episodes = 1)::INT) AS si, sum((n_untrusted > 0)::INT) AS u FROM beliefs GROUP BY 1) JOIN ages USING (subject_id)""",
)
def _(spark, d):
    ages = visible(spark, d).groupBy("subject_id").agg(((F.lit(AT) - F.min("recorded_at")) / float(DAY)).alias("age_days"))
    return temporal.uncertainty(beliefs(spark, d), ages, "subject_id")


@query("x7_l1_salience_decay", with_("assertions") + f"SELECT subject_id, max(recorded_at) AS last_activity, round(greatest(0.05, exp(-0.01 * greatest(0.0, ({AT} + {40 * DAY} - max(recorded_at)) / {float(DAY)}))), 6) AS salience FROM assertions GROUP BY 1")
def _(spark, d):
    from epistema.operators.pack import decay

    return decay(fx.assertions(spark, d), AT + 40 * DAY, DAY)
