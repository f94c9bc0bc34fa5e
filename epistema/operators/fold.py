"""Folding assertions into beliefs: visibility, coalescing, denial, cross-object rules, support and confidence.

``assertions`` have: subject_id, predicate, object, statement_id, episode_id, extractor_id, polarity,
claimed_from, claimed_to, confidence, recorded_at, retracted_at, trust. The fold is a fixed
sequence of shuffles on the statement and on its (subject, predicate) group, so it grows with
the assertions; only the ontology is broadcast, and only up to a number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epistema.operators import intervals
from epistema.plans.storage import small

GROUP = ["subject_id", "predicate"]
#: Weights of trust tiers, and the multiplier of extractors without measurements.
TRUST = {"trusted": 1.0, "semi_trusted": 0.7, "untrusted": 0.3}
CALIBRATION = 0.8


def visible_at(at: Column | int) -> Column:
    """Recorded by ``at`` and not retracted by then."""
    at = at if isinstance(at, Column) else F.lit(at)
    return (F.col("recorded_at") <= at) & (F.col("retracted_at").isNull() | (F.col("retracted_at") > at))


def held(visible: DataFrame) -> DataFrame:
    """Intervals in which a statement is affirmed and not denied: group, statement_id, start, end."""
    spans = visible.select(*GROUP, "statement_id", "polarity", F.col("claimed_from").alias("start"), F.col("claimed_to").alias("end"))
    return intervals.signed(spans, [*GROUP, "statement_id"], "polarity")


def statuses(rows: DataFrame) -> DataFrame:
    """Rows (group, statement_id, start, end, rule) with their status, and ends cut where another statement supersedes.

    supersede: a later start of another statement closes the one before; equal starts contradict.
    contradiction: statements with an interval that overlaps another statement's are contradicted throughout.
    independent: all are active. One exchange by group serves all three.
    """
    order = Window.partitionBy(*GROUP).orderBy("start", "statement_id")
    other = lambda c: F.coalesce(c != F.col("statement_id"), F.lit(False))
    before, after = F.lag("statement_id").over(order), F.lead("statement_id").over(order)
    same_start = (other(before) & (F.lag("start").over(order) == F.col("start"))) | (other(after) & (F.lead("start").over(order) == F.col("start")))
    closed = other(after) & (F.col("end") >= F.lead("start").over(order))
    rows = rows.select("*", same_start.alias("__same"), closed.alias("__closed"), F.lead("start").over(order).alias("__next"), intervals.clashes(GROUP, "start", "end", "statement_id").alias("__clash"))
    rows = rows.withColumn("__bad", F.max("__clash").over(Window.partitionBy(*GROUP, "statement_id")))
    supersede = F.when(F.col("__same"), "contradicted").when(F.col("__closed"), "superseded").otherwise("active")
    status = F.when(F.col("rule") == "supersede", supersede).when((F.col("rule") == "contradiction") & F.col("__bad"), "contradicted").otherwise("active")
    rows = rows.withColumn("status", status)
    return rows.withColumn("end", F.when(F.col("status") == "superseded", F.col("__next") - 1).otherwise(F.col("end"))).drop("__same", "__closed", "__next", "__clash", "__bad")


def support(visible: DataFrame) -> DataFrame:
    """Per statement: affirmations, denials, distinct episodes, episodes by trust tier, and what confidence needs."""
    first = visible.groupBy("statement_id", "episode_id").agg(
        F.sum(F.when(F.col("polarity") > 0, 1).otherwise(0)).alias("affirm"),
        F.sum(F.when(F.col("polarity") < 0, 1).otherwise(0)).alias("deny"),
        F.max("confidence").alias("top"),
        F.min("trust").alias("trust"),
        F.min("extractor_id").alias("extractor"),
        F.count("extractor_id").alias("extracted"),
    )
    tiers = [F.sum(F.when(F.col("trust") == t, 1).otherwise(0)).alias(f"n_{t}") for t in TRUST]
    return first.groupBy("statement_id").agg(
        F.sum("affirm").alias("affirm_count"), F.sum("deny").alias("deny_count"), F.count("*").alias("distinct_episodes"), *tiers, F.max("top").alias("raw"), F.min("extractor").alias("extractor_id"), F.sum("extracted").alias("n_extracted")
    )


def confidence(prior: Column, calibration: DataFrame | None = None) -> Column:
    """Confidence of a belief from the columns of ``support``; declarations alone are certain."""
    n = F.greatest(F.col("distinct_episodes"), F.lit(1))
    corroboration = F.greatest(F.lit(0.5), F.least(F.lit(1.0), 1 - F.exp(-0.3 * n)))
    weighted = sum((F.col(f"n_{t}") * w for t, w in TRUST.items()), F.lit(0.0)) / F.col("distinct_episodes")
    trust = F.greatest(F.lit(0.3), F.least(F.lit(1.0), weighted))
    multiplier = F.coalesce(F.col("calibration"), F.lit(CALIBRATION)) if calibration is not None else F.lit(CALIBRATION)
    out = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw") * prior * multiplier * corroboration * trust))
    return F.when(F.col("n_extracted") == 0, 1.0).otherwise(out)


def rule(cardinality: Column, temporality: Column, invalidation: Column) -> Column:
    """Which cross-object rule a predicate follows; a static predicate contradicts whatever its invalidation."""
    return F.when(cardinality == "multi", "independent").when(temporality == "static", "contradiction").when(invalidation == "supersede", "supersede").otherwise("independent")


def fold(assertions: DataFrame, ontology: DataFrame, at: Column | int | None = None, calibration: DataFrame | None = None) -> DataFrame:
    """Beliefs of every statement as known at ``at`` (all that is recorded if None).

    Columns: group, statement_id, valid_from, valid_to, status, confidence, and support's counts.
    calibration: (extractor_id, calibration); others have the default.
    """
    visible = assertions if at is None else assertions.filter(visible_at(at))
    # one exchange by statement serves intervals, support and their join
    visible = visible.repartition("statement_id")
    defs = ontology.select(F.col("name").alias("predicate"), rule(F.col("cardinality"), F.col("temporality"), F.col("invalidation")).alias("rule"), "prior")
    counts = support(visible)
    if calibration is not None:
        counts = counts.join(calibration, "extractor_id", "left")
    rows = held(visible).join(counts, "statement_id").join(small(defs), "predicate")
    out = statuses(rows)
    return out.select(*GROUP, "statement_id", F.col("start").alias("valid_from"), F.col("end").alias("valid_to"), "status", F.round(confidence(F.col("prior"), calibration), 6).alias("confidence"), "affirm_count", "deny_count", "distinct_episodes", *(f"n_{t}" for t in TRUST))


def refold(beliefs: DataFrame, assertions: DataFrame, touched: DataFrame, ontology: DataFrame, at: Column | int | None = None) -> DataFrame:
    """Beliefs with those of the touched groups (subject_id, predicate) folded anew."""
    keys = touched.select(*GROUP).distinct()
    return beliefs.join(keys, GROUP, "left_anti").unionByName(fold(assertions.join(keys, GROUP, "left_semi"), ontology, at))
