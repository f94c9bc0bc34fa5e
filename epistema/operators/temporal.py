"""Questions about beliefs over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistema.operators import fold as folding
from epistema.operators import relational as rel


def beliefs_as_of(assertions: DataFrame, ontology: DataFrame, valid: int, known: int) -> DataFrame:
    """Beliefs valid at one time as known at another."""
    return folding.fold(assertions, ontology, known).filter(rel.valid_at(valid))


def timeline(beliefs: DataFrame, assertions: DataFrame, entity: str, a: int, b: int) -> DataFrame:
    """Beliefs of an entity that meet a span, with the last time each was recorded."""
    mine = beliefs.filter((F.col("subject_id") == entity) & rel.valid_within(a, b))
    seen = assertions.filter(F.col("subject_id") == entity).groupBy("statement_id").agg(F.max("recorded_at").alias("recorded_at"))
    return mine.join(seen, "statement_id", "left").select("predicate", "statement_id", "valid_from", "valid_to", "status", "confidence", "recorded_at").orderBy("valid_from", "statement_id")


def difference(beliefs: DataFrame, a: int, b: int) -> DataFrame:
    """What changed between two valid times: added, removed, or changed in status or start."""
    # one aggregate for both times, so that the beliefs are made once
    last = lambda t: F.max_by(F.when(rel.valid_at(t), F.struct("status", "valid_from")), F.when(rel.valid_at(t), F.struct("valid_from", "status")))
    both = beliefs.filter(rel.valid_at(a) | rel.valid_at(b)).groupBy("statement_id").agg(last(a).alias("x"), last(b).alias("y"))
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when((F.col("x.status") != F.col("y.status")) | (F.col("x.valid_from") != F.col("y.valid_from")), "changed")
    return both.select("statement_id", change.alias("change"), F.col("x.status").alias("status_before"), F.col("y.status").alias("status_after")).filter("change is not null")


def why(beliefs: DataFrame, assertions: DataFrame) -> DataFrame:
    """Provenance of statements: latest status, confidence of the first assertion, affirmations, denials and episodes."""
    last = beliefs.groupBy("statement_id").agg(F.max_by("status", "valid_from").alias("status"), F.max("valid_from").alias("valid_from"))
    made = assertions.groupBy("statement_id").agg(
        F.min_by("confidence", F.struct("recorded_at", "assertion_id")).alias("raw"),
        F.sum(F.when(F.col("polarity") > 0, 1).otherwise(0)).cast("long").alias("affirmed"),
        F.sum(F.when(F.col("polarity") < 0, 1).otherwise(0)).cast("long").alias("denied"),
        F.array_join(F.array_sort(F.collect_set("episode_id")).cast("array<string>"), ",").alias("episodes"),
    )
    return last.join(made, "statement_id")


def contradictions(beliefs: DataFrame, assertions: DataFrame) -> DataFrame:
    """Contradicted statements with the episodes that affirm and deny them."""
    bad = beliefs.filter("status = 'contradicted'").select("statement_id").distinct()
    listed = lambda sign: F.array_join(F.array_sort(F.collect_set(F.when(F.col("polarity") == sign, F.col("episode_id")))).cast("array<string>"), ",")
    return assertions.join(bad, "statement_id", "left_semi").groupBy("subject_id", "predicate", "statement_id").agg(listed(1).alias("affirmed_by"), listed(-1).alias("denied_by"))


def merges_in_force(events: DataFrame, at: int | None = None) -> DataFrame:
    """Of merge events (loser, winner, decided_at, undone_at) the last of each loser, if it was not undone; at: as decided and undone up to then."""
    undone = F.col("undone_at").isNotNull() if at is None else F.coalesce(F.col("undone_at") <= at, F.lit(False))
    made = events if at is None else events.filter(F.col("decided_at") <= at)
    return rel.latest(made, ["loser"], "decided_at", "winner").filter(~undone).select("loser", "winner")


def merge_closure(merges: DataFrame, most: int = 32) -> DataFrame:
    """(entity_id, canonical): winners followed to the end by doubling; a cycle is an error."""
    from epistema.plans.storage import settled

    at = merges.select(F.col("loser").alias("entity_id"), F.col("winner").alias("canonical"))
    for _ in range(most):
        step = at.select(F.col("entity_id").alias("canonical"), F.col("canonical").alias("__next"))
        joined = settled(at.join(step, "canonical", "left").select("entity_id", F.coalesce("__next", "canonical").alias("canonical"), F.col("__next").isNotNull().alias("__moved")))
        if not joined.filter("__moved").limit(1).count():
            return joined.select("entity_id", "canonical")
        if joined.filter("entity_id = canonical").limit(1).count():
            break
        at = joined.select("entity_id", "canonical")
    raise ValueError("merges form a cycle")


def beliefs_of(entities: DataFrame, beliefs: DataFrame, closure: DataFrame) -> DataFrame:
    """entity_id and the beliefs of its whole group: all entities with the same end of their merges, whichever of them is asked for.

    closure: (entity_id, canonical) of ``merge_closure``. The log and the beliefs stay as they are, so a split shows as soon as the closure leaves it out.
    """
    group = closure.unionByName(closure.select(F.col("canonical").alias("entity_id"), "canonical").distinct())
    asked = entities.select("entity_id").distinct().join(group, "entity_id", "left").select("entity_id", F.coalesce("canonical", "entity_id").alias("canonical"))
    alone = asked.select(F.col("canonical").alias("entity_id"), "canonical").distinct().join(group.select("entity_id"), "entity_id", "left_anti")
    members = group.unionByName(alone).select(F.col("entity_id").alias("subject_id"), "canonical")
    return asked.join(members, "canonical").join(beliefs, "subject_id").drop("canonical")


def uncertainty(beliefs: DataFrame, ages: DataFrame, key: str) -> DataFrame:
    """Score of how doubtful the beliefs of a key are. ages: (key, age_days) of its oldest episode."""
    counts = beliefs.groupBy(key).agg(
        F.count("*").alias("total"),
        F.sum((F.col("status") == "contradicted").cast("int")).alias("contradicted"),
        F.sum((F.col("distinct_episodes") == 1).cast("int")).alias("single"),
        F.sum((F.col("n_untrusted") > 0).cast("int")).alias("untrusted"),
    )
    share = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) / F.greatest(F.col("total"), F.lit(1))))
    stale = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("age_days", F.lit(0.0)) / 365.0))
    score = share("contradicted") * 0.4 + share("single") * 0.25 + stale * 0.15 + share("untrusted") * 0.2
    return counts.join(ages, key, "left").select(key, "total", F.round(score, 6).alias("uncertainty"))
