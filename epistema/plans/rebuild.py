"""The ledger's derived tables as a pure function of it: declarations and extractions to assertions, beliefs, indexes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistema.functions.scalars import content_id
from epistema.operators import extract, fold, redact, temporal, text
from epistema.operators import relational as rel
from epistema.schema import TIME_MAX, TIME_MIN


@dataclass
class Truth:
    assertions: DataFrame
    beliefs: DataFrame
    merges: DataFrame
    ontology: DataFrame


def declared(log: DataFrame) -> DataFrame:
    """Assertions of the log's add_statement rows (seq, op, subject_id, predicate, object, polarity, valid_from, valid_to, at, trust); a later retract of the statement closes them."""
    key = ["subject_id", "predicate", "object"]
    add = log.filter("op = 'add_statement'")
    undo = log.filter("op = 'retract'").select(*key, F.col("seq").alias("__s"), F.col("at").alias("__at"))
    closed = add.join(undo, key, "left").withColumn("__at", F.when(F.col("__s") > F.col("seq"), F.col("__at"))).groupBy(*add.columns).agg(F.min("__at").alias("retracted_at"))
    return closed.select(
        content_id("a", F.col("seq").cast("string")).alias("assertion_id"),
        *key,
        content_id("s", *(F.col(k) for k in key)).alias("statement_id"),
        F.col("seq").cast("long").alias("episode_id"),
        F.lit(None).cast("string").alias("extractor_id"),
        F.coalesce("polarity", F.lit(1)).alias("polarity"),
        F.coalesce("valid_from", F.lit(TIME_MIN)).alias("claimed_from"),
        F.coalesce("valid_to", F.lit(TIME_MAX)).alias("claimed_to"),
        F.lit(1.0).alias("confidence"),
        F.col("at").alias("recorded_at"),
        "retracted_at",
        "trust",
    )


def merges(log: DataFrame) -> DataFrame:
    """Merge events of the log (merge and split rows: subject_id loses, object wins)."""
    rows = log.filter("op in ('merge', 'split')")
    return rows.select(F.col("subject_id").alias("loser"), F.col("object").alias("winner"), F.col("at").alias("decided_at"), F.when(F.col("op") == "split", F.col("at")).alias("undone_at"))


def predicates(ontology: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """The ontology with registered predicates, the last of each name by ``seq``; without that column, names that repeat must be equal rows."""
    if registered is None:
        return ontology
    registered = rel.latest(registered, ["name"], "seq") if "seq" in registered.columns else registered.distinct()
    return ontology.join(registered.select("name"), "name", "left_anti").unionByName(registered.select(ontology.columns))


def rebuild(log: DataFrame, ontology: DataFrame, responses: DataFrame | None = None, redacted: DataFrame | None = None) -> Truth:
    """All truth tables: declarations in order of seq, then extractions, then redactions, then the fold."""
    made = declared(log)
    if responses is not None:
        valid, _ = extract.quarantine(extract.checked(extract.claims(responses), ontology))
        made = made.unionByName(extract.project(valid).select(made.columns))
    if redacted is not None:
        gone = redact.closure(made, redacted).filter("kind = 'assertion'").select(F.col("id").alias("assertion_id"))
        made = made.join(gone, "assertion_id", "left_anti")
    canonical = temporal.merge_closure(temporal.merges_in_force(merges(log)))
    for side in ("subject_id", "object"):
        step = canonical.select(F.col("entity_id").alias(side), F.col("canonical").alias("__c"))
        made = made.join(step, side, "left").withColumn(side, F.coalesce("__c", side)).drop("__c")
    made = made.withColumn("statement_id", content_id("s", F.col("subject_id"), F.col("predicate"), F.col("object")))
    return Truth(made, fold.fold(made, ontology), canonical, ontology)


def ranking(documents: DataFrame) -> dict[str, DataFrame]:
    """Word and trigram postings and TF-IDF weights of documents (kind, id, text)."""
    keyed = documents.withColumn("key", F.concat_ws(":", "kind", F.col("id").cast("string")))
    return {
        "word": text.postings(keyed, text.words(F.col("text")), "key"),
        "trigram": text.postings(keyed, text.grams(F.col("text")), "key"),
        "tfidf": text.tfidf(keyed, text.grams(F.col("text")), documents.count(), "key"),
    }


def indexed(episodes: DataFrame, beliefs: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Rows to index: episodes' texts that are not redacted, statements as text, and surfaces."""
    live = episodes.filter("redacted_at is null").select(F.lit("episode").alias("kind"), F.col("episode_id").cast("string").alias("id"), F.col("content").alias("text"))
    said = beliefs.select(F.lit("statement").alias("kind"), F.col("statement_id").alias("id"), F.concat_ws(" ", "subject_id", "predicate", "object").alias("text")).distinct()
    return live.unionByName(said).unionByName(surfaces.select(F.lit("entity").alias("kind"), F.col("entity_id").cast("string").alias("id"), F.col("surface").alias("text")))
