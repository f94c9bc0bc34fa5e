"""A cleaning pipeline over ``documents`` by the operators of ``llm``.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept.
All but the last return the columns of ``docs``. Rows with a null id go through every stage;
stages that remove rows decide by id, so rows that repeat an id stand or fall together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import op1_ngram_jaccard, op2_pii, op3_language_id, op5_decontamination, op7_byte_bpe, shared

#: Near duplicates share 80 hundredths of their 5-word shingles.
SHINGLE, SIMILAR, OF = 5, 80, 100


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is not among ``ids`` (one column, doc_id)."""
    gone = ids.select(F.col("doc_id").alias("__gone")).filter("__gone is not null").distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, null and empty ones among them, and those that the best language's model codes in more bits than they
    have by more than an allowance, whole and without words that hold a digit. Where no language was learned every text with a letter stays.
    Repeated rows are judged alike; a text of any length is judged whole; an empty table stays empty.
    """
    return op3_language_id.accepted(docs, op3_language_id.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least id of each group of near duplicates, with all rows that repeat it. Texts without words and rows with a null id are in no group and stay."""
    found = op1_ngram_jaccard.join(docs, SHINGLE, SIMILAR, OF)
    return _without(docs, shared.written(found.filter("doc_id <> component_id").select("doc_id")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, by id: rows that repeat it go too. Null and empty texts and rows with a null id stay; without items all do."""
    found = op5_decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts <kind> in place of personal data, row by row; null texts stay null, and texts of any length are scanned whole."""
    model = op2_pii.learn(docs)
    found = op2_pii.find(docs, model, keep=docs.columns)
    text = op2_pii.redacted(F.col("text"), F.array_sort(F.concat("base", "added")))
    return found.select(*(F.when(F.col(f"kept.{c}").isNotNull(), text).alias(c) if c == "text" else F.col(f"kept.`{c}`").alias(c) for c in docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text, the number of tokens and the ids of each text, row by row; a null text becomes the empty one without tokens."""
    return op7_byte_bpe.encode(docs).select("doc_id", F.col("decoded").cast("string").alias("text"), "n_tokens", "ids")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("redact", redact),
    ("tokens", tokens),
]

#: No stage after the first can be put in DuckDB's SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared.written(docs)
    return docs
