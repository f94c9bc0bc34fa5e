import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_shingles string, src string, component string"

ODD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one"),
    (5, "one two"),
    (6, "one two"),
    (7, "É ß ü — naïve text 日本語"),
    (8, "x" * 40000),
    (9, "word " * 9000),
    (None, "a null id with some words in it"),
    (None, None),
    (10, "same text again and again " * 20),
    (11, "same text again and again " * 20),
    (11, "same text again and again " * 20),
    (12, "+1 (555) 123-4567 a@b.co 1.2.3.4 4111 1111 1111 1111 token = \"abcdef0123456789abcdef0123456789\""),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows at the edges, with columns named like those operators make."""
    rows = [(i, t, "en" if (i or 0) % 2 else None, "s", len(t or ""), "x", "y", "z") for i, t in ODD]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}
