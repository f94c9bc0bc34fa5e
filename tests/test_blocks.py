"""Blocks of postings against counting in the texts, and what is built on them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from epistema.operators import blocks, text
from epistema.plans import retrieval

TEXTS = ["The cat, the CAT", "", None, "ab", "abc", "aaaaaa", "é😀é😀é😀 the", "x-y\nthe the", "\u0000\u0000\u0000 nul"]


def docs(spark, texts):
    return spark.createDataFrame([("e", str(i), t) for i, t in enumerate(texts)], "kind string, id string, text string").repartition(3)


@pytest.mark.parametrize("characters", [10, 2_000_000])
def test_blocks_hold_every_place(spark, monkeypatch, characters):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("ab c") for _ in range(rng.randrange(400))) for _ in range(60)]
    monkeypatch.setattr(blocks, "CHARACTERS", characters)
    numbered = blocks.numbered(docs(spark, texts))
    rows = blocks.opened(blocks.blocks(numbered), "idx", "term").join(numbered.select("doc", "id"), "doc").collect()
    got = {(r.idx, r.term, r.id): (r.tf, r.places) for r in rows}
    assert len(got) == len(rows)
    want = {}
    for i, t in enumerate(texts):
        low = (t or "").lower()
        words = "".join(c if c.isalnum() else " " for c in low).split()
        for idx, terms in (("gram", [low[k : k + 3] for k in range(len(low) - 2)]), ("word", words)):
            for k, term in enumerate(terms):
                want.setdefault((idx, term, str(i)), []).append(k)
    assert got == {k: (len(v), v) for k, v in want.items()}


def test_numbers_of_any_size_come_back():
    import numpy as np

    values = np.array([0, 1, 127, 128, 2**14 - 1, 2**14, 2**21, 2**35, 2**50, 3])
    assert (blocks.numbers(blocks.varints(values)[0]) == values).all()
    assert len(blocks.numbers(blocks.varints(values[:0])[0])) == 0


def test_grams_score_as_vectors_of_exploded_terms(spark):
    rng = random.Random(5)
    table = docs(spark, TEXTS + [" ".join(rng.choice(["the", "then", "other", "ring", "small"]) for _ in range(rng.randrange(30))) for _ in range(40)])
    runs = ["ing", "mal", "rin", "sma", "the"]
    held = retrieval.grams(table)
    n = table.count()
    idf = text.frequencies(table, text.grams(F.col("text")), n).filter(F.col("term").isin(*runs))
    norm = math.sqrt(sum(r.idf**2 for r in idf.collect()))
    want = text.cosine(text.tfidf(table, text.grams(F.col("text")), n, "id"), idf.select("term", (F.col("idf") / norm).alias("weight")), "id")
    got = {r.id: r.score for r in held.cosine(runs).collect()}
    want = {r.id: r.score for r in want.collect()}
    assert want and got.keys() == want.keys() and all(abs(got[k] - v) < 2e-6 for k, v in want.items())
    want = {r.id: r.score for r in text.bm25_of(table, text.grams(F.col("text")), ["ing", "the"], "id").collect()}
    got = {r.id: r.score for r in held.bm25(["ing", "the"], F.lit(True)).collect()}
    assert want and got.keys() == want.keys() and all(abs(got[k] - v) < 2e-6 for k, v in want.items())


def test_an_index_keeps_blocks_and_its_vectors_are_those_of_the_texts(spark, tmp_path):
    from epistema.plans import index

    rng = random.Random(6)
    say = lambda: " ".join(rng.choice(["the", "then", "other", "ring", "small"]) for _ in range(9))
    table = lambda d: spark.createDataFrame([("e", k, v) for k, v in d.items()], "kind string, id string, text string").coalesce(2)
    first, late = {str(i): say() for i in range(60)}, {str(i): say() for i in range(50, 70)}
    kept, fresh = (index.Index(spark, f"file:{tmp_path}/{name}", buckets=2) for name in ("kept", "fresh"))
    kept.build(table(first))
    # a row for each term and document before
    assert kept._table("postings", index.POSTINGS, 1).filter("idx = 'gram'").count() < 300
    kept.update(table(late), spark.createDataFrame([("e", "3")], "kind string, id string"))
    fresh.build(table({k: v for k, v in (first | late).items() if k != "3"}))
    asked = spark.createDataFrame([(1, "the ring"), (2, "mallet"), (3, "zqzq")], "query long, text string")
    found = []
    for one in (kept, fresh):
        one.fit()
        found.append({(r.query, r.id): r.score for r in one.similar(asked).collect()})
    assert found[0] and found[0].keys() == found[1].keys() and all(abs(found[0][k] - v) < 2e-6 for k, v in found[1].items())
