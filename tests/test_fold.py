import random

import pytest
from model import contradict, held, supersede

from epistema.operators import fold, intervals
from epistema.schema import TIME_MAX, ontology

SCHEMA = "assertion_id long, subject_id string, predicate string, object string, statement_id string, episode_id long, extractor_id string, polarity int, claimed_from long, claimed_to long, confidence double, recorded_at long, retracted_at long, trust string"


def row(n, subject, predicate, obj, polarity, a, b, **kw):
    base = dict(episode=n, extractor="x", confidence=0.9, recorded=0, retracted=None, trust="trusted") | kw
    return (n, subject, predicate, obj, f"{subject}|{predicate}|{obj}", base["episode"], base["extractor"], polarity, a, b, base["confidence"], base["recorded"], base["retracted"], base["trust"])


def beliefs(spark, rows, at=None):
    return fold.fold(spark.createDataFrame(rows, SCHEMA), ontology(spark), at)


@pytest.mark.parametrize(
    ("spans", "want"),
    [([(1, 5), (5, 9)], [(1, 9)]), ([(1, 5), (6, 10)], [(1, 5), (6, 10)]), ([(1, 9), (2, 3)], [(1, 9)]), ([], [])],
)
def test_coalesce(spark, spans, want):
    df = spark.createDataFrame([("k", a, b) for a, b in spans], "k string, start long, end long")
    assert sorted((r.start, r.end) for r in intervals.coalesce(df, ["k"]).collect()) == want


@pytest.mark.parametrize(
    ("span", "holes", "want"),
    [((1, 9), [(1, 3)], [(4, 9)]), ((1, 9), [(7, 9)], [(1, 6)]), ((1, 9), [(4, 5)], [(1, 3), (6, 9)]), ((1, 9), [(0, 10)], []), ((1, 9), [(20, 30)], [(1, 9)]), ((1, 9), [(2, 3), (3, 4), (8, 8)], [(1, 1), (5, 7), (9, 9)])],
)
def test_subtract(spark, span, holes, want):
    kind = "k string, start long, end long"
    got = intervals.subtract(spark.createDataFrame([("k", *span)], kind), spark.createDataFrame([("k", *h) for h in holes], kind), ["k"])
    assert sorted((r.start, r.end) for r in got.collect()) == want


def test_random_groups_follow_the_sequential_rules(spark):
    rng, rows, n = random.Random(5), [], 0
    for g in range(150):
        for i in range(rng.randint(1, 4)):
            for _ in range(rng.randint(1, 4)):
                s = rng.randint(0, 20)
                for predicate in ("employed_by", "born_in", "knows"):
                    rows.append(row(n := n + 1, f"g{g}", predicate, str(i), -1 if rng.random() < 0.25 else 1, s, s + rng.randint(0, 6)))
                    rng.seed(rng.random())
    got = {}
    for r in beliefs(spark, rows).collect():
        got.setdefault((r.subject_id, r.predicate), []).append((r.statement_id, r.valid_from, r.valid_to, r.status))
    groups = {}
    for r in rows:
        groups.setdefault((r[1], r[2]), []).append((r[4], r[7], r[8], r[9]))
    for key, own in groups.items():
        spans = held(own)
        want = {"employed_by": supersede, "born_in": contradict}.get(key[1], lambda x: sorted((i, s, e, "active") for i, v in x.items() for s, e in v))(spans)
        assert sorted(got.get(key, [])) == want, key


def test_valid_time_changes_the_answer(spark):
    b = beliefs(spark, [row(1, "alice", "employed_by", "acme", 1, 1000, 2000), row(2, "alice", "employed_by", "globex", 1, 2000, TIME_MAX)])
    at = lambda t: [r.statement_id for r in b.filter((b.valid_from <= t) & (b.valid_to >= t)).collect()]
    assert at(1500) == ["alice|employed_by|acme"]
    assert at(2500) == ["alice|employed_by|globex"]
    assert {r.status for r in b.filter("valid_to = 1999").collect()} == {"superseded"}


def test_transaction_time(spark):
    rows = [row(1, "a", "knows", "b", 1, 0, 9, recorded=5), row(2, "a", "knows", "c", 1, 0, 9, recorded=5, retracted=7)]
    assert {r.statement_id for r in beliefs(spark, rows, 4).collect()} == set()
    assert len(beliefs(spark, rows, 6).collect()) == 2
    assert [r.statement_id for r in beliefs(spark, rows, 7).collect()] == ["a|knows|b"]


def test_confidence(spark):
    b = beliefs(spark, [row(1, "a", "knows", "b", 1, 0, 9, extractor=None), row(2, "a", "knows", "c", 1, 0, 9, confidence=0.5, trust="untrusted")]).collect()
    got = {r.statement_id: r.confidence for r in b}
    assert got["a|knows|b"] == 1.0
    assert got["a|knows|c"] == pytest.approx(0.5 * 0.8 * 0.5 * 0.3)


def test_empty(spark):
    assert beliefs(spark, []).collect() == []
