"""Walks and communities against models that take one node after the other."""

import random

import pytest
from pyspark.sql import functions as F

from epistema.operators import graph


def propagated(edges, rounds=10):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    label = {n: n for n in near}
    for _ in range(rounds):
        moved = False
        for n in sorted(near):
            votes = {}
            for m, w in near[n]:
                votes[label[m]] = votes.get(label[m], 0) + w
            best = min(votes, key=lambda x: (-votes[x], x))
            moved |= best != label[n]
            label[n] = best
        if not moved:
            break
    return label


def random_edges(rng, nodes, n):
    names = [f"n{i:02}" for i in range(nodes)]
    return [(rng.choice(names), rng.choice(names), rng.choice([1, 1, 2, 3]) / 4) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_communities_are_those_of_votes_in_order(spark, seed):
    rng = random.Random(seed)
    edges = random_edges(rng, 40, 70)
    if seed == 2:  # a chain of ascending names, along which a change spreads
        edges = [(f"n{i:02}", f"n{i + 1:02}", 1.0) for i in range(12)] + [("n00", "n00", 5.0)]
    got = {r.node: r.label for r in graph.communities(spark.createDataFrame(edges, "src string, dst string, weight double")).collect()}
    assert got == propagated(edges)


def walked(edges, seeds, depth, most, direction, allowed):
    out, back = {}, {}
    for a, b, p, s in sorted(edges, key=lambda e: e[3]):
        out.setdefault(a, []).append((b, p, s))
    for a, b, p, s in sorted(edges, key=lambda e: e[3]):
        back.setdefault(b, []).append((a, p, s))
    seen, found, front = dict.fromkeys(seeds, 0), [], sorted(set(seeds))
    for d in range(1, depth + 1):
        later = set()
        for e in front:
            if len(seen) >= most:
                return seen, found, True
            lists = (out.get(e, []) if direction != "in" else []) + (back.get(e, []) if direction != "out" else [])
            for n, p, s in lists:
                if p not in allowed:
                    continue
                found.append((e, n, p, s, d))
                if n not in seen:
                    if len(seen) >= most:
                        return seen, found, True
                    seen[n] = d
                    later.add(n)
        front = sorted(later)
    return seen, found, False


def test_bounded_walks_are_those_node_by_node(spark):
    rng = random.Random(1)
    names = [f"n{i:02}" for i in range(24)]
    edges = [(rng.choice(names), rng.choice(names), rng.choice("pqr"), f"s{i:03}") for i in range(40)]
    table = spark.createDataFrame(edges, "src string, dst string, predicate string, statement_id string")
    starts = {q: rng.sample(names, rng.choice([1, 2, 4])) for q in range(12)}
    seeds = spark.createDataFrame([(q, n) for q, own in starts.items() for n in own], "query int, node string")
    flags = set()
    for most, direction, allowed in ((1, "both", "pqr"), (4, "out", "pq"), (6, "both", "pqr"), (9, "in", "pqr"), (200, "both", "pr")):
        got = graph.walks(table, seeds, 3, most, direction, F.col("predicate").isin(*allowed))
        nodes, found, ended = got.nodes.collect(), got.edges.orderBy("query", "depth", "place").drop("place").collect(), {r.query for r in got.truncated.collect()}
        for q, own in starts.items():
            want = walked(edges, own, 3, most, direction, allowed)
            assert {r.node: r.depth for r in nodes if r.query == q} == want[0]
            assert [tuple(r)[1:] for r in found if r.query == q] == want[1]
            assert (q in ended) == want[2]
            flags.add(want[2])
    assert flags == {True, False}
    one = graph.bounded(table, seeds.filter("query = 3").select("node"), 2, 7)
    want = walked(edges, starts[3], 2, 7, "both", "pqr")
    assert {r.node: r.depth for r in one[0].collect()} == want[0] and one[1].count() == len(want[1]) and one[2] == want[2]


def test_a_walk_from_nowhere(spark):
    none = spark.createDataFrame([], "src string, dst string, predicate string, statement_id string")
    nodes, edges, truncated = graph.bounded(none, spark.createDataFrame([("a",), ("a",)], "node string"), 2, 5)
    assert [tuple(r) for r in nodes.collect()] == [("a", 0)] and not edges.count() and not truncated


def test_rounds_of_communities_move_numbers(spark, monkeypatch):
    written, whole = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: written.append([f.dataType.simpleString() for f in df.schema]) or whole(df))
    edges = [("b", "a", 1.0), ("é", "a", 1.0), ("Z", "b", 2.0), ("c", "c", 1.0)]
    got = {r.node: r.label for r in graph.communities(spark.createDataFrame(edges, "src string, dst string, weight double")).collect()}
    assert got == propagated(edges)
    # every table of a round held names before
    assert sum("string" in types for types in written) == 1


def least_reachable(links):
    least = {n: n for link in links for n in link if link[0] != link[1]}
    for _ in least:
        before = dict(least)
        for u, v in links:
            if u != v:
                least[u] = least[v] = min(least[u], least[v])
        if least == before:
            return least
    return least


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_components_shrink_from_round_to_round(spark, monkeypatch, kind):
    far = 2**40 if kind == "long" else 2**20
    links = [(i, i + 1) for i in range(120)] + [(i * far, (i + 1) * far) for i in range(1000 // far + 1, 9)] + [(-7, -3), (-3, -9), (500, 500), (7000, 7001), (7001, 7000)]
    links += [(9000 + i % 13, 9000 + i % 7) for i in range(91)]
    links = [(str(u), str(v)) for u, v in links] if kind == "string" else links
    written, whole = [], graph.settled

    def counted(df):
        out = whole(df)
        if out.columns == ["u", "v"]:
            written.append(out.count())
        return out

    monkeypatch.setattr(graph, "settled", counted)
    table = spark.createDataFrame([*links, (None, links[0][0])], f"u {kind}, v {kind}")
    got = graph.components(table)
    assert [f.dataType.simpleString() for f in got.schema] == [table.schema["u"].dataType.simpleString()] * 2
    rows = got.collect()
    assert {r.id: r.component for r in rows} == least_reachable(links) and len(rows) == len(least_reachable(links))
    # every node but the least of each component stayed in all rounds before
    assert written[-1] == 0 and sum(written[1:]) < written[0]
    assert not graph.components(table.limit(0)).count()
