import json

import pytest
from pyspark.sql import functions as F

from epistema.functions import scalars as sc
from epistema.operators import extract, graph, pack, rank, resolve, temporal, text
from epistema.operators import relational as rel
from epistema.schema import TIME_MAX, TIME_MIN, ontology
from epistema.sources import html, ledger, notes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_fnv1a(spark):
    def fnv(s):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return f"{h:016x}"

    rows = spark.createDataFrame([("",), ("a",), ("foobar",), ("ünïcode",)], "s string").select("s", sc.fnv1a(F.col("s")).alias("h")).collect()
    assert all(r.h == fnv(r.s) for r in rows)


def test_scalars(spark):
    assert one(spark, sc.number_text(F.lit(-0.0))) == "0"
    assert one(spark, sc.number_text(F.lit(3.0))) == "3"
    assert one(spark, sc.validity(F.lit(TIME_MIN), F.lit(TIME_MAX))) == "open"
    assert one(spark, sc.short_date(F.lit(0))) == "1970-01-01"
    assert one(spark, sc.noon(F.lit("2024-03-01"))) == 1709294400000
    assert one(spark, sc.tokens(F.lit("abc"))) == 1
    assert one(spark, sc.link_entity(sc.entity_link(F.lit("s"), F.lit("e")))) == "e"
    assert one(spark, sc.content_hash(F.lit("a\r\nb  "))) == one(spark, sc.content_hash(F.lit("a\nb")))


def test_html(spark):
    page = "<!-- x --><p>a&amp;b</p><script>no</script><div>c &lt; d</div><!-- open"
    assert one(spark, html.to_text(F.lit(page))) == "a&b c < d"
    assert one(spark, html.to_text_whole(F.lit("<p>caf&eacute; &#65;</p><b>x</b>y <unended"))) == "café A xy"
    assert one(spark, html.note_text(F.lit("<!-- +++\nt = 1\n+++ --><p>hi</p>"))) == "hi"


def test_notes(spark, tmp_path):
    for name, body in {"a.md": "A", "b/c.HTML": "B", "TEMPLATE.md": "x", "_assets/d.md": "x", ".git/e.md": "x", "Chat.md": "x", "f.txt": "x"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    got = notes.scan(spark, str(tmp_path))
    assert [r.path for r in got.collect()] == ["a.md", "b/c.HTML"]
    empty = spark.createDataFrame([], "path string, hash string, seq long")
    new, states = notes.sync(got, empty, empty.drop("seq"))
    assert {(r.state, r.n) for r in states.collect()} == {("new", 2)}


def test_ledger_round_trip(spark):
    df = spark.createDataFrame([(1, "a", bytearray(b"\x00\xff"), None)], "i long, s string, b binary, n string")
    back = ledger.load(ledger.export({"t": df}), {"t": "i long, s string, b binary, n string"})["t"].first()
    assert (back.i, back.s, bytes(back.b), back.n) == (1, "a", b"\x00\xff", None)
    shuffled = spark.range(100).repartition(7)
    assert ledger.snapshot({"t": shuffled}).first() == ledger.snapshot({"t": spark.range(100)}).first()
    with pytest.raises(ValueError):
        ledger.ensure_version(spark, spark.createDataFrame([("schema_version", "9")], "key string, value string"), 8)


def test_merge_cycle(spark):
    m = spark.createDataFrame([(1, 2), (2, 3), (4, 3)], "loser long, winner long")
    assert {(r.entity_id, r.canonical) for r in temporal.merge_closure(m).collect()} == {(1, 3), (2, 3), (4, 3)}
    with pytest.raises(ValueError):
        temporal.merge_closure(spark.createDataFrame([(1, 2), (2, 1)], "loser long, winner long"))


def test_resolution(spark):
    rows = [(1, "Person", "Ann  Lee"), (2, "Person", "ann lee"), (3, "Place", "Ann Lee"), (4, "Person", "Bob Stone")]
    got = {r.mention_id: r.entity_id for r in resolve.resolve_all(spark.createDataFrame(rows, "mention_id long, type string, surface string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    assert one(spark, resolve.normal(F.lit("ＡＢ  c"), compatible=True)) == "ab c"
    assert one(spark, resolve.score(F.lit(False), F.lit("a"), F.lit("a"))) == 0.0


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "p"), ("b", "c", "p"), ("c", "d", "q"), ("x", "y", "p")], "src string, dst string, predicate string")
    seeds = spark.createDataFrame([("a",)], "node string")
    nodes, scanned = graph.traverse(e, seeds, 2)
    assert {(r.node, r.depth) for r in nodes.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert scanned.count() == 2
    assert graph.shortest_path(e, "a", "d") == ["a", "b", "c", "d"]
    assert graph.shortest_path(e, "a", "x") == []
    links = spark.createDataFrame([(1, 2), (3, 2), (7, 8)], "u long, v long")
    assert {(r.id, r.component) for r in graph.components(links).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    w = e.withColumn("weight", F.lit(1.0))
    assert graph.communities(w).count() == graph.communities(w, ordered=False).count() == 6


def test_episode_clusters_of_all_assertions(spark, sf):
    import pandas as pd

    def clusters(rows):
        parent = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        first = {}
        for s, e in rows:
            a, b = find(first.setdefault(s, e)), find(e)
            parent[max(a, b)] = min(a, b)
        sizes = pd.Series([find(e) for e in parent]).value_counts()
        return {(e, find(e)) for e in parent if sizes[find(e)] > 1}

    from epistema import fixtures as fx
    from epistema.catalogue import every

    # of the table itself, and of two rows in thirty, where clusters are many
    rows = [(r.statement_id, r.episode_id) for r in fx.assertions(spark, sf).select("statement_id", "episode_id").collect()]
    got = {(r.id, r.component) for r in every()[0]["g8_episode_clusters_all"](spark, sf).collect()}
    assert got and got == clusters(rows)
    few = [(s, e) for k, (s, e) in enumerate(sorted(rows)) if k % 30 < 2]
    links = rel.support_links(spark.createDataFrame(few, "statement_id string, episode_id long"))
    want = clusters(few)
    assert len({c for _, c in want}) > 1 and {(r.id, r.component) for r in graph.components(links).collect()} == want


def test_as_of(spark):
    p = spark.createDataFrame([("s", "trusted", 10, 20), ("s", "untrusted", 30, None)], "source_id string, trust string, effective_from long, effective_to long")
    rows = spark.createDataFrame([("s", t) for t in (5, 10, 19, 20, 30, 99)] + [("other", 50)], "source_id string, at long")
    got = {(r.source_id, r.at): r.policy_trust for r in rel.as_of(rows, p, "source_id", "at").collect()}
    assert got == {("s", 5): None, ("s", 10): "trusted", ("s", 19): "trusted", ("s", 20): None, ("s", 30): "untrusted", ("s", 99): "untrusted", ("other", 50): None}


def test_mmr_keeps_all(spark):
    items = spark.createDataFrame([("q", i, 1.0 / (i + 1)) for i in range(6)], "query string, id long, fused double")
    vectors = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(6)], "id long, embedding array<double>")
    got = rank.mmr(items, vectors, 0.5, 0.9).orderBy("final_order").collect()
    assert sorted(r.id for r in got) == list(range(6))
    assert [r.id for r in got][:2] == [0, 1]


def test_chunks_cover(spark):
    for t in ("", "a" * 50, "one two\n\nthree. four five", "é" * 33, "a. b. " * 20):
        spans = extract.split_spans(t, 16)
        assert "".join(t.encode()[a:b].decode() for a, b in spans) == t
        assert all(b - a <= 16 for a, b in spans)


def placed(content, surface, quote, span):
    """The rules for one mention, step by step on bytes."""
    raw, low = content.encode(), lambda x: bytes(c + 32 if 65 <= c < 91 else c for c in x)
    s = surface.encode()
    if quote is not None:
        at = raw.find(quote.encode())
        if not s or at < 0:
            return None
        inside = quote.encode().find(s)
        inside = inside if inside >= 0 else low(quote.encode()).find(low(s))
        return None if inside < 0 else (at + inside, at + inside + len(s), raw[at + inside : at + inside + len(s)].decode())
    a, b = span or (0, 0)
    if a <= b <= len(raw) and raw[a:b] == s:
        return a, b, surface
    if a <= b <= len(content) and a < len(content) and content[a:b] == surface:
        start = len(content[:a].encode())
        return start, start + len(s), surface
    if a <= b <= len(raw) and low(raw[a:b]) == low(s):
        return a, b, raw[a:b].decode()
    return None


def test_mentions(spark):
    import random

    rng = random.Random(6)
    rows = [("Zoë met Ann", "Ann", None, [9, 12]), ("Zoë met Ann", "Ann", None, [8, 11]), ("Zoë met Ann", "Bob", None, [8, 11]), ("x Ann y", "Ann", "Ann y", None), ("x Ann y", "ANN", "Ann y", [0, 1]), ("x", "", "x", None), ("", "a", "", None), ("ab", "ab", "zz", [0, 2])]
    alphabet = ["a", "B", "b", "é", "日", " ", "😀"]
    for _ in range(400):
        c = "".join(rng.choice(alphabet) for _ in range(rng.randrange(9)))
        i, j = sorted((rng.randrange(len(c) + 1), rng.randrange(len(c) + 1)))
        surface = rng.choice([c[i:j], c[i:j].swapcase() if c[i:j].isascii() else c[i:j], "b"])
        start = rng.choice([i, len(c[:i].encode()), i + 1])
        quote = rng.choice([None, None, c[max(0, i - 1) : j + 1], "zz"])
        if surface:
            rows.append((c, surface, quote, rng.choice([[start, start + len(surface)], [start, start + len(surface.encode())], None])))
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, c string, s string, q string, p array<bigint>")
    got = {r.k: tuple(r.at) if r.at else None for r in df.select("k", extract.place(F.col("c"), F.col("s"), F.col("q"), F.col("p")).alias("at")).collect()}
    assert got == {k: placed(*r) for k, r in enumerate(rows)}
    assert sum(v is not None for v in got.values()) > 100


def test_claims(spark):
    good = {"predicate": "knows", "subject": {"surface": "ann", "entity_type": "Person", "quote": "Ann knows"}, "object": {"kind": "entity", "mention": {"surface": "Bob", "entity_type": "Person", "span": [10, 13]}}, "polarity": "affirm", "confidence": 0.5}
    bad = good | {"predicate": "nope", "confidence": 2}
    rows = spark.createDataFrame([(1, "Ann knows Bob", "x", 0, "trusted", json.dumps({"claims": [good, bad]}))], "episode_id long, content string, extractor_id string, recorded_at long, trust string, raw_response string")
    ok, wrong = extract.quarantine(extract.checked(extract.claims(rows), ontology(spark)))
    assert [r.subject_id for r in extract.project(ok).collect()] == ["ann"]
    assert wrong.first().errors == ["confidence_out_of_range", "unknown_predicate"]
    claim = ok.first().claim
    assert (claim.subject.surface, claim.subject.span, claim.object.surface, claim.object.span) == ("Ann", [0, 3], "Bob", [10, 13])
    text = {"predicate": "full_name", "subject": good["subject"], "object": {"kind": "literal", "literal_type": "text", "value": "BOB", "quote": "Bob"}, "confidence": 1.0}
    more = [
        (good | {"object": {"kind": "entity", "mention": {"surface": "Bob", "entity_type": "Place", "span": [10, 13]}}}, ["object_type"]),
        (good | {"subject": {"surface": "Ann", "entity_type": "Place", "span": [4, 7]}}, ["subject_type", "subject_not_verbatim"]),
        (good | {"predicate": "full_name"}, ["object_type"]),
        (text, []),
        (text | {"object": text["object"] | {"literal_type": "date"}}, ["object_type"]),
        (text | {"object": text["object"] | {"quote": "Ann"}}, ["object_not_verbatim"]),
        (text | {"object": {"kind": "literal", "literal_type": "text", "value": "x", "span": [3, 99]}}, ["span_out_of_bounds"]),
        (text | {"predicate": "size_of", "object": text["object"] | {"value": "Bob"}}, ["object_type"]),
        (text | {"predicate": "size_of", "object": {"kind": "literal", "literal_type": "any", "value": "large", "span": [0, 3]}}, []),
    ]
    own = ontology(spark).withColumn("object_types", F.when(F.col("name") == "knows", "Person")).unionByName(spark.createDataFrame([("size_of", "enum", "Person", "small,large")], "name string, object_kind string, subject_types string, object_types string"), allowMissingColumns=True)
    rows = spark.createDataFrame([(i, "Ann knows Bob", json.dumps({"claims": [c]})) for i, (c, _) in enumerate(more)], "episode_id long, content string, raw_response string")
    assert {r.episode_id: r.errors for r in extract.checked(extract.claims(rows), own).collect()} == {i: e for i, (_, e) in enumerate(more)}


def test_pack(spark):
    assert sum(pack.reserves(3000).values()) == 3000
    lines = spark.createDataFrame([(1, "episodes", i, "x" * 400) for i in range(9)], "context_id long, layer string, position long, line string")
    got = pack.packed(lines, 250).collect()
    assert sum(r.tokens for r in got) <= 250
    assert pack.step("queued", "ok") == "extracted"


def test_jobs(spark):
    jobs = pack.enqueue(spark.createDataFrame([], "job_id string, state string, attempts int, created_at long, lease_until long"), spark.createDataFrame([("a",), ("b",)], "job_id string"), 1)
    leased = pack.claim(jobs, 1, 10, 5)
    assert {(r.job_id, r.state) for r in leased.collect()} == {("a", "leased"), ("b", "queued")}
    assert {r.state for r in pack.reclaim(leased, 99).collect()} == {"queued"}
    assert {r.state for r in pack.finish(leased, ["a"], True).collect()} == {"done", "queued"}


def test_text(spark):
    assert one(spark, text.shingles(F.lit(""))) == []
    assert one(spark, text.grams(F.lit("ab"))) == []
    assert one(spark, text.similarity(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_the_last_registration_of_a_predicate_counts(spark):
    from epistema.plans import rebuild

    base = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "name string, weight double")
    more = spark.createDataFrame([("b", 2.0, 1), ("c", 3.0, 2), ("b", 4.0, 3)], "name string, weight double, seq long")
    assert sorted(tuple(r) for r in rebuild.predicates(base, more).collect()) == [("a", 1.0), ("b", 4.0), ("c", 3.0)]
    again = more.filter("seq = 2").drop("seq")
    assert rebuild.predicates(base, again.unionAll(again)).count() == 3


def test_engine_answers_by_any_name_of_a_group(spark):
    from epistema.plans.engine import Engine

    schema = "seq long, op string, subject_id string, predicate string, object string, polarity int, valid_from long, valid_to long, at long, trust string"
    say = lambda i, op, s, p, o: (i, op, s, p, o, 1, None, None, i, "trusted")
    log = [say(1, "add_statement", "ann", "knows", "bob"), say(2, "add_statement", "annie", "knows", "cid"), say(3, "add_statement", "bob", "knows", "dee"), say(4, "merge", "annie", None, "ann")]
    episodes = spark.createDataFrame([], "episode_id long, content string, redacted_at long")
    surfaces = spark.createDataFrame([("ann", "Ann")], "entity_id string, surface string")
    own = Engine(spark, spark.createDataFrame(log, schema), episodes, surfaces)
    assert {r.object for r in own.entity("ann").collect()} == {r.object for r in own.entity("annie").collect()} == {"bob", "cid"}
    assert {r.object for r in own.entity("bob").collect()} == {"dee"} and not own.entity("nobody").count()
    nodes, edges, truncated = own.traverse(["ann"], 2)
    assert {(r.node, r.depth) for r in nodes.collect()} == {("ann", 0), ("bob", 1), ("cid", 1), ("dee", 2)} and not truncated
    assert edges.filter("depth = 1").count() == 2 and {r.salience for r in nodes.collect()} <= {0.5, 1.0}
    assert own.traverse(["ann"], 2, most=2)[2]
    split = own.declare(spark.createDataFrame([say(5, "split", "annie", None, "ann")], schema))
    assert {r.object for r in split.entity("annie").collect()} == {"cid"} and {r.object for r in split.entity("ann").collect()} == {"bob"}
    assert own.stats().first().entities == 2


def test_claims_are_placed_once(spark, sf):
    from epistema.catalogue import search
    from epistema.operators import extract
    from epistema.schema import ontology

    made = extract.checked(extract.claims(search.responses(spark, sf)), ontology(spark))
    places = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("locate(")
    # the filter on errors held all places again before, and each use of a place its whole expression
    assert places(extract.project(extract.quarantine(made)[0])) == places(made) < 60


def test_rows_lost_are_counted_with_repeats(spark):
    rows = lambda *n: spark.createDataFrame([(x, None if x == 3 else "v") for x in n], "a int, b string")
    before, after = rows(1, 1, 1, 2, 3, 3, 4), rows(1, 2, 2, 3, 5)
    got = {r.a: r.n for r in rel.lost(before, after).collect()}
    assert got == {1: 2, 3: 1, 4: 1} and sum(got.values()) == before.exceptAll(after).count()
