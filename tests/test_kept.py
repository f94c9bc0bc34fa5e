"""What is kept between runs against models that take one thing after the other."""

import math
import random
import uuid

from pyspark.sql import functions as F

from epistema.operators import resolve, text
from epistema.plans import index
from epistema.plans import keys as keys_module
from epistema.plans.keys import Keys


def folder(tmp_path):
    return f"file:{tmp_path}/{uuid.uuid4().hex}"


def shingles(s):
    padded = "\1\1" + s + "\1\1"
    return {padded[i : i + 3] for i in range(len(padded) - 2)} if s else set()


def one_by_one(mentions, bands):
    """The entities of mentions (id, space, type, normalized), each decided by what those before it made; bands: of each normal form."""
    keys, out = [], {}
    for i, space, kind, name in mentions:
        found = []
        for s, k, other, entity in keys:
            if (s, k) == (space, kind) and (other == name or bands[other] & bands[name]):
                a, b = shingles(name), shingles(other)
                found.append((-min(1.0, (other == name) + round(len(a & b) / len(a | b), 12)), entity))
        best = min(found, default=(0.0, None))
        out[i] = best[1] if -best[0] >= resolve.HIGH else i
        if not any((s, k, o) == (space, kind, name) for s, k, o, _ in keys):
            keys.append((space, kind, name, out[i]))
    return out


def test_batches_resolve_as_one_mention_after_the_other(spark, tmp_path):
    rng = random.Random(3)
    stems = ["anna maria lee", "annabel lee junior", "robert stone", "roberta stones", "acme corporation of york"]
    names = []
    for _ in range(160):
        s = list(rng.choice(stems))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(s))
            s[at : at + 1] = rng.choice([[], [s[at], "x"], [s[at], s[at]]])
        names.append("".join(s).strip())
    names += ["aaaa", "aaaaaa", "aaa", "item 1", "item 12", "item 123", "item 1234", "item 12345", "item 123456"] * 2
    rows = [(i, rng.choice(["s1", "s1", "s2"]), rng.choice(["Person", "Person", "Place"]), n.upper() if rng.random() < 0.3 else f" {n} ") for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "mention_id long, space string, type string, surface string")
    normal = df.select("*", resolve.normal(F.col("surface"), True).alias("n"))
    of = {r.mention_id: r.n for r in normal.collect()}
    shingled = normal.select("n").distinct().withColumn("s", text.shingles(F.col("n")))
    bands = {r.n: set(r.b) if r.e >= resolve.ENTROPY else set() for r in shingled.select("n", resolve.entropy(F.col("s")).alias("e"), resolve.bands(resolve.minhash(F.col("s"))).alias("b")).collect()}
    want = one_by_one([(i, s, k, of[i]) for i, s, k, _ in rows], bands)
    assert len(set(want.values())) < 0.7 * len(rows)
    for size in (len(rows), 70):
        keys, got = Keys(spark, folder(tmp_path), parts=4), {}
        for a in range(0, len(rows), size):
            got |= {r.mention_id: r.entity_id for r in keys.resolve(df.filter((F.col("mention_id") >= a) & (F.col("mention_id") < a + size))).collect()}
        assert got == want


def test_a_batch_reads_its_own_partitions(spark, tmp_path):
    keys = Keys(spark, folder(tmp_path), parts=64)
    df = spark.createDataFrame([(i, "s", "Person", f"name {i} of many {i * 7919}") for i in range(40)], "mention_id long, space string, type string, surface string")
    keys.resolve(df)
    few = keys.held("keys", "part int, batch string", [3, 5])
    plan = few._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan
    assert {r.part for r in few.collect()} <= {3, 5}
    # rows of a batch that did not finish are not there
    spark.createDataFrame([("s", "Person", "ghost", 1, 1, "broken", 0)], "space string, type string, normalized string, first long, entity long, batch string, part int").write.mode("append").partitionBy("part").parquet(f"{keys.root}/keys")
    later = spark.createDataFrame([(99, "s", "Person", "ghost"), (100, "s", "Person", "name 3 of many 23757")], "mention_id long, space string, type string, surface string")
    assert {(r.mention_id, r.entity_id) for r in keys.resolve(later).collect()} == {(99, 99), (100, 3)}


def test_a_crowded_band_is_not_compared_in_all_pairs(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    names = [f"Customer#{i:09}" for i in rng.sample(range(3000), 160)] + [f"Customer#{i:09}" for i in (11, 111, 1111, 11111, 22, 222, 2222)]
    names += [f"the long and winding road to the town of {a} {b}" for a in ("leeds", "york", "yorks") for b in range(5)] + ["a", "b", "ab", "aab", "aaab", "the long and winding road to the town"]
    rng.shuffle(names)
    rows = [(i, "s", "Person", n.lower()) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "mention_id long, space string, type string, surface string")
    s = text.shingles(F.col("surface"))
    bands = {r.surface: set(r.b) if r.ok else set() for r in df.select("surface", resolve.bands(resolve.minhash(s)).alias("b"), (resolve.entropy(s) >= resolve.ENTROPY).alias("ok")).collect()}
    want = one_by_one(rows, bands)
    met, whole = [], keys_module._scored
    monkeypatch.setattr(keys_module, "_scored", lambda r, on: met.append((on, r.groupBy(*on).count().agg(F.max("count")).first()[0])) or whole(r, on))
    for crowd, size in ((64, len(rows)), (2, len(rows)), (2, 70)):
        monkeypatch.setattr(keys_module, "CROWD", crowd)
        keys, got = Keys(spark, folder(tmp_path), parts=4), {}
        for a in range(0, len(rows), size):
            got |= {r.mention_id: r.entity_id for r in keys.resolve(df.filter((F.col("mention_id") >= a) & (F.col("mention_id") < a + size))).collect()}
        assert got == want
    # all 167 numbered names shared a band, and each was compared with each
    assert met[0][1] <= 64 and met[1][0] == ["space", "type", "mark"] and met[1][1] < 60


def test_names_are_not_sent_through_the_driver(spark, tmp_path, monkeypatch):
    plans, whole = [], keys_module.settled
    monkeypatch.setattr(keys_module, "settled", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or whole(df))
    keys = Keys(spark, folder(tmp_path), parts=2)
    for batch in (0, 1):
        rows = [(1000 * batch + i, "s", "Person", f"customer#{i:09}") for i in range(70 + batch)]
        got = keys.resolve(spark.createDataFrame(rows, "mention_id long, space string, type string, surface string"))
        plans.append(got._jdf.queryExecution().executedPlan().toString())
    sent = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line and "batch#" not in line]  # batches are a row each
    assert len(plans) > 10 and not sent


def scores(docs, queries, idx):
    """BM25 of phrases by counting in the texts."""
    import re

    split = (lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]) if idx == "word" else (lambda t: [t.lower()[i : i + 3] for i in range(len(t) - 2)])
    tokens = {d: split(t) for d, t in docs.items()}
    mean = sum(map(len, tokens.values())) / len(tokens)
    out = {}
    for q, s in queries:
        phrases = [p for p in map(split, s.split()) if p]
        tf = [{d: n for d, t in tokens.items() if (n := sum(t[i : i + len(p)] == p for i in range(len(t) - len(p) + 1)))} for p in phrases]
        for d in tokens:
            if phrases and all(d in f for f in tf):
                total = sum(math.log(1 + (len(tokens) - len(f) + 0.5) / (len(f) + 0.5)) * f[d] * 2.2 / (f[d] + 1.2 * (0.25 + 0.75 * len(tokens[d]) / mean)) for f in tf)
                out[q, d] = round(total, 5)
    return out


def test_an_index_after_changes_is_that_of_the_texts(spark, tmp_path):
    rng = random.Random(8)
    say = lambda: " ".join(rng.choice(["ab", "abc", "x-y", "the", "The", "aaaa", "zed", "é"]) for _ in range(rng.randrange(9)))
    docs = {str(i): say() for i in range(40)}
    queries = [(1, "the"), (2, "ab abc"), (3, "x-y the"), (4, "aaa"), (5, "ab ! the"), (6, "!"), (7, "zed zed"), (8, "the-the"), (9, "é")]
    asked = spark.createDataFrame(queries, "query long, text string")
    table = lambda d: spark.createDataFrame([("e", k, v) for k, v in d.items()], "kind string, id string, text string")
    kept = index.Index(spark, folder(tmp_path), buckets=4)
    kept.build(table(docs))

    def same():
        for idx in ("word", "gram"):
            got = {(r.query, r.id): r.score for r in kept.search(asked, idx).collect()}
            want = scores(docs, queries, idx)
            assert got.keys() == want.keys() and all(abs(got[k] - v) < 2e-5 for k, v in want.items())

    same()
    for step in range(2):  # the second change also replaces what the first one wrote
        changed = {str(i): say() for i in rng.sample(range(50), 9)}
        gone = [k for k in docs if k not in changed][step :: 5]
        kept.update(table(changed), spark.createDataFrame([("e", k) for k in gone], "kind string, id string"))
        docs = {k: v for k, v in (docs | changed).items() if k not in gone}
        same()
    # a change that broke before its commit leaves no trace
    kept._table("postings", index.POSTINGS, 1).limit(5).withColumn("gen", F.lit("broken")).write.mode("append").partitionBy("idx", "bucket").parquet(f"{kept.root}/v1/postings")
    same()
    kept.compact()
    same()
    kept.update(table({"0": "the end"}))
    docs["0"] = "the end"
    same()


def test_a_search_reads_the_partitions_of_its_terms(spark, tmp_path):
    kept = index.Index(spark, folder(tmp_path), buckets=16)
    kept.build(spark.createDataFrame([("e", str(i), f"word{i} common text") for i in range(30)], "kind string, id string, text string"))
    rows = kept.postings(spark.createDataFrame([("word3",)], "term string"), "word")
    plan = rows._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(idx" in plan and "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "PushedFilters" in plan and "term" in plan.split("PushedFilters:")[1].split("]")[0]
    assert [r.id for r in rows.collect()] == ["3"]


def test_a_derived_episode_for_each_set_of_members(spark, tmp_path):
    from epistema.plans.consolidate import Consolidation

    rows = [("s1", 1), ("s1", 2), ("s2", 2), ("s2", 3), ("s3", 7), ("s4", 8), ("s4", 9)]
    schema = "statement_id string, episode_id long, subject_id string, object string"
    table = lambda rows: spark.createDataFrame([(s, e, f"e:{s}", f"o:{e}") for s, e in rows], schema)
    episodes = spark.createDataFrame([(i, f"First of {i}. More.", 0) for i in range(12)], "episode_id long, content string, ingested_at long")
    beliefs = spark.createDataFrame([("e:s1", "contradicted", 1, 0), ("e:s2", "active", 3, 0)], "subject_id string, status string, distinct_episodes long, n_untrusted long")
    store = Consolidation(spark, folder(tmp_path))
    assert store.run(table(rows), episodes, beliefs, "x", 0) == 2
    first = {r.text: (r.n_members, r.uncertainty) for r in store.derived().collect()}
    # of two beliefs one is contradicted, one has a single episode
    assert first == {"First of 1.\nFirst of 2.\nFirst of 3.": (3, round(0.4 * 0.5 + 0.25 * 0.5, 6)), "First of 8.\nFirst of 9.": (2, 0.0)}
    of = {r.episode_id: r.n_members for r in store.derived().collect()}
    assert sorted((of[r.from_episode], r.to_episode, r.rel) for r in store.links().collect()) == [(2, "8", "summarizes"), (2, "9", "summarizes"), (3, "1", "summarizes"), (3, "2", "summarizes"), (3, "3", "summarizes")]
    assert store.run(table(list(reversed(rows))), episodes, beliefs, "x", 5) == 0
    assert store.run(table([*rows, ("s4", 10)]), episodes, beliefs, "x", 5) == 1
    assert store.run(table(rows), episodes, beliefs, "other", 5) == 2
    assert store.derived().count() == 5


def test_links_seen_before_are_not_clustered_again(spark, tmp_path, monkeypatch):
    from epistema.operators import graph
    from epistema.plans.consolidate import Consolidation

    rows = [("s1", 1), ("s1", 2), ("s1", 2), ("s2", 2), ("s2", 3), ("s4", 8), ("s4", 9), ("s5", None), (None, 9), (None, 4)]
    table = lambda rows: spark.createDataFrame([(s, e, f"e:{s}", f"o:{e}") for s, e in rows], "statement_id string, episode_id long, subject_id string, object string")
    episodes = spark.createDataFrame([(i, f"First of {i}.", 0) for i in range(12)], "episode_id long, content string, ingested_at long")
    beliefs = spark.createDataFrame([], "subject_id string, status string, distinct_episodes long, n_untrusted long")
    times, clustered = [], graph.components
    monkeypatch.setattr(graph, "components", lambda *a, **k: times.append(1) or clustered(*a, **k))
    store = Consolidation(spark, folder(tmp_path))
    made = lambda rows, extractor="x": (store.run(table(rows), episodes, beliefs, extractor, 0), len(times))
    assert made([], "none") == (0, 1) and not store.derived().count() and not store.links().count()
    assert made(rows) == (2, 2)
    assert made(rows[::-1]) == (0, 2) and made(rows[:2] + rows[3:]) == (0, 2)  # the same links
    assert made(rows[:6]) == (0, 3) and made(rows[:6]) == (0, 3) and made(rows) == (0, 3)  # sets made before, found by other links
    assert made(rows, "other") == (2, 4)
    assert made([*rows, ("s4", 10)]) == (1, 5)
    assert sorted(r.n_members for r in store.derived().collect()) == [2, 2, 3, 3, 3]


def test_occurrence_ids_are_those_of_one_chain(spark):
    import hashlib

    from epistema.operators import relational as rel

    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", "c"]), n, f"c{rng.randrange(9)}") for n in range(300)]
    want, last = set(), {}
    for key, n, content in sorted(rows, key=lambda r: r[1]):
        ident = hashlib.sha256(f"src|{key}|{last.get(key, '')}|{content}".encode()).hexdigest()
        want.add((key, n, last.get(key), ident))
        last[key] = ident
    df = spark.createDataFrame(rows, "path string, seq long, content string").repartition(5)
    got = rel.occurrence_ids(df, "src", "path", "seq", "content")
    assert {(r.path, r.seq, r.predecessor, r.occurrence_id) for r in got.collect()} == want
    assert rel.occurrence_ids(df.limit(0), "src", "path", "seq", "content").count() == 0


def test_any_name_of_a_merged_group_has_its_beliefs(spark):
    from epistema.operators import temporal

    events = spark.createDataFrame([("a", "b", 1, None), ("b", "c", 2, 9), ("x", "y", 3, None)], "loser string, winner string, decided_at long, undone_at long")
    beliefs = spark.createDataFrame([(s, f"of {s}") for s in "abcxyz"], "subject_id string, statement_id string")
    asked = spark.createDataFrame([(s,) for s in "abcxzq"], "entity_id string")

    def said(at):
        out = {}
        for r in temporal.beliefs_of(asked, beliefs, temporal.merge_closure(temporal.merges_in_force(events, at))).collect():
            out.setdefault(r.entity_id, set()).add(r.subject_id)
        return out

    assert said(5) == {"a": set("abc"), "b": set("abc"), "c": set("abc"), "x": set("xy"), "z": {"z"}}
    assert said(9) == {"a": set("ab"), "b": set("ab"), "c": {"c"}, "x": set("xy"), "z": {"z"}}
    assert said(1) == {"a": set("ab"), "b": set("ab"), "c": {"c"}, "x": {"x"}, "z": {"z"}}


def test_trigrams_are_kept_without_places_and_phrases_are_sought_in_texts(spark, tmp_path, monkeypatch):
    table = lambda d: spark.createDataFrame([("e", k, v) for k, v in d.items()], "kind string, id string, text string")
    docs = {"1": "aaaaaa baa", "2": "abab ABABA", "3": "bab aba", "4": "İstanbul \U0001f600\U0001f600\U0001f600\U0001f600", "5": "xaba bxab"}
    kept = index.Index(spark, folder(tmp_path), buckets=2)
    kept.build(table(docs))
    kept.update(table({"3": "abab no more"}), spark.createDataFrame([("e", "5")], "kind string, id string"))
    docs = {k: v for k, v in (docs | {"3": "abab no more"}).items() if k != "5"}
    held = {r.idx: r.b for r in kept._table("postings", index.POSTINGS, 1).groupBy("idx").agg(F.sum(F.length("places")).alias("b")).collect()}
    assert held["gram"] == 0 < held["word"]
    asked = [(1, "aaaa"), (2, "abab aba"), (3, "babab"), (4, "BABA"), (5, "\U0001f600\U0001f600\U0001f600\U0001f600 İstan"), (6, "abaab")]
    queries = spark.createDataFrame(asked, "query long, text string")
    for named in (10_000, 2):  # documents named in the plan, or joined
        monkeypatch.setattr(index, "NAMED", named)
        hits = {(r.query, r.phrase, r.id): r.tf for r in kept.hits(queries, "gram").collect()}
        want = {}
        for q, s in asked:
            for i, p in enumerate(s.lower().split()):
                for d, t in docs.items():
                    n = sum(t.lower().startswith(p, k) for k in range(len(t.lower())))
                    if n:
                        want[q, i, d] = n
        assert hits == want and len(want) == 8
    kept.compact()
    assert {(r.query, r.phrase, r.id): r.tf for r in kept.hits(queries, "gram").collect()} == want
