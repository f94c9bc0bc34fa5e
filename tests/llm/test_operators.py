import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import ODD
from pyspark.sql import functions as F

from llm import components, kernel, op1_ngram_jaccard, op2_pii, op3_language_id, op4_substring_dedup, op5_decontamination, op6_repetition, op7_byte_bpe, op8_toxicity, op9_token_files, op10_secrets, vocab

SF = "/root/testdata/sf0.001"


def pairs(df):
    return sorted(((r.doc_id, *r[1:]) for r in df.collect()), key=str)


def test_words_of_slices_are_those_of_a_pattern():
    import re

    t = ["a b", "", "é x y", " lead", "trail ", "\x0b\x0c", "x" * 50]
    own = []
    for _, _, w in kernel.each_slice(pa.array(t), limit=9):
        for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True):
            own.append([w.data[s:e].tobytes().decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)])
    assert own == [re.findall(r"[^\x20\x09-\x0D]+", x) for x in t]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for u, v in links if u != v for x in (u, v)}
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == want


@pytest.mark.parametrize("block", [16 << 20, 3000])
def test_op1_query_and_blocks(spark, docs, texts, block):
    got = pairs(op1_ngram_jaccard.join(docs, block_bytes=block))
    assert got == sorted(op1_ngram_jaccard.brute_force(list(texts.items())), key=str)


def test_op1_near_copies_in_blocks(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(9999)}"
        rows.append((i, " ".join(w)))
    got = pairs(op1_ngram_jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=9000))
    assert got == sorted(op1_ngram_jaccard.brute_force(rows), key=str)


def test_op1_an_id_is_one_node(spark):
    a, b, c = "a b c d", "e f g h", "k l m n"
    rows = [(5, a), (7, a), (5, b), (3, b), (9, c), (8, c), (9, ""), (9, None), (2, ""), (2, None), (4, "only one"), (4, "only one")]
    got = pairs(op1_ngram_jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == sorted(op1_ngram_jaccard.brute_force(rows), key=str)
    assert {k for i, _, k in got if i in (3, 5, 7)} == {3} and {k for i, _, k in got if i == 9} == {8}


def test_op1_a_set_meets_only_sets_that_share_rare_shingles(monkeypatch):
    import numpy as np

    rng = random.Random(4)
    common = rng.sample(range(10**6, 2 * 10**6), 300)
    # groups of near copies that share common shingles with each other, which chain them to one cluster
    sets, group = [], []
    for g in range(40):
        base = rng.sample(range(10**6), 60)
        for _ in range(4):
            sets.append(np.array(sorted({*base[: 60 - rng.randrange(3)], *rng.sample(common, 40), g * 10**3 + rng.randrange(3)} if g % 4 else {*rng.sample(base, 58), *common[:40]}), np.uint64))
            group.append(g)
    met, whole = [], op1_ngram_jaccard.SetTrie._near
    monkeypatch.setattr(op1_ngram_jaccard.SetTrie, "_near", lambda self, p, before: met.append(whole(self, p, before)) or met[-1])
    for num in (60, 90):
        met.clear()
        links = list(op1_ngram_jaccard.SetTrie(sets, [len(s) for s in sets], num, 100).links())
        sizes = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i in range(len(sets)) for j in range(i)}
        true = [k for k, c in sizes.items() if 100 * c >= num * (len(sets[k[0]]) + len(sets[k[1]]) - c)]
        assert true and components_of(len(sets), links) == components_of(len(sets), true)
        # all sets before each are 12,720 pairs
        assert sum(map(len, met)) < 1000


def components_of(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def thue_morse(n):
    """Two words that powers of any base modulo 2**64 hash alike from 1,024 bytes on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096, 8192])
def test_words_that_only_look_alike(spark, n):
    from tokenizers import Tokenizer

    one, two = thue_morse(n)
    raw = np.frombuffer(f"{one} {two}".encode(), np.uint8)
    w = kernel.words(raw, np.array([0, len(raw)]))
    assert w.hash[0] != w.hash[1]
    library = Tokenizer.from_file(public_tokenizers.path(op9_token_files.VOCABULARY))
    cache = vocab.Cache(op9_token_files.Library(public_tokenizers.path(op9_token_files.VOCABULARY)))
    ids, size = cache(raw, w.start, w.end)
    want = [library.encode(t, add_special_tokens=False).ids for t in (one, two)]
    assert size.tolist() == [len(x) for x in want] and ids.tolist() == want[0] + want[1]


def test_cache_looks_at_bytes_where_hashes_meet(monkeypatch):
    monkeypatch.setattr(kernel, "span_hash", lambda data, start, end, fold=False: (end - start).astype(np.uint64))
    cache = vocab.Cache(lambda units: (np.concatenate([np.frombuffer(u, np.uint8) for u in units]).astype(np.uint32), [len(u) for u in units]))
    for text in (b"ab cd ab e", b"xy cd f", b"cd ab"):
        raw = np.frombuffer(text, np.uint8)
        start, end, _ = kernel.spans(raw, np.array([0, len(raw)]))
        assert bytes(cache(raw, start, end)[0].astype(np.uint8)) == text.replace(b" ", b"")


def test_op1_odd_rows(odd, empty):
    got = pairs(op1_ngram_jaccard.join(odd))
    assert len(got) == len(ODD)
    by = {i: (n, c) for i, n, c in got if i is not None}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[5] == (1, 5) and by[6] == (1, 5) and by[11][1] == 10
    assert all(c is None for i, _, c in got if i is None)
    assert op1_ngram_jaccard.join(empty).count() == 0


def test_op2_query(spark, texts):
    for r in op2_pii.query(spark, SF).collect():
        assert tuple(r[1:6]) == op2_pii.brute_force(texts[r.doc_id])
        spans = [s for s in r.spans.split(",") if s]
        assert len(spans) == sum(r[1:5]) + r.n_added
        if not r.n_added:
            assert hashlib.sha256(r.spans.encode()).hexdigest() == r.base_sha256


def test_op2_adds_other_writings_and_no_lookalikes(spark):
    model = op2_pii.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rng = np.random.default_rng(5)
    planted = []
    for i in range(60):
        a, b, c, d = (int(v) for v in rng.integers(100, 250, 4))
        planted += [("email", f"user{a}.x [at] mail{b % 10} [dot] example [dot] org"), ("email", f"u{a}(at)host{b}(dot)net"), ("phone", f"1 ({a}) 555-{1000 + b}"), ("ip", f"{a}[.]{b}[.]{c}[.]{d}"), ("ip", f"2001:db8:{a}:{b}:{c}:{d}:0:1")]
        digits = "".join(str(int(v)) for v in rng.integers(0, 10, 15)) + "0"
        total = sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(digits)))
        good = digits[:-1] + str((-total) % 10)
        bad = digits[:-1] + str((1 - total) % 10)
        planted += [("card", "/".join(good[k : k + 4] for k in (0, 4, 8, 12))), (None, "/".join(bad[k : k + 4] for k in (0, 4, 8, 12))), (None, f"on 2024-11-{10 + i % 20} at 12:30:{i % 50 + 10} v1.{i}.3")]
    rows = [(i, f"word beside {t} word") for i, (_, t) in enumerate(planted)]
    out = op2_pii.find(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    right = sum(planted[r.doc_id][0] in [s.kind for s in r.added] for r in out if planted[r.doc_id][0])
    added = sum(len(r.added) for r in out)
    assert right >= 0.9 * sum(k is not None for k, _ in planted) and right >= 0.9 * added


def test_op2_scores_are_those_of_the_trees(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, (200, len(op2_pii.FEATURES))).astype(float)
    m = op2_pii.boost(x, ((x[:, 0] + x[:, 3]) > 6) * 3.0, np.full(200, 3.0), np.arange(200) % 5 == 4)
    want = m.start + sum(op2_pii.RATE * op2_pii._value(t, x) for t in m.trees)
    df = spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(x)], ", ".join(["i int"] + [f"`{f}` int" for f in op2_pii.FEATURES]))
    score = F.lit(m.start)
    for t in m.trees:
        score = score + op2_pii.RATE * op2_pii._sql(t, F.col)
    got = [r.s for r in df.select("i", score.alias("s")).orderBy("i").collect()]
    assert np.allclose(got, want)


def test_op2_spans_over_several_blocks(spark):
    text = "ü 1.2.3.4 a@b.co " * (op2_pii.BLOCK + 40)
    none = {k: op2_pii.Boosted(-20.0, [], np.inf) for k in op2_pii.KINDS}
    r = op2_pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), none).select(op2_pii.joined(F.col("base")).alias("b")).first()
    assert hashlib.sha256(r.b.encode()).hexdigest() == op2_pii.brute_force(text)[4]


def test_op2_odd_rows_and_added_spans(spark, docs, odd, empty):
    model = op2_pii.learn(docs)
    hard = [(i, t) for i, t in ODD] + [(20, "7" * 30000 + "+" + "1 " * 9000), (21, "a@b" + ".c" * 9000 + "_d@e.f 1.2.3.4.5.6.7.8 999.1.1.1 000255.1.1.1")]
    out = op2_pii.find(spark.createDataFrame(hard, "doc_id long, text string"), model).select("text", op2_pii.joined(F.col("base")).alias("b")).collect()
    assert len(out) == len(hard)
    for r in out:
        assert hashlib.sha256(r.b.encode()).hexdigest() == op2_pii.brute_force(r.text)[4]
    assert op2_pii.find(empty, model).count() == 0
    none = op2_pii.learn(empty)
    assert op2_pii.find(odd, none).count() == len(ODD)


def test_op2_boosting_ranks_and_calibrates():
    x = np.array([[i % 5, i % 3] + [0] * 6 for i in range(300)], float)
    y = (x[:, 0] >= 3).astype(float) * 10
    m = op2_pii.boost(x, y, np.full(300, 10.0), np.arange(300) % 5 == 4)
    score = m.start + sum(op2_pii.RATE * op2_pii._value(t, x) for t in m.trees)
    assert ((score >= m.threshold) == (y > 0)).all()


def test_op2_redacts(spark):
    model = {k: op2_pii.Boosted(-20.0, [], np.inf) for k in op2_pii.KINDS}
    df = spark.createDataFrame([(1, "mail a@b.co now"), (2, "no")], "doc_id long, text string")
    got = op2_pii.find(df, model).select(op2_pii.redacted(F.col("text"), F.col("base")).alias("t")).collect()
    assert [r.t for r in got] == ["mail <email> now", "no"]


def test_op3_held_out_accuracy(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in op3_language_id.query(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(held) > 100
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in held)


def test_op3_rejects_what_is_in_no_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(1)
    odd = ["Съешь же ещё этих мягких французских булок да выпей чаю " * 3, "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(200)), "12 34"]
    more = docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"), allowMissingColumns=True)
    kept = {r.doc_id for r in op3_language_id.accepted(more, op3_language_id.learn(docs)).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}
    model = op3_language_id.learn(docs)
    keys = spark.createDataFrame([(1, 'the reason token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" 8316107434564120')], "doc_id long, text string")
    assert op3_language_id.accepted(keys, model).count() == 1


def test_op3_learns_every_language_and_one_row_of_repeats(spark, monkeypatch):
    monkeypatch.setattr(op3_language_id, "train", lambda samples: samples)
    rows = [(i, f"{chr(97 + i % 26)}{i} " * 20, f"l{i:03}") for i in range(300) if zlib.crc32(str(i).encode()) % 4 != 2]
    samples = op3_language_id.learn(spark.createDataFrame(rows * 3, "doc_id long, text string, lang string"))
    assert samples == {r[2]: [r[1].encode()] for r in rows} and len(rows) > 200


def test_op3_odd_rows(docs, odd, empty):
    got = pairs(op3_language_id.identify(odd, op3_language_id.learn(docs)))
    by = {i: p for i, p, *_ in got if i is not None}
    assert len(got) == len(ODD) and by[1] == by[2] == by[3] == "und" and by[9] != "und"
    assert {r.lang_pred for r in op3_language_id.identify(odd, op3_language_id.learn(empty)).collect()} == {"und"}
    assert op3_language_id.identify(empty, op3_language_id.learn(docs)).count() == 0


def test_op4_query(spark, docs, texts):
    want = dict(zip(texts, op4_substring_dedup.brute_force(list(texts.values())), strict=True))
    for r in op4_substring_dedup.query(spark, SF).collect():
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]


@pytest.mark.parametrize("window", [2, 5, 6])
def test_op4_windows(spark, window):
    rng = random.Random(window)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 30)))) for i in range(12)]
    want = op4_substring_dedup.brute_force([t for _, t in rows], window)
    got = op4_substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"), window).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed) for r in got] == [x[:2] for x in want]


def test_op4_odd_rows(odd, empty):
    got = op4_substring_dedup.repeats(odd).collect()
    want = sorted((x[:2] for x in op4_substring_dedup.brute_force([t for _, t in ODD])))
    assert sorted((r.n_words, r.n_removed) for r in got) == want
    assert op4_substring_dedup.repeats(empty).count() == 0


def test_op5_finds_what_stands_in_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in op5_decontamination.contaminated(docs, items).collect()}
    want = op5_decontamination.brute_force([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert want and len(want & got) >= 0.98 * len(want)
    assert len(got - want) <= 0.02 * len(want) + 1


@pytest.mark.parametrize("copies", [False, True])
def test_op5_finds_an_item_that_a_third_of_documents_hold(spark, copies):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    item, group = text(24), text(80)
    hot = [f"{group if copies else text(40)} {item} {text(0 if copies else 40)}" for _ in range(400)]
    rows = [*enumerate(hot + [f"{text(60)} {item} {text(60)}" for _ in range(5)] + [text(120) for _ in range(795)])]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, text(30))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in op5_decontamination.contaminated(docs, items).collect()}
    assert got == {(d, 1) for d in range(405)}


@pytest.mark.parametrize("least, most", [(5, 10), (15, 59), (100, 150), (250, 350)])
def test_op5_finds_every_copy_of_a_full_block(spark, least, most):
    rng = random.Random(least)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    long = [w for _, t in rows if len(w := (t or "").split()) > most]
    items = []
    for i in range(op5_decontamination.ITEMS):
        words, n = rng.choice(long), rng.randint(least, most)
        a = rng.randrange(len(words) - n)
        items.append((i, " ".join(words[a : a + n])))
    got = {(r.doc_id, r.item_id) for r in op5_decontamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = op5_decontamination.brute_force(rows, items)
    print(least, most, len(want & got), len(want))
    assert want and not want - got


def test_op5_paraphrase_and_odd_rows(spark, odd, empty, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    text = items.filter("item_id = 0").first().text.split()
    changed = " ".join(w if i % 9 else "zzz" for i, w in enumerate(text))
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, f"some words before {changed} and after")], "doc_id long, text string"))
    assert (10**6, 0) in {(r.doc_id, r.item_id) for r in op5_decontamination.contaminated(more, items).collect()}
    none = items.filter("item_id < 0")
    assert op5_decontamination.contaminated(odd, none).count() == 0
    assert op5_decontamination.contaminated(empty, items).count() == 0
    op5_decontamination.contaminated(odd, items.unionByName(spark.createDataFrame([(900, None), (901, ""), (None, "one two")], "item_id long, text string"))).count()


def test_op5_lcs():
    assert op5_decontamination.lcs_length([1, 2, 3, 4], [2, 9, 3, 4, 1]) == 3
    assert op5_decontamination.lcs_length([], [1]) == 0


def test_op5_tries_every_start(spark):
    item = [f"u{i}" for i in range(40)]
    kept = [w for i, w in enumerate(item) if i % 10 < 7]
    fill = iter(f"z{i}" for i in range(10**6))
    spread = [w for i, w in enumerate(kept) for w in ([w] if i == 27 else [w, next(fill)])]
    spread[-1:-1] = [next(fill) for _ in range(60 - len(spread))]
    rows = [(k, " ".join([next(fill) for _ in range(50)] + ["u36"] * k + spread + [next(fill) for _ in range(50)])) for k in range(30)]
    rows += [(100 + k, " ".join([w for w in item if w not in kept][::-1])) for k in range(60)]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.lcs for r in op5_decontamination.contaminated(docs, items).collect()}
    assert got == {k: 0.7 for k in range(30)}


def test_op5_best_span_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n, most = int(rng.integers(1, 12)), int(rng.integers(2, 20))
        item, text = rng.integers(0, most, n).astype(np.uint64), rng.integers(0, most, int(rng.integers(0, 40))).astype(np.uint64)
        span, least = n + max(4, n // 2), int(np.ceil(op5_decontamination.LCS * n))
        want = max((op5_decontamination.lcs_length(item.tolist(), text[i : i + span].tolist()) for i in range(len(text))), default=0)
        assert op5_decontamination.best_span(item, text, span, least)[0] == (want if want >= least else 0)


def test_op6_query(spark, texts):
    for r in op6_repetition.query(spark, SF).collect():
        if len(texts[r.doc_id]) < 12000:
            assert tuple(r[1:9]) == op6_repetition.brute_force(texts[r.doc_id]), r.doc_id


def test_op6_long_repeats():
    rng = random.Random(2)
    for _ in range(20):
        passage = " ".join(f"p{i}" for i in range(rng.randrange(5, 40)))
        t = " ".join(f"a{i}" for i in range(60)) + f" {passage} mid {passage} " + " ".join(f"b{i}" for i in range(40))
        raw = np.frombuffer(t.encode(), np.uint8)
        out = op6_repetition._slice(kernel.words(raw, np.array([0, len(raw)])), np.array([0, len(raw)]), 10)
        assert int(out[5][0]) == op6_repetition.brute_force(t)[-1]


def test_op6_odd_rows(odd, empty):
    got = op6_repetition.judge(odd).collect()
    assert len(got) == len(ODD) and all(r.base_failed and not r.kept for r in got if r.n_words < 50)
    assert op6_repetition.judge(empty).count() == 0


def test_op7_is_the_library(spark):
    import tiktoken

    ranks = op7_byte_bpe.read_ranks(public_tokenizers.path(op7_byte_bpe.RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    rows = list(ODD) + [(100 + i, "".join(rng.choice("ab c\n\t 'st12.é日　  \x1c") for _ in range(rng.randrange(80)))) for i in range(300)]
    got = op7_byte_bpe.encode(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    for (i, t), r in zip(rows, got, strict=True):
        assert r.doc_id == i and bytes(r.decoded).decode() == (t or "")
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode_ordinary(t or "")


def test_op7_appends_and_edits():
    encoder = op7_byte_bpe.Encoder(op7_byte_bpe.read_ranks(public_tokenizers.path(op7_byte_bpe.RANKS)))
    rng = random.Random(6)
    for _ in range(100):
        w = bytes(rng.choice(b"abcdefgh the ing") for _ in range(40))
        p = op7_byte_bpe.Prefixes(encoder, w[:20])
        p.append(w[20:])
        a, b = sorted(rng.sample(range(40), 2))
        p.replace(a, b, b"zq" * rng.randrange(4))
        assert p.ids() == op7_byte_bpe.Prefixes(encoder, p.piece).ids()
        assert encoder.decode(p.ids()) == p.piece


def test_op8_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in op8_toxicity.query(spark, sf).collect() if r.held_out and r.doc_id in labels]
    hit = sum(r.predicted and labels[r.doc_id] for r in held)
    assert hit / sum(labels[r.doc_id] for r in held) > 0.85
    assert hit / max(1, sum(r.predicted for r in held)) > 0.9
    assert all(0 <= r.score <= 1 for r in held)


def test_op8_folds_and_excepts():
    assert op8_toxicity.fold("1D10T Ѕtuρid! don't wörthless 2024 ＩＤＩＯＴ") == " idiot stupid dont worthless 2024 idiot "
    m = op8_toxicity.Matcher(op8_toxicity.Lexicon({"trash": 2.0, "idiot": 3.0}, ("trash can",), (0.0, 1.0, 1.0)))
    assert m.features("the trash can") == (0, 0, 3)
    assert m.features("Trash! 1d10t trash can")[:2] == (2, 5.0)


def test_op8_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 1), (4, 1, 0), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    for lex in (op8_toxicity.learn(odd, labels), op8_toxicity.learn(odd, labels.limit(0)), op8_toxicity.learn(empty, labels)):
        assert op8_toxicity.score(odd, lex).count() == len(ODD)
    assert op8_toxicity.score(empty, lex).count() == 0


def test_op9_round_trip_of_blocks():
    rng = np.random.default_rng(0)
    for n in (1, 5, 511, 512, 513, 100_000):
        ids = (rng.zipf(1.3, n) % 49408).astype(np.uint32)
        table = op9_token_files.Table.of(np.bincount(ids, minlength=1 << 16))
        assert int(table.f.sum()) == 1 << op9_token_files.BITS
        states, words, points = table.encode(ids)
        assert (table.decode(n, states, words)[0] == ids).all()
        assert (np.concatenate(table.parts(n, states, words, points)) == ids).all()


def test_op9_query(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(op9_token_files.VOCABULARY))
    at, want = 0, []
    for i in sorted(texts):
        ids = [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert pairs(op9_token_files.query(spark, SF)) == sorted(want, key=str)


def test_op9_special_tokens_in_texts(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(op9_token_files.VOCABULARY))
    rng = random.Random(9)
    marks = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "<", "|", "A", "don't", "é", "É", "×", "12", " ", "  ", "\n", "日本", "e\u0301", "!?", "\x1c", "ß"]
    rows = [(0, "hello <|endoftext|> world"), (1, "hello<|endoftext|>world <|endoftext|><|endoftext|>"), *((2 + i, "".join(rng.choices(marks, k=rng.randrange(12)))) for i in range(400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    raw = op9_token_files.tokenized(docs, public_tokenizers.path(op9_token_files.VOCABULARY), 2).filter("block >= 0").orderBy("shard", "block").collect()
    ids = np.concatenate([np.frombuffer(r.low, np.uint8) | np.frombuffer(r.high, np.uint8).astype(np.uint32) << 8 for r in raw])
    lengths = np.concatenate([np.frombuffer(r.lengths, np.uint32) for r in raw]).astype(np.int64)
    ends = np.cumsum(lengths)
    for (_, t), a, b in zip(rows, ends - lengths, ends, strict=True):
        assert ids[a:b].tolist() == [*library.encode(t, add_special_tokens=False).ids, 2], t


def test_op9_odd_rows_and_damage(spark, odd, empty, tmp_path):
    op9_token_files.write(odd, f"file:{tmp_path}/a")
    got = op9_token_files.read(spark, f"file:{tmp_path}/a").orderBy("start").collect()
    assert len(got) == len(ODD) and got[0].doc_id is None and [r.n_tokens for r in got if r.doc_id == 1] == [1]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:], strict=False))
    op9_token_files.write(empty, f"file:{tmp_path}/b")
    assert op9_token_files.read(spark, f"file:{tmp_path}/b").count() == 0
    bad = spark.read.parquet(f"{tmp_path}/a/blocks").withColumn("crc32", F.col("crc32") + 1)
    bad.write.parquet(f"{tmp_path}/c/blocks")
    spark.read.parquet(f"{tmp_path}/a/table").write.parquet(f"{tmp_path}/c/table")
    with pytest.raises(Exception, match="checksum"):
        op9_token_files.read(spark, f"file:{tmp_path}/c").collect()


def test_op10_query(spark, texts):
    for r in op10_secrets.query(spark, SF).collect():
        assert tuple(r[1:5]) == op10_secrets.brute_force(texts[r.doc_id])


def test_op10_field_knows_secrets_it_was_not_shown(spark, docs):
    field = op10_secrets.learn(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    held = [t for (t,) in docs.filter("text rlike 'AKIA|token = |password='").select("text").limit(30).collect()]
    right = wrong = missed = 0
    for t in held:
        raw = np.frombuffer(t.encode(), np.uint8)
        w = kernel.words(raw, np.array([0, len(raw)]))
        want, got = op10_secrets.labels(w, op10_secrets.base_spans(raw)) > 0, op10_secrets.tag(w, field) > 0
        right, wrong, missed = right + int((want & got).sum()), wrong + int((got & ~want).sum()), missed + int((want & ~got).sum())
    assert right >= 0.9 * (right + missed) and right >= 0.9 * (right + wrong)


def test_op10_adds_other_writings_and_no_lookalikes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = op10_secrets.learn(docs)
    clean = [r.text for r in docs.filter("length(text) between 200 and 5000").select("text").limit(200).collect()]
    rng, rows = np.random.default_rng(99), []
    for i, text in enumerate(clean):
        words, value = text.split()[:40], op10_secrets._value(rng)
        lead = op10_secrets.LEADS[int(rng.integers(len(op10_secrets.LEADS)))]
        rows.append((i, " ".join([*words[:20], lead, value, *words[20:]]), value))
    out = op10_secrets.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), field).collect()
    right = sum(rows[r.doc_id][1][s.start : s.end] == rows[r.doc_id][2] for r in out for s in r.spans if s.kind == "crf")
    assert right >= 0.9 * len(rows) and right >= 0.9 * sum(r.n_crf for r in out)
    other = ["the password is required", "see https://docs.example.com/Reference/API_Index.html for the token list", "order 9807915762804490 of 2024-11-26", "the secret of state-of-the-art ceremony"]
    assert sum(r.n_crf for r in op10_secrets.scan(spark.createDataFrame(list(enumerate(other)), "doc_id long, text string"), field).collect()) == 0


def test_op10_viterbi_and_pruning():
    rng = np.random.default_rng(1)
    for _ in range(30):
        s, turn = rng.normal(0, 2, (5, 3)), rng.normal(0, 1, (3, 3))
        best, score = None, -np.inf
        import itertools

        barred = turn + op10_secrets._BARRED
        for path in itertools.product(range(3), repeat=5):
            v = sum(s[i, p] for i, p in enumerate(path)) + sum(barred[a, b] for a, b in zip((0, *path), (*path, 0), strict=True))
            if v > score:
                best, score = path, v
        assert tuple(op10_secrets.viterbi(s, turn)) == best


def test_op10_odd_rows(odd, empty):
    field = op10_secrets.learn(odd)
    assert op10_secrets.scan(odd, field).count() == len(ODD)
    assert op10_secrets.scan(empty, op10_secrets.learn(empty)).count() == 0


def test_units_cover_texts():
    t = "  a \n b　c  d  ".encode()
    data = np.frombuffer(t, np.uint8)
    s, e = vocab.spaced_words(data, np.array([0, len(t)]))
    assert b"".join(t[a:b] for a, b in zip(s, e, strict=True)) == t
