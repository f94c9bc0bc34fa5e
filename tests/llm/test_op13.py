import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import ODD

from llm import op13_divergence as op13

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute_force(rows, least=op13.LEAST, top=op13.TOP):
    """Rows of (text, lang, source) to the query's, over all terms of all pairs."""
    docs = [(a or "", b or "", c or "") for a, b, c in rows]
    seen, whole, own = defaultdict(int), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        words = TERM.findall(text.translate(UPPER))
        for w in set(words):
            seen[lang, w] += 1
        whole[lang].update(words)
        own[lang, source].update(words)
    out = []
    for lang in {b for _, b, _ in docs}:
        kept = [w for w in whole[lang] if seen[lang, w] >= least]
        p = {}
        for name, counts in [*((s, c) for (b, s), c in own.items() if b == lang), (None, whole[lang])]:
            total = sum(counts[w] for w in kept) + 2 * len(kept)
            p[name] = {w: 1 + 10**9 * (counts[w] + 2) // total for w in kept}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for source in p.keys() - {None}:
            pair = [(sum(f(p[source][w], p[o][w]) for w in kept), o) for o in p.keys() - {None, source}]
            term = [(f(p[source][w], p[None][w]), w) for w in kept if own[lang, source][w] and p[source][w] > p[None][w]]
            for part, found in (("pair", pair), ("term", sorted(term, key=lambda x: (-x[0], x[1].encode()))[:top])):
                out += [(lang, source, part, item, v, i) for i, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def made(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("seed", range(3))
def test_random_tables_against_all_terms_of_all_pairs(spark, monkeypatch, seed):
    rng = random.Random(seed)
    words = ["the", "The", "été", "ÉTÉ", "naïve", "日本", "a1b", "x-y", "don't", "\U0001f600", " ", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = []
    for _ in range(300):
        text = " ".join(rng.choice(words[: rng.randrange(2, len(words))]) for _ in range(rng.randrange(12)))
        rows.append((rng.choice([text, text, text, None, ""]), rng.choice(["en", "en", "de", None, "", "rare"]), rng.choice([None, "", "hot", "hot", "hot", *(f"s{k}" for k in range(9))])))
    rows += [("word " * 30, "lone", "one")] * 12 + [("too few", "none", s) for s in ("a", "b", "b")]
    monkeypatch.setattr(op13, "SLICE_BYTES", 700)
    monkeypatch.setattr(op13, "ADDED", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert rows_of(op13.audit(made(spark, rows))) == brute_force(rows)
        assert rows_of(op13.audit(made(spark, rows), least=1, top=3)) == brute_force(rows, 1, 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_partial_sums_are_emitted_in_between():
    rng = np.random.default_rng(4)
    rows = [("en", f"t{t:02}", f"s{s:02}", int(rng.integers(1, 9))) for t in range(30) for s in range(12) if rng.random() < 0.8]
    total, of = Counter(), Counter()
    for _, t, s, n in rows:
        total[s] += n
        of[t] += n
    columns = [*zip(*rows, strict=True), [of[r[1]] for r in rows], [total[r[2]] for r in rows], [30] * len(rows), [sum(of.values())] * len(rows)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["lang", "term", "source", "n", "all_n", "total", "terms", "all_total"])
    sums = []
    for held in (3, 10**6):
        found = Counter()
        for size in (7, 1000):
            part = Counter()
            for out in op13.scan_terms(iter([batch.slice(i, size) for i in range(0, len(rows), size)]), held):
                for r in out.to_pylist():
                    part[r["part"], r["source"], r["item"]] += r["value"]
            assert not found or part == found
            found = part
        sums.append(found)
    assert sums[0] == sums[1] and len([k for k in sums[0] if k[0] == "pair"]) == len(list(itertools.combinations(total, 2)))


def test_shares_of_large_totals_are_exact():
    n, total = np.array([2, 10**15, 123456789012345, 7]), np.array([9 * 10**15, 10**15, 987654321098765, 10**15])
    assert op13.share(n, total).tolist() == [1 + 10**9 * a // b for a, b in zip(n.tolist(), total.tolist(), strict=True)]


def test_odd_rows(spark, odd, empty):
    rows = [(t, "en" if (i or 0) % 2 else None, "s") for i, t in ODD]
    assert rows_of(op13.audit(odd, least=2)) == brute_force(rows, 2)
    assert op13.audit(empty).count() == 0


def test_a_text_of_megabytes(spark):
    rows = [("ab " * 1_000_000, "en", "long"), ("é" * 1_000_000, "en", "short"), ("ab cd " * 10, "en", "short")] * 2
    assert rows_of(op13.audit(made(spark, rows), least=2)) == brute_force(rows, 2)


def test_query_is_its_sql(spark):
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    assert rows_of(op13.query(spark, "/root/testdata/sf0.01")) == sorted(con.sql(op13.SQL).fetchall())
