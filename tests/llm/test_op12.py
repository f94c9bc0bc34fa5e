import random
import zlib

import duckdb
import pytest
from conftest import ODD

from llm import op12_zorder_layout as op12

COLUMNS = ["doc_id", "z", "position", "file", "files_touched", "files_matching", "file_bounds"]


def brute_force(rows, per_file, reach=op12.REACH):
    """Rows of (doc_id, text, lang, source) to the query's columns, all pairs of rows and files."""
    least = lambda x: (0, b"") if x is None else (1, x.encode() if isinstance(x, str) else x)
    own = []
    for i, text, lang, source in rows:
        date = None if i is None else zlib.crc32(str(i).encode()) % 365
        own.append((i, {"source": source, "lang": lang, "length": -1 if text is None else len(text.encode()), "date": date}))
    n = len(own)
    at = []
    for _, v in own:
        at.append({a: 16 * sum(least(w[a]) < least(v[a]) for _, w in own) // n for a in v})
    z = []
    for c in at:
        bits = "".join(f"{c[a]:04b}"[d] for d in range(4) for a in ("length", "source", "date", "lang"))
        z.append(int(bits, 2))
    order = sorted(range(n), key=lambda r: (z[r], own[r][0] is not None, own[r][0] or 0))
    files = {}
    for p, r in enumerate(order):
        files.setdefault(p // per_file, []).append(r)
    bounds = {f: {a: (min(at[r][a] for r in rs), max(at[r][a] for r in rs)) for a in op12.AXES} for f, rs in files.items()}
    out = []
    for p, r in enumerate(order):
        box = {a: (at[r][a] - reach.get(a, 0), at[r][a] + reach.get(a, 0)) for a in op12.AXES}
        touched = sum(all(b[a][0] <= box[a][1] and b[a][1] >= box[a][0] for a in box) for b in bounds.values())
        match = sum(any(all(box[a][0] <= at[o][a] <= box[a][1] for a in box) for o in rs) for rs in files.values())
        f = p // per_file
        out.append((own[r][0], z[r], p, f, touched, match, ",".join(str(x) for a in op12.AXES for x in bounds[f][a])))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def made(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("per_file", [1, 7, 500])
def test_random_tables_against_all_pairs(spark, per_file):
    rng = random.Random(per_file)
    rows = []
    for i in range(260):
        source = rng.choice([None, "", "hot", "hot", "hot", "é", "z", "\U0001f600", *(f"s{k}" for k in range(12))])
        text = rng.choice([None, "", "é" * rng.randrange(40), "x" * rng.randrange(300), "same text"])
        rows.append((rng.choice([None, i, i, i, i, 5, 10**12 + i]), text, rng.choice([None, "de", "en", "en", "fr"]), source))
    assert rows_of(op12.layout(made(spark, rows), per_file)) == brute_force(rows, per_file)


def test_boxes_of_other_reach(spark):
    rng = random.Random(9)
    rows = [(i, "x" * rng.randrange(90), rng.choice(["de", "en"]), f"s{rng.randrange(9)}") for i in range(150)]
    reach = {"source": 1, "lang": 16, "length": 0}
    assert rows_of(op12.layout(made(spark, rows), 6, reach)) == brute_force(rows, 6, reach)


def test_a_table_of_copies(spark):
    rows = [(7, "same", "en", "s")] * 120 + [(None, None, None, None)] * 60
    assert rows_of(op12.layout(made(spark, rows), 8)) == brute_force(rows, 8)


def test_odd_rows(spark, odd, empty):
    rows = [(i, t, "en" if (i or 0) % 2 else None, "s") for i, t in ODD]
    assert rows_of(op12.layout(odd, 4)) == brute_force(rows, 4)
    assert op12.layout(empty).count() == 0


@pytest.mark.parametrize("per_file", [9, 500])
def test_sql_of_the_query(spark, docs, per_file):
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    own = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert rows_of(op12.layout(own, per_file)) == sorted(con.sql(op12.sql(per_file)).fetchall(), key=str)


def test_written_files_hold_their_rows(spark, docs, tmp_path):
    op12.write(docs, f"file:{tmp_path}/out", 30)
    back = spark.read.parquet(f"file:{tmp_path}/out")
    want = {(r.doc_id, r.file) for r in op12.layout(docs, 30).collect()}
    assert {(r.doc_id, r.file) for r in back.select("doc_id", "file").collect()} == want
    assert set(back.columns) == {*docs.columns, "file"}
