import base64
import pickle
import random
import zlib
from collections import Counter, defaultdict
from math import log2

import numpy as np
import pyarrow as pa
import pytest

from llm import op3_language_id as op3

SF = "/root/testdata/sf0.01"


def folded(text):
    return b"   " + bytes(b + 32 if 65 <= b < 91 else b for b in text)


def plain_coder(texts, text):
    """Bits of a text, byte for byte, after counts of all contexts of the training texts."""
    seen = defaultdict(Counter)
    for t in map(folded, texts):
        for i in range(3, len(t)):
            for k in range(4):
                seen[t[i - k : i]][t[i]] += 1
    t, bits = folded(text), 0.0
    for i in range(3, len(t) + 1):
        for k in (3, 2, 1, 0):
            c = seen.get(t[i - k : i])
            if c:
                n, d = sum(c.values()), len(c)
                if i < len(t) and t[i] in c:
                    bits -= log2(c[t[i]] / (n + d))
                    break
                bits -= log2(d / (n + d))
        else:
            bits += 8 if i < len(t) else 0
    return bits


def laid_out(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))


@pytest.mark.parametrize("dense", [32, 0])
@pytest.mark.parametrize("block", [1 << 17, 7])
def test_code_lengths_are_those_of_a_plain_coder(monkeypatch, dense, block):
    monkeypatch.setattr(op3, "BLOCK", block)
    rng = random.Random(block)
    words = ["abab", "ba", " ", "xy", "  ", "é", "日", "Q", "\n"]
    mk = lambda n: "".join(rng.choice(words) for _ in range(n)).encode()
    samples = {x: [mk(rng.randrange(12)) for _ in range(5)] for x in "abc"} | {"none": [b""]}
    texts = [mk(rng.randrange(15)) for _ in range(60)] + [b"", b" ", b"   ", b"zzzz \xff", b""]
    model = op3.train(samples)
    got = op3.Scorer(model, dense)(*laid_out(texts))
    assert np.allclose(got, [[plain_coder(samples[x], t) for x in model.languages] for t in texts], atol=1e-4)


#: Letters of five scripts; words of each language are drawn from its own.
SCRIPTS = {"ru": "абвгдежзийклмнопрстуфхцчшщыьэюя", "el": "αβγδεζηθικλμνξοπρστυφχψω", "zh": "的一是不了人我在有他这中大来上国", "ja": "のにはをたがでてとしれさある", "en": "etaoinshrdlucmfw"}


def invented(rng, letters, n):
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(60)]
    return [" ".join(rng.choice(words) for _ in range(12)) for _ in range(n)]


def test_other_scripts(spark):
    rng = random.Random(2)
    rows = [(t, x) for x, letters in SCRIPTS.items() for t in invented(rng, letters, 60)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in op3.identify(docs, op3.learn(docs)).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 50 and np.mean([got[i] == rows[i][1] for i in held]) > 0.98
    known = docs.filter("lang in ('en', 'ru')")
    model = op3.learn(known)
    kept = {r.doc_id for r in op3.accepted(docs, model).select("doc_id").collect()}
    assert {i for i, (_, x) in enumerate(rows) if x in ("en", "ru")} <= kept
    others = [i for i, (_, x) in enumerate(rows) if x not in ("en", "ru")]
    assert np.mean([i not in kept for i in others]) > 0.9


def test_short_clean_texts_stay_and_noise_goes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scorer_model = op3.learn(docs)
    texts = {r.doc_id: r.text for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    clean = ["one two", "Hello world", "bonjour", "OK", "Hi!", "NASA FBI"]
    heads = [" ".join(t.split()[a : a + k]) for t in texts.values() for k in (1, 2, 3) for a in (0, 3)]
    heads = [h for h in heads if any(c.isalpha() for c in h) and not any(c.isdigit() for c in h)]
    assert len(heads) > 1000
    rng = random.Random(5)
    noise = []
    for _ in range(100):
        noise.append("".join(rng.choice("asdfghjklqwertyuiopzxcvbnm   ") for _ in range(60)))
        noise.append(base64.b64encode(rng.randbytes(45)).decode())
        noise.append("".join(rng.choice("абвгдежзиклмн  ") for _ in range(40)))
        noise.append("".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(30)))
    rows = [*clean, *heads, *noise]
    kept = {r.doc_id for r in op3.accepted(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), scorer_model).collect()}
    n = len(clean) + len(heads)
    assert set(range(len(clean))) <= kept
    assert np.mean([i in kept for i in range(n)]) >= 0.99
    assert np.mean([i not in kept for i in range(n, len(rows))]) >= 0.9


def test_texts_stay_where_nothing_was_learned(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, "12"), (3, None), (4, "été")], "doc_id long, text string")
    model = op3.learn(docs.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r.doc_id for r in op3.accepted(docs, model).collect()} == {1, 4}


def test_windows_are_spread_over_long_texts(spark):
    text = "".join(chr(97 + i // 1000) for i in range(26_000))
    rows = spark.createDataFrame([(1, text, "x"), (3, "short", "x"), (5, "", "x"), (7, "z" * 800, "x")], "doc_id long, text string, lang string")
    seen = {len(r.t): b"".join(map(bytes, r.t)) for r in rows.select(op3._windows(rows.text, 800).alias("t"), "doc_id").filter("doc_id = 1").collect()}
    assert set(seen) == {op3.WINDOWS} and len(seen[op3.WINDOWS]) == 800
    assert seen[op3.WINDOWS][:1] == b"a" and seen[op3.WINDOWS][-1:] == b"z" and len(set(seen[op3.WINDOWS])) >= op3.WINDOWS
    whole = [r.t for r in rows.select(op3._windows(rows.text, 800).alias("t"), "doc_id").filter("doc_id > 1").orderBy("doc_id").collect()]
    assert [[bytes(x) for x in t] for t in whole] == [[b"short"], [b""], [b"z" * 800]]


def test_a_thousand_languages():
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzàéîöüß"
    samples = {f"l{i:04}": [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(120)).encode()] for i in range(1000)}
    model = op3.train(samples)
    assert len(pickle.dumps(model)) < 100 << 20
    names = list(samples)[::97]
    best, *_ = op3._predicted(op3.Scorer(model), pa.array([samples[x][0].decode()[50:400] for x in names]))
    assert [model.languages[i] for i in best] == names


def test_a_text_of_megabytes_takes_the_memory_of_a_block():
    import tracemalloc

    model = op3.train({"a": [b"some words of a language"], "b": [b"andere worte"]})
    scorer = op3.Scorer(model)
    text = b"some words " * 400_000
    tracemalloc.start()
    bits = scorer(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert bits.argmin() == 0 and peak < 40 << 20
