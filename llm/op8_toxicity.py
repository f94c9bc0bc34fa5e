"""Toxicity by a weighted lexicon, matched by Aho-Corasick.

Texts are folded: compatibility forms, accents and case go, look-alike letters of
other scripts and digits or signs put for letters become those letters, and all else
separates words. Terms are matched as whole words in the folded text.
A term counts with its weight unless an exception phrase covers it. The score is
a logistic function of the weights found, by number and in proportion to the
length of the text.

Terms and weights are learned from at most ``SAMPLE`` labelled rows, those with the least
hash of their id among the rows whose crc32(doc_id) mod 5 is not 0: words
that at least ``LEAST_DOCS`` toxic rows hold, whose log odds are high and beyond chance, however many there are in that sample. Exceptions are
given, and two-word phrases around a term are added that only clean rows hold.
labels, lang, source and doc_id take no part in scoring.
Null or empty text matches nothing and gets the score of a text without terms;
without labels to learn from no text is toxic. Repeated rows and null ids are scored alike. Time and memory of a text grow with its length;
columns with other names are ignored, and an empty table gives an empty one.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAMPLE, LEAST_DOCS, LEAST_WEIGHT = 16_000, 3, 2.0
#: Least likelihood ratio of a term against chance, so that rare words of a few toxic rows are none.
SIGNIFICANT = 24.0
#: Signs and digits put for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t"}
#: Letters of other scripts that look like Latin ones.
LOOK_ALIKE = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "х": "x", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g"}
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish", "pathetic fallacy")


class _Fold(dict):
    """Translation table that is filled as characters come."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", LOOK_ALIKE.get(c.lower(), c.lower())) if not unicodedata.combining(x))
        plain = "".join(LOOK_ALIKE.get(x, x) for x in plain)
        if unicodedata.combining(c) or unicodedata.category(c) == "Cf":
            out = ""
        elif c in SUBSTITUTES or c == "'":
            out = c
        else:
            out = plain if plain and all(x.isalnum() for x in plain) else " "
        self[code] = out
        return out


_FOLD = _Fold()
_SIGNS = str.maketrans(SUBSTITUTES)


def fold(text: str | None) -> str:
    """Folded words between single spaces, with one before the first and after the last."""
    words = (text or "").translate(_FOLD).split()
    out = []
    for w in words:
        if not w.isalpha():
            w = w.strip("!+'")
            if w.isdecimal():
                pass
            elif any(x.isalpha() for x in w):
                w = w.translate(_SIGNS).replace("'", "")
            else:
                continue
        out.append(w)
    return f" {' '.join(out)} "


class Lexicon(NamedTuple):
    terms: dict[str, float]
    exceptions: tuple[str, ...]
    weights: tuple[float, float, float]  #: of the score: for nothing, for what is found, for what is found a word


class Matcher:
    """Terms and exceptions in one Aho-Corasick automaton."""

    def __init__(self, lexicon: Lexicon) -> None:
        import ahocorasick

        self.lexicon, self.automaton = lexicon, ahocorasick.Automaton()
        for t, w in lexicon.terms.items():
            self.automaton.add_word(f" {t} ", (len(t), w))
        for t in lexicon.exceptions:
            self.automaton.add_word(f" {t} ", (len(t), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def found(self, folded: str) -> tuple[int, float]:
        """Terms not covered by an exception, and their weights' sum."""
        if not len(self.automaton):
            return 0, 0.0
        hits, safe = [], []
        for end, (size, weight) in self.automaton.iter(folded):
            (hits.append((end - size, end, weight)) if weight is not None else safe.append((end - size, end, 0.0)))
        if safe:  # the farthest end of the exceptions that start up to a term's start tells whether one covers it
            safe.sort()
            starts, ends = [a for a, _, _ in safe], list(accumulate((b for _, b, _ in safe), max))
            hits = [h for h in hits if not (k := bisect_right(starts, h[0])) or ends[k - 1] < h[1]]
        return len(hits), sum(h[2] for h in hits)

    def features(self, text: str | None) -> tuple[int, float, int]:
        folded = fold(text)
        return *self.found(folded), folded.count(" ") - 1


def logistic(found: np.ndarray, words: np.ndarray, weights: tuple[float, float, float]) -> np.ndarray:
    a, b, c = weights
    z = a + b * np.log1p(found) + c * np.log1p(100 * found / np.maximum(words, 1))
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    learn = labels.filter("toxic is not null and doc_id is not null").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    learn = learn.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(SAMPLE)
    # at most SAMPLE rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(learn), "doc_id")
    # copies of a text count once, as otherwise whatever they hold looks like a term
    first = Window.partitionBy(F.xxhash64("text"), "toxic").orderBy("doc_id")
    return rows.withColumn("copy", F.row_number().over(first)).filter("copy = 1").select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    rows = _training(docs, labels)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        rows = [0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen[toxic > 0].update(set(fold(text).split()))
                rows[toxic > 0] += 1
        words = list({*seen[0], *seen[1]})
        yield pa.RecordBatch.from_arrays([pa.array([*words, ""]), pa.array([*(seen[1][w] for w in words), rows[1]]), pa.array([*(seen[0][w] for w in words), rows[0]])], names=["word", "toxic", "clean"])

    counts = rows.mapInArrow(count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    total = counts.filter("word = ''").first()
    n1, n0 = (total.toxic, total.clean) if total else (0, 0)
    if not n1:
        return Lexicon({}, exceptions, (-5.0, 0.0, 0.0))
    odds = F.log((F.col("toxic") + 0.2) / (n1 + 0.4)) - F.log((F.col("clean") + 0.2) / (n0 + 0.4))
    both, share = F.col("toxic") + F.col("clean"), n1 / (n1 + n0)
    ratio = 2 * (F.col("toxic") * F.log(F.col("toxic") / (both * share)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (both * (1 - share)))).otherwise(0.0)) if n0 else F.lit(SIGNIFICANT)
    top = counts.filter((F.col("word") != "") & (F.col("toxic") >= LEAST_DOCS)).withColumn("w", odds).filter((F.col("w") >= LEAST_WEIGHT) & (ratio >= SIGNIFICANT))
    terms = {r.word: float(r.w) for r in top.orderBy(F.desc("toxic"), "word").collect()}

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                w = fold(text).split()
                at = [i for i, x in enumerate(w) if x in terms]
                seen[toxic > 0].update({f"{w[i]} {w[i + 1]}" for j in at for i in (j - 1, j) if 0 <= i < len(w) - 1})
        both = [p for p in seen[0] if p not in seen[1]]
        both += list(seen[1])
        yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([seen[1][p] for p in both], pa.int64()), pa.array([seen[0][p] for p in both], pa.int64())], names=["phrase", "toxic", "clean"])

    safe = rows.mapInArrow(phrases, "phrase string, toxic long, clean long").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    safe = [r.phrase for r in safe.filter(f"toxic = 0 and clean >= {LEAST_DOCS}").orderBy(F.desc("clean"), "phrase").collect()]
    own = Lexicon(terms, (*exceptions, *safe), (0.0, 0.0, 0.0))
    found, words, toxic = [], [], []

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(own)
        for batch in batches:
            f = [m.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in f], pa.float64()), pa.array([x[2] for x in f], pa.int64()), batch.column("toxic")], names=["found", "words", "toxic"])

    for r in rows.mapInArrow(measured, "found double, words long, toxic int").collect():
        found.append(r.found), words.append(r.words), toxic.append(r.toxic > 0)
    return own._replace(weights=_fit(np.array(found), np.array(words), np.array(toxic, float)))


def _fit(found: np.ndarray, words: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small penalty."""
    x = np.stack((np.ones(len(y)), np.log1p(found), np.log1p(100 * found / np.maximum(words, 1))), 1)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.05 * np.eye(3), x.T @ (y - p) - 0.05 * w)
        w = w + step
        if abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, predicted, terms found and words of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value)
        for batch in batches:
            for part in (batch.slice(a, 500) for a in range(0, batch.num_rows, 500)):
                f = [matcher.features(t.as_py()) for t in part.column("text")]
                n, found, words = (np.array(x) for x in zip(*f, strict=True))
                s = logistic(found.astype(float), words, matcher.lexicon.weights)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(words.astype(np.int64))], names=["doc_id", "score", "predicted", "n_terms", "n_words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int, n_terms long, n_words long")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).select("doc_id", held.alias("held_out"), "score", "predicted", "n_terms", "n_words")
