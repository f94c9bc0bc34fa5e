"""Quality rules with suffix-array repetition.

Base rules count words, symbols, repeated lines and repeated 3-word windows.
The method sorts the suffixes of each document's word sequence by prefix
doubling; neighbours in that order share longest common prefixes, and the
intervals of those with at least ``least`` words are the maximal repeated
substrings. The union of their spans gives the covered fraction, and the longest
prefix the longest repeat; both are limited. Ranks include the document, so one
sort serves all documents of a slice of text.

Null or empty text has no words: all counts are 0 and the base rule fails it.
Rows are judged alone, so repeated rows and null ids are as good as any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import kernel

#: Shortest repeat that counts, in words; most of a document that repeats may cover, in hundredths; longest repeat, in words.
LEAST, COVERED, LONGEST = 10, 30, 150
SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
LINE_END = np.arange(256) == 10
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long, n_repeats long"


def repeated(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which of these are found twice or more in their document."""
    order = np.argsort(kernel.mix(hashes ^ kernel.mix(doc.astype(np.uint64) + np.uint64(1))))
    h, d = hashes[order], doc[order]
    same = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    out = np.zeros(len(hashes), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def suffix_repeats(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of word sequences, and the common prefix of each suffix with the one before it, within documents."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, rank = np.unique(kernel.mix(hashes ^ kernel.mix(doc.astype(np.uint64) + np.uint64(1))), return_inverse=True)
    rank = rank.astype(np.int64) + 1
    levels, width = [rank], 1
    order = np.argsort(rank, kind="stable")
    while int(levels[-1].max()) < n:
        now = levels[-1]
        ahead = np.zeros(n, np.int64)
        ahead[:-width or None] = now[width:] if width < n else 0
        far = np.zeros(n, bool)
        far[:-width or None] = doc[width:] == doc[:-width] if width < n else False
        ahead[~far] = 0
        key = now * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([1], (ranked[1:] != ranked[:-1]).astype(np.int64))))
        levels.append(new)
        width *= 2
        if width > n:
            break
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n, np.int64)
    shared = np.zeros(n - 1, np.int64)
    own = doc[a] == doc[b]
    last = np.concatenate((levels[0], [0]))
    for k in range(len(levels) - 1, -1, -1):
        last = np.concatenate((levels[k], [0]))
        i, j = np.minimum(a + shared, n), np.minimum(b + shared, n)
        same = own & (last[i] == last[j]) & (last[i] > 0)
        shared[same] += 1 << k
    common[1:] = shared
    return order, common


def _slice(w: kernel.Words, offsets: np.ndarray, least: int) -> list[np.ndarray]:
    docs = len(w.bounds) - 1
    doc = w.doc
    n_words = np.diff(w.bounds)
    lead = np.concatenate(([0], np.cumsum((w.data & 0xC0) != 0x80)))
    chars = np.bincount(doc, weights=lead[w.end] - lead[w.start], minlength=docs).astype(np.int64) if len(doc) else np.zeros(docs, np.int64)
    symbols = np.concatenate(([0], np.cumsum(SYMBOLS[w.data])))
    n_symbols = symbols[offsets[1:]] - symbols[offsets[:-1]]
    start, end, bounds = kernel.spans(w.data, offsets, LINE_END)
    line_doc = np.repeat(np.arange(docs), np.diff(bounds))
    full = np.searchsorted(w.start, start) < np.searchsorted(w.start, end)
    lines, line_doc = kernel.span_hash(w.data, start[full], end[full]), line_doc[full]
    key = np.lexsort((lines, line_doc)) if len(lines) else np.zeros(0, np.int64)
    again = (lines[key][1:] == lines[key][:-1]) & (line_doc[key][1:] == line_doc[key][:-1]) if len(lines) else np.zeros(0, bool)
    n_dup_lines = np.bincount(line_doc[key][1:][again], minlength=docs) if len(lines) else np.zeros(docs, np.int64)
    at = kernel.window_starts(w.bounds, 3)
    found = at[repeated(kernel.windows(w.hash, 3)[at], doc[at])] if len(at) else at
    change = np.zeros(len(doc) + 4, np.int32)
    change[found] += 1
    change[found + 3] -= 1
    n_repeat = np.bincount(doc[np.cumsum(change)[: len(doc)] > 0], minlength=docs)
    order, common = suffix_repeats(w.hash, doc)
    most = np.zeros(len(doc) + 1, np.int64)
    if len(order):
        most[order] = np.maximum(common, np.concatenate((common[1:], [0])))
    most = most[: len(doc)]
    long = np.flatnonzero(most >= least)
    change = np.zeros(len(doc) + 1, np.int64)
    np.add.at(change, long, 1)
    np.add.at(change, long + most[long], -1)
    covered = np.bincount(doc[np.cumsum(change)[: len(doc)] > 0], minlength=docs)
    longest = np.zeros(docs, np.int64)
    np.maximum.at(longest, doc, most)
    above = common >= least
    heads = np.flatnonzero(above & ~np.concatenate(([False], above[:-1]))) if len(order) else np.zeros(0, np.int64)
    n_repeats = np.bincount(doc[order[heads]], minlength=docs) if len(heads) else np.zeros(docs, np.int64)
    return [x.astype(np.int64) for x in (n_words, chars, n_symbols, n_dup_lines, n_repeat, covered, longest, n_repeats)]


def judge(docs: DataFrame, least: int = LEAST, covered: int = COVERED, longest: int = LONGEST) -> DataFrame:
    """One row per document: base counts, whether the base rule fails it, and the verdict; ``kept`` needs both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = kernel.strings(batch.column("text"))
            parts = []
            for a, b in kernel.slices(offsets):
                own = offsets[a : b + 1] - offsets[a]
                parts.append(_slice(kernel.words(data[offsets[a] : offsets[b]], own), own, least))
            n, chars, symbols, lines, repeat, cover, most, groups = (np.concatenate(x) for x in zip(*parts, strict=True))
            failed = (n < 50) | (100 * repeat > 50 * n)
            kept = ~failed & (100 * cover <= covered * n) & (most <= longest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x) for x in (n, chars, symbols, lines, repeat, failed, kept, cover, most, groups))],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat", "n_repeats"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_force(text: str | None, least: int = LEAST, covered: int = COVERED, longest: int = LONGEST) -> tuple:
    """The row of one text without its id, by plain counting; for short texts."""
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(w)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams: dict[tuple, list[int]] = {}
    for i in range(n - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeat = len({j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 3)})
    most = [0] * n
    long: dict[tuple, list[int]] = {}
    for i in range(n - least + 1):
        long.setdefault(tuple(w[i : i + least]), []).append(i)
    for at in long.values():
        for x in at:
            for y in at:
                if x != y:
                    k = 0
                    while x + k < n and y + k < n and w[x + k] == w[y + k]:
                        k += 1
                    most[x] = max(most[x], k)
    cover = len({j for i, k in enumerate(most) if k >= least for j in range(i, i + k)})
    failed = n < 50 or 100 * repeat > 50 * n
    kept = not failed and 100 * cover <= covered * n and max(most, default=0) <= longest
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, repeat, failed, kept, cover
