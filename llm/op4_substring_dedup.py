"""Exact substring deduplication by fixed-block anchors.

Every ``block`` words a document contributes one reference block; every rolling
window of that many words probes them. With ``window >= 2 * block - 1`` each
window holds a whole reference block, so two equal windows always show as a
block of the one hit by a rolling window of the other. Hits are then extended:
only windows around a hit are compared over their whole length, and runs of
repeated windows make up the maximal exact repeats, whose words are removed.

Each pass recomputes the hashes of a batch of documents and exchanges them in
packed form (``packed.py``): 4 bytes a word for the anchors, 8 for the windows
around hits. A passage that any number of documents share costs as much as any
other: no pairs are formed.

Null or empty text has no words and nothing removed. Repeated rows are separate
documents, so each removes what it shares with the other. Null ids are kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import kernel, packed, shared

WINDOW = 35
SCHEMA = "doc_id long, n_words long, n_removed long, n_repeats long, longest_repeat long, kept_text string"
_OUT = pa.schema([("doc_id", pa.int64()), *((x, pa.int64()) for x in ("n_words", "n_removed", "n_repeats", "longest_repeat")), ("kept_text", pa.string())])


def _batch(table: pa.Table, size: int) -> tuple[pa.Table, list[kernel.Words], np.ndarray, np.ndarray, np.ndarray]:
    """Sorted batch, its words by slice, word hashes and bounds over the batch, and where windows of ``size`` start."""
    table = packed.sorted_batch(table)
    parts = [w for _, _, w in kernel.each_slice(table.column("text"))]
    hashes = np.concatenate([w.hash for w in parts]) if parts else np.zeros(0, np.uint64)
    lengths = np.concatenate([np.diff(w.bounds) for w in parts]) if parts else np.zeros(0, np.int64)
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    return table, parts, hashes, bounds, kernel.window_starts(bounds, size)


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: words, removed words, maximal repeats, the longest of them in words, and the kept text."""
    if window < 2:
        raise ValueError("window must be at least 2")
    block = (window + 1) // 2
    buckets = shared.partitions(docs.sparkSession)
    batches = shared.batched(docs)

    def probes(hashes: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rolling = kernel.windows(hashes, block)[at] if len(at) else np.zeros(0, np.uint64)
        anchor = (at - np.repeat(bounds[:-1], np.maximum(0, np.diff(bounds) - block + 1))) % block == 0
        return rolling, anchor

    def send_probes(key: tuple, table: pa.Table) -> pa.Table:
        _, _, hashes, bounds, at = _batch(table, block)
        rolling, anchor = probes(hashes, bounds, at)
        return packed.ask(key[0].as_py(), ((rolling.astype(np.uint32) << np.uint32(1)) | anchor.astype(np.uint32)), rolling, buckets)

    def around_hits(hashes: np.ndarray, bounds: np.ndarray, at: np.ndarray, answer: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the whole windows in which a probe hit."""
        rolling, _ = probes(hashes, bounds, at)
        hit = np.zeros(len(hashes) + 1, np.int32)
        hit[at] = packed.answered(answer, rolling, buckets) > 0
        before = np.concatenate(([0], np.cumsum(hit)))
        starts = kernel.window_starts(bounds, window)
        starts = starts[before[starts + window - block + 1] > before[starts]] if len(starts) else starts
        return starts, (kernel.windows(hashes, window)[starts] if len(starts) else np.zeros(0, np.uint64))

    def send_windows(key: tuple, table: pa.Table, answer: pa.Table) -> pa.Table:
        _, _, hashes, bounds, at = _batch(table, block)
        _, whole = around_hits(hashes, bounds, at, answer)
        return packed.ask(key[0].as_py(), whole, whole, buckets)

    def remove(key: tuple, table: pa.Table, answer: pa.Table) -> pa.Table:
        table, parts, hashes, bounds, at = _batch(table, block)
        kind = np.asarray(answer.column("kind"))
        starts, whole = around_hits(hashes, bounds, at, answer.filter(pa.array(kind == 0)))
        found = starts[packed.answered(answer.filter(pa.array(kind == 1)), whole, buckets) > 0]
        change = np.zeros(len(hashes) + window + 1, np.int32)
        change[found] += 1
        change[found + window] -= 1
        gone = np.cumsum(change)[: len(hashes)] > 0
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        edge = np.flatnonzero(gone & ~np.concatenate(([False], gone[:-1] & (doc[1:] == doc[:-1])))[: len(gone)]) if len(gone) else np.zeros(0, np.int64)
        n_repeats = np.bincount(doc[edge], minlength=len(bounds) - 1)
        total = np.concatenate(([0], np.cumsum(gone)))
        longest = np.zeros(len(bounds) - 1, np.int64)
        if len(edge):
            length = np.diff(np.concatenate((total[edge], [total[-1]])))
            np.maximum.at(longest, doc[edge], length)
        kept, first = [], 0
        for w in parts:
            stay = ~gone[first : first + len(w.start)]
            raw = w.data.tobytes()
            for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
                own = np.flatnonzero(stay[a:b]) + a
                kept.append(b" ".join([raw[s:e] for s, e in zip(w.start[own].tolist(), w.end[own].tolist(), strict=True)]))
            first += len(w.start)
        return pa.Table.from_arrays(
            [table.column("doc_id"), pa.array(np.diff(bounds)), pa.array(total[bounds[1:]] - total[bounds[:-1]]), pa.array(n_repeats.astype(np.int64)), pa.array(longest), pa.array(kept, pa.binary()).cast(pa.string())],
            schema=_OUT,
        )

    hits = packed.answers(batches.groupBy("src").applyInArrow(send_probes, packed.ASKED), np.uint32, flagged=True)
    asked = batches.groupBy("src").cogroup(hits.groupBy("src")).applyInArrow(send_windows, packed.ASKED)
    same = packed.answers(asked, np.uint64)
    both = hits.withColumn("kind", F.lit(0)).unionByName(same.withColumn("kind", F.lit(1)))
    return batches.groupBy("src").cogroup(both.groupBy("src")).applyInArrow(remove, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), "n_repeats", "longest_repeat")


def brute_force(texts: list[str | None], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, kept_sha256) of each text, by comparing all windows."""
    import re
    from collections import Counter

    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
