"""Benchmark decontamination by latent semantic retrieval.

Words (runs of letters and digits, case folded) are hashed into ``BUCKETS`` TF-IDF
dimensions with document frequencies counted over all documents. A randomised
SVD of TF-IDF passages, computed in distributed passes over a bounded sample of
document passages (``FIT_DOCS`` documents) and all benchmark passages, gives
up to ``RANK`` latent dimensions for each ``RANK`` benchmark passages, so that none is lost in them; benchmark passages carry most of the weight, as theirs
are the directions that must survive, and only dimensions in which the benchmark has words are kept. Every passage of every document is then
compared with every benchmark passage: a candidate is one whose projection on it, over the
share of it that the dimensions keep, is ``COSINE`` of the shorter of the two, so words
around a short item can't hide it. Passages whose words can't reach that, each taken
with the benchmark passage it is nearest to, are not projected. Candidates are checked on the words themselves: the longest common
subsequence with the item must cover ``LCS`` of it within a window little longer
than the item, and the item's rarest words (its answer terms) must be there.

The benchmark is read in blocks of ``ITEMS`` items, and searched for ``SPACES`` latent spaces in one
pass over the documents, so what is broadcast is bounded but for an item that is longer than that.
Null or empty texts and items match nothing. Repeated rows or items are each
reported; rows with a null id are reported with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import kernel, shared, worker

BUCKETS, RANK, OVERSAMPLE, ROUNDS = 1 << 16, 160, 16, 2
FIT_DOCS, FIT_WORDS, ITEMS = 500, 2000, 500
STEP, SHORT, SPACES = 8, 24, 8
COSINE, LCS, ANSWER = 0.35, 0.7, 0.5
SCHEMA = "doc_id long, item_id long, cosine double, lcs double, first_word long"
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


class Item(NamedTuple):
    item_id: int
    words: np.ndarray  #: hashes


class Index(NamedTuple):
    """Latent space of at most RANK passages; pairs are of short and long ones."""

    row: np.ndarray  #: row in ``vectors`` of each bucket
    vectors: np.ndarray
    queries: tuple[np.ndarray, np.ndarray]  #: unit latent vectors over the share of the passage's length that they keep
    norm: tuple[np.ndarray, np.ndarray]  #: lengths of the passages
    reach: tuple[np.ndarray, np.ndarray]  #: most that each bucket adds to any projection, and to any over the passage's length
    owner: tuple[np.ndarray, np.ndarray]  #: places of the items they are of


class Batch(NamedTuple):
    """What one pass over the documents searches."""

    items: list[Item]
    idf: np.ndarray
    spaces: list[Index]


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, bounds = kernel.spans(data, offsets, NOT_WORD)
    return kernel.span_hash(data, start, end, fold=True), bounds


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64) % BUCKETS


def _each(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, offsets = kernel.strings(batch.column("text"))
    for a, b in kernel.slices(offsets):
        yield a, *_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _windows(bounds: np.ndarray, length: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of windows that begin every ``step`` words; the last may be shorter."""
    n = np.diff(bounds)
    count = np.where(n == 0, 0, np.maximum(0, -(-(n - length) // step)) + 1)
    doc = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = bounds[doc] + nth * step
    return start, np.minimum(start + length, bounds[doc + 1]), doc


def _summed(rows: DataFrame, kind: type, shape: tuple[int, int]) -> np.ndarray:
    """Sum of matrices sent as rows (part, data); parts keep what each task holds small."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(0, kind)
        for x in table.column("data"):
            own = np.frombuffer(x.as_buffer(), kind)
            total = own.copy() if not len(total) else total + own
        return pa.table({"part": table.column("part").slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(shape, kind)
    for r in rows.groupBy("part").applyInArrow(add, "part int, data binary").collect():
        x = np.frombuffer(bytes(r.data), kind).reshape(-1, shape[1])
        out[r.part * _ROWS : r.part * _ROWS + len(x)] = x
    return out


_ROWS = 1 << 12


def _parts(matrix: np.ndarray) -> pa.RecordBatch:
    cuts = range(0, len(matrix), _ROWS)
    return pa.RecordBatch.from_arrays([pa.array([c // _ROWS for c in cuts], pa.int32()), pa.array([matrix[c : c + _ROWS].tobytes() for c in cuts], pa.binary())], names=["part", "data"])


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Documents in which each bucket occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, hashes, bounds in _each(batch):
                doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                key = np.unique(doc * BUCKETS + _bucket(hashes))
                total += np.bincount(key % BUCKETS, minlength=BUCKETS)
        if total.any():
            yield _parts(total.reshape(-1, 1))

    return _summed(docs.mapInArrow(worker.trimmed(run), "part int, data binary"), np.int64, (BUCKETS, 1)).reshape(-1)


def _gram(hashes: np.ndarray, bounds: np.ndarray, idf: np.ndarray, row: np.ndarray, basis: np.ndarray, length: int, step: int, weight: float) -> np.ndarray:
    """transpose(A) A basis for the unit TF-IDF passages A of some documents, in the dimensions that have a row."""
    out = np.zeros_like(basis)
    start, end, _ = _windows(bounds, length, step)
    bucket = _bucket(hashes)
    mass = np.concatenate(([0.0], np.cumsum(idf[bucket].astype(np.float64) ** 2)))
    for a in range(0, len(start), 2000):
        s, e = start[a : a + 2000], end[a : a + 2000]
        size = e - s
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(s, size)
        of = np.repeat(np.arange(len(s)), size)
        r = row[bucket[at]]
        at, of, r = at[r >= 0], of[r >= 0], r[r >= 0]
        if not len(r):
            continue
        value = (idf[bucket[at]] / np.sqrt(np.maximum(mass[e] - mass[s], 1e-9))[of]).astype(np.float32)
        head = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        projected = np.add.reduceat(basis[r] * value[:, None], head, axis=0)
        nth = np.cumsum(np.concatenate(([0], (of[1:] != of[:-1]).astype(np.int64))))
        np.add.at(out, r, projected[nth] * (value * weight)[:, None])
    return out


def _queries(items: list[Item]) -> list[tuple[int, np.ndarray]]:
    """(item, words) of the passages by which items are searched."""
    out = []
    for i, item in enumerate(items):
        n = len(item.words)
        cuts = [(0, n)] if n <= 64 else [(a, min(n, a + 48)) for a in range(0, n - 16, 32)]
        out += [(i, item.words[a:b]) for a, b in cuts]
    return out


def _passes(items: list[Item]) -> Iterator[list[Item]]:
    """Runs of items with at most SPACES * RANK passages, or of one item."""
    own, total = [], 0
    for item in items:
        n = len(_queries([item]))
        if own and total + n > SPACES * RANK:
            yield own
            own, total = [], 0
        own.append(item)
        total += n
    if own:
        yield own


def _space(passages: list[tuple[int, np.ndarray]], items: list[Item], idf: np.ndarray, row: np.ndarray, vectors: np.ndarray) -> Index:
    queries, norms, reaches, owner = [], [], [], []
    for short in (True, False):
        found = [(i, w) for i, w in passages if (len(items[i].words) <= SHORT) == short]
        q, norm = np.zeros((len(found), vectors.shape[1]), np.float32), np.zeros(len(found), np.float32)
        for k, (_, w) in enumerate(found):
            q[k] = vectors[row[_bucket(w)]].sum(0)
            bucket, times = np.unique(_bucket(w), return_counts=True)
            norm[k] = np.sqrt(((times * idf[bucket]) ** 2).sum())
        q *= (norm / np.maximum((q * q).sum(1), 1e-9))[:, None]
        reach = np.zeros((2, len(idf)), np.float32)
        if len(found):
            kept = np.flatnonzero(row >= 0)
            for k, by in enumerate((q, q / norm[:, None])):
                reach[k, kept] = np.maximum(0, (vectors @ by.T).max(1))[row[kept]]
        queries.append(q)
        norms.append(norm)
        reaches.append(reach)
        owner.append(np.array([i for i, _ in found], np.int64))
    return Index(row, vectors, tuple(queries), tuple(norms), tuple(reaches), tuple(owner))


def fit(sample: DataFrame, items: list[Item], idf: np.ndarray) -> Batch:
    """Latent spaces of the items, with what the search needs of them."""
    rng = np.random.default_rng(7)
    found = _queries(items)
    blocks = [found[a : a + RANK] for a in range(0, len(found), RANK)]
    width = RANK + OVERSAMPLE
    rows, bases, own = [], [], []
    for block in blocks:
        hashes = np.concatenate([w for _, w in block])
        kept = np.unique(_bucket(hashes))
        row = np.full(BUCKETS, -1, np.int32)
        row[kept] = np.arange(len(kept))
        rows.append(row)
        bases.append(np.linalg.qr(rng.standard_normal((len(kept), min(width, len(kept)))).astype(np.float32))[0])
        own.append((hashes, np.cumsum([0, *(len(w) for _, w in block)])))
    context = sample.sparkSession.sparkContext
    at = np.cumsum([0, *(len(b) for b in bases)])
    for _ in range(ROUNDS):
        sent = context.broadcast((idf, rows, bases))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            weights, rows, bases = sent.value
            total = np.zeros((sum(len(q) for q in bases), width), np.float32)
            for batch in batches:
                for _, h, b in _each(batch):
                    cut = np.minimum(np.diff(b), FIT_WORDS)
                    keep = np.arange(len(h)) - np.repeat(b[:-1], np.diff(b)) < np.repeat(cut, np.diff(b))
                    begin = 0
                    for row, q in zip(rows, bases, strict=True):
                        total[begin : begin + len(q), : q.shape[1]] += _gram(h[keep], np.concatenate(([0], np.cumsum(cut))), weights, row, q, 32, 32, 1e-3)
                        begin += len(q)
            yield _parts(total)

        gram = _summed(sample.mapInArrow(worker.trimmed(run), "part int, data binary"), np.float32, (int(at[-1]), width))
        for k, basis in enumerate(bases):
            own_gram = _gram(*own[k], idf, rows[k], basis, 64, 64, 1.0)
            bases[k] = np.linalg.qr(gram[at[k] : at[k + 1], : basis.shape[1]] + own_gram)[0].astype(np.float32)
        sent.unpersist()
    spaces = []
    for block, row, basis, (hashes, bounds) in zip(blocks, rows, bases, own, strict=True):
        # the dimensions with the largest values of the benchmark's own passages, which have no more than their number
        small = basis.T @ _gram(hashes, bounds, idf, row, basis, 64, 64, 1.0)
        _, turn = np.linalg.eigh((small + small.T) / 2)
        vectors = (basis @ turn[:, ::-1][:, : len(block)]).astype(np.float32) * idf[row >= 0][:, None]
        spaces.append(_space(block, items, idf, row, vectors))
    return Batch(items, idf, spaces)


def lcs_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits of one integer a row."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        m = at.get(x, 0)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def best_span(item: np.ndarray, text: np.ndarray, span: int, least: int) -> tuple[int, int]:
    """Longest common subsequence with any ``span`` words of the text, and where they start; (0, 0) if below ``least``."""
    hit = np.flatnonzero(np.isin(text, item))
    a, b = item.tolist(), text[hit].tolist()
    most = lcs_length(a, b)
    if most < least:
        return 0, 0
    end = np.searchsorted(hit, hit + span)
    best = first = k = 0
    while k < len(hit):
        found = lcs_length(a, b[k : end[k]])
        if found > best:
            best, first = found, int(hit[k])
        if best == most:
            break
        # a later start gains at most the hits that come in at the end
        k = max(k + 1, int(np.searchsorted(end, end[k] + max(best + 1, least) - found)))
    return (best, first) if best >= least else (0, 0)


def looks(batch: Batch) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each item the buckets of its words, and places of its rarest fifth."""
    out = []
    for item in batch.items:
        bucket = _bucket(item.words)
        out.append((bucket, np.argsort(-batch.idf[bucket], kind="stable")[: max(1, len(bucket) // 5)]))
    return out


def _search(batch: Batch, hashes: np.ndarray, bounds: np.ndarray, known: list[tuple[np.ndarray, np.ndarray]] | None = None) -> dict[tuple[int, int], tuple[float, float, int]]:
    """(document, item) to (cosine, share of the item found, first word). known: ``looks`` of the batch."""
    known = looks(batch) if known is None else known
    there = np.zeros(len(batch.idf), bool)
    bucket = _bucket(hashes)
    mass = np.concatenate(([0.0], np.cumsum(batch.idf[bucket].astype(np.float64) ** 2)))
    found: dict[tuple[int, int], tuple[float, float, int]] = {}
    cut = [(_windows(bounds, 2 * STEP, STEP), 0), (_windows(bounds, 4 * STEP, 2 * STEP), 1)]
    for index, ((start, end, doc), kind) in ((x, c) for x in batch.spaces for c in cut):
        queries, owner = index.queries[kind], index.owner[kind]
        if not len(owner):
            continue
        norm = np.sqrt(mass[end] - mass[start])
        most = [np.concatenate(([0.0], np.cumsum(x[bucket].astype(np.float64)))) for x in index.reach[kind]]
        near = np.flatnonzero((most[0][end] - most[0][start] >= 0.999 * COSINE * norm) | (most[1][end] - most[1][start] >= 0.999 * COSINE))
        for a in range(0, len(near), 4096):
            w = near[a : a + 4096]
            size = end[w] - start[w]
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[w], size)
            r = index.row[bucket[at]]
            of = np.repeat(np.arange(len(w)), size)[r >= 0]
            latent = np.zeros((len(w), index.vectors.shape[1]), np.float32)
            head = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
            if len(of):
                latent[of[head]] = np.add.reduceat(index.vectors[r[r >= 0]], head, axis=0)
            projected = latent @ queries.T
            for i, q in zip(*np.nonzero(projected >= COSINE * np.minimum(norm[w][:, None], index.norm[kind])), strict=True):
                d, item = int(doc[w[i]]), batch.items[owner[q]]
                key = (d, int(owner[q]))
                n = len(item.words)
                if key in found and found[key][1] >= 1:
                    continue
                span = n + max(4, n // 2)
                lo, hi = max(int(bounds[d]), int(start[w[i]]) - span), min(int(bounds[d + 1]), int(end[w[i]]) + span)
                text, (words, rare) = hashes[lo:hi], known[owner[q]]
                there[bucket[lo:hi]] = True
                here = there[words]  # words whose bucket is there, a word that is there among them
                there[bucket[lo:hi]] = False
                if here.sum() < LCS * n or here[rare].mean() < ANSWER:
                    continue
                here = np.isin(item.words, text)
                if here.sum() < LCS * n or here[rare].mean() < ANSWER:
                    continue
                best, first = best_span(item.words, text, span, int(np.ceil(LCS * n)))
                if best and best / n > found.get(key, (0.0, 0.0, 0))[1]:
                    found[key] = (float(projected[i, q] / norm[w[i]]), best / n, int(lo + first - bounds[d]))
    return found


def search(docs: DataFrame, index: Batch) -> DataFrame:
    """(doc_id, item_id) of every document that holds an item of the batch."""
    sent = docs.sparkSession.sparkContext.broadcast(index)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("first_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Batch = sent.value
        known = looks(own)
        for batch in batches:
            rows = []
            ids = batch.column("doc_id")
            for a, hashes, bounds in _each(batch):
                for (d, i), (cosine, lcs, first) in sorted(_search(own, hashes, bounds, known).items()):
                    rows.append((ids[a + d].as_py(), own.items[i].item_id, cosine, lcs, first))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return docs.mapInArrow(worker.trimmed(run), SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item found in it: cosine of the passage, share of the item, and where it begins."""
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    df, n_docs = document_frequencies(docs.select("text")), docs.count()
    # above zero for every word: a passage that most documents hold has no others
    idf = np.log1p((1 + n_docs) / (1 + df)).astype(np.float32)
    every = max(1, n_docs // FIT_DOCS)
    sample = None
    out = spark.createDataFrame([], SCHEMA)
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    blocks = -(-rows.count() // ITEMS)
    for k in range(blocks):
        own = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        items = []
        for r in own:
            raw = np.frombuffer(r.text.encode(), np.uint8)
            items.append(Item(r.item_id, _hashes(raw, np.array([0, len(raw)]))[0]))
        items = [i for i in items if len(i.words)]
        for part in _passes(items) if n_docs else ():
            if sample is None:
                sample = shared.written(docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).select("text").repartition(4))
            out = out.unionAll(search(docs, fit(sample, part, idf)))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], share: float = 1.0) -> set[tuple[int, int]]:
    """Pairs in which the words of an item, case folded, stand in a document in a row."""
    import re

    def split(t: str | None) -> list[str]:
        return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub(r"[A-Z]+", lambda m: m[0].lower(), t or ""))

    want = [(i, " " + " ".join(split(t)) + " ") for i, t in items if split(t)]
    return {(d, i) for d, t in docs for own in [" " + " ".join(split(t)) + " "] for i, x in want if x in own}
