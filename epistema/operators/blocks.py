"""Postings of terms in blocks of documents, made in the tasks that read the texts.

A row is a term in a block: the documents that hold it, how often, and where, each as differences in variable bytes (``docs``, ``counts``,
``places``). A block is some MB of text, so what is exchanged is a few bytes for each term and document, not a row with its names. Documents
go by numbers that are written with their texts first, so that whatever reads them again finds the same.
"""

from __future__ import annotations

import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epistema.operators import text
from epistema.plans.storage import shared_root

BLOCK = "idx string, term string, base long, n int, docs binary, counts binary, places binary"
#: Characters, and documents, that a block holds at most; a longer text is a block of its own.
CHARACTERS, DOCUMENTS = 2_000_000, 50_000

# executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def with_numbers(docs: DataFrame) -> DataFrame:
    """The documents (kind, id, text) with a number each and their text in lower case: doc, kind, id, text. The numbers hold once the rows are written."""
    return docs.select(F.monotonically_increasing_id().alias("doc"), "kind", F.col("id").cast("string").alias("id"), F.coalesce(F.lower(F.col("text").cast("string")), F.lit("")).alias("text"))


def numbered(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of ``with_numbers``, written."""
    spark = docs.sparkSession
    path = path or f"{shared_root(spark)}/step-{uuid.uuid4().hex}"
    rows = with_numbers(docs)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 as bytes of seven bits, least first, and where each one starts, with the end."""
    v = values.astype(np.uint64)
    n = np.ones(len(v), np.int64)
    for k in range(1, 9):
        more = v >= np.uint64(1 << 7 * k)
        if not more.any():
            break
        n += more
    starts = np.zeros(len(v) + 1, np.int64)
    np.cumsum(n, out=starts[1:])
    out = np.empty(starts[-1], np.uint8)
    for k in range(int(n.max()) if len(n) else 0):
        m = n > k
        out[starts[:-1][m] + k] = (v[m] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | (n[m] > k + 1).astype(np.uint8) << 7
    return out, starts


def numbers(data: np.ndarray) -> np.ndarray:
    """The numbers of ``varints``."""
    last = np.flatnonzero(data < 128)
    if not len(last):
        return np.zeros(0, np.int64)
    starts = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(data)) - np.repeat(starts, last - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, starts)


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _restarted(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Differences to the value before; whole values at ``firsts``."""
    out = np.diff(values, prepend=0)
    out[firsts] = values[firsts]
    return out


def _summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of ``_restarted`` in runs of some sizes (above 0)."""
    total = np.cumsum(values)
    starts = np.cumsum(sizes) - sizes
    return total - np.repeat(total[starts] - values[starts], sizes)


def _block(idx: str, docs: np.ndarray, doc: np.ndarray, place: np.ndarray, code: np.ndarray, names, places: bool) -> pa.RecordBatch | None:
    """One block: tokens by document (place in ``docs``), place and code, in order of documents and places; names: of distinct codes."""
    if not len(code):
        return None
    order = np.argsort(code, kind="stable")
    code, doc, place = code[order], docs[doc[order]], place[order].astype(np.int64)
    new = np.concatenate(([True], code[1:] != code[:-1]))
    pairs = np.flatnonzero(new | np.concatenate(([True], doc[1:] != doc[:-1])))
    first = np.flatnonzero(new[pairs])  # of the pairs, the first of each term
    ends = np.append(first, len(pairs))
    base = int(docs.min())
    d, at = varints(_restarted(doc[pairs] - base, first))
    c, ct = varints(np.diff(np.append(pairs, len(code))))
    n = len(first)
    columns = [pa.array([idx] * n), names(code[pairs[first]]), pa.array(np.full(n, base)), pa.array(np.diff(ends).astype(np.int32)), _binary(d, at[ends]), _binary(c, ct[ends])]
    if places:
        p, pt = varints(_restarted(place, pairs))
        columns.append(_binary(p, pt[np.append(pairs, len(code))[ends]]))
    else:
        columns.append(pa.array([b""] * n))
    return pa.RecordBatch.from_arrays(columns, ["idx", "term", "base", "n", "docs", "counts", "places"])


def _grams(docs: np.ndarray, texts: pa.Array, places: bool) -> pa.RecordBatch | None:
    strings = texts.to_pylist()
    sizes = np.array([len(t) for t in strings], np.int64)
    own = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(own) < 3:
        return None
    code = own[:-2] << 42 | own[1:-1] << 21 | own[2:]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = doc[:-2] == doc[2:]
    mask = (1 << 21) - 1

    def names(codes):
        chars = np.stack([codes >> 42, codes >> 21 & mask, codes & mask], 1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return pa.array([chars[i : i + 3] for i in range(0, len(chars), 3)], pa.string())

    return _block("gram", docs, doc[:-2][whole], place[:-2][whole], code[whole], names, places)


def _words(docs: np.ndarray, words: pa.Array, places: bool) -> pa.RecordBatch | None:
    flat = words.flatten()
    sizes = np.diff(words.offsets.to_numpy())
    coded = flat.dictionary_encode()
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return _block("word", docs, np.repeat(np.arange(len(sizes)), sizes), place, coded.indices.to_numpy(), lambda codes: coded.dictionary.take(pa.array(codes)).cast(pa.string()), places)


def blocks(texts: DataFrame, indexes: tuple[str, ...] = ("word", "gram"), places: bool = True) -> DataFrame:
    """Rows of ``BLOCK`` for texts as ``numbered`` gives them: for words, runs of three characters, or both. Nothing is exchanged."""

    def run(batches):
        for batch in batches:
            docs = batch.column("doc").to_numpy()
            sizes = np.array([len(t or "") for t in batch.column("text").to_pylist()], np.int64)
            a = 0
            while a < len(docs):
                b = a + max(1, int(np.searchsorted(np.cumsum(sizes[a:]), CHARACTERS, side="right")))
                b = min(b, a + DOCUMENTS, len(docs))
                for idx in indexes:
                    made = _grams(docs[a:b], batch.column("text").slice(a, b - a), places) if idx == "gram" else _words(docs[a:b], batch.column("words").slice(a, b - a), places)
                    if made is not None:
                        yield made
                a = b

    words = text.words(F.col("text")) if "word" in indexes else F.array().cast("array<string>")
    return texts.select("doc", "text", words.alias("words")).mapInArrow(run, BLOCK)


def _opened(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Number of documents of each row, and the documents of all rows."""
    n = batch.column("n").to_numpy().astype(np.int64)
    docs = numbers(np.frombuffer(b"".join(batch.column("docs").to_pylist()), np.uint8))
    return n, _summed(docs, n) + np.repeat(batch.column("base").to_numpy(), n)


def _slices(batches, most: int = 2_000_000):
    """The batches in parts of some documents."""
    for batch in batches:
        n = batch.column("n").to_numpy().astype(np.int64)
        a = 0
        while a < len(n):
            b = a + max(1, int(np.searchsorted(np.cumsum(n[a:]), most, side="right")))
            yield batch.slice(a, b - a)
            a = b


def opened(rows: DataFrame, *keep: str, places: bool = True) -> DataFrame:
    """A row for each term and document of rows of blocks: the columns ``keep``, doc, tf and, if asked for, places."""
    kinds = dict(rows.dtypes)

    def run(batches):
        for batch in _slices(batches):
            n, docs = _opened(batch)
            tf = numbers(np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.uint8))
            at = pa.array(np.repeat(np.arange(len(n)), n))
            columns = [batch.column(k).take(at) for k in keep] + [pa.array(docs), pa.array(tf.astype(np.int32))]
            if places:
                own = _summed(numbers(np.frombuffer(b"".join(batch.column("places").to_pylist()), np.uint8)), tf)
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(tf))).astype(np.int32)), pa.array(own.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, [*keep, "doc", "tf", *(["places"] if places else [])])

    schema = ", ".join([f"{k} {kinds[k]}" for k in keep] + ["doc long", "tf int"] + (["places array<int>"] if places else []))
    needed = ["base", "n", "docs", "counts"] + (["places"] if places else [])
    return rows.select(*keep, *(c for c in needed if c not in keep)).mapInArrow(run, schema)


def closed(rows: DataFrame, *keep: str, places: bool = True) -> DataFrame:
    """Rows of blocks again from ``keep``, base and ``of``, an array of (doc, tf and, if they are kept, places) in order of documents."""
    kinds = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            of = batch.column("of")
            n = np.diff(of.offsets.to_numpy())
            flat = of.flatten()
            tf = flat.field("tf").to_numpy().astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(n)))
            d, at = varints(_restarted(flat.field("doc").to_numpy() - np.repeat(batch.column("base").to_numpy(), n), ends[:-1]))
            c, ct = varints(tf)
            columns = [batch.column(k) for k in keep] + [batch.column("base"), pa.array(n.astype(np.int32)), _binary(d, at[ends]), _binary(c, ct[ends])]
            if places:
                pairs = np.concatenate(([0], np.cumsum(tf)))
                p, pt = varints(_restarted(flat.field("places").flatten().to_numpy().astype(np.int64), pairs[:-1]))
                columns.append(_binary(p, pt[pairs[ends]]))
            else:
                columns.append(pa.array([b""] * len(n), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [*keep, "base", "n", "docs", "counts", "places"])

    schema = ", ".join([f"{k} {kinds[k]}" for k in keep] + ["base long, n int, docs binary, counts binary, places binary"])
    held = F.transform("of", lambda x: F.struct(*(x[c].alias(c) for c in ("doc", "tf", *(["places"] if places else [])))))
    return rows.select(*keep, "base", held.alias("of")).mapInArrow(run, schema)


def sums(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Sum of a term's value over the terms of each document: ``keys``, doc, total. Rows are added up where they are read, so a row a document and task is exchanged."""
    kinds = dict(rows.dtypes)

    def run(batches):
        for batch in _slices(batches):
            n, docs = _opened(batch)
            values = np.repeat(batch.column(value).to_numpy(), n)
            names = [batch.column(k).dictionary_encode() for k in keys]
            code = np.zeros(len(n), np.int64)
            for x in names:
                code = code * max(1, len(x.dictionary)) + x.indices.to_numpy()
            order = np.lexsort((docs, np.repeat(code, n)))
            by, docs, values = np.repeat(np.arange(len(n)), n)[order], docs[order], values[order]
            if not len(docs):
                continue
            of = code[by]
            first = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (of[1:] != of[:-1]))))
            at = pa.array(by[first])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), pa.array(docs[first]), pa.array(np.add.reduceat(values, first))], [*keys, "doc", "part"])

    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["doc long", "part double"])
    return rows.select(*keys, "base", "n", "docs", value).mapInArrow(run, schema).groupBy(*keys, "doc").agg(F.sum("part").alias("total"))
