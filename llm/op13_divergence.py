"""Divergence of sources inside a language, by sorted runs.

**Counts.** A task sorts the terms of a slice of texts by (lang, term, source, document) and scans the runs: each
(lang, term, source) gives its documents and occurrences there. Runs of a task's slices are added up, so what is shuffled
is one row for each of some ten thousand documents, not one for each word. These rows are repartitioned by (lang, term), sorted by (lang, term, source) inside
partitions, and scanned again: the runs' sums are the counts, the documents of all sources the document frequency.
A term in a third of all documents has as many rows as tasks and sources that hold it.

**Divergence.** Kept terms get their group's totals and are sorted by (lang, term, source) once more. The scan of a
run emits the term for each source that has more of it than the language, and partial sums for each pair of sources
that both have it. A task adds partial sums up before it emits them, and keeps at most ``HELD`` of them.
Of a pair's other terms one source has count 0, where p depends on the group alone. They enter by the number of
terms of each count in a group, so sources of few terms never meet all terms of a language:
sum over t of f = sum over g's terms of f(p, q0) + sum over q's terms of f(p0, q) + rest * f(p0, q0) + sum over common
terms of (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)), where p0 and q0 belong to count 0.

All arithmetic is on integers of 64 bits: a quotient is found in three steps of a thousand, exact while totals stay
below 9 * 10**15, and the square of a difference of p is below 2**63. Words are compared as 64-bit hashes inside a slice
and as strings everywhere else.

Null text, lang and source count as ''. Each row is a document, so rows that repeat an id, or have none, count each.
Texts without terms and groups without kept terms have their pairs nevertheless. A text of any length is one document,
held whole. Ties of value are ordered by the item's bytes. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm import kernel, shared, vocab, worker

LEAST, TOP = 10, 10
ONE = 1_000_000_000
SLICE_BYTES = 2 << 20
#: Rows of runs that a task adds up before it emits them.
ADDED = 600_000
#: Partial sums of pairs that a task holds before it emits them.
HELD = 500_000
_BREAK = np.ones(256, bool)
_BREAK[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
RUNS = "lang string, term string, source string, docs long, n long"
KEPT = "lang string, term string, source string, n long, all_n long, first long"
EMITTED = "part string, lang string, source string, item string, value long"


def _coded(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of a string column in the order of its values, and the values."""
    column = column.fill_null("")
    values = pc.unique(column)
    values = values.take(pc.sort_indices(values))
    return pc.index_in(column, values).to_numpy(zero_copy_only=False).astype(np.int64), values


def _edges(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys, in sorted rows."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def runs_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of (lang, term, source) of slices of documents."""
    data, offsets = kernel.strings(batch.column("text"))
    for a, b in kernel.slices(offsets, SLICE_BYTES):
        own = offsets[a : b + 1] - offsets[a]
        text = _LOWER[data[offsets[a] : offsets[b]]]
        start, end, bounds = kernel.spans(text, own, _BREAK)
        if not len(start):
            continue
        lang, langs = _coded(batch.column("lang").slice(a, b - a))
        source, sources = _coded(batch.column("source").slice(a, b - a))
        terms, first, term = np.unique(kernel.span_hash(text, start, end), return_index=True, return_inverse=True)
        order = np.argsort(source, kind="stable")  # documents by source, so that one number sorts both
        place = np.empty(b - a, np.int64)
        place[order] = np.arange(b - a)
        size = np.diff(bounds)
        key = (np.repeat(lang, size) * len(terms) + term) * (b - a) + np.repeat(place, size)
        key.sort()
        each = _edges(key)
        n = np.diff(each, append=len(key))
        both, doc = np.divmod(key[each], b - a)
        of = source[order][doc]
        run = _edges(both, of)
        at, width = start[first], (end - start)[first]
        names = pa.StringArray.from_buffers(len(terms), pa.py_buffer(np.concatenate(([0], np.cumsum(width))).astype(np.int32)), pa.py_buffer(vocab.gathered(text, at, width)))
        in_lang, in_term = np.divmod(both[run], len(terms))
        columns = [langs.take(pa.array(in_lang)), names.take(pa.array(in_term)), sources.take(pa.array(of[run])), pa.array(np.diff(run, append=len(each))), pa.array(np.add.reduceat(n, run))]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "term", "source", "docs", "n"])


def _added(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """The runs of several slices as one row each."""
    if not held:
        return []
    keys = ["lang", "term", "source"]
    sums = pa.Table.from_batches(held).group_by(keys, use_threads=False).aggregate([("docs", "sum"), ("n", "sum")])
    return sums.select([*keys, "docs_sum", "n_sum"]).rename_columns([*keys, "docs", "n"]).to_batches(max_chunksize=100_000)


def _new(batch: pa.RecordBatch, *names: str) -> np.ndarray:
    """Starts of runs of equal strings in sorted rows."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for name in names:
        c = batch.column(name)
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _whole_runs(batches: Iterator[pa.RecordBatch], merged=lambda batch: batch) -> Iterator[pa.RecordBatch]:
    """Sorted rows in batches that end with a run of (lang, term); what is held over goes through ``merged``."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches(max_chunksize=None)[0]
        last = int(_new(batch, "lang", "term")[-1])
        if last:
            yield merged(batch.slice(0, last))
        held = merged(batch.slice(last))
    if held is not None:
        yield held


def _summed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row for each run of (lang, term, source)."""
    run = _new(batch, "lang", "term", "source")
    keys = [batch.column(k).take(pa.array(run)) for k in ("lang", "term", "source")]
    sums = [pa.array(np.add.reduceat(batch.column(k).to_numpy(), run)) for k in ("docs", "n")]
    return pa.RecordBatch.from_arrays([*keys, *sums], names=["lang", "term", "source", "docs", "n"])


def counted(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term, source, n (occurrences there), all_n (in the language) of terms in at least ``least`` documents; first: 1 in one row of each term."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for runs in runs_of(batch):
                held.append(runs)
                if sum(h.num_rows for h in held) > ADDED:
                    held = _added(held)
                    if sum(h.num_rows for h in held) > ADDED // 2:
                        yield from held
                        held = []
        yield from _added(held)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_runs(batches, _summed):
            run = _new(batch, "lang", "term")
            size = np.diff(run, append=batch.num_rows)
            docs, n = (np.add.reduceat(batch.column(k).to_numpy(), run) for k in ("docs", "n"))
            first = np.zeros(batch.num_rows, np.int64)
            first[run] = 1
            keep = np.flatnonzero(np.repeat(docs >= least, size))
            out = pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("term"), batch.column("source"), batch.column("n"), pa.array(np.repeat(n, size)), pa.array(first)], names=["lang", "term", "source", "n", "all_n", "first"])
            yield out.take(pa.array(keep))

    runs = docs.select(*text).mapInArrow(worker.trimmed(split), RUNS)
    keys = ("lang", "term", "source")
    return runs.repartition(shared.partitions(docs.sparkSession), "lang", "term").sortWithinPartitions(*keys).mapInArrow(worker.trimmed(scan), KEPT)


def share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * n / total) for n <= total."""
    out = np.zeros(len(n), np.int64)
    for _ in range(3):
        n = n * 1000
        more, n = np.divmod(n, total)
        out = out * 1000 + more
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class _Pairs:
    """Partial sums of pairs of groups."""

    def __init__(self) -> None:
        self.code: dict[tuple[str, str], int] = {}
        self.name: list[tuple[str, str]] = []
        self.sum: dict[int, int] = {}

    def codes(self, batch: pa.RecordBatch) -> np.ndarray:
        lang, langs = _coded(batch.column("lang"))
        source, sources = _coded(batch.column("source"))
        both, back = np.unique(lang * len(sources) + source, return_inverse=True)
        known = []
        for x in both.tolist():
            name = (langs[x // len(sources)].as_py(), sources[x % len(sources)].as_py())
            if name not in self.code:
                self.code[name] = len(self.name)
                self.name.append(name)
            known.append(self.code[name])
        return np.array(known, np.int64)[back]

    def add(self, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> None:
        key = (a << 32) | b
        order = np.argsort(key, kind="stable")
        run = _edges(key[order])
        for k, v in zip(key[order][run].tolist(), np.add.reduceat(value[order], run).tolist(), strict=True):
            self.sum[k] = self.sum.get(k, 0) + v

    def emitted(self) -> Iterator[pa.RecordBatch]:
        rows = [(*self.name[k >> 32], self.name[k & 0xFFFFFFFF][1], v) for k, v in self.sum.items()]
        self.sum, self.code, self.name = {}, {}, []
        if rows:
            lang, source, item, value = zip(*rows, strict=True)
            yield _emitted("pair", pa.array(lang), pa.array(source), pa.array(item), pa.array(value, pa.int64()))


def _emitted(part: str, lang: pa.Array, source: pa.Array, item: pa.Array, value: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part] * len(lang), pa.string()), lang, source, item, value], names=["part", "lang", "source", "item", "value"])


def scan_terms(batches: Iterator[pa.RecordBatch], held: int = HELD) -> Iterator[pa.RecordBatch]:
    """Terms above their language's share, and partial sums of what common terms add to pairs of sources."""
    pairs = _Pairs()
    for batch in _whole_runs(batches):
        n, all_n, total, terms, all_total = (batch.column(k).to_numpy() for k in ("n", "all_n", "total", "terms", "all_total"))
        whole = total + 2 * terms
        p, p0, q = share(n + 2, whole), share(np.full(len(n), 2, np.int64), whole), share(all_n + 2, all_total + 2 * terms)
        above = pa.array(np.flatnonzero(p > q))
        yield _emitted("term", *(batch.column(k).take(above) for k in ("lang", "source", "term")), pa.array(apart(p, q)).take(above))
        run = _new(batch, "lang", "term")
        end = np.repeat(np.append(run[1:], batch.num_rows), np.diff(run, append=batch.num_rows))
        group, low, step = pairs.codes(batch), np.arange(batch.num_rows), 0
        while True:
            step += 1
            low = low[end[low] > low + step]
            if not len(low):
                break
            high = low + step
            pairs.add(group[low], group[high], apart(p[low], p[high]) - apart(p[low], p0[high]) - apart(p0[low], p[high]) + apart(p0[low], p0[high]))
            if len(pairs.sum) > held:
                yield from pairs.emitted()
                group = pairs.codes(batch)
    yield from pairs.emitted()


def _share(n: str, total: str, terms: str) -> Column:
    """As ``share``; null where a language keeps no term."""
    whole = f"nullif({total} + 2 * {terms}, 0)"
    return F.expr(f"1 + cast({n} + 2 as decimal(20, 0)) * {ONE} div {whole}")


def _apart(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: divergence from every other source of the language, and the terms that set a source apart."""
    spark = docs.sparkSession
    kept = shared.written(counted(docs, least))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own_terms"), F.sum("first").alias("first"))
    of_lang = of_group.groupBy("lang").agg(F.sum("total").alias("all_total"), F.sum("first").alias("terms"))
    names = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = names.join(of_group.drop("first"), ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0)
    groups = shared.written(groups.withColumn("none", _share("0", "total", "terms")))

    ready = kept.join(groups, ["lang", "source"]).select("lang", "term", "source", "n", "all_n", "total", "terms", "all_total")
    ready = ready.repartition(shared.partitions(spark), "lang", "term").sortWithinPartitions("lang", "term", "source")
    emitted = shared.written(ready.mapInArrow(worker.trimmed(scan_terms), EMITTED))

    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("other_none"), F.col("own_terms").alias("other_terms"))
    ways = lambda df: df.select("lang", F.inline(F.array(F.struct("source", "item", "value"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), "value"))))
    alike = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("many")).join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", "terms"))
    against = alike.join(other, "lang").filter("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("many") * _apart("p", "other_none")).alias("value"))
    rest = groups.join(other, "lang").filter("source <> item")
    rest = rest.select("lang", "source", "item", F.coalesce((F.col("terms") - F.col("own_terms") - F.col("other_terms")) * _apart("none", "other_none"), F.lit(0)).alias("value"))
    common = emitted.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pair = rest.unionByName(ways(against)).unionByName(ways(common)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ("lang", "source", "part", "item", "value", "rank")
    pair = pair.withColumn("part", F.lit("pair")).withColumn("rank", rank)
    term = emitted.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= top)
    return pair.select(*columns).unionByName(term.select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST}
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang
), totals AS (
  SELECT lang, source, sum(n)::HUGEINT AS n FROM counts GROUP BY lang, source
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + {ONE}::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(t.n, 0) + 2 * l.v) AS p,
    1 + {ONE}::HUGEINT * (k.n + 2) // (l.n + 2 * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM cells WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
) WHERE part = 'pair' OR rank <= {TOP}
"""
