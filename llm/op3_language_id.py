"""Language identification by prediction by partial matching over bytes.

For each language the contexts of up to three bytes of its training texts form a tree of counts, of the contexts that
occur only. A byte is coded in the longest context known, with probability count / (n + d) for n bytes and d distinct
ones seen there; a byte not seen there costs an escape of d / (n + d) and is coded in the context one byte shorter, down
to an even choice among 256. Three spaces stand before each text, and its end costs the escapes from its last contexts.
After training nothing is updated, so the code length of a text is a sum of table entries: it is exact, and the same
wherever the text is scored. Bytes are folded first: A-Z to a-z.

The tables hold, for a run of one to four bytes and a language that has seen it, by how much it changes the code length:
what coding its last byte there saves against the shorter run, and the escape that it costs as a context. A language's
code length is then a base rate for each byte plus the entries of the runs that end there, and takes no room for runs that
the language has not seen. Up to ``DENSE`` languages the entries of a run and its shorter ones are summed beforehand.

The language with the shortest code wins, the first by name of equal ones. Texts without a letter are ``und`` with score 0,
null and empty ones too, and so are all texts if nothing was learned. Learning reads at most ``sample`` documents of each
language, those of the least hash of id and text, and of each up to ``WINDOWS`` windows spread evenly over the text,
``most_bytes`` in all, which bounds what reaches the driver; repeats of a row count once. Scoring reads whole texts in blocks,
so a text of any length takes the memory of a block beside itself. lang, source and doc_id take no part in it. Rows with a
null id are scored, but belong to no fold. Columns with other names are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm import kernel, vocab, worker

ORDER = 3
#: Training documents of a language, and bytes of each, taken in so many windows.
SAMPLE, MOST_BYTES, WINDOWS = 150, 8000, 8
#: Training documents of all languages together, which share them evenly; each has one at least.
SAMPLES = 30_000
#: Languages up to which tables have a place for each language.
DENSE = 32
BLOCK = 1 << 17
#: A text is in no language if it takes more bits than RATE a byte, as it does unmodelled, and ALLOWED more for its whole length:
#: escapes dominate short texts, which is no sign of another language.
RATE, ALLOWED = 8.0, 120.0
SCHEMA = "doc_id long, lang_pred string, score double, bits_per_byte double, margin_bits double"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACES = np.full(ORDER, 32, np.uint8)


class Level(NamedTuple):
    """Entries of runs of one length: for run i, those from start[i] to start[i + 1]."""

    keys: np.ndarray
    start: np.ndarray
    language: np.ndarray
    value: np.ndarray


class Model(NamedTuple):
    languages: list[str]
    base: np.ndarray  #: bits a byte that is in no table
    once: np.ndarray  #: bits of a text besides those of its bytes
    levels: list[Level]  #: of one to four bytes


def _runs(data: np.ndarray, n: int) -> np.ndarray:
    """The runs of n bytes that end at each place from ORDER on, as numbers."""
    out = np.zeros(len(data) - ORDER, np.uint32)
    for back in range(n - 1, -1, -1):
        out = (out << np.uint32(8)) | data[ORDER - back : len(data) - back]
    return out


def _entries(texts: list[bytes]) -> tuple[float, float, list[tuple[np.ndarray, np.ndarray]]]:
    """Base rate, bits of a text, and runs with their values for each length, of one language."""
    own = [np.concatenate((_SPACES, _FOLD[np.frombuffer(t, np.uint8)])) for t in texts]
    grams, costs, escapes = [], [], []
    for n in range(1, ORDER + 2):
        run, count = np.unique(np.concatenate([_runs(t, n) for t in own] or [np.zeros(0, np.uint32)]), return_counts=True)
        context, at = np.unique(run >> np.uint32(8), return_inverse=True)
        total, kinds = np.bincount(at, weights=count, minlength=len(context)), np.bincount(at, minlength=len(context))
        grams.append(run)
        costs.append(-np.log2(count / (total + kinds)[at]) if len(run) else np.zeros(0))
        escapes.append((context, -np.log2(kinds / (total + kinds))))
    leave = float(escapes[0][1][0]) if len(grams[0]) else 0.0
    base = leave + 8.0
    out = []
    below_runs, below_costs = np.zeros(1, np.uint32), np.array([8.0])
    for n, (run, cost) in enumerate(zip(grams, costs, strict=True)):
        short = (run & np.uint32((1 << 8 * n) - 1)) if n else np.zeros(len(run), np.uint32)
        lower = below_costs[np.searchsorted(below_runs, short)] if len(run) else np.zeros(0)
        context, escape = escapes[n]
        saved = cost - lower - (escape[np.searchsorted(context, run >> np.uint32(8))] if len(run) else 0)
        if n < ORDER:
            after, price = escapes[n + 1]
            keys = np.union1d(run, after)
            value = np.zeros(len(keys))
            value[np.searchsorted(keys, run)] += saved
            value[np.searchsorted(keys, after)] += price
        else:
            keys, value = run, saved
        out.append((keys, value))
        below_runs, below_costs = run, cost
    # contexts of the spaces before a text; runs of them that occur are in the tables of their lengths
    once = leave
    for n in range(1, ORDER + 1):
        context, price = escapes[n]
        at = np.flatnonzero(context == int.from_bytes(b" " * n, "big"))
        once += float(price[at[0]]) if len(at) else 0.0
    return base, once, out


def train(samples: dict[str, list[bytes]]) -> Model:
    """A model of the texts of each language."""
    languages = sorted(samples)
    if not languages:
        return Model([], np.zeros(0), np.zeros(0), [])
    base, once, each = zip(*(_entries(samples[x]) for x in languages), strict=True)
    levels = []
    for n in range(ORDER + 1):
        keys = np.concatenate([e[n][0] for e in each])
        language = np.repeat(np.arange(len(languages), dtype=np.uint16 if len(languages) < 1 << 16 else np.int32), [len(e[n][0]) for e in each])
        value = np.concatenate([e[n][1] for e in each]).astype(np.float32)
        order = np.argsort(keys, kind="stable")
        runs, first = np.unique(keys[order], return_index=True)
        levels.append(Level(runs, np.append(first, len(keys)).astype(np.int32), language[order], value[order]))
    return Model(languages, np.array(base), np.array(once), levels)


class Scorer:
    """Code lengths by a model's tables."""

    def __init__(self, model: Model, dense: int = DENSE) -> None:
        self.model, self.k = model, len(model.languages)
        self.short, self.long = [], []
        for n, level in enumerate(model.levels[:2]):
            table = np.full(256 ** (n + 1), -1, np.int32)
            table[level.keys] = np.arange(len(level.keys))
            self.short.append(table)
        for level in model.levels[2:]:
            places = vocab._Places()
            places.add(level.keys.astype(np.uint64))
            self.long.append(places)
        self.full: list[np.ndarray] | None = None
        if self.k <= dense:
            self.full = []
            for n, level in enumerate(model.levels):
                own = np.zeros((len(level.keys), self.k), np.float64)
                own[np.repeat(np.arange(len(level.keys)), np.diff(level.start)), level.language] = level.value
                if n:
                    self._add_shorter(own, level.keys & np.uint32((1 << 8 * n) - 1), n)
                self.full.append(own)
            self.full = [f.astype(np.float32) for f in self.full]

    def find(self, runs: np.ndarray, n: int) -> np.ndarray:
        """Places of runs of n bytes in their table, or -1."""
        return self.short[n - 1][runs] if n <= 2 else self.long[n - 3].find(runs.astype(np.uint64))

    def _add_shorter(self, out: np.ndarray, runs: np.ndarray, n: int, rows: np.ndarray | None = None) -> None:
        """Adds the summed entries of each run of n bytes, or of the longest end of it in a table."""
        rows = np.arange(len(runs)) if rows is None else rows
        while n and len(rows):
            at = self.find(runs, n)
            known = at >= 0
            out[rows[known]] += self.full[n - 1][at[known]]
            rows, runs, n = rows[~known], runs[~known], n - 1
            runs = runs & np.uint32((1 << 8 * n) - 1)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text in each language."""
        size = np.diff(offsets)
        total = size[:, None] * self.model.base + self.model.once
        data = _FOLD[data]
        position = None
        for low in range(0, len(data), BLOCK):
            high = min(len(data), low + BLOCK)
            first = int(np.searchsorted(offsets, low, side="right")) - 1
            edge = offsets[first:]
            edge = edge[: int(np.searchsorted(edge, high))]
            begin = np.maximum(edge, low) - low
            doc = np.repeat(np.arange(first, first + len(edge)), np.diff(begin, append=high - low))
            position = np.arange(low, high) - offsets[doc]
            run = data[low:high].astype(np.uint32)
            for back in range(1, ORDER + 1):
                before = np.full(high - low, 32, np.uint32)
                from_ = max(0, back - low)
                before[from_:] = data[low + from_ - back : high - back]
                before[position < back] = 32
                run |= before << np.uint32(8 * back)
            if self.full is not None:
                bits = np.zeros((len(run), self.k), np.float32)
                self._add_shorter(bits, run, ORDER + 1)
                full = np.flatnonzero(np.diff(begin, append=high - low) > 0)
                total[first + full] += np.add.reduceat(bits, begin[full], axis=0, dtype=np.float64)
            else:
                self._sparse(total, doc, run)
        return total

    def _sparse(self, total: np.ndarray, doc: np.ndarray, run: np.ndarray) -> None:
        for n, level in enumerate(self.model.levels, 1):
            at = self.find(run & np.uint32((1 << 8 * n) - 1), n)
            known = at >= 0
            key, count = np.unique(doc[known] * len(level.keys) + at[known], return_counts=True)
            of, at = np.divmod(key, len(level.keys))
            size = level.start[at + 1] - level.start[at]
            cuts = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()) + 1, 1 << 21)[1:])
            for part in np.split(np.arange(len(key)), cuts):
                if len(part):
                    own = size[part]
                    entry = np.arange(int(own.sum())) + np.repeat(level.start[at[part]] - (np.cumsum(own) - own), own)
                    low = int(of[part[0]])
                    place = np.repeat(of[part] - low, own) * self.k + level.language[entry]
                    sums = np.bincount(place, weights=level.value[entry] * np.repeat(count[part], own), minlength=(int(of[part[-1]]) - low + 1) * self.k)
                    total[low : int(of[part[-1]]) + 1] += sums.reshape(-1, self.k)


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text in each language."""
    return Scorer(model)(data, offsets)


def _letters(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))


def _windows(text, most_bytes: int):
    """Bytes of a text: all, or windows that are spread evenly over it."""
    raw, each = text.cast("binary"), max(1, most_bytes // WINDOWS)
    step = (F.octet_length(raw) - each) / F.lit(WINDOWS - 1)
    parts = [F.substring(raw, (F.floor(step * i) + 1).cast("int"), F.lit(each)) for i in range(WINDOWS)]
    return F.when(F.octet_length(raw) <= WINDOWS * each, F.array(raw)).otherwise(F.array(*parts))


def learn(docs: DataFrame, sample: int = SAMPLE, most_bytes: int = MOST_BYTES) -> Model:
    """A model from the rows whose crc32(doc_id) mod 4 is not 2."""
    rows = docs.filter("lang is not null and text is not null and doc_id is not null").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    rows = rows.select("lang", F.xxhash64("doc_id", "text").alias("h"), _windows(F.col("text"), most_bytes).alias("t"))
    # every language is learned, from fewer documents each where there are many languages
    sample = max(1, min(sample, SAMPLES // max(1, rows.agg(F.countDistinct("lang")).first()[0])))
    # the hash up to which rows are taken is found on hashes alone: within 64 parts of a language, then over those
    ranked = rows.select("lang", "h").withColumn("part", F.pmod("h", F.lit(64))).withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy("h"))).filter(F.col("r") <= sample)
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= sample)
    edges = ranked.groupBy("lang").agg(F.max("h").alias("h")).collect()
    # one row a language; repeats of a row are one sample
    edge = F.broadcast(docs.sparkSession.createDataFrame([(r.lang, r.h) for r in edges], "lang string, edge long"))
    taken = rows.join(edge, "lang").filter("h <= edge").groupBy("lang", "h").agg(F.min("t").alias("t"))
    samples: dict[str, list[bytes]] = {}
    for row in taken.orderBy("lang", "h").collect():
        samples.setdefault(row.lang, []).extend(map(bytes, row.t))
    return train(samples)


def _slices(offsets: np.ndarray, languages: int) -> Iterator[tuple[int, int]]:
    most = max(1, 4_000_000 // max(1, languages))
    for a, b in kernel.slices(offsets, 1 << 20):
        for c in range(a, b, most):
            yield c, min(b, c + most)


def _predicted(scorer: Scorer, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index of the language of each text (the number of languages for none), score, bits in it, and the lead in bits."""
    data, offsets = kernel.strings(texts)
    found: list[tuple[np.ndarray, ...]] = []
    for a, b in _slices(offsets, scorer.k) if scorer.k else ():
        own = offsets[a : b + 1] - offsets[a]
        bits = scorer(data[offsets[a] : offsets[b]], own)
        best = bits.argmin(1)
        least = bits[np.arange(b - a), best]
        second = np.partition(bits, 1, axis=1)[:, 1] if scorer.k > 1 else least
        # bits count less the longer a text is, so long texts are not all certain
        weight = np.exp2(-np.minimum(1000, (bits - least[:, None]) / 8 / np.sqrt(np.maximum(1, np.diff(own)))[:, None]))
        found.append((best, 1 / weight.sum(1), least, second - least))
    n = len(texts)
    best, score, least, lead = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(n, np.int64), *(np.zeros(n) for _ in range(3)))
    und = ~_letters(texts)
    if not scorer.k:
        und[:] = True
    return np.where(und, scorer.k, best), np.where(und, 0.0, score), np.where(und, 0.0, least), np.where(und, 0.0, lead)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: predicted language, score, bits a byte in it, and bits by which it leads."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(broadcast.value)
        names = np.array([*scorer.model.languages, "und"], dtype=object)
        for batch in batches:
            if batch.num_rows:
                best, score, bits, lead = _predicted(scorer, batch.column("text"))
                size = np.maximum(1, np.diff(kernel.strings(batch.column("text"))[1]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[best], pa.string()), *map(pa.array, (score, bits / size, lead))], names=["doc_id", "lang_pred", "score", "bits_per_byte", "margin_bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(worker.trimmed(run), SCHEMA)


#: Words with a digit, such as numbers and keys, which are in no language.
_KEYS = re.compile(r"\S*\d\S*")


def accepted(docs: DataFrame, model: Model, rate: float = RATE, allowed: float = ALLOWED) -> DataFrame:
    """Rows of ``docs``, as they are, whose text is in one of the languages: it has a letter, and its best code, whole or without
    words that hold a digit, is short enough against its length. If no language was learned, all texts with a letter stay.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def good(scorer: Scorer, texts: pa.Array) -> np.ndarray:
        best, _, bits, _ = _predicted(scorer, texts)
        return (best < scorer.k) & (bits <= rate * np.diff(kernel.strings(texts)[1]) + allowed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(broadcast.value)
        for batch in batches:
            if batch.num_rows:
                texts = batch.column("text")
                kept = _letters(texts)
                if scorer.k:
                    kept = good(scorer, texts)
                    over = np.flatnonzero(~kept & _letters(texts))
                    if len(over):
                        plain = [_KEYS.sub(" ", t) for t in texts.take(pa.array(over)).to_pylist()]
                        kept[over] = good(scorer, pa.array(plain, pa.string()))
                yield batch.filter(pa.array(kept))

    return docs.mapInArrow(worker.trimmed(run), docs.schema)


def held_out(column) -> object:
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte", "margin_bits")
