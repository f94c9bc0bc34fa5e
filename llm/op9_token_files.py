"""Token-id files: static range asymmetric numeral system (rANS) over shared frequencies.

Documents are range-partitioned by id into shards; a shard is a row of blocks of
about ``BLOCK`` ids, cut between documents. All blocks use one frequency table,
counted over all ids of the corpus and scaled to ``2 ** BITS``. A block deals its
ids over ``LANES`` interleaved coders, whose states and 32-bit words make one stream;
every ``CHECKPOINT`` steps the states and the place in the stream are kept, so parts of a
block can be decoded by themselves. Each block holds its checksum.

Files are Parquet, one row a block (columns of ``FILE``), and a second folder holds the
frequency table: Spark can read and write both in whatever store the shared folder is.
Readers need no other block, so they work in parallel and a lost task costs its block.

Null text is empty and has the end id alone. Ties of doc_id are ordered by text;
rows with a null id come first.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm import kernel, shared, vocab, worker

VOCABULARY, END = "word_bpe_49k.json", 2
BITS, LANES, CHECKPOINT, BLOCK = 18, 512, 128, 1 << 18
LOW = np.uint64(1 << 31)
FILE = "shard int, block int, n_tokens long, n_docs long, doc_ids binary, null_ids binary, lengths binary, states binary, words binary, checkpoints binary, crc32 long"
_FILE = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_tokens", pa.int64()), ("n_docs", pa.int64()), *((x, pa.binary()) for x in ("doc_ids", "null_ids", "lengths", "states", "words", "checkpoints")), ("crc32", pa.int64())])
RAW = "shard int, block int, n_tokens long, doc_ids binary, null_ids binary, lengths binary, low binary, high binary"
_RAW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_tokens", pa.int64()), *((x, pa.binary()) for x in ("doc_ids", "null_ids", "lengths", "low", "high"))])


class Table:
    """Frequencies scaled to ``2 ** bits``; ids that never occur have none."""

    def __init__(self, scaled: np.ndarray, bits: int = BITS) -> None:
        self.bits = bits
        self.f = scaled.astype(np.uint64)
        self.c = (np.cumsum(scaled) - scaled).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(scaled), dtype=np.uint32), scaled)

    @classmethod
    def of(cls, counts: np.ndarray, bits: int = BITS) -> Table:
        total, size = int(counts.sum()), 1 << bits
        if not total:
            return cls(np.zeros(len(counts), np.int64), bits)
        if np.count_nonzero(counts) > size:
            raise ValueError("more ids than the table has places")
        scaled = np.where(counts > 0, np.maximum(1, (counts.astype(object) * size // total).astype(np.int64)), 0)
        order = np.lexsort((np.arange(len(counts)), -scaled))
        over = int(scaled.sum()) - size
        if over < 0:
            scaled[order[0]] -= over
        for i in order:  # the largest give what rounding up took
            if over <= 0:
                break
            give = min(over, int(scaled[i]) // 2)
            scaled[i] -= give
            over -= give
        return cls(scaled, bits)

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = CHECKPOINT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First states, 32-bit words, and checkpoints (place in the words, then states) of a block."""
        steps = -(-len(ids) // lanes)
        x = np.full(lanes, LOW, np.uint64)
        chunks: list[np.ndarray] = []
        kept: list[tuple[int, np.ndarray]] = []
        done, bits = 0, np.uint64(self.bits)
        for step in range(steps - 1, -1, -1):
            own = ids[step * lanes : (step + 1) * lanes]
            m = len(own)
            f, c, state = self.f[own], self.c[own], x[:m]
            full = state >= ((LOW >> bits) << np.uint64(32)) * f
            if full.any():
                chunks.append(state[full].astype(np.uint32))
                done += len(chunks[-1])
                state = np.where(full, state >> np.uint64(32), state)
            x[:m] = ((state // f) << bits) + state % f + c
            if step % every == 0 and step:
                kept.append((done, x.copy()))
        words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, np.uint32)
        points = [np.concatenate(([np.uint64(done - at)], states)) for at, states in reversed(kept)]
        return x, words, np.concatenate(points) if points else np.zeros(0, np.uint64)

    def decode(self, n: int, states: np.ndarray, words: np.ndarray, lanes: int = LANES, first: int = 0, last: int | None = None, at: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids of the steps from ``first`` to ``last`` of a block of n ids, the states after them, and the place in the words."""
        steps = -(-n // lanes)
        last = steps if last is None else min(last, steps)
        out = np.empty(max(0, min(n, last * lanes) - first * lanes), np.uint32)
        x, mask, bits = states.copy(), np.uint64((1 << self.bits) - 1), np.uint64(self.bits)
        for step in range(first, last):
            m = min(lanes, n - step * lanes)
            state = x[:m]
            slot = state & mask
            symbol = self.symbol[slot]
            out[(step - first) * lanes : (step - first) * lanes + m] = symbol
            state = self.f[symbol] * (state >> bits) + slot - self.c[symbol]
            short = np.flatnonzero(state < LOW)
            if len(short):
                state[short] = (state[short] << np.uint64(32)) | words[at : at + len(short)]
                at += len(short)
            x[:m] = state
        return out, x, at

    def parts(self, n: int, states: np.ndarray, words: np.ndarray, checkpoints: np.ndarray, lanes: int = LANES, every: int = CHECKPOINT) -> list[np.ndarray]:
        """The block's ids in parts that are decoded each by itself, from its checkpoint."""
        starts = [(0, states), *((int(p[0]), p[1:]) for p in checkpoints.reshape(-1, lanes + 1))]
        return [self.decode(n, s, words, lanes, i * every, (i + 1) * every, at)[0] for i, (at, s) in enumerate(starts)]


#: Units of small Latin letters, digits or signs without the separator: neither normal form nor pattern changes or cuts them.
_PLAIN = re.compile(rb"(?:[\x02-\x1f!-&(-@\[-\x7f]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_CALL = 64


class Library:
    """Ids by the library: whole for any text, and for plain units by its model alone, many of them a call."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.whole, self.model = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # the characters that stand for bytes in the vocabulary; a space parts units
        self.characters = {b: ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(b))[0][0] for b in range(1, 128) if b != 32}
        self.characters |= {b: ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(bytes((0xC3, b)).decode())[0][0][1] for b in range(0x80, 0xC0)}
        self.characters[0xC3] = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str("é")[0][0][0]
        self.model.normalizer, self.model.pre_tokenizer = None, WhitespaceSplit()
        (self.mark,) = self.whole.encode("\x01", add_special_tokens=False).ids

    def __call__(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.fromiter((_PLAIN.fullmatch(u) is not None and b"<|" not in u for u in units), bool, len(units))
        sizes, parts = np.zeros(len(units), np.int64), np.zeros(0, np.uint32)
        own = [u for u, p in zip(units, plain.tolist(), strict=True) if p]
        if own:
            calls = [b" \x01 ".join(own[a : a + _CALL]).decode("latin-1").translate(self.characters) for a in range(0, len(own), _CALL)]
            found = [np.array(x.ids, np.uint32) for x in self.model.encode_batch_fast(calls, add_special_tokens=False)]
            mark = np.array([self.mark], np.uint32)
            parts = np.concatenate([x for f in found for x in (f, mark)])
            ends = np.flatnonzero(parts == self.mark)
            sizes[plain] = np.diff(ends, prepend=-1) - 1
            parts = parts[parts != self.mark]
        rest = np.flatnonzero(~plain)
        if len(rest):
            found = [np.array(x.ids, np.uint32) for x in self.whole.encode_batch_fast([units[i].decode() for i in rest.tolist()], add_special_tokens=False)]
            at = np.cumsum(sizes)[rest]
            sizes[rest] = [len(f) for f in found]
            parts = np.insert(parts, np.repeat(at, sizes[rest]), np.concatenate(found))
        return parts, sizes


def _cache(path: str) -> vocab.Cache:
    return worker.keep(f"op9 {path}", lambda: vocab.Cache(Library(path)))


def tokenized(docs: DataFrame, path: str, end: int) -> DataFrame:
    """Blocks of ids in the order of doc_id, not yet coded; low and high bytes apart. Rows of block -1 count ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, shard = _cache(path), TaskContext.get().partitionId()
        counts = np.zeros(1 << 16, np.int64)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        block = 0

        def flush() -> pa.RecordBatch:
            nonlocal block
            keys, nulls, lengths, ids = (np.concatenate([h[i] for h in held]) for i in range(4))
            held.clear()
            block += 1
            row = (shard, block - 1, len(ids), keys.tobytes(), nulls.tobytes(), lengths.astype(np.uint32).tobytes(), (ids & 0xFF).astype(np.uint8).tobytes(), (ids >> 8).astype(np.uint8).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _RAW, strict=True)], schema=_RAW)

        for batch in batches:
            data, offsets = kernel.strings(batch.column("text"))
            column = batch.column("doc_id")
            nulls = np.asarray(column.is_null()).astype(np.uint8)
            keys = np.asarray(column.fill_null(0))
            for a, b in kernel.slices(offsets, vocab.SLICE_BYTES):
                own = offsets[a : b + 1] - offsets[a]
                part = data[offsets[a] : offsets[b]]
                units, start, stop = vocab.finer(part, *vocab.words(part, own), digits_alone=True, fold=True, bar=b"<|")
                ids, size = cache(units, start, stop)
                bounds = vocab.per_document(start, size, own)
                ids = np.insert(ids, bounds[1:], end)
                if len(ids) and int(ids.max()) >= 1 << 16:
                    raise ValueError("ids above 65535 do not fit this format")
                counts += np.bincount(ids, minlength=1 << 16)
                lengths = np.diff(bounds) + 1
                # cut between documents into blocks
                ends, first = np.cumsum(lengths), 0
                while first < b - a:
                    had = sum(len(h[3]) for h in held)
                    base = int(ends[first - 1]) if first else 0
                    to = min(b - a, max(first + 1, int(np.searchsorted(ends, base + BLOCK - had, side="right"))))
                    held.append((keys[a + first : a + to], nulls[a + first : a + to], lengths[first:to], ids[base : int(ends[to - 1])]))
                    first = to
                    if had + len(held[-1][3]) >= BLOCK or first < b - a:
                        yield flush()
        if held:
            yield flush()
        if counts.any():
            row = (shard, -1, 0, None, None, None, counts.astype("<i8").tobytes(), None)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _RAW, strict=True)], schema=_RAW)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = own.repartitionByRange(shared.partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return ranged.mapInArrow(run, RAW)


def _frequencies(raw: DataFrame) -> np.ndarray:
    """Counts of all ids; what reaches the driver is one row an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column("low"):
                total += np.frombuffer(x.as_buffer(), "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    counts = np.zeros(1 << 16, np.int64)
    for r in raw.filter("block = -1").select("low").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    return counts


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = END) -> None:
    """Writes the ids of all documents below ``folder``: blocks in blocks/, the frequency table in table/."""
    import public_tokenizers

    spark = docs.sparkSession
    raw = shared.written(tokenized(docs, path or public_tokenizers.path(VOCABULARY), end))
    shared.release(spark)
    table = Table.of(_frequencies(raw))
    sent = spark.sparkContext.broadcast(table.f)
    at = np.flatnonzero(table.f)
    spark.createDataFrame([(int(i), int(table.f[i])) for i in at], "id int, f long").coalesce(1).write.parquet(f"{folder}/table")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Table(sent.value.astype(np.int64))
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["low"], np.uint8) | np.frombuffer(r["high"], np.uint8).astype(np.uint32) << 8
                states, words, points = own.encode(ids)
                row = (r["shard"], r["block"], len(ids), len(r["null_ids"]), r["doc_ids"], r["null_ids"], r["lengths"], states.tobytes(), words.tobytes(), points.tobytes(), zlib.crc32(ids.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _FILE, strict=True)], schema=_FILE)

    raw.filter("block >= 0").mapInArrow(run, FILE).write.option("compression", "none").parquet(f"{folder}/blocks")
    shared.dropped(raw)


def _read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents by block, with their place in it; and the place of each block among all ids."""
    rows = spark.read.parquet(f"{folder}/table").collect()
    f = np.zeros(1 << 16, np.int64)
    for r in rows:
        f[r.id] = r.f
    sent = spark.sparkContext.broadcast(f)
    out = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("within", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(sent.value)
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                ids = table.decode(r["n_tokens"], np.frombuffer(r["states"], np.uint64), np.frombuffer(r["words"], np.uint32))[0].astype("<u4")
                raw = ids.tobytes()
                if zlib.crc32(raw) != r["crc32"]:
                    raise ValueError(f"shard {r['shard']}, block {r['block']}: checksum does not match")
                lengths = np.frombuffer(r["lengths"], np.uint32).astype(np.int64)
                ends = np.cumsum(lengths)
                keys = pa.array(np.frombuffer(r["doc_ids"], np.int64), mask=np.frombuffer(r["null_ids"], np.uint8).astype(bool))
                n = len(lengths)
                pieces = [raw[4 * a : 4 * b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["shard"], np.int32)), pa.array(np.full(n, r["block"], np.int32)), keys, pa.array(ends - lengths), pa.array(lengths), pa.array(pieces, pa.binary())], schema=out)

    blocks = spark.read.schema(FILE).parquet(f"{folder}/blocks")
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("shard", "block", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("offset")).join(totals, "shard")
    docs = blocks.mapInArrow(run, "shard int, block int, doc_id long, within long, n_tokens long, ids binary")
    return docs, starts


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit integers)."""
    docs, starts = _read(spark, folder)
    return docs.join(starts, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("offset") + F.col("within")).alias("start"), "n_tokens", "ids")


def query(spark, sf_dir: str) -> DataFrame:
    folder = shared.folder(spark)
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    docs, starts = _read(spark, folder)
    docs = docs.select("shard", "block", "doc_id", "within", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return docs.join(starts, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("offset") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
