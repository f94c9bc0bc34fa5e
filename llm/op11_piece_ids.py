"""SentencePiece encoding and decoding by a table of distinct chunks.

Merges join two symbols only if a piece spells both, so they never cross a place between two characters that
stand side by side in no piece. Whitespace markers follow nothing but markers in the pieces of such a model, so
every marked word is cut off from the one before it; the same test also cuts around line ends, digits and most
signs. A task keeps a table of the distinct chunks it has met with their ids (``vocab.Cache``: bytes are compared,
at most ``vocab.CAPACITY`` chunks), segments each new one once, and joins ids back by position. Nothing is
shuffled: a row is encoded where it was read, so no key or group of copies can be hot and a lost task costs itself.

Chunks are segmented by the library behind a character that is part of no longer piece; what stands for that
character and the marker that the library puts in front is then dropped. A model with markers inside pieces, or
with rules that are not local (normal forms, white space removed, pieces other than plain, byte and control
ones), is refused.

Null and empty texts have the begin and end ids alone and decode to the empty text. Each row is encoded alone:
repeated rows and ids, null ids and columns with other names have no effect, and an empty table gives an empty one.
A text of any length is handled whole; one without a place to cut is a single chunk, and takes memory of its own size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import kernel, vocab, worker

MODEL = "piece_bpe_32k.model"
MARK = "▁"
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded binary"


class Pieces:
    """A model's pieces: where texts can be cut, the ids of chunks, and the bytes that ids stand for."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(n)]
        control = [self.library.is_control(i) for i in range(n)]
        byte = [self.library.is_byte(i) for i in range(n)]
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        plain = [p for p, c, b in zip(names, control, byte, strict=True) if not (c or b)]
        if any(MARK in p.lstrip(MARK) for p in plain):
            raise ValueError("a piece of this model holds a whitespace marker after other characters")
        #: meets[a, b]: some piece has byte a just before byte b.
        self.meets = np.zeros((256, 256), bool)
        for piece in plain:
            if len(piece) > 1:  # a marker is a space in texts, or itself
                for raw in {piece.replace(MARK, " ").encode(), piece.encode()}:
                    own = np.frombuffer(raw, np.uint8)
                    self.meets[own[:-1], own[1:]] = True
        mark = MARK.encode()  # one kind of marker may follow the other
        self.meets[0x20, mark[0]] = self.meets[mark[-1], 0x20] = True
        apart = ~(self.meets.any(0) | self.meets.any(1))
        bars = [c for c in (10, 9, *range(1, 128)) if apart[c]]
        if not bars:
            raise ValueError("every character of ASCII is part of a longer piece of this model")
        self.bar = chr(bars[0])
        self.lead = len(self.library.encode(self.bar))
        if self.library.encode(f"  {self.bar}ÅÅ {self.bar}", out_type=str)[-1:] != self.library.encode(self.bar, out_type=str)[-1:] or self.library.decode(self.library.encode("  Å  ")) != "  Å  ":
            raise ValueError("this model changes texts before it encodes them")
        stands = [b"" if c else bytes([int(p[3:5], 16)]) if b else p.replace(MARK, " ").encode() for p, c, b in zip(names, control, byte, strict=True)]
        if self.library.unk_id() >= 0:
            stands[self.library.unk_id()] = " ⁇ ".encode()
        self.flat = np.frombuffer(b"".join(stands), np.uint8)
        self.at = np.concatenate(([0], np.cumsum([len(x) for x in stands])))

    def chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans that cover all bytes, cut wherever no piece can cross."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cut = np.empty(len(data), bool)
        cut[0] = True
        np.logical_not(self.meets[data[:-1], data[1:]], out=cut[1:])
        cut &= (data & 0xC0) != 0x80
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(cut)
        return start, np.append(start[1:], len(data))

    def __call__(self, chunks: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """Ids of chunks in turn, and how many each has."""
        bar, lead = self.bar, self.lead
        found = self.library.encode([bar + c.decode() for c in chunks], num_threads=1)
        return np.array([i for ids in found for i in ids[lead:]], np.uint32), [len(ids) - lead for ids in found]

    def decoded(self, ids: list[int]) -> str:
        """The text that any ids stand for."""
        raw = b"".join(self.flat[self.at[i] : self.at[i + 1]].tobytes() for i in ids)
        try:
            return raw.decode().removeprefix(" ")
        except UnicodeDecodeError:  # bytes that are no text: the library's rules for these
            return self.library.decode(ids)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers, begin and end ids included) and the text they decode to."""
    import public_tokenizers

    with open(path or public_tokenizers.path(MODEL), "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())  # a file of the vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        pieces = Pieces(sent.value)
        cache = vocab.Cache(pieces)
        try:
            for batch in batches:
                data, offsets = kernel.strings(batch.column("text"))
                for a, b in kernel.slices(offsets, vocab.SLICE_BYTES):
                    own = offsets[a : b + 1] - offsets[a]
                    yield _encoded(batch.column("doc_id").slice(a, b - a), data[offsets[a] : offsets[b]], own, pieces, cache)
        finally:  # idle workers keep nothing of it
            cache.clear()
            worker.trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _encoded(doc_id: pa.Array, data: np.ndarray, offsets: np.ndarray, pieces: Pieces, cache: vocab.Cache) -> pa.RecordBatch:
    n = len(offsets) - 1
    # a text has the library's marker in front, unless it is empty
    full = np.flatnonzero(np.diff(offsets))
    text = np.insert(data, offsets[full], 0x20)
    offsets = offsets + np.concatenate(([0], np.cumsum(np.diff(offsets) > 0)))
    start, end = pieces.chunks(text, offsets)
    ids, size = cache(text, start, end)
    bounds = vocab.per_document(start, size, offsets)
    n_ids = np.diff(bounds) + 2
    whole = np.empty(int(n_ids.sum()), "<u4")
    last = np.cumsum(n_ids)
    edge = np.zeros(len(whole), bool)
    edge[last - n_ids] = edge[last - 1] = True
    whole[last - n_ids], whole[last - 1] = pieces.begin, pieces.end
    whole[~edge] = ids
    own = ids.astype(np.int64)
    width = np.concatenate(([0], np.cumsum(pieces.at[own + 1] - pieces.at[own])))[bounds]
    back = vocab.gathered(pieces.flat, pieces.at[own], pieces.at[own + 1] - pieces.at[own]).tobytes()
    skip = np.zeros(n, np.int64)
    skip[full] = 1  # that marker
    raw = whole.tobytes()
    return pa.RecordBatch.from_arrays(
        [
            doc_id,
            pa.array(n_ids),
            pa.array([raw[4 * (y - k) : 4 * y] for y, k in zip(last.tolist(), n_ids.tolist(), strict=True)], pa.binary()),
            pa.array([back[x:y] for x, y in zip((width[:-1] + skip).tolist(), width[1:].tolist(), strict=True)], pa.binary()),
        ],
        names=["doc_id", "n_tokens", "ids", "decoded"],
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
