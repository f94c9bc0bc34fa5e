"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Every byte prefix of a piece has one valid encoding, so it is enough to store the
last token of each prefix: it is the longest token that ends there and may follow
the last token of what stands before it. Whether a token may follow another is
decided by undoing their merges from the latest: no merge across the border may
come before one that it needs undone. Appending bytes extends the table; an edit
keeps the table up to it, and rejoins the old tokens once both tables agree.

``public_tokenizers.PATTERN`` splits texts first, and a piece that is itself a token is
that token. White space and the words between can be split apart (``vocab.py``), so a
task encodes each distinct word once as long as its cache holds it.
Null text is empty: no tokens. Rows are encoded alone, repeated rows and null ids too.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import kernel, vocab, worker

RANKS = "byte_bpe_multi_50k.tiktoken"
#: What a task keeps at most: ids of units and of pieces, and pairs of tokens that may follow each other.
UNITS, PIECES, PAIRS = 300_000, 60_000, 150_000
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded binary"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Encoder:
    """Encodes byte strings by the ranks of merges."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.follows: dict[int, bool] = {}
        self.usable: dict[bytes, int] = {}
        self.ends = None
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.parts[rank] = None
                self.usable[token] = rank
            else:
                found = self._table(token, [])
                first = found[-1]
                a = self.bytes_of[first]
                left = self.backward(found[: len(token) - len(a)])
                if len(left) == 1:  # else the merges never make it
                    self.parts[rank] = (left[0], first)
                    self.merged[left[0], first] = rank
                    self.usable[token] = rank
        self.ends = ahocorasick.Automaton()
        for token, rank in self.usable.items():
            self.ends.add_word(token.decode("latin-1"), (rank, len(token)))
        self.ends.make_automaton()

    def may_follow(self, a: int, b: int) -> bool:
        """Whether b can stand after a: no merge over their border comes before those that make them."""
        key = a << 32 | b
        known = self.follows.get(key)
        if known is not None:
            return known
        left, right, before = a, b, float("inf")
        while True:
            over = self.merged.get((left, right))
            if over is not None and over < before:
                out = False
                break
            x, y = self.parts[left], self.parts[right]
            if x is None and y is None:
                out = True
                break
            # undo the later of the two merges; of equal ones the right, as the left one is made first
            if y is None or (x is not None and left > right):
                before, left = left, x[1]
            else:
                before, right = right + 1, y[0]
        self.follows[key] = out
        if len(self.follows) > PAIRS:
            self.follows.clear()
        return out

    def _table(self, piece: bytes, last: list[int]) -> list[int]:
        """Last tokens of all prefixes of ``piece``; ``last`` has those of the first ones."""
        usable, follows, longest = self.usable, self.follows, self.longest
        if self.ends is not None:  # the tokens that end at each byte, the longest first
            done = len(last)
            for end, (token, size) in self.ends.iter(piece.decode("latin-1"), max(0, done + 1 - longest)):
                if end != done:
                    continue
                if end >= size:
                    before = last[end - size]
                    ok = follows.get(before << 32 | token)
                    if not (ok or (ok is None and self.may_follow(before, token))):
                        continue
                last.append(token)
                done += 1
            return last
        for end in range(len(last) + 1, len(piece) + 1):
            for begin in range(max(0, end - longest), end):
                token = usable.get(piece[begin:end])
                if token is not None:
                    if not begin:
                        break
                    ok = follows.get(last[begin - 1] << 32 | token)
                    if ok or (ok is None and self.may_follow(last[begin - 1], token)):
                        break
            last.append(token)
        return last

    def backward(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.backward(self._table(piece, []))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Prefixes:
    """Encoding of one growing or edited piece."""

    def __init__(self, encoder: Encoder, piece: bytes = b"") -> None:
        self.encoder, self.piece, self.last = encoder, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        self.encoder._table(self.piece, self.last)

    def replace(self, start: int, end: int, by: bytes) -> None:
        """Puts ``by`` in place of the bytes from start to end; only prefixes near the edit are encoded again."""
        tail, shift = self.last[end:], len(by) - (end - start)
        self.piece = self.piece[:start] + by + self.piece[end:]
        fresh = self.last[:start]
        longest, at = self.encoder.longest, start + len(by)
        self.encoder._table(self.piece[:at], fresh)
        same = 0
        while at < len(self.piece):
            self.encoder._table(self.piece[: at + 1], fresh)
            same = same + 1 if fresh[at] == tail[at - shift - end] else 0
            at += 1
            if same >= longest:  # all that later prefixes look back on is as before
                fresh += tail[at - shift - end :]
                break
        self.last = fresh

    def ids(self) -> list[int]:
        return self.encoder.backward(self.last)


class Units:
    """Encodes units: splits them by the pattern and keeps the ids of pieces seen, at most ``most`` of them."""

    def __init__(self, encoder: Encoder, pattern: str, most: int = PIECES) -> None:
        import regex

        self.encoder, self.split, self.most = encoder, regex.compile(pattern), most
        self.pieces: dict[bytes, list[int]] = {}

    def __call__(self, units: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """Ids of all units in turn, and how many each has."""
        pieces, split, piece_of = self.pieces, self.split, self.encoder.piece
        if len(pieces) > self.most:
            pieces.clear()
        out: list[int] = []
        sizes = []
        for unit in units:
            before = len(out)
            for piece in split.findall(unit.decode()):
                raw = piece.encode()
                ids = pieces.get(raw)
                if ids is None:
                    ids = pieces[raw] = piece_of(raw)
                out += ids
            sizes.append(len(out) - before)
        return np.array(out, np.uint32), sizes


def token_bytes(encoder: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens, flat, with their offsets."""
    tokens = [encoder.bytes_of.get(i, b"") for i in range(max(encoder.bytes_of) + 1)]
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in tokens])))


def decoded(ids: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bytes of all tokens in turn."""
    size = at[ids + 1] - at[ids] if len(ids) else np.zeros(0, np.int64)
    total = np.cumsum(size)
    return flat[np.arange(int(total[-1]) if len(total) else 0) + np.repeat(at[ids] - (total - size), size)] if len(ids) else flat[:0]


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the bytes they decode to."""
    import public_tokenizers

    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    # a table of the vocabulary's size, built once
    sent = docs.sparkSession.sparkContext.broadcast(Encoder(read_ranks(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        encoder: Encoder = sent.value
        cache = vocab.Cache(Units(encoder, pattern), UNITS)
        flat, at = token_bytes(encoder)
        try:
            yield from each(batches, cache, flat, at)
        finally:  # idle workers keep nothing of it
            cache.clear()
            cache.encode.pieces.clear()
            encoder.follows.clear()
            worker.trim()

    def each(batches: Iterator[pa.RecordBatch], cache: vocab.Cache, flat: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernel.strings(batch.column("text"))
            for a, b in kernel.slices(offsets, vocab.SLICE_BYTES):
                own = offsets[a : b + 1] - offsets[a]
                part = data[offsets[a] : offsets[b]]
                part, start, end = vocab.finer(part, *vocab.spaced_words(part, own))
                ids, size = cache(part, start, end)
                bounds = vocab.per_document(start, size, own)
                width = np.concatenate(([0], np.cumsum(at[ids.astype(np.int64) + 1] - at[ids])))
                back = decoded(ids.astype(np.int64), flat, at).tobytes()
                raw = ids.astype("<u4").tobytes()
                cut = width[bounds]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(np.diff(bounds)),
                        pa.array([raw[4 * x : 4 * y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary()),
                        pa.array([back[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
