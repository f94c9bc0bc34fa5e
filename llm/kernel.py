"""Vectorised word and window hashing over Arrow string buffers.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``. All of these are
ASCII, so working on UTF-8 bytes gives the same words as working on code points.
Hashes are 64-bit. A word's is the sum of its bytes' random values, each times a random
factor of its place in the word, then mixed: no structure of the bytes makes two words
meet, as it can with powers of a base modulo 2**64. Hashes of windows join those of halves,
mixed at each join. Equal words always get equal hashes; different ones collide with a chance
of about 2**-62 a pair, which is taken as equality where bytes are not compared as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer document is handled alone.
SLICE_BYTES = 1 << 19

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents, each of at most ``limit`` bytes or of one document."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


class Words(NamedTuple):
    """Words of some documents: byte spans in ``data``, hashes, and ``bounds`` (documents + 1) into them."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document bounds of words; ``offsets`` begin at 0 and end at len(data)."""
    n = len(data)
    word = np.zeros(n + 2, dtype=bool)
    word[1:-1] = ~space[data]
    cut = offsets[:-1][np.diff(offsets) > 0]
    before = word[:-1].copy()
    before[cut] = False
    start = np.flatnonzero(word[1:] & ~before)
    after = word[1:].copy()
    after[cut] = False
    end = np.flatnonzero(word[:-1] & ~after)
    return start, end, np.searchsorted(start, offsets)


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> Words:
    """Words with hashes; ``fold`` takes A-Z as a-z."""
    start, end, bounds = spans(data, offsets)
    return Words(data, start, end, span_hash(data, start, end, fold), bounds)


class _Factors:
    """Random odd factors by place, grown on demand."""

    def __init__(self) -> None:
        self.own = np.zeros(0, np.uint64)

    def of(self, n: int) -> np.ndarray:
        if len(self.own) < n:
            size = 1 << max(8, int(n - 1).bit_length())
            self.own = mix(mix(np.arange(1, size + 1, dtype=np.uint64)) ^ np.uint64(0x6A09E667F3BCC909)) | np.uint64(1)
        return self.own[:n]


_FACTORS = _Factors()


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """Hashes of spans, which ascend and don't overlap."""
    if not len(start):
        return np.zeros(0, np.uint64)
    low, high = int(start[0]), int(end[-1])
    factors = _FACTORS.of(int((end - start).max()) + 1)
    first = (start - low).astype(np.int32)
    place = np.arange(high - low, dtype=np.int32)
    place -= np.repeat(first, np.diff(first, append=np.int32(high - low)))
    np.minimum(place, np.int32(len(factors) - 1), out=place)  # bytes between spans, which count for none
    total = (_FOLDED if fold else _BYTE)[data[low:high]]
    total *= factors[place]
    np.cumsum(total, out=total)
    out = total[end - (low + 1)]
    out[1:] -= total[first[1:] - 1]
    out += (end - start).astype(np.uint64)
    return mix(out)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of two runs that follow each other."""
    x = a * np.uint64(0x9FB21C651E98DF25) + b * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(33)
    return x


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; entry i covers words i to i + size - 1. Runs over document ends are included."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, done, width, run = None, 0, 1, hashes
    while True:
        if size & width:  # the shorter parts come first
            part = run[done : done + n]
            out = part if out is None else _join(out, part)
            done += width
        width *= 2
        if width > size:
            return mix(out + np.uint64(size))
        run = _join(run[: -width // 2], run[width // 2 :])


def window_starts(bounds: np.ndarray, size: int) -> np.ndarray:
    """Indices of the words at which a run of ``size`` words of one document starts."""
    lengths = np.maximum(0, np.diff(bounds) - size + 1)
    total = int(lengths.sum())
    shift = np.repeat(bounds[:-1] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total) + shift


def each_slice(column: pa.Array | pa.ChunkedArray, fold: bool = False, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first document, end, words) over slices of a string column."""
    data, offsets = strings(column)
    for a, b in slices(offsets, limit):
        own = offsets[a : b + 1]
        yield a, b, words(data[own[0] : own[-1]], own - own[0], fold)
