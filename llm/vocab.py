"""Encoding texts by way of their distinct units.

A unit is a run of text that a tokenizer treats alone, whatever stands around it.
Units of a slice are hashed and looked up in a cache of ids that a Python worker keeps
between slices and tasks; a hit counts only if the bytes are equal too, and only units
not in it are encoded. Ids of all occurrences are then gathered in one step.
The cache holds at most ``CAPACITY`` units (or those of one slice, if more) and starts anew beyond that.

Words of ASCII and the Latin letters U+00C0 to U+00FF, which neither normal forms nor patterns join
with others, are cut further where letters, digits and signs meet.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from llm import kernel

CAPACITY = 600_000
SLICE_BYTES = 2 << 20
#: Code points with the Unicode property White_Space beyond ASCII, as UTF-8.
WIDE_SPACES = [bytes(chr(c), "utf-8") for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def white(data: np.ndarray) -> np.ndarray:
    """Which bytes are part of white space."""
    out = kernel.IS_SPACE[data]
    for lead in np.flatnonzero(_LEADS[data]).tolist() if _has_wide(data) else ():
        for s in WIDE_SPACES:
            if data[lead : lead + len(s)].tobytes() == s:
                out[lead : lead + len(s)] = True
    return out


def _has_wide(data: np.ndarray) -> bool:
    raw = data.tobytes()
    return any(s in raw for s in WIDE_SPACES)


def _runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(inside)
    flag = np.zeros(n + 2, bool)
    flag[1:-1] = inside
    cut = offsets[:-1][np.diff(offsets) > 0]
    before = flag[:-1].copy()
    before[cut] = False
    after = flag[1:].copy()
    after[cut] = False
    return np.flatnonzero(flag[1:] & ~before), np.flatnonzero(flag[:-1] & ~after)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of runs without white space."""
    return _runs(~white(data), offsets)


def spaced_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that cover all bytes: words with one space before them, and the white space left.

    Of white space before a word, all but the last character stand together; the last
    one goes with the word if it is a space, and stands alone otherwise.
    """
    space = white(data)
    start, end = _runs(~space, offsets)
    ws, we = _runs(space, offsets)
    last = we - 1
    for _ in range(2):
        inside = (data[last] & 0xC0) == 0x80 if len(last) else np.zeros(0, bool)
        last = np.where(inside, last - 1, last)
    # white space at the end of a document stands whole
    final = np.isin(we, offsets)
    joined = ~final & (data[last] == 0x20) if len(last) else np.zeros(0, bool)
    start = start.copy()
    if len(ws):
        start[np.searchsorted(start, we[joined])] = last[joined]
    several = ~final & (last > ws)
    alone = ~final & ~joined
    s = np.concatenate((start, ws[final], ws[several], last[alone]))
    e = np.concatenate((end, we[final], last[several], we[alone]))
    order = np.argsort(s, kind="stable")
    return s[order], e[order]


LETTER, DIGIT, SIGN, WHOLE = 1, 2, 3, 4
_CLASS = np.full(256, WHOLE, np.uint8)  # 0 white space
_CLASS[:128] = SIGN
_CLASS[[*range(65, 91), *range(97, 123), 0xC3]] = LETTER
_CLASS[48:58] = DIGIT
_CLASS[kernel.IS_SPACE] = 0
_CLASS[39] = WHOLE  # patterns look at what follows an apostrophe
_AFTER_C3 = np.full(256, WHOLE, np.uint8)
_AFTER_C3[0x80:0xC0] = LETTER
_AFTER_C3[[0x97, 0xB7]] = WHOLE  # signs
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def finer(data: np.ndarray, start: np.ndarray, end: np.ndarray, digits_alone: bool = False, fold: bool = False, bar: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of units: spans cut between letters, digits and signs where only plain characters stand in them.

    White space at the head of a span stays with what follows. digits_alone: every digit is a unit.
    fold: plain spans are put in lower case. bar: spans with these two bytes in a row stay whole.
    """
    if not len(start):
        return data, start, end
    kind = _CLASS[data]
    after = np.flatnonzero(data == 0xC3) + 1
    after = after[after < len(data)]
    kind[after] = _AFTER_C3[data[after]]
    if bar:
        kind[:-1][(data[:-1] == bar[0]) & (data[1:] == bar[1])] = WHOLE
    odd = np.concatenate((np.zeros(1, np.int32), np.cumsum(kind == WHOLE, dtype=np.int32)))
    plain = odd[end] == odd[start]
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, start[plain], 1)
    np.subtract.at(edge, end[plain], 1)
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    cut = np.zeros(len(data), bool)
    cut[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] > 0)
    if digits_alone:
        cut |= kind == DIGIT
    cut &= inside
    cut[start] = True
    begin = np.flatnonzero(cut)
    last = np.searchsorted(begin, start[1:])  # the first unit of each next span
    stop = np.empty(len(begin), np.int64)
    stop[:-1] = begin[1:]
    stop[np.concatenate((last - 1, [len(begin) - 1]))] = end
    if fold:
        low = _LOWER[data]
        wide = after[(data[after] >= 0x80) & (data[after] < 0x9F) & (data[after] != 0x97)]
        low[wide] += 32
        data = np.where(inside, low, data)
    return data, begin, stop


class _Places:
    """Places of 64-bit keys in a list, by open addressing."""

    def __init__(self, bits: int = 12) -> None:
        self.bits, self.n = bits, 0
        self.slot = np.full(1 << bits, -1, np.int32)
        self.key = np.zeros(1 << bits, np.uint64)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        at, left = self._at(keys), np.arange(len(keys))
        while len(left):
            place = self.slot[at]
            met = place >= 0
            same = met & (self.key[place] == keys[left])
            out[left[same]] = place[same]
            on = met & ~same
            left, at = left[on], (at[on] + 1) & (len(self.slot) - 1)
        return out

    def add(self, keys: np.ndarray) -> None:
        """Puts new, distinct keys at the end of the list."""
        if 2 * (self.n + len(keys)) > len(self.slot):
            old = self.key[: self.n].copy()
            self.bits = max(self.bits, int(3 * (self.n + len(keys))).bit_length())
            self.slot, self.n = np.full(1 << self.bits, -1, np.int32), 0
            self.key = np.zeros(1 << (self.bits - 1), np.uint64)
            self._put(old)
        self._put(keys)

    def _put(self, keys: np.ndarray) -> None:
        place = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.key[self.n : self.n + len(keys)] = keys
        self.n += len(keys)
        at = self._at(keys)
        while len(place):
            free = self.slot[at] < 0
            self.slot[at[free]] = place[free]
            on = self.slot[at] != place
            place, at = place[on], (at[on] + 1) & (len(self.slot) - 1)


class _Grown:
    """An array with room at its end."""

    def __init__(self, kind: type) -> None:
        self.own, self.n = np.zeros(1 << 10, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.own):
            room = np.zeros(max(self.n + len(more), len(self.own) * 3 // 2), self.own.dtype)
            room[: self.n] = self.own[: self.n]
            self.own = room
        self.own[self.n : self.n + len(more)] = more
        self.n += len(more)


def gathered(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of ``flat``, given their starts and lengths, one after the other."""
    total = np.cumsum(size)
    return flat[np.arange(int(total[-1]) if len(total) else 0) + np.repeat(at - (total - size), size)]


class Cache:
    """Ids of units. ``encode`` gives the ids of some byte strings in turn, and how many each has."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, Sequence[int]]], capacity: int = CAPACITY) -> None:
        self.encode, self.capacity = encode, capacity
        self.clear()

    def clear(self) -> None:
        self.places = _Places()
        self.at, self.size, self.ids = _Grown(np.int64), _Grown(np.int32), _Grown(np.uint32)
        self.bytes_at, self.width, self.bytes = _Grown(np.int64), _Grown(np.int32), _Grown(np.uint8)

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        raw = data.tobytes()
        ids, sizes = self.encode([raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        sizes = np.asarray(sizes, np.int64)
        self.at.add(np.cumsum(sizes) - sizes + self.ids.n)
        self.size.add(sizes)
        self.ids.add(ids)
        width = end - start
        self.bytes_at.add(np.cumsum(width) - width + self.bytes.n)
        self.width.add(width)
        self.bytes.add(gathered(data, start, width))
        self.places.add(hashes)

    def _same(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the bytes of each unit are those at its place."""
        width = end - start
        out = self.width.own[place] == width
        full = np.flatnonzero(out & (width > 0))
        if len(full):
            width = width[full]
            differ = gathered(data, start[full], width) != gathered(self.bytes.own, self.bytes_at.own[place[full]], width)
            if differ.any():
                out[full[np.searchsorted(np.cumsum(width), np.flatnonzero(differ), side="right")]] = False
        return out

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in turn, and how many each has."""
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        hashes = kernel.span_hash(data, start, end)
        place = self.places.find(hashes)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            if self.places.n and self.places.n + len(new) > self.capacity:
                self.clear()
                missing = np.arange(len(hashes))
                new, first = np.unique(hashes, return_index=True)
            at = missing[first]
            self._learn(data, start[at], end[at], new)
            place[missing] = self.places.find(hashes[missing])
        size, at, ids = self.size.own[place].astype(np.int64), self.at.own[place], self.ids.own
        other = np.flatnonzero(~self._same(data, start, end, place))
        if len(other):  # another unit has this hash
            raw = data.tobytes()
            more, sizes = self.encode([raw[a:b] for a, b in zip(start[other].tolist(), end[other].tolist(), strict=True)])
            size[other] = sizes
            at[other] = self.ids.n + np.cumsum(size[other]) - size[other]
            ids = np.concatenate((ids[: self.ids.n], more))
        return gathered(ids, at, size), size


def per_document(start: np.ndarray, size: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bounds of each document's ids, given the units' starts and numbers of ids."""
    return np.concatenate(([0], np.cumsum(size)))[np.searchsorted(start, offsets)]
