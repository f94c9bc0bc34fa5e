"""Secret scans: fixed formats, and a linear-chain conditional random field.

The base finds assignments, access keys and long hexadecimal runs by pattern. The
field tags every word of a text as beginning, being inside or outside a secret from
its shape (length, digits, case, signs, a key word in it), the words on both sides, and
a key word up to ``BACK`` words before, and how much of the file looks like settings. It is trained by maximum likelihood on
windows around the base finds and around unremarkable words of about ``SAMPLE``
documents, chosen by hash, where the field sees shapes and neighbours but
not the patterns. As all these finds are the base's own, each is written anew as well (``rewritten``): after the
phrases ``LEADS`` with values of random letters and digits, as no base format takes them, and, to be left alone, plain words
after the same phrases and random values (names of files, places, dates, numbers) after none. Decoding is by Viterbi; words whose score for "outside" exceeds the
others by more than any change of transitions could make up are outside on
every best path, so only the stretches between them are decoded.

Tagged spans that touch no base span are added as kind ``crf``, without quotes and commas around them, if they
have at least ``SHORTEST`` characters and are not of digits alone; a tagged plain word is added too. Null or empty text
has no secrets. Rows are scanned alone, repeated rows and null ids too; an empty table gives no rows; a very long text
is a slice of its own; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import kernel

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KEY_WORD = re.compile(rb"pass|pwd|secret|token|key|auth|credential|bearer", re.IGNORECASE)
#: Documents to learn from, words on each side of a window's middle, windows in all.
SAMPLE, AROUND, WINDOWS = 4000, 6, 6000
#: Words back to a key word; characters of an added secret; rewritten windows of each kind.
BACK, SHORTEST, REWRITTEN = 4, 8, 2000
LEADS = ("password is", "the password is", "secret key is", "token is", "api key:", "auth", "Authorization: Bearer", "bearer", "credentials are", "pwd:", "login secret", "key", "token", "secret", "password", "use the key")
PLAIN = ("https://example.com/{0}/page", "/usr/share/{0}/file.txt", "{1}-{2}-{3}", "v{1}.{2}.{3}", "{4}", "{4}{4}", "Report_{1}.pdf", "#{1}{2}", "{5}", "{0}_{0}", "{1}:{2}:{3}", "({1})", "Internationalisation", "re-establishing", "state-of-the-art", "{0}.{0}()")
WORDS = ("required", "changed", "expired", "necessary", "important,", "for", "the", "of", "which", "management", "authentication", "administrator.", "different", "ceremony", "holder", "ring", "generation", "invalid")
HEX = np.zeros(256, bool)
HEX[[*range(48, 58), *range(97, 103)]] = True
_CLASS = np.zeros(256, np.uint8)  # 1 digit, 2 lower case, 3 upper case, 4 sign, 5 other
_CLASS[33:127] = 4
_CLASS[48:58], _CLASS[97:123], _CLASS[65:91], _CLASS[128:] = 1, 2, 3, 5
OWN, SIDE, FILE = 6 * 4 * 4 * 2, 3 * 2 * 3, 3
STATES = 3  # outside, begin, inside
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_crf long, spans array<struct<kind:string,start:long,end:long>>"
_OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])


def base_spans(data: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base finds in some text, in bytes."""
    raw = data.tobytes()
    out = []
    if b"=" in raw or b":" in raw:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = HEX[data]
    edge = np.flatnonzero(np.diff(inside))
    start, end = edge[::2], edge[1::2]
    long = end - start >= 24
    out += [(s, e, 2) for s, e in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return sorted(out, key=lambda x: (x[0], x[2]))


class Features(NamedTuple):
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    file: np.ndarray


def features(w: kernel.Words) -> Features:
    """Numbers of the features of every word."""
    n = len(w.start)
    kinds = _CLASS[w.data]
    sums = [np.concatenate(([0], np.cumsum(kinds == k))) for k in (1, 2, 3, 4)]
    digits, lower, upper, signs = (s[w.end] - s[w.start] for s in sums)
    length = w.end - w.start
    size = np.searchsorted([6, 12, 20, 32, 48], length, side="right")
    share = np.where(digits == 0, 0, np.where(4 * digits < length, 1, np.where(2 * digits < length, 2, 3)))
    case = np.where(upper == 0, 0, np.where(lower == 0, 1, np.where(upper == 1, 2, 3)))
    key = np.zeros(n, bool)
    near = np.zeros(n, bool)
    for m in KEY_WORD.finditer(w.data.tobytes()):
        at = int(np.searchsorted(w.start, m.start(), side="right")) - 1
        if at >= 0:
            key[at] = True
    own = ((size * 4 + share) * 4 + case) * 2 + key
    last = w.data[w.end - 1] if n else np.zeros(0, np.uint8)
    mark = np.where(np.isin(last, [58, 61]), 2, np.where(np.isin(w.data[w.start] if n else last, [34, 39, 60]), 1, 0))
    side = (mark * 2 + key) * 3 + np.minimum(2, np.maximum(0, size - 1))
    doc = w.doc
    before, after = np.full(n, 2 * SIDE), np.full(n, SIDE)
    for back in range(1, min(BACK, n - 1) + 1):
        near[back:] |= key[:-back] & (doc[back:] == doc[:-back])
    if n:
        same = doc[1:] == doc[:-1]
        before[1:][same] = side[:-1][same] + SIDE * near[1:][same]
        after[:-1][same] = side[1:][same]
    set_like = np.bincount(doc, weights=(mark == 2) | (signs * 3 > length), minlength=len(w.bounds) - 1)
    words = np.maximum(1, np.diff(w.bounds))
    file = np.where(set_like * 10 > words, 2, np.where(set_like * 50 > words, 1, 0))[doc]
    return Features(own.astype(np.int32), before.astype(np.int32), after.astype(np.int32), file.astype(np.int32))


def labels(w: kernel.Words, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Tags of the words of secrets: the value of an assignment, else the whole find."""
    out = np.zeros(len(w.start), np.int8)
    raw = w.data.tobytes()
    for s, e, kind in spans:
        if kind == 0:
            m = ASSIGN.match(raw, s)
            s, e = (m.start(2), m.end(2)) if m else (s, e)
        a, b = int(np.searchsorted(w.end, s, side="right")), int(np.searchsorted(w.start, e, side="left"))
        for i in range(a, b):
            out[i] = max(out[i], 2) if i > a and out[i] == 0 else 1 if out[i] == 0 else out[i]
    return out


class Field(NamedTuple):
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    file: np.ndarray
    turn: np.ndarray  #: transitions; the chain begins after "outside"

    def scores(self, f: Features) -> np.ndarray:
        return self.own[f.own] + self.before[f.before] + self.after[f.after] + self.file[f.file]


#: "inside" does not follow "outside".
_BARRED = np.array([[0, 0, -1e4], [0, 0, 0], [0, 0, 0]])


def train(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.2, penalty: float = 1e-4) -> Field:
    """Maximum likelihood on windows: x has four feature numbers a word (own < 0: no word), y the tags."""
    sizes = (OWN, 2 * SIDE + 1, SIDE + 1, FILE)
    w = [np.zeros((s, STATES)) for s in sizes] + [np.zeros((STATES, STATES))]
    # a start that holds most words to be outside
    w[0][:, 0] = 1.0
    n, t = y.shape
    if n == 0:
        w[0][:, 0] = 50.0
        return Field(*w)
    there = x[:, :, 0] >= 0
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    for step in range(1, rounds + 1):
        s = sum(w[k][np.maximum(0, x[:, :, k])] for k in range(4))
        turn = w[4] + _BARRED
        forward = np.empty((n, t, STATES))
        a = turn[0] + s[:, 0]
        a = np.where(there[:, 0, None], a, np.array([0, -1e4, -1e4]))
        forward[:, 0] = a
        for i in range(1, t):
            b = np.logaddexp.reduce(a[:, :, None] + turn[None], axis=1) + s[:, i]
            a = np.where(there[:, i, None], b, a)
            forward[:, i] = a
        total = np.logaddexp.reduce(a, axis=1)
        grad = [np.zeros_like(p) for p in w]
        back = np.zeros((n, STATES))
        for i in range(t - 1, -1, -1):
            on = there[:, i]
            p = np.exp(forward[:, i] + back - total[:, None])
            p[np.arange(n), y[:, i]] -= 1
            p[~on] = 0
            for k in range(4):
                np.subtract.at(grad[k], np.maximum(0, x[:, i, k]), p)
            before = forward[:, i - 1] if i else np.tile(np.array([0, -1e4, -1e4]), (n, 1))
            pair = np.exp(before[:, :, None] + turn[None] + (s[:, i] + back)[:, None, :] - total[:, None, None])
            pair[np.arange(n), y[:, i - 1] if i else 0, y[:, i]] -= 1
            grad[4] -= pair[on].sum(0)
            step_back = np.logaddexp.reduce(turn[None] + (s[:, i] + back)[:, None, :], axis=2)
            back = np.where(on[:, None], step_back, back)
        for k, p in enumerate(w):
            g = grad[k] / n - penalty * p
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Field(*w)


def viterbi(s: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Best tags of a stretch that stands after and before "outside"."""
    turn = turn + _BARRED
    a, back = turn[0] + s[0], []
    for row in s[1:]:
        each = a[:, None] + turn
        back.append(each.argmax(0))
        a = each.max(0) + row
    a = a + turn[:, 0]
    out = [int(a.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return np.array(out[::-1])


def tag(w: kernel.Words, field: Field) -> np.ndarray:
    """Tags of all words."""
    tags = np.zeros(len(w.start), np.int8)
    if not len(w.start):
        return tags
    s = field.scores(features(w))
    swing = 2 * (field.turn.max() - field.turn.min())
    open_at = np.flatnonzero(s[:, 0] - s[:, 1:].max(1) <= swing)
    if not len(open_at):
        return tags
    doc = w.doc
    cut = np.flatnonzero((np.diff(open_at) > 1) | (np.diff(doc[open_at]) > 0)) + 1
    for run in np.split(open_at, cut):
        tags[run] = viterbi(s[run], field.turn)
    return tags


def _slices(texts: pa.Array) -> Iterator[tuple[int, kernel.Words, np.ndarray]]:
    data, offsets = kernel.strings(texts)
    for a, b in kernel.slices(offsets):
        own = offsets[a : b + 1] - offsets[a]
        yield a, kernel.words(data[offsets[a] : offsets[b]], own), own


def learn(docs: DataFrame, sample: int = SAMPLE) -> Field:
    n = docs.count()
    width = 2 * AROUND + 1
    rows = docs.select(F.xxhash64("doc_id", "text").alias("h"), F.col("text").cast("string").alias("text")).filter(F.pmod("h", F.lit(max(1, n // sample))) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, w, own in _slices(batch.column("text")):
                if not len(w.start):
                    continue
                f, y = np.stack(features(w), 1).astype(np.int16), labels(w, _within(w.data, own))
                doc, rank = w.doc, kernel.mix(w.hash + np.arange(len(w.hash), dtype=np.uint64))
                found = np.flatnonzero(y == 1)
                other = np.flatnonzero((y == 0) & (rank % np.uint64(400) == 0))
                numeric = np.flatnonzero((y == 0) & (f[:, 0] // 8 % 4 > 0))
                for i in np.unique(np.concatenate((found, other, numeric))):
                    at = np.arange(i - AROUND, i + AROUND + 1)
                    inside = (at >= 0) & (at < len(doc))
                    inside[inside] = doc[at[inside]] == doc[i]
                    x, t = np.full((width, 4), -1, np.int16), np.zeros(width, np.int8)
                    x[inside], t[inside] = f[at[inside]], y[at[inside]]
                    sides = [at[inside & (at < i)], at[inside & (at > i)]]
                    plain = y[i] == 0 and not t.any() and (w.end - w.start)[at[inside]].max() <= 64
                    words = [b"\0".join(w.data[w.start[j] : w.end[j]].tobytes() for j in side) for side in sides] if plain else [None, None]
                    out.append((x.tobytes() + t.tobytes(), int(y[i] == 1), int(rank[i].view(np.int64)), *words))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["x", "positive", "rank", "before", "after"])

    windows = rows.select("text").mapInArrow(run, "x binary, positive int, rank long, before binary, after binary").distinct()
    got, around = [], []
    for side in (1, 0):
        for r in windows.filter(F.col("positive") == side).orderBy("rank", "x", "before", "after").limit(WINDOWS // 2).select("x", "before", "after").collect():
            got.append(bytes(r.x))
            if r.before is not None:
                around.append((bytes(r.before).split(b"\0") if r.before else [], bytes(r.after).split(b"\0") if r.after else []))
    x = np.array([np.frombuffer(g[: width * 8], np.int16).reshape(width, 4) for g in got], np.int64).reshape(-1, width, 4)
    y = np.array([np.frombuffer(g[width * 8 :], np.int8) for g in got], np.int64).reshape(-1, width)
    more_x, more_y = rewritten(around)
    return train(np.concatenate((x, more_x)), np.concatenate((y, more_y)))


def _value(rng: np.random.Generator) -> str:
    """A random secret that no base format takes."""
    kind, size = int(rng.integers(5)), int(rng.integers(16, 49))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    both = letters + letters.lower() + "0123456789"
    alphabet = (both, letters + "0123456789", both + "-_", both + "+/", both + "!@$%^&*")[kind]
    out = "".join(rng.choice(list(alphabet), size=size if kind < 4 else size // 2))
    return ("", "", "sk_", "ghp_", "")[int(rng.integers(5))] + out[:-2] + "7a"


def rewritten(windows: list[tuple[list[bytes], list[bytes]]], n: int = REWRITTEN, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows (features, tags) with secrets in other writings, and with what only looks like them, between given words before and after."""
    rng, width = np.random.default_rng(seed), 2 * AROUND + 1
    x, y = np.full((2 * n, width, 4), -1, np.int64), np.zeros((2 * n, width), np.int64)
    if not windows:
        return x[:0], y[:0]
    for i in range(2 * n):
        before, after = windows[int(rng.integers(len(windows)))]
        lead, secret = LEADS[int(rng.integers(len(LEADS)))].encode(), i < n
        if secret:
            middle = _value(rng).encode()
            quote = (b"", b"", b'"', b"'")[int(rng.integers(4))]
            middle = quote + middle + quote + (b"", b"", b".", b",")[int(rng.integers(4))]
        elif rng.integers(2):
            middle = WORDS[int(rng.integers(len(WORDS)))].encode()
        else:
            number = [int(v) for v in rng.integers(0, 3000, 3)]
            form = PLAIN[int(rng.integers(len(PLAIN)))]
            lead, middle = b"", form.format("".join(rng.choice(list("abcdefghijklmnop"), size=int(rng.integers(4, 12)))), *number, int(rng.integers(10**9, 10**16)), ("Example", "COMPANY", "iPhone", "McDonald")[int(rng.integers(4))]).encode()
        parts = [*before, *lead.split(), middle, *after]
        at = len(before) + len(lead.split())
        raw = np.frombuffer(b" ".join(parts), np.uint8)
        f = np.stack(features(kernel.words(raw, np.array([0, len(raw)]))), 1)
        places = np.arange(at - AROUND, at + AROUND + 1)
        inside = (places >= 0) & (places < len(parts))
        x[i][inside] = f[places[inside]]
        if secret:
            y[i, AROUND] = 1
    return x, y


def _within(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """Base finds of some texts, each text by itself."""
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b > a:
            out += [(s + a, e + a, k) for s, e, k in base_spans(data[a:b])]
    return out


_QUOTES = b"\"'`<>()[]{},.;:"


def _trimmed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without quotes and commas around them; those that are too short or of digits alone are left out."""
    out = []
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        raw = data[s:e].tobytes()
        head = len(raw) - len(raw.lstrip(_QUOTES))
        raw = raw.strip(_QUOTES)
        if len(raw) >= SHORTEST and not raw.isdigit():
            out.append((s + head, s + head + len(raw)))
    out = np.array(out, np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """One row per document: numbers of finds by kind and all spans in code points, end exclusive."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_field = sent.value
        for batch in batches:
            ids = batch.column("doc_id")
            for a, w, own in _slices(batch.column("text")):
                spans = [np.array(x) for x in zip(*_within(w.data, own), strict=True)] or [np.zeros(0, np.int64)] * 3
                tags = tag(w, own_field)
                start = np.flatnonzero(tags == 1)
                stop = start + 1
                for i in range(len(start)):
                    while stop[i] < len(tags) and tags[stop[i]] == 2:
                        stop[i] += 1
                s, e = w.start[start], w.end[stop - 1] if len(start) else w.end[:0]
                s, e = _trimmed(w.data, s, e)
                if len(s) and len(spans[0]):
                    order = np.argsort(spans[0], kind="stable")
                    reach = np.maximum.accumulate(spans[1][order])
                    k = np.searchsorted(spans[0][order], e, side="left") - 1
                    free = (k < 0) | (reach[np.maximum(k, 0)] <= s)
                    s, e = s[free], e[free]
                all_s, all_e = np.concatenate((spans[0], s)).astype(np.int64), np.concatenate((spans[1], e)).astype(np.int64)
                kind = np.concatenate((spans[2], np.full(len(s), 3))).astype(np.int64)
                order = np.lexsort((kind, all_s))
                all_s, all_e, kind = all_s[order], all_e[order], kind[order]
                lead = np.concatenate(([0], np.cumsum((w.data & 0xC0) != 0x80)))
                doc = np.searchsorted(own, all_s, side="right") - 1
                base = lead[own[doc]] if len(doc) else all_s
                places = pa.StructArray.from_arrays([pa.array([KINDS[k] for k in kind], pa.string()), pa.array(lead[all_s] - base), pa.array(lead[all_e] - base)], names=["kind", "start", "end"])
                n = len(own) - 1
                bounds = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
                counts = [np.bincount(doc[kind == k], minlength=n).astype(np.int64) for k in range(4)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, n), *map(pa.array, counts), pa.ListArray.from_arrays(pa.array(bounds), places)], schema=_OUT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def joined(spans, kinds: tuple[str, ...] | None = None):
    """Spans as kind:start:end, joined by commas."""
    if kinds is not None:
        spans = F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, learn(docs))
    base = F.sha2(joined(F.col("spans"), KINDS[:3]).cast("binary"), 256)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", base.alias("base_sha256"), joined(F.col("spans")).alias("spans"), "n_crf")


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """(n_assign, n_access, n_hex, base_sha256) of one text."""
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    finds = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    finds += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    finds += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    base = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(finds))
    return *(sum(k == j for _, k, _ in finds) for j in range(3)), hashlib.sha256(base.encode()).hexdigest()
