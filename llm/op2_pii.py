"""Personal data by candidate gradient boosting, in DataFrame and SQL functions.

The base spans follow fixed formats and checks. Beside them, wide generators propose
spans that may overlap: digit groups like telephone numbers or cards, hexadecimal
groups and dotted numbers like addresses, and written-out e-mail addresses. Boosted
regression trees score each from its format and the words before it, and spans
over a calibrated threshold that touch no base span are added; of added ones that
overlap the higher score stays.

Training takes all documents; those without a sign of a candidate or a base find have nothing to count. Base finds are written
anew in ways the base's formats miss (``disguised``: an e-mail address with "[at]" and "dot", a
telephone number without its plus sign, a card with other signs between its groups, an address of
eight groups or with its dots in brackets), ``VARIANTS`` times each; of the candidates in these texts
that touch no base span, as in use, those on a rewritten find are positive and all others negative. Some
writings are spoiled, and negative too: plain words around "at" and "dot", hardware addresses of six and of eight pairs, times, addresses
of seven groups or with a part above 255, another check digit, nine digits. They are counted by feature cell in SQL, a fifth of the texts
apart for calibration. Trees are grown on the driver from the cells, a few thousand rows,
and become one SQL expression. Each kind's threshold is the least score at which the
texts not used in growing (all, if these hold under ``ENOUGH`` positives) reach the precision ``PRECISION``, and 0 at least;
a kind that can't reach it, or has no base find to learn from, adds nothing.

Patterns use possessive groups, which Java matches without recursion, and look back
only where a run begins, so one very long word or number costs no more than its length.
Null or empty text has no spans. Rows are scanned alone, repeated rows and null ids too; an empty
table gives no rows; other columns are ignored, whatever their names. Spans are compared in blocks of
``BLOCK``, so a very long text costs little more than its length.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@|\x20?[\[({](?:at|AT)[\])}]\x20?|\x20(?:at|AT)\x20)[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[({](?:dot|DOT)[\])}]\x20?|\x20(?:dot|DOT)\x20)[A-Za-z0-9-]{1,63}+){1,6}+",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}+(?::[0-9]{1,5}+)?+|[0-9]{1,3}+(?:\[\.\][0-9]{1,3}+){3}+|(?:[0-9A-Fa-f]{1,4}+:){3,7}+[0-9A-Fa-f]{1,4}+)(?![0-9A-Fa-f])",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9(])[(]?[0-9](?:[\x20()./-]{0,2}[0-9]){6,14}+(?![0-9])",
}
#: Cheap conditions without which a pattern can't match.
NEEDS = {"email": "(?:@|[\\[({](?:at|AT)[\\])}]|\\x20(?:dot|DOT)\\x20)", "ip": "(?:[0-9]\\.[0-9]|[0-9]\\[\\.\\][0-9]|[0-9A-Fa-f]:[0-9A-Fa-f])", "card": "[0-9][\\x20./-]?[0-9]", "phone": "[0-9][\\x20()./-]{0,2}[0-9]"}
CONTEXT = {
    1: r"(?i)(?:tel|phone|call|mobile|fax|cell|whatsapp)",
    2: r"(?i)(?:card|visa|master|amex|credit|debit|iban|account)",
    3: r"(?i)(?:\bip\b|host|server|addr|ping)",
    4: r"(?i)(?:mail|contact|write|reach)",
    5: r"(?i)(?:order|invoice|version|isbn|id\b|no\.|ref|date|page|room)",
}
FEATURES = ("digits", "groups", "signs", "parens", "context", "glued", "first", "last", "check")
TREES, RATE, PRECISION, LEAST, ENOUGH = 30, 0.3, 0.97, 5.0, 20.0
#: Ways in which each document with base finds is rewritten; spans to a block, and blocks to a group of them.
VARIANTS, BLOCK = 8, 64
_SPANS = "array<struct<start:int,end:int,value:string,before:string>>"


def _bound(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _cut(items: Column) -> Column:
    """Runs of BLOCK items."""
    return F.transform(F.sequence(F.lit(0), F.size(items) - 1, F.lit(BLOCK)), lambda i: F.slice(items, i + 1, BLOCK))


def _spans(text: Column, found: Column, pattern: str) -> Column:
    """Places of all matches, from the texts between them: array of (start, end, value, before), ``before`` at most 24 characters.

    What an aggregate has gathered is copied at each step, so matches are counted through in blocks, from where each block begins.
    """
    empty = F.expr(f"cast(array() as {_SPANS})")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["value"])
        span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), F.right(x["piece"], F.lit(24)).alias("before"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def placed(z: Column) -> Column:
        own = lambda block, i: F.aggregate(block, F.struct(F.get(z["begin"], i).alias("at"), empty.alias("out")), step, lambda o: o["out"])
        return F.flatten(F.transform(z["blocks"], own))

    def begun(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + F.length(x["piece"]) + F.length(x["value"])))
        begin = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return _bound(F.struct(blocks.alias("blocks"), begin.alias("begin")), placed)

    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda p, v: F.struct(p.alias("piece"), v.alias("value")))
    return F.when(F.size(found) > 0, _bound(_bound(pairs, _cut), begun)).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def worth(i: Column) -> Column:
        d = F.substring(digits, i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


#: A number of at most 255, with any zeros before it.
_BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.when(F.length(F.regexp_replace(p, "^0+", "")) <= 3, F.concat(F.lit("0"), F.regexp_replace(p, "^0+", "")).cast("int")), F.lit(999)) <= 255)
    if kind == "card":
        return (n >= 14) & (n <= 19) & _luhn(value)
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def _features(kind: str, span: Column) -> Column:
    """Small numbers for the format of a candidate and the words before it."""
    value, digits, before = span["value"], _digits(span["value"]), span["before"]
    groups = F.filter(F.split(value, "[^0-9A-Za-z]+"), lambda g: g != "")
    signs = F.array_distinct(F.split(F.regexp_replace(value, "[0-9A-Za-z()]", ""), ""))
    signs = F.filter(signs, lambda s: s != "")
    context = F.lit(0)
    for k, pattern in reversed(CONTEXT.items()):
        context = F.when(before.rlike(pattern), k).otherwise(context)
    return F.struct(
        F.least(F.length(digits), F.lit(20)).alias("digits"),
        F.least(F.size(groups), F.lit(8)).alias("groups"),
        F.when(F.size(signs) == 0, 0).when(F.size(signs) > 1, 5).when(F.array_contains(signs, " "), 1).when(F.array_contains(signs, "-"), 2).when(F.array_contains(signs, "."), 3).otherwise(4).alias("signs"),
        F.when(F.contains(value, F.lit("(")), 1).otherwise(0).alias("parens"),
        context.cast("int").alias("context"),
        F.when(before.rlike("[0-9A-Za-z_.:-]$"), 1).otherwise(0).alias("glued"),
        F.least(F.length(F.coalesce(F.get(groups, F.lit(0)), F.lit(""))), F.lit(8)).alias("first"),
        F.least(F.length(F.coalesce(F.element_at(groups, -1), F.lit(""))), F.lit(8)).alias("last"),
        (F.when(_luhn(value), 1).otherwise(0) if kind == "card" else F.lit(0)).alias("check"),
    )


def _found(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, text, and per kind the base spans (b_) and the candidates (w_)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(None)
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), held.alias("kept"))
    none = F.expr("cast(array() as array<string>)")
    need = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+")), "ip": F.col("text").rlike(r"[0-9]\.[0-9]"), "card": F.col("text").rlike(r"[0-9][\x20-]?[0-9]")}
    base = {k: BASE[k] if k != "card" else r"[0-9](?:[\x20-]?[0-9]){13,}+" for k in KINDS}
    df = df.select("*", *(F.when(need[k], F.regexp_extract_all("text", F.lit(base[k]), F.lit(0))).otherwise(none).alias(f"m_{k}") for k in KINDS), *(F.when(F.col("text").rlike(NEEDS[k]), F.regexp_extract_all("text", F.lit(WIDE[k]), F.lit(0))).otherwise(none).alias(f"c_{k}") for k in KINDS))
    df = df.select("doc_id", "text", "kept", *(_spans(F.col("text"), F.col(f"m_{k}"), base[k]).alias(f"s_{k}") for k in KINDS), *(_spans(F.col("text"), F.col(f"c_{k}"), WIDE[k]).alias(f"w_{k}") for k in KINDS))
    return df.select("doc_id", "text", "kept", *(F.filter(f"s_{k}", _of(k, lambda kind, s: _valid(kind, s["value"]))).alias(f"b_{k}") for k in KINDS), *(f"w_{k}" for k in KINDS))


def _of(kind, f):
    """A function of one column for ``kind``; Spark counts a function's parameters."""
    return lambda s: f(kind, s)


_OWN = "array<struct<low:int,high:int,own:array<struct<start:int,end:int,kind:string>>>>"


def _grouped(items: Column, empty: str, of) -> Column:
    """Runs of BLOCK items with the least start and the greatest end in each."""

    def group(i: Column) -> Column:
        own = F.slice(items, i + 1, BLOCK)
        low, high, kept = of
        return F.struct(F.array_min(F.transform(own, low)).alias("low"), F.array_max(F.transform(own, high)).alias("high"), F.transform(own, kept).alias("own"))

    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.size(items) - 1, F.lit(BLOCK)), group)).otherwise(F.expr(f"cast(array() as {empty})"))


def _blocks(spans: Column) -> Column:
    """Spans in order of start, in blocks and groups of blocks with their least start and greatest end."""
    blocks = _grouped(spans, _OWN, (lambda b: b["start"], lambda b: b["end"], lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["kind"].alias("kind"))))
    # bound first, so that the blocks are made once
    return F.get(F.transform(F.array(blocks), lambda own: _grouped(own, f"array<struct<low:int,high:int,own:{_OWN}>>", (lambda b: b["low"], lambda b: b["high"], lambda b: b))), F.lit(0))


def _touches(groups: Column, s: Column, kind: str | None = None) -> Column:
    """Whether a span meets one of those in the groups (of ``kind``)."""
    near = lambda b: (b["low"] < s["end"]) & (s["start"] < b["high"])
    meets = lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]) & (F.lit(True) if kind is None else b["kind"] == kind)
    return F.exists(groups, lambda g: near(g) & F.exists(g["own"], lambda b: near(b) & F.exists(b["own"], meets)))


#: Ways of each kind that are spoiled.
SPOILED = {"email": (4, 5, 6, 7), "ip": (3, 4, 5, 6, 7), "card": (2, 3, 6, 7), "phone": (3, 7)}


def _disguise(kind: Column, value: Column, way: Column) -> Column:
    """A base find in another writing."""
    # half of the addresses without digits, and half of the bracketed ones with a plain name and host, else digits or dots alone would tell
    some = F.pmod(F.crc32(value.cast("binary")), F.lit(4))
    lettered = F.when(some <= 1, F.translate(value, "0123456789", "abcdefghij")).otherwise(value)
    name, host, digits = F.substring_index(lettered, "@", 1), F.substring_index(lettered, "@", -1), _digits(value)
    plainly = (F.pmod(some, F.lit(2)) == 0) & (way != 2) & (F.regexp_replace(name, "[^A-Za-z0-9]", "") != "")
    name, host = F.when(plainly, F.regexp_replace(name, "[^A-Za-z0-9]", "")).otherwise(name), F.when(plainly, F.substring_index(host, ".", -2)).otherwise(host)
    dotted = lambda at, dot: F.concat(name, F.lit(at), F.replace(host, F.lit("."), F.lit(dot)))
    bare = F.substring(value, F.lit(2), F.length(value))
    plain = lambda v, other: F.when(F.regexp_replace(v, "[^A-Za-z]", "") == "", F.lit(other)).otherwise(F.substring(F.regexp_replace(v, "[^A-Za-z]", ""), 1, 12))
    place = F.when(F.pmod(way, F.lit(2)) == 0, plain(F.substring_index(host, ".", 1), "home")).otherwise(F.right(F.concat(F.lit("10"), _digits(value)), F.lit(2)))
    words = F.concat(plain(name, "meet"), F.lit(" at "), place, F.lit(" dot "), plain(F.substring_index(host, ".", -1), "com"))
    email = F.when(way == 0, dotted(" [at] ", " [dot] ")).when(way == 1, dotted("(at)", "(dot)")).when(way == 2, dotted(" at ", " dot ")).when(way == 3, dotted("[at]", ".")).otherwise(words)
    part = F.transform(F.split(value, r"\."), lambda p: F.right(p, F.lit(3)).cast("int"))
    pair = lambda i: F.lower(F.lpad(F.hex(F.get(part, F.lit(i))), 2, "0"))
    two = lambda i, top: F.lpad(F.pmod(F.get(part, F.lit(i)), F.lit(top)).cast("string"), 2, "0")
    pairs = F.concat_ws(":", *(pair(i) for i in range(4)))
    short = F.concat_ws(":", *(F.lower(F.hex(F.get(part, F.lit(i)) * 77 + 1)) for i in range(4)))
    ip = F.when(way == 0, F.replace(value, F.lit("."), F.lit("[.]"))).when(way == 1, F.concat(F.lit("2001:db8:"), F.translate(value, ".", ":"), F.lit(":0:1"))).when(way == 2, F.concat(F.lit("fe80:0:0:0:"), short))
    ip = ip.when(way == 3, F.concat(pairs, F.lit(":"), pair(1), F.lit(":"), pair(2))).when(way == 4, F.concat_ws(":", two(0, 24), two(1, 60), two(2, 60), two(3, 60))).when(way == 5, F.concat(F.lit("2001:db8:"), F.translate(value, ".", ":"), F.lit(":1")))
    ip = ip.when(way == 6, F.concat(pairs, F.lit(":"), pairs)).otherwise(F.concat_ws(".", *((F.get(part, F.lit(i)) + 256 * (i > 1)).cast("string") for i in range(4))))
    way = F.pmod(way, F.lit(4))
    phone = F.when(way == 0, bare).when(way == 1, F.regexp_replace(bare, r"^[0-9]{1,3}\x20", "")).when(way == 2, F.regexp_replace(F.regexp_replace(bare, "[()]", ""), r"[\x20-]+", ".")).otherwise(F.regexp_extract(bare, "^(?:[^0-9]*[0-9]){9}", 0))
    spoiled = F.concat(F.left(digits, F.length(digits) - 1), F.pmod(F.right(digits, F.lit(1)).cast("int") + 1, F.lit(10)).cast("string"))
    grouped = lambda of, sign: F.regexp_replace(of, "([0-9]{4})(?=[0-9])", "$1" + sign)
    card = F.when(way == 0, grouped(digits, ".")).when(way == 1, grouped(digits, "/")).when(way == 2, grouped(spoiled, "/")).otherwise(grouped(spoiled, "."))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).otherwise(phone)


def disguised(text: Column, spans: Column, way: Column) -> Column:
    """(text, truth): text with base spans, in order of start, in other writings, and their new places; of spans that overlap, the first."""
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:string>>)")
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"), F.lit(0).alias("long"), none.alias("truth"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        own = F.pmod(F.hash(s["value"]) + way, F.lit(VARIANTS))
        put = _disguise(s["kind"], s["value"], own)
        wrong = reduce(lambda a, b: a | b, ((s["kind"] == k) & own.isin(*ways) for k, ways in SPOILED.items()))
        kind = F.when(wrong, F.lit("spoiled")).otherwise(s["kind"])
        start = acc["long"] + F.length(piece)
        place = F.struct(start.alias("start"), (start + F.length(put)).alias("end"), kind.alias("kind"))
        done = F.struct(s["end"].alias("at"), F.concat(acc["text"], piece, put).alias("text"), place["end"].alias("long"), F.concat(acc["truth"], F.array(place)).alias("truth"))
        return F.when(s["start"] < acc["at"], acc).otherwise(done)

    return F.aggregate(spans, first, step, lambda acc: F.struct(F.concat(acc["text"], F.substring(text, acc["at"] + 1, F.length(text))).alias("text"), acc["truth"].alias("truth")))


class Tree(NamedTuple):
    feature: int
    at: float
    low: Tree | float
    high: Tree | float


class Boosted(NamedTuple):
    start: float
    trees: list[Tree]
    threshold: float


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> Tree | float:
    """A regression tree on the loss's slopes and curvatures of cells."""
    leaf = -g.sum() / (h.sum() + 1.0)
    if depth == 0 or len(x) < 2:
        return float(leaf)
    best = (g.sum() ** 2 / (h.sum() + 1.0) + 1e-6, None)
    for f in range(x.shape[1]):
        for at in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= at
            gain = sum(g[m].sum() ** 2 / (h[m].sum() + 1.0) for m in (low, ~low))
            if gain > best[0]:
                best = (gain, (f, float(at)))
    if best[1] is None:
        return float(leaf)
    f, at = best[1]
    low = x[:, f] <= at
    return Tree(f, at, _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1))


def _value(tree: Tree | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, Tree):
        return np.full(len(x), tree)
    return np.where(x[:, tree.feature] <= tree.at, _value(tree.low, x), _value(tree.high, x))


def boost(x: np.ndarray, positive: np.ndarray, total: np.ndarray, held: np.ndarray, trees: int = TREES, precision: float = PRECISION) -> Boosted:
    """Boosted trees on cells: features, positives and all candidates of each, and which only calibrate."""
    fit = ~held
    if not len(x) or not positive[fit].sum() or positive[fit].sum() == total[fit].sum():  # nothing to tell apart
        return Boosted(-20.0, [], np.inf)
    rate = positive[fit].sum() / total[fit].sum()
    start = float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))
    score, grown = np.full(len(x), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x[fit], (total * p - positive)[fit], (total * p * (1 - p))[fit], 3)
        grown.append(tree)
        score = score + RATE * _value(tree, x)
    use = held if positive[held].sum() >= ENOUGH else np.ones(len(x), bool)
    order = np.argsort(-score[use], kind="stable")
    right, all_ = np.cumsum(positive[use][order]), np.cumsum(total[use][order])
    good = np.flatnonzero((right / np.maximum(all_, 1) >= precision) & (right >= LEAST))
    # a span that is rather none is never added, however few of its like would spoil the precision
    return Boosted(start, grown, max(0.0, float(score[use][order][good[-1]])) if len(good) else np.inf)


def _sql(tree: Tree | float, feature) -> Column:
    if not isinstance(tree, Tree):
        return F.lit(float(tree))
    return F.when(feature(FEATURES[tree.feature]) <= tree.at, _sql(tree.low, feature)).otherwise(_sql(tree.high, feature))


def learn(docs: DataFrame) -> dict[str, Boosted]:
    # a text without these has neither a candidate nor a base find
    signs = [F.col("text").cast("string").rlike(p) for p in (*NEEDS.values(), r"\+[0-9]")]
    some = docs.filter(reduce(lambda a, b: a | b, signs))
    whole = F.array_sort(F.flatten(F.array(*(F.transform(f"b_{k}", _of(k, lambda kind, s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))) for k in KINDS))))
    ways = _found(some).select("doc_id", "text", whole.alias("base")).withColumn("way", F.explode(F.when(F.size("base") > 0, F.sequence(F.lit(0), F.lit(VARIANTS - 1))).otherwise(F.array(F.lit(0)))))
    hidden = ways.select("doc_id", F.xxhash64("text").alias("of"), disguised(F.col("text"), F.col("base"), F.col("way")).alias("d")).select("doc_id", "of", "d.text", "d.truth")
    found = _found(hidden, ["of", "truth"])
    base = F.array_sort(F.flatten(F.array(*(F.transform(f"b_{k}", _of(k, lambda kind, s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))) for k in KINDS))))
    found = found.select("*", _blocks(base).alias("blocks"), _blocks(F.col("kept.truth")).alias("truths"))
    free = [F.filter(f"w_{k}", lambda s: ~_touches(F.col("blocks"), s)) for k in KINDS]
    every = F.flatten(F.array(*(F.transform(c, _of(k, lambda kind, s: F.struct(F.lit(kind).alias("kind"), _features(kind, s).alias("x"), _touches(F.col("truths"), s, kind).cast("int").alias("y")))) for k, c in zip(KINDS, free, strict=True))))
    cells = found.select(F.explode(every).alias("c"), (F.pmod("kept.of", F.lit(5)) == 4).alias("held")).groupBy("held", "c.kind", *(F.col(f"c.x.{f}").alias(f) for f in FEATURES)).agg(F.sum("c.y").alias("positive"), F.count("*").alias("total")).orderBy("kind", "held", *FEATURES).collect()
    out = {}
    for k in KINDS:
        own = [r for r in cells if r.kind == k]
        x = np.array([[r[f] for f in FEATURES] for r in own], float).reshape(-1, len(FEATURES))
        out[k] = boost(x, np.array([r.positive for r in own], float), np.array([r.total for r in own], float), np.array([r.held for r in own], bool))
    return out


def find(docs: DataFrame, model: dict[str, Boosted], keep: list[str] | None = None) -> DataFrame:
    """doc_id, text, base and added spans: arrays of (start, rank, end, kind, score) in order of start, then kind.

    keep: columns of ``docs`` that come along as the struct ``kept``.
    """
    found = _found(docs, keep)
    span = lambda k, s, score: F.struct(s["start"].alias("start"), F.lit(KINDS.index(k)).alias("rank"), s["end"].alias("end"), F.lit(k).alias("kind"), score.alias("score"))
    base = F.array_sort(F.flatten(F.array(*(F.transform(f"b_{k}", _of(k, lambda kind, s: span(kind, s, F.lit(1.0)))) for k in KINDS))))
    df = found.select("doc_id", "text", "kept", base.alias("base"), *(f"w_{k}" for k in KINDS))
    df = df.withColumn("blocks", _blocks(F.col("base")))
    wide = []
    for k, m in model.items():
        if m.trees and np.isfinite(m.threshold):
            free = F.filter(f"w_{k}", lambda s: ~_touches(F.col("blocks"), s))

            def total(own: Boosted, c: Column) -> Column:
                z = F.lit(own.start)
                for tree in own.trees:
                    z = z + RATE * _sql(tree, lambda f: c["x"][f])
                return z

            shaped = F.transform(free, _of(k, lambda kind, s: F.struct(s.alias("s"), _features(kind, s).alias("x"))))
            scores = F.transform(shaped, _of((k, m), lambda km, c: span(km[0], c["s"], total(km[1], c))))
            wide.append(F.filter(scores, _of(m.threshold, lambda least, c: c["score"] >= least)))
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string,score:double>>)")
    df = df.select("doc_id", "text", "kept", "base", (F.array_sort(F.flatten(F.array(*wide))) if wide else none).alias("wide"))

    def keep(acc: Column, s: Column) -> Column:
        clear = (F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1))["end"] <= s["start"])
        last = F.try_element_at(acc, F.lit(-1))
        return F.when(clear, F.concat(acc, F.array(s))).when(last["score"] >= s["score"], acc).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(s)))

    added = F.when(F.size("wide") == 0, none).otherwise(F.aggregate("wide", none, keep))
    return df.select("doc_id", "text", "kept", "base", added.alias("added"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """Text with spans, in order of start, put as <kind>; overlapping ones share one mark, that of the first.

    A place in a text costs the way there, so each block of spans is written within its own part of the text.
    """

    def part(z: Column, block: Column, i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(z["reach"], i))
        last = F.greatest(begin, F.array_max(F.transform(block, lambda s: s["end"])))
        chunk = F.substring(text, begin + 1, last - begin)

        def written(own: Column) -> Column:
            def step(acc: Column, s: Column) -> Column:
                more = F.concat(acc["out"], F.substring(own, acc["at"] - begin + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">"))
                return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(more).alias("out"))

            return F.aggregate(block, F.struct(begin.alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

        return _bound(chunk, written)

    def whole(z: Column) -> Column:
        parts = F.transform(z["blocks"], lambda block, i: part(z, block, i))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(z["reach"], -1) + 1, F.length(text)))

    def reached(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda s: s["end"])))
        reach = F.aggregate(ends, F.array(F.lit(0)), lambda acc, e: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), e))))
        return _bound(F.struct(blocks.alias("blocks"), reach.alias("reach")), whole)

    return F.when(F.size(spans) == 0, text).otherwise(_bound(_cut(spans), reached))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find(docs, learn(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    both = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(both).alias("spans"), F.size("added").cast("long").alias("n_added"))


def brute_force(text: str | None) -> tuple[int, int, int, int, str]:
    """(n_email, n_ip, n_card, n_phone, base_sha256) of one text."""
    text = text or ""
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")

    def luhn(d: str) -> bool:
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def ok(k: int, m: str) -> bool:
        d = re.sub("[^0-9]", "", m)
        return (True, all(int(p) <= 255 for p in m.split(".")) if k == 1 else True, 14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15)[k]

    found = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, text) if ok(k, m[0]))
    base = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)
    return *(sum(k == j for _, k, _ in found) for j in range(4)), hashlib.sha256(base.encode()).hexdigest()
