"""Scalar functions of the data model, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from epistema.schema import TIME_MAX, TIME_MIN


def content_id(*parts: Column | str) -> Column:
    """Identifier from content: hash of the parts."""
    return F.sha2(F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(p) for p in parts)), 256)


def normal_content(text: Column) -> Column:
    """Line ends as LF and no white space at the end; for compatibility forms see ``nfkc``."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\s+\z", "")


def content_hash(text: Column) -> Column:
    return F.sha2(normal_content(text), 256)


def number_text(x: Column) -> Column:
    """Canonical text of a number: no minus zero, whole numbers below 1e15 without a fraction."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(x == 0, "0").when(whole, F.when(whole, x).cast("long").cast("string")).otherwise(x.cast("string"))


def tokens(text: Column) -> Column:
    """Estimate: a quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def salience(age_days: Column) -> Column:
    return F.greatest(F.lit(0.05), F.exp(-0.01 * age_days))


def expand_score(s: Column, age_days: Column) -> Column:
    """Rank of an episode for a context: salience and recency."""
    return s * F.greatest(s, F.lit(0.5)) / (1 + F.greatest(age_days, F.lit(0.0)) / 365.0)


def short_date(millis: Column) -> Column:
    """Date of a time in milliseconds; the epoch's for times up to it."""
    return F.when(millis <= 0, "1970-01-01").otherwise(F.date_format(F.timestamp_millis(F.when(millis > 0, F.least(millis, F.lit(253402300799999)))), "yyyy-MM-dd"))


def noon(date: Column) -> Column:
    """Milliseconds of noon of an ISO date."""
    return F.unix_millis(F.to_timestamp(date, "yyyy-MM-dd") + F.expr("interval 12 hours"))


def validity(start: Column, end: Column) -> Column:
    """Text of an interval, with open ends."""
    a, b = start.cast("string"), end.cast("string")
    open_start, open_end = start <= TIME_MIN, end >= TIME_MAX
    return F.when(open_start & open_end, "open").when(open_start, F.concat(F.lit("until "), b)).when(open_end, F.concat(F.lit("since "), a)).otherwise(F.concat(a, F.lit(" to "), b))


def entity_link(space: Column, ident: Column) -> Column:
    return F.concat(F.lit("kb://"), space, F.lit("/entity/"), ident)


def link_entity(link: Column) -> Column:
    """The entity of a link, or null."""
    m = F.regexp_extract(link, r"^kb://[^/]+/entity/(.+)$", 1)
    return F.when(m != "", m)


def set_hash(members: Column, prefix: str = "") -> Column:
    """Hash of a set, whatever its order."""
    return F.sha2(F.concat(F.lit(prefix), F.array_join(F.array_sort(F.array_distinct(members)), ",")), 256)


def context_prefix(date: Column, kind: Column, mentions: Column, most: int = 8) -> Column:
    """Heading of a chunk: date, kind and the first mentions."""
    names = F.array_join(F.slice(mentions, 1, most), ", ")
    more = F.when(F.size(mentions) > most, ", ...").otherwise("")
    return F.concat(F.lit("["), F.concat_ws(" · ", date, kind, F.when(F.size(mentions) > 0, F.concat(F.lit("mentions: "), names, more))), F.lit("]"))


def object_repr(kind: Column, text: Column, number: Column, unit: Column) -> Column:
    """Object of a statement as text, with the prefix of its kind."""
    out = F.when(kind == "entity", F.concat(F.lit("e:"), text))
    for name, prefix in (("text", "t:"), ("date", "d:"), ("datetime", "dt:"), ("bool", "b:"), ("enum", "en:")):
        out = out.when(kind == name, F.concat(F.lit(prefix), text))
    return out.when(kind == "number", F.concat(F.lit("n:"), number_text(number))).when(kind == "quantity", F.concat(F.lit("q:"), number_text(number), F.lit(" "), unit))


def claim_repr(polarity: Column, start: Column, end: Column, confidence: Column) -> Column:
    return F.concat_ws(":", F.when(polarity > 0, "a").otherwise("d"), start.cast("string"), end.cast("string"), F.format_number(confidence, 6))


def literal_text(json: Column) -> Column:
    """Display of a literal held as JSON: its value, with a unit if it has one."""
    value, unit = F.get_json_object(json, "$.value"), F.get_json_object(json, "$.unit")
    return F.coalesce(F.concat(value, F.lit(" "), unit), value, json)


def fnv1a(hex_text: Column) -> Column:
    """64-bit FNV-1a of the bytes of a string, as hexadecimal; products are taken in 16-bit limbs, as ANSI arithmetic does not wrap."""
    pairs = F.filter(F.split(F.hex(F.encode(hex_text, "UTF-8")), "(?<=\\G..)"), lambda h: h != "")
    byte = F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("long"))
    limb = lambda v, k: F.shiftrightunsigned(v, 16 * k).bitwiseAND(0xFFFF)

    def step(h: Column, b: Column) -> Column:
        x = h.bitwiseXOR(b)
        # the prime is 2**40 + 0x1B3: low limb 0x1B3, and 0x100 two limbs up
        a0 = limb(x, 0) * 0x1B3
        a1 = limb(x, 1) * 0x1B3 + F.shiftrightunsigned(a0, 16)
        a2 = limb(x, 2) * 0x1B3 + limb(x, 0) * 0x100 + F.shiftrightunsigned(a1, 16)
        a3 = limb(x, 3) * 0x1B3 + limb(x, 1) * 0x100 + F.shiftrightunsigned(a2, 16)
        return limb(a0, 0).bitwiseOR(F.shiftleft(limb(a1, 0), 16)).bitwiseOR(F.shiftleft(limb(a2, 0), 32)).bitwiseOR(F.shiftleft(limb(a3, 0), 48))

    start = F.lit(0xCBF29CE484222325 - (1 << 64)).cast("long")
    return F.lower(F.lpad(F.hex(F.aggregate(byte, start, step)), 16, "0"))
