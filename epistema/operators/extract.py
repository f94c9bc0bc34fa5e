"""Claims: checks against ontology and text, quarantine, projection, quality measures, prompts, chunks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epistema.functions.scalars import content_id
from epistema.operators.relational import jaccard
from epistema.operators.text import shingles
from epistema.plans.storage import small
from epistema.schema import OBJECT_TYPES, TIME_MAX, TIME_MIN

_MENTION = "surface:string,entity_type:string,quote:string,span:array<bigint>"
CLAIMS = f"claims array<struct<predicate:string,subject:struct<{_MENTION}>,object:struct<kind:string,{_MENTION},mention:struct<{_MENTION}>,literal_type:string,value:string>,polarity:string,confidence:double,valid_from:bigint,valid_to:bigint>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _once(rows: DataFrame, *made: Column) -> DataFrame:
    """Rows with further columns that are computed once: a projection would be merged with those after it and computed for each use and each filter."""
    return rows.select("*", F.inline(F.array(F.struct(*made))))


def claims(responses: DataFrame) -> DataFrame:
    """A row for each claim of responses (episode_id, content, raw_response). An object's mention may stand in it or under ``mention``."""
    parsed = _once(responses, F.from_json("raw_response", CLAIMS).alias("__c"))
    rows = parsed.select(*[c for c in responses.columns if c != "raw_response"], F.posexplode("__c.claims").alias("ordinal", "claim"))
    obj = F.col("claim.object")
    own = [F.coalesce(obj["mention"][f], obj[f]).alias(f) for f in ("surface", "entity_type", "quote", "span")]
    return rows.withColumn("claim", F.col("claim").withField("object", F.when(obj.isNotNull(), F.struct(obj["kind"].alias("kind"), *own, obj["literal_type"].alias("literal_type"), obj["value"].alias("value")))))


def _folded(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _located(content: Column, quote: Column, needle: Column) -> Column:
    """Where a needle stands inside the first occurrence of a quote: bytes start and end, and the text there; ASCII letters in either case if it is not there as it is."""
    at = F.call_function("locate", quote, content)
    exact = F.call_function("locate", needle, quote)
    inside = F.when(exact > 0, exact).otherwise(F.call_function("locate", _folded(needle), _folded(quote)))
    start = (F.octet_length(content.substr(F.lit(1), at - 1)) + F.octet_length(quote.substr(F.lit(1), inside - 1))).cast("long")
    return F.when((needle != "") & (at > 0) & (inside > 0), F.struct(start.alias("start"), (start + F.octet_length(needle)).alias("end"), quote.substr(inside, F.length(needle)).alias("repaired")))


def place(content: Column, surface: Column, quote: Column, span: Column) -> Column:
    """Where a mention stands in a text: bytes start and end, and the text there, or null.

    By its quote, if it has one, and by that alone; else by its span, taken as bytes, as characters, or as bytes where
    ASCII letters may differ in case. A span is never moved elsewhere. A span that is not there is (0, 0).
    """
    a, b = (F.coalesce(F.get(span, F.lit(i)), F.lit(0)).cast("int") for i in (0, 1))
    size, chars = F.octet_length(content), F.length(content)
    within = (a >= 0) & (a <= b)
    slice_of = lambda text: text.cast("binary").substr(a + 1, b - a)
    as_bytes = within & (b <= size) & (slice_of(content) == surface.cast("binary"))
    as_chars = within & (a < chars) & (b <= chars) & (content.substr(a + 1, b - a) == surface)
    but_case = within & (b <= size) & (slice_of(_folded(content)) == _folded(surface).cast("binary"))
    here = lambda start, text: F.struct(start.cast("long").alias("start"), (start + F.octet_length(surface)).cast("long").alias("end"), text.alias("repaired"))
    found = F.when(as_bytes, here(a, surface)).when(as_chars, here(F.octet_length(content.substr(F.lit(1), a)), surface)).when(but_case, here(a, slice_of(content).cast("string")))
    return F.when(quote.isNotNull(), _located(content, quote, surface)).otherwise(found)


def checked(rows: DataFrame, ontology: DataFrame) -> DataFrame:
    """Claims with the array of what is wrong with them; those without faults have their surfaces and spans as the text has them.

    An unknown predicate ends the check of a claim. object_types of the ontology are the types that an entity object may
    have, or the variants of an enum; without that column they are those of the built-in predicates. An ontology of moderate size is broadcast.
    """
    if "object_types" not in ontology.columns:
        types = F.create_map(*(F.lit(x) for kv in OBJECT_TYPES.items() for x in kv))
        ontology = ontology.withColumn("object_types", F.try_element_at(types, F.col("name")))
    defs = ontology.select(F.col("name").alias("__name"), F.col("object_kind").alias("__kind"), F.col("subject_types").alias("__subject"), F.col("object_types").alias("__object"))
    out = rows.join(small(defs), F.col("claim.predicate") == F.col("__name"), "left")
    c = lambda f: F.col(f"claim.{f}")
    one_of = lambda value, names: F.array_contains(F.split(names, ","), F.coalesce(value, F.lit("")))
    known, entity, literal = F.col("__name").isNotNull(), F.coalesce(c("object.kind") == "entity", F.lit(False)), F.coalesce(c("object.kind") == "literal", F.lit(False))
    kind_of = F.col("__kind")
    fits = F.when(entity, (kind_of == "entity") & F.coalesce(one_of(c("object.entity_type"), F.col("__object")), F.lit(True)))
    fits = fits.when(literal & (kind_of == "enum"), F.coalesce(one_of(c("object.value"), F.col("__object")), F.lit(False))).when(literal, F.coalesce(c("object.literal_type") == kind_of, F.lit(False))).otherwise(False)
    at = lambda who: place(F.col("content"), c(f"{who}.surface"), c(f"{who}.quote"), c(f"{who}.span"))
    value_at = _located(F.col("content"), c("object.quote"), c("object.value"))
    out = _once(out, F.when(known, at("subject")).alias("__s"), F.when(known & entity, at("object")).alias("__o"), F.when(known & literal, value_at).alias("__v"))
    a, b = (F.coalesce(F.get(c("object.span"), F.lit(i)), F.lit(0)) for i in (0, 1))
    outside = (a >= F.octet_length("content")) | (b > F.octet_length("content")) | (a >= b)
    quoted = c("object.quote").isNotNull()
    errors = F.array_compact(
        F.array(
            F.when(c("confidence").isNull() | ~c("confidence").between(0, 1), "confidence_out_of_range"),
            F.when(~known, "unknown_predicate"),
            F.when(known & ~one_of(c("subject.entity_type"), F.col("__subject")), "subject_type"),
            F.when(known & ~fits, "object_type"),
            F.when(known & F.col("__s").isNull(), "subject_not_verbatim"),
            F.when(known & ((entity & F.col("__o").isNull()) | (literal & quoted & F.col("__v").isNull())), "object_not_verbatim"),
            F.when(known & literal & ~quoted & outside, "span_out_of_bounds"),
        )
    )
    out = _once(out, errors.alias("errors"))
    mended = lambda who, where: F.col("claim").getField(who).withField("surface", F.col(f"{where}.repaired")).withField("span", F.array(f"{where}.start", f"{where}.end"))
    value = c("object").withField("value", F.col("__v.repaired")).withField("span", F.array("__v.start", "__v.end"))
    whole = F.col("claim").withField("subject", mended("subject", "__s")).withField("object", F.when(entity, mended("object", "__o")).when(quoted, value).otherwise(c("object")))
    return out.withColumn("claim", F.when(F.size("errors") == 0, whole).otherwise(F.col("claim"))).drop("__name", "__kind", "__subject", "__object", "__s", "__o", "__v")


def quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims without and with errors."""
    return rows.filter(F.size("errors") == 0), rows.filter(F.size("errors") > 0)


def project(valid: DataFrame) -> DataFrame:
    """Assertions of valid claims; open ends where none are given, trust from the episode."""
    c = lambda f: F.col(f"claim.{f}")
    obj = F.coalesce(c("object.surface"), c("object.value"))
    return valid.select(
        content_id("a", F.col("episode_id").cast("string"), F.col("ordinal").cast("string")).alias("assertion_id"),
        F.lower(c("subject.surface")).alias("subject_id"),
        c("predicate").alias("predicate"),
        F.lower(obj).alias("object"),
        content_id("s", F.lower(c("subject.surface")), c("predicate"), F.lower(obj)).alias("statement_id"),
        "episode_id",
        "extractor_id",
        F.when(c("polarity") == "deny", -1).otherwise(1).alias("polarity"),
        F.coalesce(c("valid_from"), F.lit(TIME_MIN)).alias("claimed_from"),
        F.coalesce(c("valid_to"), F.lit(TIME_MAX)).alias("claimed_to"),
        c("confidence").alias("confidence"),
        "recorded_at",
        F.lit(None).cast("long").alias("retracted_at"),
        "trust",
    )


def metrics(extracted: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 over distinct lower-case triples; nothing expected is all recalled."""
    low = lambda df: df.select(*(F.lower(k).alias(k) for k in keys)).distinct()
    a, b = low(extracted).withColumn("x", F.lit(1)), low(expected).withColumn("y", F.lit(1))
    n = a.join(b, keys, "full_outer").agg(F.count("x").alias("got"), F.count("y").alias("want"), F.sum(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1).otherwise(0)).alias("both"))
    p = F.when(F.col("got") == 0, 1.0).otherwise(F.col("both") / F.col("got"))
    r = F.when(F.col("want") == 0, 1.0).otherwise(F.col("both") / F.col("want"))
    return n.select(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)), 6).alias("f1"))


def fabrication(rows: DataFrame, surface: str, content: str) -> DataFrame:
    """Share of surfaces that the text does not contain."""
    return rows.agg(F.round(F.avg(F.when(F.contains(F.col(content), F.col(surface)), 0.0).otherwise(1.0)), 6).alias("fabrication_rate"), F.count("*").alias("n"))


def calibration(precision: Column, fabricated: Column) -> Column:
    return F.greatest(F.lit(0.1), F.least(F.lit(2.0), 0.8 * precision * (1 - fabricated)))


def gate(precision: Column, recall: Column, fabricated: Column, least: tuple[float, float, float] = (0.9, 0.7, 0.0)) -> Column:
    return (precision >= least[0]) & (recall >= least[1]) & (fabricated <= least[2])


def few_shot(examples: DataFrame, target: str, k: int) -> DataFrame:
    """The k examples nearest to a text by shingles."""
    return examples.withColumn("score", F.round(jaccard(shingles(F.lower("text")), shingles(F.lower(F.lit(target)))), 6)).orderBy(F.desc("score"), "text").limit(k)


def response_schema(ontology: list) -> dict:
    """JSON schema of responses, from the rows of the ontology."""
    names = sorted(r[0] for r in ontology)
    types = sorted({t for r in ontology for t in r[2].split(",")})
    mention = {"type": "object", "required": ["surface", "entity_type"], "properties": {"surface": {"type": "string"}, "entity_type": {"enum": types}, "quote": {"type": "string"}}}
    claim = {"type": "object", "required": ["predicate", "subject", "object", "polarity", "confidence"], "properties": {"predicate": {"enum": names}, "subject": mention, "object": {"type": "object"}, "polarity": {"enum": ["affirm", "deny"]}, "confidence": {"type": "number", "minimum": 0, "maximum": 1}}}
    return {"type": "object", "required": ["claims"], "properties": {"claims": {"type": "array", "items": claim}}}


def grammar(ontology: list) -> str:
    """Grammar of predicate names for constrained decoding."""
    return "predicate ::= " + " | ".join(json.dumps(r[0]) for r in sorted(ontology))


def prompt(ontology: list, text: str, examples: list[str] = ()) -> str:
    lines = [f"- {r[0]}: {r[2]} -> {r[1]}" for r in sorted(ontology)]
    shots = [f"Example:\n{e}" for e in examples]
    return "\n\n".join(["State the claims of the text as JSON.", "Predicates:\n" + "\n".join(lines), *shots, f"Text:\n{text}"])


SEPARATORS = ("\n\n", "\n", ". ", "。", " ")


def split_spans(text: str, most: int = 4096) -> list[tuple[int, int]]:
    """Spans in bytes that cover the text, each of at most ``most`` bytes, cut at the widest separator there is."""
    def cut(piece: str) -> list[str]:
        if len(piece.encode()) <= most:
            return [piece] if piece else []
        for sep in SEPARATORS:
            if sep in piece:
                parts, out = piece.split(sep), []
                parts = [p + sep for p in parts[:-1]] + [parts[-1]]
                held = ""
                for p in parts:
                    if held and len((held + p).encode()) > most:
                        out += [held]
                        held = ""
                    held += p
                out += [held] if held else []
                return [x for o in out for x in (cut(o) if len(o.encode()) > most and o != piece else hard(o) if len(o.encode()) > most else [o])]
        return hard(piece)

    def hard(piece: str) -> list[str]:
        out, held, size = [], [], 0
        for c in piece:
            n = len(c.encode())
            if size + n > most:
                out.append("".join(held))
                held, size = [], 0
            held.append(c)
            size += n
        return out + ["".join(held)] if held else out

    spans, at = [], 0
    for p in cut(text):
        spans.append((at, at + len(p.encode())))
        at = spans[-1][1]
    return spans


def chunks(episodes: DataFrame, most: int = 4096) -> DataFrame:
    """episode_id, ordinal, start and end in bytes of the chunks of episodes (episode_id, content)."""

    @F.pandas_udf("array<struct<start:bigint,end:bigint>>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b} for a, b in split_spans(t or "", most)])

    return episodes.select("episode_id", F.posexplode(spans("content")).alias("ordinal", "s")).select("episode_id", "ordinal", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))
