"""HTML notes to text: front matter, comments, tags, entities."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Named entities that are decoded.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def strip_comments(text: Column) -> Column:
    """Without comments; one that does not end takes the rest."""
    return F.regexp_replace(text, r"(?s)<!--.*?(?:-->|\z)", "")


def front_matter(text: Column) -> Column:
    """Struct of the leading <!-- +++ ... +++ --> block (null if none) and the rest."""
    pattern = r"(?s)\A\s*<!--\s*\+\+\+\s*(.*?)\s*\+\+\+\s*-->(.*)\z"
    found = text.rlike(pattern)
    return F.struct(F.when(found, F.regexp_extract(text, pattern, 1)).alias("front"), F.when(found, F.regexp_extract(text, pattern, 2)).otherwise(text).alias("body"))


def to_text(text: Column) -> Column:
    """Text of a page with built-in expressions: comments, scripts, styles and tags go, named entities are decoded, white space is single."""
    out = F.regexp_replace(strip_comments(text), r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)", " ")
    out = F.regexp_replace(out, r"(?s)<[/!?a-zA-Z][^>]*>", " ")
    for name, c in ENTITIES.items():
        if name != "amp":
            out = F.regexp_replace(out, f"&{name};", c)
    out = F.regexp_replace(out, "&amp;", "&")
    return F.trim(F.regexp_replace(out, r"[ \t\r\n\f\x0B]+", " "))


_BLOCK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|section|article|header|footer|nav|main|blockquote|pre|hr|figure|title|head|body|html)\b[^>]*(?:>|\Z)", re.IGNORECASE)


def _whole(page: str) -> str:
    page = re.sub(r"(?s)<!--.*?(?:-->|\Z)", "", page)
    page = re.sub(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)", " ", page)
    page = _BLOCK.sub(" ", page)
    page = re.sub(r"(?s)<[/!?a-zA-Z][^>]*(?:>|\Z)", "", page)
    return " ".join(html.unescape(page).split())


@F.pandas_udf(T.StringType())
def to_text_whole(pages: pd.Series) -> pd.Series:
    """Like ``to_text``, with tags that do not end, inline tags that part no words, and all entities, numeric ones too."""
    return pages.map(_whole, na_action="ignore")


def note_text(text: Column) -> Column:
    return to_text(front_matter(text)["body"])
