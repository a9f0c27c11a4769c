"""Text normalisation and number tokens, as column expressions (one Arrow function: NFKC has no built-in)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Dash and punctuation variants that are folded, and traditional characters of statement titles.
DASHES = "−–—‐‑‒―﹣－"
PUNCTUATION = ("、。「」『』‘’“”", ",.\"\"\"\"''\"\"")
TRADITIONAL = ("損綜營經現動產務據財東應擁權業績銀險開發額淨總額資債", "损综营经现动产务据财东应拥权业绩银险开发额净总额资债")

#: A whole number as it is searched on a page: not part of a longer number, not followed by more decimals.
STRICT_NUMBER = r"(?<![\d.])\d+(?:\.\d+)?(?!\d|\.\d)"
#: A number in the wider set that scoring uses.
LOOSE_NUMBER = r"(?<![\d.])\d+(?:\.\d+)?(?!\d)"


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    """FN1. Full-width and radical folding; null is empty. Run once where pages enter."""
    return _nfkc(F.coalesce(c, F.lit("")))


def dashes(c: Column) -> Column:
    return F.translate(c, DASHES, "-" * len(DASHES))


def for_match(c: Column) -> Column:
    """FN2: folded, simplified characters, unified punctuation, no white space, lower case."""
    c = nfkc(c)
    c = F.translate(c, DASHES + PUNCTUATION[0] + TRADITIONAL[0], "-" * len(DASHES) + PUNCTUATION[1] + TRADITIONAL[1])
    return F.lower(F.regexp_replace(c, r"(?U)\s+", ""))


def for_numbers(c: Column) -> Column:
    """FN3: folded, thousands separators go, white space stays."""
    return F.regexp_replace(dashes(nfkc(c)), r"(?<=\d),(?=\d{3}(?!\d))", "")


def number_tokens(c: Column) -> Column:
    """FN17, on ``for_numbers`` text: strict tokens, in order."""
    return F.regexp_extract_all(c, F.lit(STRICT_NUMBER), F.lit(0))


def number_set(c: Column) -> Column:
    """FN18: distinct loose tokens."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(LOOSE_NUMBER), F.lit(0)))


def signed(raw: Column, negative: Column) -> Column:
    """FN16: a leading minus for negatives that have none."""
    return F.when(F.coalesce(negative, F.lit(False)) & ~raw.rlike(r"^\s*[-(−]"), F.concat(F.lit("-"), raw)).otherwise(raw)


def json_block(c: Column) -> Column:
    """The first fenced block of a reply that begins like JSON, else the reply itself."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    blocks = F.regexp_extract_all(c, F.lit(r"(?s)```(?:json|JSON)?\s*\n(.*?)\n\s*```"), F.lit(1))
    return F.coalesce(F.try_element_at(F.filter(F.transform(blocks, strip), lambda x: x.rlike(r"^[\[{]")), F.lit(1)), strip(F.coalesce(c, F.lit(""))))


def reply_kind(c: Column) -> Column:
    """FN24: json, table or empty."""
    t = F.coalesce(c, F.lit(""))
    return F.when(~t.rlike(r"\S"), "empty").when(t.rlike(r"^\s*(?:[\[{]|```)") | json_block(c).rlike(r"^[\[{]"), "json").otherwise("table")
