"""Text cleaning."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: s if s is None else html.unescape(html.unescape(s)))


def decode_entities(text: Column) -> Column:
    """Every HTML entity, twice, as texts are at times encoded twice. Only texts that hold an ampersand travel to Python, in Arrow batches."""
    coded = text.contains("&")
    return F.when(coded, _unescaped(F.when(coded, text))).otherwise(text)


def strip_markup(text: Column) -> Column:
    """Breaks and tags of up to 80 characters to blanks, control characters to blanks, white space collapsed, trimmed."""
    t = F.regexp_replace(text, r"<br ?/?>", " ")
    t = F.regexp_replace(t, r"<[^>]{1,80}>", " ")
    t = F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    return F.trim(F.regexp_replace(t, r"[\s ]+", " "))


def clean_text(text: Column) -> Column:
    return strip_markup(decode_entities(F.coalesce(text, F.lit(""))))


def shortened(text: Column, limit: int) -> Column:
    """For display: white space collapsed, cut at a word with an ellipsis."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(t) > limit, F.concat(F.regexp_replace(F.substring(t, 1, limit), r"\s+\S*$", ""), F.lit("…"))).otherwise(t)
