"""What counts as a missing cell in catalogue data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that only say that nothing is known, folded to lower case and trimmed.
PLACEHOLDERS = (
    "", "-", "--", "---", "?", "??", "n/a", "na", "n.a.", "nan", "nil", "none", "null", "tbd", "tba", "unknown",
    "not available", "not applicable", "not specified", "not known", "unspecified", "undefined", "see description", "missing",
)

PRICE_LOW, PRICE_HIGH = 20.0, 20000.0


def folded(c: Column) -> Column:
    """Lower case, any white space (also no-break) to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[\s\u00a0\u2000-\u200b\u202f\u3000\ufeff]+", " "))


def text_missing(c: Column) -> Column:
    return c.isNull() | folded(c).isin(*PLACEHOLDERS)


def number_missing(c: Column, low: float = PRICE_LOW, high: float = PRICE_HIGH) -> Column:
    """Null, not a number, or outside ``[low, high]``."""
    return c.isNull() | F.isnan(c) | ~c.between(low, high)


def known_number(c: Column, low: float = PRICE_LOW, high: float = PRICE_HIGH) -> Column:
    return F.when(~number_missing(c, low, high), c)


def known_text(c: Column) -> Column:
    return F.when(~text_missing(c), c)
