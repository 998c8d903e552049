"""Faceted search over the catalogue: predicates, text match, sorts, pages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cataloom.functions import vocabulary as V


@dataclass(frozen=True)
class Filters:
    """A bound on a column that may be missing keeps known values only; absent bounds keep everything."""

    brands: Sequence[str] = ()
    segments: Sequence[str] = ()
    os_families: Sequence[str] = ()
    min_price: float | None = None
    max_price: float | None = None
    min_ram: float | None = None
    min_storage: float | None = None
    min_tier: float | None = None
    screen: tuple[float, float] | None = None
    min_rating: float | None = None
    min_ratings: int | None = None
    discrete_gpu: bool | None = None
    renewed: bool | None = None
    exclude_renewed: bool = False
    priced_only: bool = False
    include_unpriced: bool = False
    with_sentiment: bool | None = None
    _: object = field(default=None, repr=False)

    def __post_init__(self) -> None:
        unknown = set(self.segments) - set(V.SEGMENTS)
        if unknown:
            raise ValueError(f"unknown segments: {sorted(unknown)}")
        if self.min_price is not None and self.max_price is not None and self.min_price > self.max_price:
            raise ValueError("min_price is above max_price")


def predicate(f: Filters) -> Column:
    """One conjunction for the scan; cheap equality tests come first."""
    parts: list[Column] = []
    for names, column in ((f.brands, "brand"), (f.segments, "segment"), (f.os_families, "os_family")):
        if names:
            parts.append(F.col(column).isin(*names))
    for flag, column in ((f.discrete_gpu, "is_discrete_gpu"), (f.renewed, "is_renewed"), (f.with_sentiment, "has_sentiment")):
        if flag is not None:
            parts.append(F.col(column) == flag)
    if f.exclude_renewed:
        parts.append(~F.col("is_renewed"))
    price = F.lit(True)
    if f.min_price is not None:
        price = price & (F.col("price") >= f.min_price)
    if f.max_price is not None:
        price = price & (F.col("price") <= f.max_price)
    if f.min_price is not None or f.max_price is not None:
        parts.append(price | F.col("price").isNull() if f.include_unpriced else price & F.col("price").isNotNull())
    if f.priced_only:
        parts.append(F.col("price").isNotNull())
    for bound, column in ((f.min_ram, "ram_gb"), (f.min_storage, "storage_gb"), (f.min_tier, "cpu_tier"), (f.min_rating, "average_rating"), (f.min_ratings, "rating_number")):
        if bound is not None:
            parts.append(F.col(column) >= bound)
    if f.screen is not None:
        parts.append(F.col("screen_in").between(*f.screen))
    out = F.lit(True)
    for p in parts:
        out = out & p
    return F.coalesce(out, F.lit(False))


def tokens(query: str) -> list[str]:
    """Runs of letters and digits, lower case."""
    import re

    return re.findall(r"[a-z0-9]+", query.lower())


def text_match(df: DataFrame, query: str) -> DataFrame:
    """Listings whose title, brand, segment or parts hold every token, with their text score."""
    words = tokens(query)
    if not words:
        return df.withColumn("text_score", F.lit(0.0))
    title = F.lower(F.coalesce("title", F.lit("")))
    blob = F.lower(F.concat_ws(" ", "title", "brand", "segment", "cpu_family", "gpu_model", "os_family"))
    every, score = F.lit(True), F.lit(0.0)
    for w in words:
        every = every & blob.contains(w)
        score = score + F.when(title.contains(w), 2.0).otherwise(1.0)
    if len(words) > 1:
        score = score + F.when(title.contains(" ".join(words)), 6.0).otherwise(0.0)
    score = score + F.when(~title.contains(" ".join(words)) | F.lit(len(words) == 1), F.when(F.substring(title, 1, 60).contains(words[0]), 1.0).otherwise(0.0)).otherwise(0.0)
    return df.where(every).withColumn("text_score", score + F.log1p("rating_number") / 25)


SORTS = {
    "price_asc": [F.asc_nulls_last, "price"], "price_desc": [F.desc_nulls_last, "price"], "rating": [F.desc_nulls_last, "average_rating", "rating_number"],
    "reviews": [F.desc_nulls_last, "n_reviews", "rating_number"], "ram": [F.desc_nulls_last, "ram_gb"], "storage": [F.desc_nulls_last, "storage_gb"],
}


def order(sort: str, has_text: bool) -> list[Column]:
    """Missing last in both directions, then the key. Relevance without a text means most reviewed."""
    if sort == "relevance":
        if has_text:
            return [F.desc("text_score"), F.asc("parent_asin")]
        sort = "reviews"
    if sort not in SORTS:
        raise ValueError(f"sort is one of relevance, {', '.join(SORTS)}")
    by, *columns = SORTS[sort]
    return [*[by(c) for c in columns], F.asc("parent_asin")]


def page(df: DataFrame, filters: Filters, query: str = "", sort: str = "relevance", limit: int = 24, offset: int = 0) -> DataFrame:
    """A page of cards with their rank over the whole result."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit lies in 1..200, offset is not negative")
    found = text_match(df.where(predicate(filters)), query)
    keys = order(sort, bool(tokens(query)))
    top = found.orderBy(*keys).limit(offset + limit)  # a top-k, not a full sort
    ranked = top.withColumn("rank", F.row_number().over(W.orderBy(*keys)))
    return ranked.where(F.col("rank") > offset).select("rank", *card())


def result_coverage(df: DataFrame, filters: Filters, query: str = "") -> DataFrame:
    """Hits, priced hits and coverage of a search."""
    found = text_match(df.where(predicate(filters)), query)
    return found.agg(F.count(F.lit(1)).alias("total"), F.count("price").alias("priced"), F.round(F.try_divide(F.count("price"), F.count(F.lit(1))), 6).alias("coverage"))


def price_display(price: Column) -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.format_number(price, 2)), F.lit("price not listed"))


def resolution(w: Column, h: Column) -> Column:
    return F.when(w.isNotNull() & h.isNotNull(), F.concat_ws("x", w.cast("long").cast("string"), h.cast("long").cast("string"))).otherwise("unknown")


def card() -> list[Column]:
    return [
        F.col("parent_asin"), F.col("title"), F.col("brand"), F.col("segment"), F.col("price"), price_display(F.col("price")).alias("price_text"),
        F.col("average_rating"), F.col("n_reviews"), resolution(F.col("screen_w"), F.col("screen_h")).alias("resolution"),
    ]


def specs() -> Column:
    return F.struct("cpu_family", "cpu_tier", "ram_gb", "storage_gb", "screen_in", "gpu_model", "is_discrete_gpu", "os_family", "weight_lb")


def display_table(df: DataFrame) -> DataFrame:
    """Texts for display; what is missing says so."""
    shown = lambda c, fmt: F.coalesce(F.format_string(fmt, F.col(c)), F.lit("unknown"))
    return df.select(
        "parent_asin", price_display(F.col("price")).alias("price"), F.when(F.col("ram_gb").isNull(), "unknown").otherwise(shown("ram_gb", "%.0f GB")).alias("ram"),
        F.when(F.col("screen_in").isNull(), "unknown").otherwise(shown("screen_in", "%.1f in")).alias("screen"),
        F.when(F.col("average_rating").isNull(), "unknown").otherwise(shown("average_rating", "%.1f")).alias("rating"),
    )


def lookup(df: DataFrame, key: str) -> DataFrame:
    """The listing of a key; an error when there is none."""
    row = df.where(F.col("parent_asin") == key)
    if row.isEmpty():
        raise KeyError(key)
    return row


def default_pick(df: DataFrame) -> DataFrame:
    """The most reviewed priced listing with sentiment; without one, the most reviewed."""
    good = F.col("price").isNotNull() & F.col("has_sentiment")
    return df.orderBy(F.desc(good), F.desc("n_reviews"), "parent_asin").limit(1).select("parent_asin", "n_reviews", "price", "has_sentiment")


def sample_products(df: DataFrame, segment: str | None = None, priced: bool = True, low: float | None = None, high: float | None = None, min_reviews: int = 0, n: int = 10) -> DataFrame:
    f = Filters(segments=(segment,) if segment else (), min_price=low, max_price=high, priced_only=priced)
    return df.where(predicate(f) & (F.col("n_reviews") >= min_reviews)).orderBy(F.desc("n_reviews"), "parent_asin").limit(n)


def ruler(value: Column, low: Column, high: Column) -> Column:
    """Position of a value in a span, clamped to 0..100 percent."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.try_divide(100 * (value - low), high - low)))
