"""From raw listings and reviews to the typed catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.functions import parse
from cataloom.functions.text import clean_text
from cataloom.session import staged


def with_reason(items: DataFrame) -> DataFrame:
    return items.withColumn("reason", parse.drop_reason(F.col("title"), F.col("categories")))


def drop_reasons(items: DataFrame) -> DataFrame:
    """Histogram of why listings are dropped."""
    return with_reason(items).where("reason <> ''").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by an explicit order. An aggregate, so copies combine before the shuffle."""
    rank = F.struct(*order)
    row = F.struct(*df.columns)
    kept = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, rank).alias("_r"))
    return kept.select("_r.*")


def expand_specs(items: DataFrame) -> DataFrame:
    """All parsers over title and details.

    Written twice on the way: one projection of all ladders would exceed the size limit of a generated method, and later
    expressions would carry the parsers inside them.
    """
    d, t = F.col("details"), F.col("title")
    out = items.select(
        "*", parse.brand(F.col("store"), d, t).alias("brand"), parse.renewed(F.col("store"), d, t).alias("is_renewed"), parse.price(F.col("price")).alias("price_usd"),
        F.coalesce(parse.detail(d, "Series"), parse.detail(d, "Model Name"), F.lit("")).alias("series_raw"), *[c.alias(n) for n, c in parse.cpu(d, t).items()],
    )
    out = staged(out, "specs-1")
    out = staged(out.select("*", *[c.alias(n) for part in (parse.ram(d, t), parse.storage(d, t), parse.screen(d, t)) for n, c in part.items()], parse.gpu(d, t)["gpu_model"].alias("gpu_model")), "specs-2")
    gpu = parse.gpu(d, t, F.col("gpu_model"))
    out = out.select("*", gpu["gpu_brand"].alias("gpu_brand"), gpu["is_discrete_gpu"].alias("is_discrete_gpu"), parse.os_family(d, t).alias("os_family"), parse.weight(d, t, F.col("screen_in")).alias("weight_lb"))
    return out.drop("price").withColumnRenamed("price_usd", "price")


def catalogue(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(products, variant map): filtered, parsed, variants collapsed, segmented. Oversize screens are dropped, unknown ones kept."""
    kept = with_reason(items).where("reason = '' AND parent_asin IS NOT NULL").withColumn("title", clean_text(F.col("title")))
    kept = first_per_key(kept.drop("reason"), ["parent_asin"], ["parent_asin", "title"])
    # written once: otherwise every later expression would carry all parsers inside it
    parsed = staged(expand_specs(kept).where(~F.coalesce(F.col("screen_in") >= 19, F.lit(False))), "catalogue-parsed")
    survivors, variants = collapse_variants(parsed)
    names = ("title", "brand", "series_raw", "os_family", "is_discrete_gpu", "gpu_model", "ram_gb", "cpu_family", "weight_lb", "screen_in", "price")
    return survivors.withColumn("segment", parse.segment({n: F.col(n) for n in names})), variants


def collapse_variants(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per model with n_variants, (parent_asin, survivor)): most ratings, then richest specification, then the smallest key.

    An aggregate per key with a join back, not a window over a whole group: a model with a third of the listings stays distributed.
    """
    names = ("screen_in", "cpu_family", "cpu_tier", "gpu_model", "is_discrete_gpu", "os_family", "is_renewed", "parent_asin")
    keyed = df.withColumn("model_sig", parse.model_signature(F.col("title"), F.col("brand")))
    keyed = staged(keyed.withColumn("dedup_key", parse.dedup_key({n: F.col(n) for n in (*names, "model_sig")})), "variants")
    rich = sum((F.col(c).isNotNull().cast("int") for c in ("cpu_ghz", "ram_gb", "storage_gb", "screen_in", "weight_lb", "price")), F.lit(0))
    rank = F.struct(-F.coalesce("rating_number", F.lit(0)), -rich, "parent_asin")
    best = keyed.groupBy("dedup_key").agg(F.min_by("parent_asin", rank).alias("survivor"), F.count(F.lit(1)).alias("n_variants"))
    survivors = keyed.join(best, (keyed["parent_asin"] == best["survivor"]) & (keyed["dedup_key"] == best["dedup_key"])).drop(best["dedup_key"], "survivor")
    mapping = keyed.select("parent_asin", "dedup_key").join(best.select("dedup_key", "survivor"), "dedup_key").where("parent_asin <> survivor").select("parent_asin", "survivor")
    return survivors, mapping


def repoint(reviews: DataFrame, survivors: DataFrame, variants: DataFrame) -> DataFrame:
    """Reviews under the surviving key, the original kept; those of no known listing dropped."""
    moved = reviews.withColumnRenamed("parent_asin", "orig_parent_asin").join(variants.select(F.col("parent_asin").alias("orig_parent_asin"), "survivor"), "orig_parent_asin", "left")
    moved = moved.withColumn("parent_asin", F.coalesce("survivor", "orig_parent_asin")).drop("survivor")
    return moved.join(survivors.select("parent_asin").distinct(), "parent_asin", "left_semi")


def load_reviews(raw: DataFrame, survivors: DataFrame, variants: DataFrame) -> DataFrame:
    """Re-pointed, cleaned, at least two characters, typed, without repeats of (user, item, text), dated."""
    r = repoint(raw, survivors, variants).withColumn("text", clean_text(F.col("text"))).where(F.length("text") >= 2)
    r = r.select(
        "parent_asin", "orig_parent_asin", "asin", "user_id", "rating", clean_text(F.col("title")).alias("review_title"), "text", F.coalesce("helpful_vote", F.lit(0)).alias("helpful_vote"),
        F.coalesce("verified_purchase", F.lit(False)).alias("verified_purchase"), F.timestamp_millis("timestamp").alias("timestamp"),
    )
    r = distinct_reviews(r, ["timestamp", "parent_asin"]).where("timestamp IS NOT NULL")
    return r.withColumn("review_year", F.year("timestamp").cast("short")).withColumn("text_len", F.char_length("text"))


def distinct_reviews(df: DataFrame, order: list[str]) -> DataFrame:
    """The first of each (user_id, asin, text). Texts travel as hashes; only the kept row's text is read back by its key inside the aggregate."""
    return first_per_key(df, ["user_id", "asin", "text"], order)


def attach_counts(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """n_reviews of each listing, 0 where there is none."""
    n = reviews.groupBy("parent_asin").agg(F.count(F.lit(1)).alias("n_reviews"))
    return products.drop("n_reviews").join(n, "parent_asin", "left").fillna(0, ["n_reviews"])


def assert_unique(df: DataFrame, key: str) -> None:
    """An error when a key repeats or is null."""
    bad = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull())
    if not bad.isEmpty():
        raise ValueError(f"{key} is not unique: {bad.first()[0]!r}")


