"""Queries of the operators in this subpackage, each over its whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.functions.missing import folded, known_number, known_text
from cataloom.llm import bpe, canonical, hnsw, leakage, listings, neardup, percentiles, stuffing
from cataloom.session import latest, spread, table

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
FIELDS = ["brand", "cpu_family", "gpu_model"]
SHARES = {0.5: "median", 0.9: "p90", 0.99: "p99"}


def _products(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    p = table(spark, sf_dir, "products")
    return latest(p.withColumn("_loaded", F.col("loaded_at")), "parent_asin", "_loaded", columns)


# 2 ---------------------------------------------------------------


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hnsw.neighbours(table(spark, sf_dir, "product_vectors"), "vec_id", "embedding", k=10, least=0.80)
    return hnsw.similar_pairs(found, "vec_id", 0.80)


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar of every usable vector whose id is divisible by 20, searched for in all."""
    v = table(spark, sf_dir, "product_vectors")
    return hnsw.neighbours(v, "vec_id", "embedding", k=10, queries=v.where("vec_id % 20 = 0"))


# 3 ---------------------------------------------------------------


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _products(spark, sf_dir, ["price", "segment", "brand", "loaded_at"])
    return p.withColumn("price", known_number(F.col("price"))).where(F.col("price").isNotNull())


def _segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per load day, so that any days' summaries can be put together."""
    p = _priced(spark, sf_dir)
    return percentiles.summary(p, [F.to_date("loaded_at"), folded(known_text(F.col("segment")))], F.col("price"))


def _named(found: DataFrame, name: str) -> DataFrame:
    return found.select(F.col("g")[0].alias(name), "n", *SHARES.values(), "rank_error")


def p3_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, 90th and 99th percentile of known prices per cleaned segment, from the merged summaries of single load days."""
    days = _segment_summary(spark, sf_dir)
    whole = percentiles.merge(days.select(F.array(F.col("g")[1]).alias("g"), "v", "n"))
    return _named(percentiles.wide(percentiles.percentiles(whole, list(SHARES)), SHARES), "segment")


def p3_day_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per load day and segment."""
    found = percentiles.wide(percentiles.percentiles(_segment_summary(spark, sf_dir), list(SHARES)), SHARES)
    return found.select(F.col("g")[0].alias("day"), F.col("g")[1].alias("segment"), "n", *SHARES.values(), "rank_error")


def _brand_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per load day, so that any days' summaries can be put together."""
    p = _products(spark, sf_dir, ["price", "brand", "loaded_at"]).where(known_number(F.col("price")).isNotNull())
    brands = canonical.resolve(p, table(spark, sf_dir, "canonical_values"), ["brand"], "parent_asin").select("parent_asin", "ref_id")
    priced = p.select("parent_asin", "price", "loaded_at").join(brands, "parent_asin", "left")
    return percentiles.summary(priced, [F.to_date("loaded_at"), F.col("ref_id")], F.col("price"))


def _brand_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "canonical_values")
    return names.where("field_name = 'brand'").select(F.col("ref_id").cast("string").alias("id"), F.col("canonical_value").alias("brand"))


def p3_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per canonical brand, from the merged summaries of single load days; brands without an entry stand together under null."""
    days = _brand_summary(spark, sf_dir)
    whole = percentiles.merge(days.select(F.array(F.col("g")[1]).alias("g"), "v", "n"))
    found = percentiles.wide(percentiles.percentiles(whole, list(SHARES)), SHARES)
    # -1 and "missing" come out as two rows without a name
    return found.withColumn("id", F.col("g")[0]).join(_brand_names(spark, sf_dir), "id", "left").select("id", "brand", "n", *SHARES.values(), "rank_error")


def p3_day_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per load day and canonical brand."""
    found = percentiles.wide(percentiles.percentiles(_brand_summary(spark, sf_dir), list(SHARES)), SHARES)
    named = found.withColumn("id", F.col("g")[1]).join(_brand_names(spark, sf_dir), "id", "left")
    return named.select(F.col("g")[0].alias("day"), "id", "brand", "n", *SHARES.values(), "rank_error")


# 4 ---------------------------------------------------------------


def _same_product(spark: SparkSession, sf_dir: str) -> listings.SameProduct:
    return listings.SameProduct(table(spark, sf_dir, "products"), "parent_asin", "loaded_at", table(spark, sf_dir, "canonical_values"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _same_product(spark, sf_dir).pairs()


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _same_product(spark, sf_dir).groups()


# 5 ---------------------------------------------------------------


def _near(spark: SparkSession, sf_dir: str) -> neardup.NearDuplicates:
    return neardup.NearDuplicates(table(spark, sf_dir, "reviews"), "review_id", "text", "loaded_at")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).pairs()


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).groups()


# 6 ---------------------------------------------------------------


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.unresolved(_products(spark, sf_dir, FIELDS), table(spark, sf_dir, "canonical_values"), FIELDS, "parent_asin")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values that no entry stands for, with the number of listings that hold them."""
    cells = canonical.resolve(_products(spark, sf_dir, FIELDS), table(spark, sf_dir, "canonical_values"), FIELDS, "parent_asin")
    return cells.where("ref_id = -1").groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n"))


# 7 ---------------------------------------------------------------


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(spread(table(spark, sf_dir, "documents")), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


# 8 ---------------------------------------------------------------


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "passage")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items with the number of documents and the longest run of words."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("words").alias("longest"))


# 9 ---------------------------------------------------------------


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.stuffing(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text").where("stuffed").select("doc_id")


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_neighbours, p3_segment, p3_day_segment, p3_brand, p3_day_brand, p4_found, p4_groups, p5_found, p5_groups, p6_found, p6_report, p7_ids, p8_found, p8_items, p9_found)
}
