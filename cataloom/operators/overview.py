"""Catalogue overview, product detail and endpoint payloads as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.functions import vocabulary as V
from cataloom.operators import pricing, search


def market_overview(df: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row of counts, shares and means."""
    a = df.agg(
        F.count(F.lit(1)).alias("n_products"), F.count_distinct("brand").alias("n_brands"), F.count("price").alias("n_priced"), F.round(F.count("price") / F.count(F.lit(1)), 6).alias("price_coverage"),
        F.count_if("is_renewed").alias("n_renewed"), F.count_if("is_discrete_gpu").alias("n_discrete"), F.round(F.avg("average_rating"), 6).alias("mean_rating"), F.sum("rating_number").alias("n_ratings"),
        F.count_if("has_sentiment").alias("n_with_sentiment"), F.round(F.median("price"), 6).alias("median_price"),
    )
    b = reviews.agg(F.count(F.lit(1)).alias("n_reviews"), F.count_distinct("parent_asin").alias("n_reviewed"))
    return a.crossJoin(b)  # one row each


def product_detail(df: DataFrame, key: str, sentiment: DataFrame) -> DataFrame:
    """A listing's card, specs, price position and aspects."""
    row = search.lookup(df, key)
    asp = [F.struct(F.lit(a).alias("aspect"), F.col(f"{a}_mentions").alias("mentions"), F.col(f"{a}_polarity").alias("polarity")) for a in V.ASPECTS]
    mined = sentiment.where(F.col("parent_asin") == key).select("parent_asin", "overall_polarity", F.filter(F.array(*asp), lambda x: x["mentions"] > 0).alias("aspects"))
    place = pricing.positions(df).where(F.col("parent_asin") == key).drop("segment", "brand", "price")
    return row.select(*search.card(), search.specs().alias("specs")).join(place, "parent_asin", "left").join(mined, "parent_asin", "left")


def health(df: DataFrame, reviews: DataFrame, sentiment: DataFrame) -> DataFrame:
    """(artifact, rows) of the tables that serving needs, counted from footers."""
    rows = None
    for name, frame in (("products", df), ("reviews", reviews), ("product_sentiment", sentiment)):
        one = frame.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("artifact"), "rows")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def top_brands_with_focus(table: DataFrame, focus: str, n: int = 10) -> DataFrame:
    """The largest brands, and the focus brand when it isn't among them."""
    top = table.orderBy(F.desc("n_total"), "brand").limit(n)
    return top.unionByName(table.where(F.col("brand") == focus).join(top.select("brand"), "brand", "left_anti"))


def peers_with_profile(found: DataFrame, sentiment: DataFrame, n: int = 6) -> DataFrame:
    """Each query's first peers that have a sentiment profile."""
    from pyspark.sql import Window as W

    rows = found.join(sentiment.select(F.col("parent_asin").alias("candidate"), "overall_polarity", "n_reviews_scored"), "candidate")
    place = F.row_number().over(W.partitionBy("query").orderBy("rank"))  # at most k rows a query
    return rows.withColumn("place", place).where(F.col("place") <= n).select("query", "candidate", "place", "overall_polarity", "n_reviews_scored")
