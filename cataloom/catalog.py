"""The catalogue entities that the operators work on, built from the driver's tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.functions.missing import folded, known_number, known_text
from cataloom.session import latest, table

_TEXTS = ["cpu_brand", "cpu_family", "ram_type", "storage_type", "gpu_brand", "gpu_model", "os_family"]
_PLAIN = ["cpu_tier", "cpu_ghz", "screen_in", "screen_w", "screen_h", "weight_lb", "average_rating"]
_COUNTS = ["rating_number", "n_reviews", "n_variants"]
_ALL = ["title", "brand", "store", "is_renewed", "is_discrete_gpu", *_TEXTS, *_PLAIN, "ram_gb", "storage_gb", "price", *_COUNTS, "segment"]


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per parent_asin: the latest, sizes in GB, unusable prices null, absent categories ``Unknown`` (segment ``unknown``)."""
    raw = latest(table(spark, sf_dir, "products").withColumn("_at", F.col("loaded_at")), "parent_asin", "_at", _ALL)
    return raw.select(
        "parent_asin",
        "title",
        F.coalesce(known_text(F.trim("brand")), F.lit("Unknown")).alias("brand"),
        "store",
        F.coalesce("is_renewed", F.lit(False)).alias("is_renewed"),
        F.coalesce("is_discrete_gpu", F.lit(False)).alias("is_discrete_gpu"),
        *[F.coalesce(known_text(F.trim(c)), F.lit("Unknown")).alias(c) for c in _TEXTS],
        *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in _PLAIN],
        F.when(F.col("ram_gb") >= 1024, F.col("ram_gb") / 1024).otherwise(F.col("ram_gb")).alias("ram_gb"),
        F.when(F.col("storage_gb") < 16, F.col("storage_gb") * 1024).otherwise(F.col("storage_gb")).alias("storage_gb"),
        known_number(F.col("price")).alias("price"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS],
        F.coalesce(folded(known_text(F.col("segment"))), F.lit("unknown")).alias("segment"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per review_id: the latest."""
    r = table(spark, sf_dir, "reviews").withColumn("_at", F.col("loaded_at"))
    columns = ["parent_asin", "orig_parent_asin", "asin", "user_id", "review_title", "text", "rating", "helpful_vote", "verified_purchase", "review_ts", "review_year"]
    return latest(r, "review_id", "_at", columns)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parent_asin, embedding): the usable vector of the smallest vec_id of each product, at unit length."""
    v = table(spark, sf_dir, "product_vectors").where("parent_asin IS NOT NULL AND size(embedding) = 384")
    one = v.groupBy("parent_asin").agg(F.min_by("embedding", F.struct("vec_id", F.xxhash64("embedding"))).alias("e"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)  # all are of one length; null becomes NaN
            norm = np.sqrt((x * x).sum(1))
            keep = np.isfinite(norm) & (norm > 0)
            x = x[keep] / norm[keep, None]
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), arrays], names=["parent_asin", "embedding"])

    return one.mapInArrow(unit, "parent_asin string, embedding array<double>")



_MISSING = """('', '-', '--', '---', '?', '??', 'n/a', 'na', 'n.a.', 'nan', 'nil', 'none', 'null', 'tbd', 'tba', 'unknown', 'not available',
 'not applicable', 'not specified', 'not known', 'unspecified', 'undefined', 'see description', 'missing')"""


def _fold(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200B}}\\x{{202F}}\\x{{3000}}\\x{{FEFF}}]+', ' ', 'g'))"


def _known(c: str) -> str:
    return f"CASE WHEN {_fold(c)} NOT IN {_MISSING} THEN trim({c}, ' ') END"


#: The same entities in SQL, as common table expressions.
PRODUCTS_SQL = f"""
cat AS MATERIALIZED (SELECT parent_asin, title, coalesce({_known("brand")}, 'Unknown') AS brand, store,
  coalesce(is_renewed, false) AS is_renewed, coalesce(is_discrete_gpu, false) AS is_discrete_gpu,
  {", ".join(f"coalesce({_known(c)}, 'Unknown') AS {c}" for c in _TEXTS)},
  {", ".join(f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" for c in _PLAIN)},
  CASE WHEN ram_gb >= 1024 THEN ram_gb / 1024 ELSE ram_gb END AS ram_gb,
  CASE WHEN storage_gb < 16 THEN storage_gb * 1024 ELSE storage_gb END AS storage_gb,
  CASE WHEN NOT isnan(price) AND price BETWEEN 20 AND 20000 THEN price END AS price,
  {", ".join(f"coalesce({c}, 0) AS {c}" for c in _COUNTS)},
  coalesce(CASE WHEN {_fold("segment")} NOT IN {_MISSING} THEN {_fold("segment")} END, 'unknown') AS segment
  FROM (SELECT *, row_number() OVER (PARTITION BY parent_asin ORDER BY loaded_at DESC) AS rn FROM products WHERE parent_asin IS NOT NULL) WHERE rn = 1)"""
REVIEWS_SQL = """
rev AS MATERIALIZED (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY loaded_at DESC) AS rn FROM reviews WHERE review_id IS NOT NULL) WHERE rn = 1)"""
VECTORS_SQL = """
vec AS MATERIALIZED (SELECT parent_asin, embedding FROM (SELECT parent_asin, embedding, row_number() OVER (PARTITION BY parent_asin ORDER BY vec_id) AS rn
  FROM product_vectors WHERE parent_asin IS NOT NULL AND len(embedding) = 384) WHERE rn = 1 AND list_sum(list_transform(embedding, lambda x: x * x)) > 0)"""
