"""Price queries over the catalogue and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom import catalog
from cataloom.functions import vocabulary as V
from cataloom.functions.stats import PRICE_BLOCK_SQL
from cataloom.operators import models, overview, pricing, search
from cataloom.session import table

CAT = f"WITH {catalog.PRODUCTS_SQL}"
SENT = "sent AS (SELECT parent_asin FROM product_sentiment)"
COVERAGE_COLUMNS = ["brand", "cpu_family", "cpu_tier", "cpu_ghz", "ram_gb", "storage_gb", "screen_in", "weight_lb", "price", "average_rating", "gpu_model", "is_renewed"]


def _cat(spark: SparkSession, d: str) -> DataFrame:
    return catalog.products(spark, d)


def marked(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue with has_sentiment."""
    scored = table(spark, d, "product_sentiment").select("parent_asin", F.lit(True).alias("has_sentiment"))
    return _cat(spark, d).join(scored, "parent_asin", "left").fillna(False, ["has_sentiment"])


def segment_price_table(spark, d):
    return pricing.group_price_table(_cat(spark, d), "segment")


def segment_overview(spark, d):
    return pricing.segment_table(_cat(spark, d), table(spark, d, "product_sentiment")).select("segment", "n_total", "median", "n_with_sentiment", "sentiment_coverage", "share_of_catalogue")


def brand_price_table(spark, d):
    return pricing.brand_price_table(_cat(spark, d), 5, 20)


def brand_list_sorted(spark, d):
    """The brand list in one of its sorts, with positions."""
    from pyspark.sql import Window as W

    t = pricing.brand_price_table(_cat(spark, d), 5, 100)
    key = [F.desc_nulls_last("coverage"), F.lower("brand"), F.col("brand")]
    return pricing.order_brands(t, "coverage", True).select("brand", "coverage", F.row_number().over(W.orderBy(*key)).alias("position"))  # at most 100 rows


def discrete_premium(spark, d):
    return pricing.discrete_premium(_cat(spark, d))


def price_rating(spark, d):
    return pricing.price_rating(_cat(spark, d))


def rating_by_price_quartile(spark, d):
    return pricing.rating_by_price_quartile(_cat(spark, d))


def premium_significance(spark, d):
    return pricing.premium_p_values(pricing.discrete_premium(_cat(spark, d))).select("segment", "z", "p_value")


def correlation_significance(spark, d):
    return pricing.correlation_p_values(pricing.price_rating(_cat(spark, d))).select("segment", "n", "pearson_p", "spearman_p")


def focus_brands(spark, d):
    """The ten largest brands, and one that need not be among them."""
    return overview.top_brands_with_focus(pricing.brand_price_table(_cat(spark, d), 5, 1000), "Orbis Nine", 10).select("brand", "n_total", "median")


def coverage_bias(spark, d):
    return pricing.coverage_bias(_cat(spark, d))


def segment_coverage_spread(spark, d):
    return pricing.segment_coverage_spread(_cat(spark, d))


def implausible_prices(spark, d):
    return pricing.implausible_prices(_cat(spark, d))


def spec_price_ratios(spark, d):
    return pricing.spec_price_ratios(_cat(spark, d))


def validation_checks(spark, d):
    return pricing.validation_checks(_cat(spark, d))


def column_coverage(spark, d):
    return pricing.column_coverage(_cat(spark, d), COVERAGE_COLUMNS)


def segment_counts(spark, d):
    return pricing.value_counts(_cat(spark, d), "segment", V.SEGMENTS)


def brand_counts(spark, d):
    return pricing.value_counts(_cat(spark, d), "brand", top=15)


def corpus_medians(spark, d):
    return pricing.corpus_medians(_cat(spark, d))


def price_histogram(spark, d):
    return pricing.histogram(_cat(spark, d))


def price_position_segment(spark, d):
    return pricing.price_position(_cat(spark, d), "segment", "vs_segment")


def price_position_brand(spark, d):
    return pricing.price_position(_cat(spark, d), "brand", "vs_brand")


def price_vs_value(spark, d):
    return pricing.price_vs_value(_cat(spark, d))


def value_outliers(spark, d):
    return pricing.outliers(pricing.price_vs_value(_cat(spark, d)), "price_per_ram_gb", 10).select("parent_asin", "price_per_ram_gb", "side")


def compare_products(spark, d):
    """The five most reviewed listings side by side."""
    cat = _cat(spark, d)
    keys = [r[0] for r in cat.orderBy(F.desc("n_reviews"), "parent_asin").limit(5).select("parent_asin").collect()]
    return pricing.compare_products(cat, keys)


def market_overview(spark, d):
    return overview.market_overview(marked(spark, d), catalog.reviews(spark, d))


def artifact_health(spark, d):
    return overview.health(*(table(spark, d, t) for t in ("products", "reviews", "product_sentiment")))


def product_detail(spark, d):
    cat = marked(spark, d)
    key = search.default_pick(cat).first()[0]
    return overview.product_detail(cat, key, table(spark, d, "product_sentiment"))


def price_model(spark, d):
    return models.price_model(_cat(spark, d))


QUERIES = {f.__name__: f for f in (segment_price_table, segment_overview, brand_price_table, brand_list_sorted, discrete_premium, price_rating, premium_significance, correlation_significance, focus_brands, rating_by_price_quartile, coverage_bias, segment_coverage_spread, implausible_prices, spec_price_ratios, validation_checks, column_coverage, segment_counts, brand_counts, corpus_medians, price_histogram, price_position_segment, price_position_brand, price_vs_value, value_outliers, compare_products, market_overview, artifact_health, product_detail, price_model)}

_GROUP = f"{PRICE_BLOCK_SQL}, count(*) FILTER (is_renewed) AS n_renewed, round(avg(average_rating), 6) AS mean_rating"
_BRANDS = f"""brands AS (SELECT brand, {_GROUP}, count(*) - count(price) AS n_unpriced, count(price) < 5 AS unreliable, round(count(*) / (SELECT count(*) FROM cat), 6) AS share_of_catalogue
  FROM cat GROUP BY brand HAVING count(*) >= 5)"""


def _position(group: str, prefix: str) -> str:
    return f"""{CAT}, peers AS (SELECT a.parent_asin, any_value(a.price) AS price, count(b.price) AS n, median(b.price) AS m,
      count(b.price) FILTER (b.price < a.price) AS below, count(b.price) FILTER (b.price = a.price) AS same
      FROM cat a LEFT JOIN cat b ON a.{group} = b.{group} AND a.parent_asin <> b.parent_asin AND b.price IS NOT NULL WHERE a.price IS NOT NULL GROUP BY a.parent_asin)
    SELECT parent_asin, n AS {prefix}_n, round(m, 6) AS {prefix}_median, CASE WHEN n > 0 THEN round(100 * (below + 0.5 * same) / n, 6) END AS {prefix}_percentile,
      round(price - m, 6) AS {prefix}_delta_usd, round(100 * (price / m - 1), 6) AS {prefix}_delta_pct, round(price / m, 6) AS {prefix}_ratio,
      CASE WHEN m IS NULL THEN 'unknown' WHEN round(price / m, 6) < 0.85 THEN 'cheaper' WHEN round(price / m, 6) > 1.15 THEN 'premium' ELSE 'comparable' END AS {prefix}_label, n >= 5 AS {prefix}_reliable FROM peers"""


# plain quotients are the same double in both engines and stay as they are
_METRICS = """CASE WHEN ram_gb > 0 THEN price / ram_gb END AS price_per_ram_gb, CASE WHEN storage_gb > 0 THEN price / (storage_gb / 100) END AS price_per_100gb,
  CASE WHEN screen_in > 0 THEN price / screen_in END AS price_per_inch, average_rating / (price / 100) AS rating_per_100usd"""
_VALUE = f"""val AS (SELECT parent_asin, segment, price, {_METRICS}, round(median(price) OVER (PARTITION BY segment), 6) AS segment_median,
  round(100 * (rank() OVER (PARTITION BY segment ORDER BY price) + (count(*) OVER (PARTITION BY segment, price) - 1) / 2) / count(*) OVER (PARTITION BY segment), 6) AS pct_rank,
  round(price / median(price) OVER (PARTITION BY segment), 6) AS ratio FROM cat WHERE price IS NOT NULL)"""
_LABEL = "CASE WHEN ratio < 0.85 THEN 'cheaper' WHEN ratio > 1.15 THEN 'premium' ELSE 'comparable' END"
_SEGMENTS = ", ".join(f"('{s}', {i})" for i, s in enumerate(V.SEGMENTS))
_ORDER = ", ".join(f"('{a}', '{b}')" for a, b in V.MEDIAN_ORDER)


def _known(c: str) -> str:
    return f"count(*) FILTER (lower(trim({c})) NOT IN ('', 'unknown'))" if c in ("brand", "cpu_family", "gpu_model") else f"count({c})"


ORACLES = {
    "segment_price_table": f"{CAT} SELECT segment, {_GROUP} FROM cat GROUP BY segment",
    "segment_overview": f"""{CAT}, {SENT} SELECT c.segment, count(*) AS n_total, round(quantile_cont(c.price, 0.5), 6) AS median, count(s.parent_asin) AS n_with_sentiment,
      round(count(s.parent_asin) / count(*), 6) AS sentiment_coverage, round(count(*) / sum(count(*)) OVER (), 6) AS share_of_catalogue FROM cat c LEFT JOIN sent s USING (parent_asin) GROUP BY c.segment""",
    "brand_price_table": f"{CAT}, {_BRANDS} SELECT * FROM brands ORDER BY n_total DESC, brand LIMIT 20",
    "focus_brands": f"{CAT}, {_BRANDS}, top AS (SELECT * FROM brands ORDER BY n_total DESC, brand LIMIT 10) SELECT brand, n_total, median FROM top UNION SELECT brand, n_total, median FROM brands WHERE brand = 'Orbis Nine'",
    "brand_list_sorted": f"{CAT}, {_BRANDS} SELECT brand, coverage, row_number() OVER (ORDER BY coverage DESC NULLS LAST, lower(brand), brand) AS position FROM (SELECT * FROM brands ORDER BY n_total DESC, brand LIMIT 100)",
    "discrete_premium": f"""{CAT}, b AS (SELECT 'ALL' AS segment, price, is_discrete_gpu AS d FROM cat UNION ALL SELECT segment, price, is_discrete_gpu FROM cat),
      agg AS (SELECT segment, count(*) FILTER (d) AS td, count(*) FILTER (NOT d) AS ti, count(price) FILTER (d) AS n_discrete, count(price) FILTER (NOT d) AS n_integrated,
        median(price) FILTER (d) AS md, median(price) FILTER (NOT d) AS mi FROM b GROUP BY segment),
      r AS (SELECT segment, d, price, rank() OVER (PARTITION BY segment ORDER BY price) + (count(*) OVER (PARTITION BY segment, price) - 1) / 2 AS rk FROM b WHERE price IS NOT NULL),
      s AS (SELECT segment, sum(rk) FILTER (d) AS rs FROM r GROUP BY segment),
      t AS (SELECT segment, sum(k * k * k - k) AS ties FROM (SELECT segment, CAST(count(*) AS DOUBLE) AS k FROM r GROUP BY segment, price) GROUP BY segment),
      u AS (SELECT *, coalesce(rs, 0) - n_discrete * (n_discrete + 1) / 2 AS u0, CAST(n_discrete AS DOUBLE) * n_integrated AS prod, n_discrete + n_integrated AS nn FROM agg LEFT JOIN s USING (segment) LEFT JOIN t USING (segment))
      SELECT segment, n_discrete, n_integrated, round(n_discrete / nullif(td, 0), 6) AS coverage_discrete, round(n_integrated / nullif(ti, 0), 6) AS coverage_integrated,
        round(md, 6) AS median_discrete, round(mi, 6) AS median_integrated, round(md - mi, 6) AS premium_usd, round(100 * (md - mi) / mi, 6) AS premium_pct, n_discrete >= 5 AND n_integrated >= 5 AS reliable,
        CASE WHEN prod > 0 THEN round(u0, 4) END AS u, CASE WHEN prod > 0 AND nn > 1 THEN round((u0 - prod / 2) / nullif(sqrt(prod / 12 * (nn + 1 - ties / (CAST(nn AS DOUBLE) * (nn - 1)))), 0), 6) END AS z FROM u""",
    "price_rating": f"""{CAT}, p AS (SELECT segment, price, average_rating AS rating FROM cat WHERE rating_number >= 20 AND price IS NOT NULL AND average_rating IS NOT NULL),
      b AS (SELECT 'ALL' AS segment, price, rating FROM p UNION ALL SELECT * FROM p),
      r AS (SELECT *, rank() OVER (PARTITION BY segment ORDER BY price) + (count(*) OVER (PARTITION BY segment, price) - 1) / 2 AS rp, rank() OVER (PARTITION BY segment ORDER BY rating) + (count(*) OVER (PARTITION BY segment, rating) - 1) / 2 AS rr FROM b)
      SELECT segment, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(corr(price, rating), 6) END AS pearson, CASE WHEN count(*) >= 3 THEN round(corr(rp, rr), 6) END AS spearman, count(*) >= 30 AS reliable FROM r GROUP BY segment""",
    "rating_by_price_quartile": f"""{CAT}, p AS (SELECT price, average_rating AS rating FROM cat WHERE rating_number >= 20 AND price IS NOT NULL AND average_rating IS NOT NULL),
      e AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.5) AS b, quantile_cont(price, 0.75) AS c FROM p)
      SELECT CASE WHEN price <= a THEN 1 WHEN price <= b THEN 2 WHEN price <= c THEN 3 ELSE 4 END AS quartile, count(*) AS n, round(avg(rating), 6) AS mean_rating FROM p, e GROUP BY ALL""",
    "coverage_bias": f"""{CAT} SELECT price IS NOT NULL AS priced, count(*) AS n, round(avg(average_rating), 6) AS mean_rating, round(avg(rating_number), 6) AS mean_rating_number, median(rating_number) AS median_rating_number,
      median(ram_gb) AS median_ram_gb, round(avg(CAST(is_renewed AS INT)), 6) AS share_renewed, round(avg(CAST(is_discrete_gpu AS INT)), 6) AS share_discrete FROM cat GROUP BY ALL""",
    "segment_coverage_spread": f"""{CAT}, t AS (SELECT segment, count(price) AS p, count(*) AS n FROM cat GROUP BY segment)
      SELECT segment, round(p / sum(p) OVER (), 6) AS share_priced, round((n - p) / sum(n - p) OVER (), 6) AS share_unpriced, round(max(p / n) OVER () - min(p / n) OVER (), 6) AS coverage_spread FROM t""",
    "implausible_prices": f"""{CAT} SELECT parent_asin, title, brand, segment, price, CASE WHEN price < 50 THEN 'below 50' ELSE 'above 10000' END AS reason FROM cat WHERE price < 50 OR price > 10000""",
    "spec_price_ratios": f"""{CAT}, r AS (SELECT 'price_per_ram_gb' AS ratio, CASE WHEN ram_gb > 0 THEN price / ram_gb END AS v FROM cat UNION ALL SELECT 'price_per_100gb', CASE WHEN storage_gb > 0 THEN price / (storage_gb / 100) END FROM cat)
      SELECT ratio, count(v) AS n, round(median(v), 6) AS median FROM r GROUP BY ratio""",
    "validation_checks": f"""{CAT}, seg AS (SELECT segment, {PRICE_BLOCK_SQL} FROM cat GROUP BY segment), voc(s, i) AS (VALUES {_SEGMENTS}), ord(lo, hi) AS (VALUES {_ORDER}),
      names AS (SELECT 'unexpected ' || segment AS s FROM seg WHERE segment NOT IN (SELECT s FROM voc) UNION ALL SELECT 'absent ' || s FROM voc WHERE s NOT IN (SELECT segment FROM seg)),
      wrong AS (SELECT count(*) AS w FROM ord LEFT JOIN seg a ON a.segment = lo LEFT JOIN seg b ON b.segment = hi WHERE NOT coalesce(a.median < b.median, false)),
      odd AS (SELECT count(*) FILTER (price < 50 OR price > 10000) AS o, count(price) AS n, count(*) AS t FROM cat)
      SELECT 'vocabulary' AS "check", count(*) = 0 AS passed, coalesce(string_agg(s, ', ' ORDER BY s), '') AS detail FROM names
      UNION ALL SELECT 'median_order', w = 0, w || ' of 6 pairs out of order' FROM wrong UNION ALL SELECT 'implausible', o < 0.01 * n, o || ' implausible' FROM odd
      UNION ALL SELECT 'small_samples', count(*) FILTER (NOT reliable) = 0, count(*) FILTER (NOT reliable) || ' unreliable segments' FROM seg
      UNION ALL SELECT 'consistency', count(*) FILTER (n > n_total OR p10 > p25 OR p25 > median OR median > p75 OR p75 > p90) = 0, count(*) FILTER (n > n_total OR p10 > p25 OR p25 > median OR median > p75 OR p75 > p90) || ' inconsistent segments' FROM seg
      UNION ALL SELECT 'coverage', n > 0, n || ' of ' || t || ' priced' FROM odd""",
    "column_coverage": CAT + " " + " UNION ALL ".join(f"""SELECT '{c}' AS "column", {_known(c)} AS known, count(*) AS total, round({_known(c)} / count(*), 6) AS share FROM cat""" for c in COVERAGE_COLUMNS),
    "segment_counts": f"""{CAT}, voc(value, position) AS (VALUES {_SEGMENTS}), c AS (SELECT segment AS value, count(*) AS n FROM cat GROUP BY segment)
      SELECT value, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM cat), 6) AS share, position FROM voc LEFT JOIN c USING (value)""",
    "brand_counts": f"""{CAT} SELECT brand AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM cat), 6) AS share, CAST(row_number() OVER (ORDER BY count(*) DESC, brand) - 1 AS INTEGER) AS position FROM cat GROUP BY brand ORDER BY n DESC, value LIMIT 15""",
    "corpus_medians": f"""{CAT} SELECT count(*) AS n_total, median(ram_gb) AS ram_gb, median(storage_gb) AS storage_gb, median(screen_in) AS screen_in, round(quantile_cont(price, 0.1), 6) AS price_p10, round(quantile_cont(price, 0.9), 6) AS price_p90 FROM cat""",
    "price_histogram": f"""{CAT}, e AS (SELECT min(price) AS lo, max(price) AS hi FROM cat) SELECT segment, CAST(least(floor((price - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 40), 39) AS INTEGER) AS bin, count(*) AS n FROM cat, e WHERE price IS NOT NULL GROUP BY ALL""",
    "price_position_segment": _position("segment", "vs_segment"),
    "price_position_brand": _position("brand", "vs_brand"),
    "price_vs_value": f"{CAT}, {_VALUE} SELECT *, {_LABEL} AS label FROM val",
    "value_outliers": f"""{CAT}, {_VALUE}, k AS (SELECT parent_asin, price_per_ram_gb FROM val WHERE price_per_ram_gb IS NOT NULL)
      (SELECT *, 'low' AS side FROM k ORDER BY price_per_ram_gb, parent_asin LIMIT 10) UNION ALL (SELECT *, 'high' FROM k ORDER BY price_per_ram_gb DESC, parent_asin LIMIT 10)""",
    "compare_products": f"""{CAT}, five AS (SELECT *, CAST(row_number() OVER (ORDER BY n_reviews DESC, parent_asin) - 1 AS INTEGER) AS position FROM cat QUALIFY position < 5)
      SELECT f.position, f.parent_asin, f.brand, f.segment, f.price, (SELECT round(median(price), 6) FROM cat c WHERE c.segment = f.segment) AS segment_median,
        CASE WHEN f.price IS NOT NULL THEN (SELECT round(100 * (count(*) FILTER (c.price < f.price) + 0.5 * count(*) FILTER (c.price = f.price)) / count(c.price), 6) FROM cat c WHERE c.segment = f.segment) END AS segment_percentile,
        {_METRICS.replace("ram_gb", "f.ram_gb").replace("price_per_f.ram_gb", "price_per_ram_gb").replace("storage_gb", "f.storage_gb").replace("screen_in", "f.screen_in").replace("average_rating", "f.average_rating").replace("THEN price", "THEN f.price").replace("(price", "(f.price")} FROM five f""",
    "market_overview": f"""{CAT}, {catalog.REVIEWS_SQL}, {SENT} SELECT (SELECT count(*) FROM cat) AS n_products, count(DISTINCT brand) AS n_brands, count(price) AS n_priced, round(count(price) / count(*), 6) AS price_coverage,
      count(*) FILTER (is_renewed) AS n_renewed, count(*) FILTER (is_discrete_gpu) AS n_discrete, round(avg(average_rating), 6) AS mean_rating, CAST(sum(rating_number) AS BIGINT) AS n_ratings,
      count(*) FILTER (parent_asin IN (SELECT parent_asin FROM sent)) AS n_with_sentiment, round(median(price), 6) AS median_price, (SELECT count(*) FROM rev) AS n_reviews, (SELECT count(DISTINCT parent_asin) FROM rev) AS n_reviewed FROM cat""",
    "artifact_health": "SELECT 'products' AS artifact, count(*) AS rows FROM products UNION ALL SELECT 'reviews', count(*) FROM reviews UNION ALL SELECT 'product_sentiment', count(*) FROM product_sentiment",
}
