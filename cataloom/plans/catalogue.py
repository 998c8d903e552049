"""Search, ingest and streaming queries over the catalogue and reviews, and their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom import catalog
from cataloom.functions import parse
from cataloom.functions.text import clean_text
from cataloom.operators import ingest, search
from cataloom.plans.pricing import CAT, SENT, marked
from cataloom.session import shared_dir, table
from cataloom.sources import io
from cataloom.streaming import ingest as streams

def empty_details():
    return F.create_map().cast("map<string,string>")


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Listings in the shape of raw items: title and store, no details."""
    p = catalog.products(spark, d)
    return p.select("parent_asin", "title", "store", F.create_map().cast("map<string,string>").alias("details"), F.array().cast("array<string>").alias("categories"), F.col("price").cast("string").alias("price"), "average_rating", "rating_number")


# ---------------------------------------------------------------- search


def search_text(spark, d):
    return search.page(marked(spark, d), search.Filters(), "kestova laptop", "relevance", 50)


def search_filters(spark, d):
    f = search.Filters(segments=("business", "gaming"), min_price=300, max_price=2500, min_ram=8, min_rating=3.5, with_sentiment=True)
    return marked(spark, d).where(search.predicate(f)).select(*search.card())


def search_sorted_page(spark, d):
    return search.page(marked(spark, d), search.Filters(min_ram=8), "", "price_desc", 24, 24)


def search_legacy_filters(spark, d):
    f = search.Filters(os_families=("Windows",), min_storage=256, min_tier=5, screen=(13, 16), min_price=200, max_price=3000, include_unpriced=True, min_ratings=5, exclude_renewed=True)
    return marked(spark, d).where(search.predicate(f)).select("parent_asin", "price", "os_family", "storage_gb")


def search_coverage(spark, d):
    return search.result_coverage(marked(spark, d), search.Filters(segments=("ultrabook",)))


def sample_listings(spark, d):
    return search.sample_products(marked(spark, d), "gaming", True, 500, 4000, 1, 25).select("parent_asin", "price", "n_reviews")


def default_pick(spark, d):
    return search.default_pick(marked(spark, d))


def display_table(spark, d):
    return search.display_table(marked(spark, d))


def price_ruler(spark, d):
    span = marked(spark, d).groupBy("segment").agg(F.min("price").alias("lo"), F.percentile("price", F.lit(0.9)).alias("hi"))
    rows = marked(spark, d).where("price IS NOT NULL").join(span, "segment")
    return rows.select("parent_asin", F.round(search.ruler(F.col("price"), F.col("lo"), F.col("hi")), 4).alias("position"))


def brand_vocabulary(spark, d):
    return catalog.products(spark, d).where("brand <> 'Unknown'").select("brand").distinct().orderBy("brand")


# ---------------------------------------------------------------- ingest


def semi_join_keep(spark, d):
    """Reviews of catalogue listings."""
    return io.keep_with_key(catalog.reviews(spark, d), catalog.products(spark, d)).select("review_id", "parent_asin")


def streaming_semi_join(spark, d):
    """The same over a stream of files, run to its end."""
    raw = table(spark, d, "reviews")
    stream = spark.readStream.schema(raw.schema).parquet(_folder(spark, d, "reviews"))
    kept = streams.keep_stream(stream.where("review_id IS NOT NULL").select("review_id", "parent_asin", "loaded_at"), catalog.products(spark, d), "parent_asin")
    return streams.drain(kept)


def _folder(spark: SparkSession, d: str, name: str) -> str:
    """A streaming source reads folders: a table in one file is linked into one by a copy in the shared folder."""
    import os

    path = f"{d}/{name}.parquet"
    if os.path.isdir(path):
        return path
    out = f"{shared_dir(spark)}/cataloom/stream-source-{hashlib.md5(path.encode()).hexdigest()}"
    spark.read.parquet(path).write.mode("overwrite").parquet(out)
    return out


def dedup_reviews(spark, d):
    """First review of each user, item and text."""
    r = catalog.reviews(spark, d).where("text IS NOT NULL")
    return ingest.distinct_reviews(r.select("review_id", "user_id", "asin", "text", "review_ts"), ["review_ts", "review_id"]).select("review_id", "user_id", "asin")


def review_counts(spark, d):
    return ingest.attach_counts(catalog.products(spark, d), catalog.reviews(spark, d)).select("parent_asin", "n_reviews")


def clean_documents(spark, d):
    """Whole texts without markup, common entities and extra white space."""
    return table(spark, d, "documents").select("doc_id", clean_text(F.col("text")).alias("text"))


def drop_reasons(spark, d):
    return ingest.drop_reasons(_items(spark, d))


def model_signature(spark, d):
    return catalog.products(spark, d).select("parent_asin", parse.model_signature(F.col("title"), F.col("brand")).alias("model_sig"))


def dedup_variants(spark, d):
    """Listings collapsed into models, with their number."""
    survivors, _ = ingest.collapse_variants(catalog.products(spark, d).drop("n_variants"))
    return survivors.select("parent_asin", "n_variants")


def variant_map(spark, d):
    return ingest.collapse_variants(catalog.products(spark, d).drop("n_variants"))[1]


def repointed_reviews(spark, d):
    survivors, variants = ingest.collapse_variants(catalog.products(spark, d).drop("n_variants"))
    return ingest.repoint(catalog.reviews(spark, d).select("review_id", "parent_asin"), survivors, variants).select("review_id", "parent_asin", "orig_parent_asin")


def parsed_specs(spark, d):
    """Every parser over every title."""
    names = ("brand", "is_renewed", "cpu_brand", "cpu_family", "cpu_tier", "cpu_ghz", "ram_gb", "ram_type", "storage_gb", "storage_type", "gpu_brand", "gpu_model", "is_discrete_gpu", "screen_in", "screen_w", "screen_h", "os_family", "weight_lb", "price")
    return ingest.expand_specs(_items(spark, d)).select("parent_asin", *names)


def title_storage(spark, d):
    """Storage and memory as titles state them."""
    p = catalog.products(spark, d)
    return p.select("parent_asin", parse.storage(empty_details(), F.col("title"))["storage_gb"].alias("storage_gb"), parse.ram(empty_details(), F.col("title"))["ram_gb"].alias("ram_gb"))


def title_os(spark, d):
    p = catalog.products(spark, d)
    return p.select("parent_asin", parse.os_family(empty_details(), F.col("title")).alias("os_family"), parse.renewed(F.col("store"), empty_details(), F.col("title")).alias("is_renewed"))


def rebuilt_catalogue(spark, d):
    """The whole ingest over titles: filter, parse, collapse, segment."""
    survivors, _ = ingest.catalogue(_items(spark, d))
    return survivors.select("parent_asin", "brand", "segment", "n_variants")


def segment_rules(spark, d):
    """The segment that the rules assign to each catalogue row."""
    names = ("title", "brand", "os_family", "is_discrete_gpu", "gpu_model", "ram_gb", "cpu_family", "weight_lb", "screen_in", "price")
    row = {n: F.col(n) for n in names} | {"series_raw": F.lit("")}
    return catalog.products(spark, d).select("parent_asin", parse.segment(row).alias("assigned"))


def sampled_reviews(spark, d):
    return io.sample(catalog.reviews(spark, d), "review_id", 500).select("review_id")


def category_filter(spark, d):
    """Listings by exact membership in a breadcrumb, here segment and system, with an entry that excludes."""
    cat = catalog.products(spark, d)
    return cat.where(io.in_category(F.array("segment", "os_family"), "business", "ChromeOS")).select("parent_asin", "segment")


def loaded_reviews(spark, d):
    """The review load: re-pointed, cleaned, two characters at least, typed, without repeats, dated."""
    survivors, variants = ingest.collapse_variants(catalog.products(spark, d).drop("n_variants"))
    raw = catalog.reviews(spark, d).drop("orig_parent_asin").withColumns({"title": F.col("review_title"), "timestamp": F.unix_millis(F.col("review_ts").cast("timestamp"))})
    return ingest.load_reviews(raw, survivors, variants).select("user_id", "asin", "text", "text_len", "review_year")


def json_rows(spark, d):
    """Catalogue rows as strict JSON."""
    return io.to_json(catalog.products(spark, d).select("parent_asin", "title", "price", "ram_gb", "is_renewed"))


QUERIES = {f.__name__: f for f in (search_text, search_filters, search_sorted_page, search_legacy_filters, search_coverage, sample_listings, default_pick, display_table, price_ruler, brand_vocabulary, semi_join_keep, streaming_semi_join, dedup_reviews, review_counts, clean_documents, drop_reasons, model_signature, dedup_variants, variant_map, repointed_reviews, parsed_specs, title_storage, title_os, rebuilt_catalogue, segment_rules, sampled_reviews, category_filter, loaded_reviews, json_rows)}

_MARK = "mk AS (SELECT c.*, s.parent_asin IS NOT NULL AS has_sentiment FROM cat c LEFT JOIN sent s USING (parent_asin))"
_PRICE_TEXT = "CASE WHEN price IS NULL THEN 'price not listed' ELSE '$' || format('{:,.2f}', price) END"
_CARD = f"""parent_asin, title, brand, segment, price, {_PRICE_TEXT} AS price_text, average_rating, n_reviews,
  CASE WHEN screen_w IS NOT NULL AND screen_h IS NOT NULL THEN CAST(screen_w AS BIGINT) || 'x' || CAST(screen_h AS BIGINT) ELSE 'unknown' END AS resolution"""
_BLOB = "lower(concat_ws(' ', title, brand, segment, cpu_family, gpu_model, os_family))"
_M = f"{CAT}, {SENT}, {_MARK}"
_REV = f"WITH {catalog.REVIEWS_SQL}"
# The entities that these texts hold; the query decodes all.
def _clean(c: str) -> str:
    out = f"coalesce({c}, '')"
    for _ in range(2):
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&apos;", "''"), ("&nbsp;", "\xa0"), ("&amp;", "&")):
            out = f"replace({out}, '{entity}', '{char}')"
    out = f"regexp_replace({out}, '<br ?/?>', ' ', 'g')"
    out = f"regexp_replace({out}, '<[^>]{{1,80}}>', ' ', 'g')"
    out = f"regexp_replace({out}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', ' ', 'g')"
    return f"trim(regexp_replace({out}, '[\\s\\x{{0B}}\\x{{A0}}]+', ' ', 'g'), ' ')"


_CLEAN = _clean("text")

_STOP = ", ".join(f"'{w}'" for w in parse.V.MODEL_STOPWORDS)
_GENERIC = ", ".join(f"'{w}'" for w in parse.V.GENERIC_MODEL)
_SIG = f"""sig0 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_split_to_array(split_part(lower(coalesce(title, '')), '(', 1), '\\||,|\\s-\\s|:')[1],
    '\\d+(?:\\.\\d+)?\\s*(?:gb|tb|mb|ghz|mhz|hz|wh|nits?)\\b', ' ', 'g'), '\\b(?:19|20)\\d{{2}}\\b', ' ', 'g'), '\\d+(?:\\.\\d+)?\\s*(?:"|''''|”|inch(?:es)?)', ' ', 'g'),
    '\\bi[3579][- ]?\\d{{3,5}}[a-z]{{0,2}}\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g') AS t FROM cat),
  sig1 AS (SELECT *, list_filter(regexp_split_to_array(t, ' +'), lambda w: length(w) > 1 AND w NOT IN ({_STOP}) AND NOT list_contains(regexp_split_to_array(regexp_replace(lower(brand), '[^a-z0-9 ]', ' ', 'g'), ' +'), w))[1:4] AS w FROM sig0),
  sig AS (SELECT * EXCLUDE (t, w), CASE WHEN len(w) = 0 OR (len(w) = 1 AND (w[1] IN ({_GENERIC}) OR length(w[1]) < 3)) THEN '' ELSE lower(brand) || '|' || array_to_string(w, ' ') END AS model_sig FROM sig1)"""
_VARIANTS = f"""{CAT}, {_SIG}, keyed AS (SELECT *, CASE WHEN model_sig = '' THEN '__uniq__' || parent_asin ELSE concat_ws('|', model_sig, coalesce(printf('%.1f', screen_in), 'na'), cpu_family, coalesce(printf('%.0f', cpu_tier), 'na'),
    gpu_model, CASE WHEN is_discrete_gpu THEN 'd' ELSE 'i' END, os_family, CASE WHEN is_renewed THEN 'R' ELSE 'N' END) END AS k,
    (cpu_ghz IS NOT NULL)::INT + (ram_gb IS NOT NULL)::INT + (storage_gb IS NOT NULL)::INT + (screen_in IS NOT NULL)::INT + (weight_lb IS NOT NULL)::INT + (price IS NOT NULL)::INT AS rich FROM sig),
  ranked AS (SELECT parent_asin, first_value(parent_asin) OVER w AS survivor, count(*) OVER (PARTITION BY k) AS n_variants FROM keyed WINDOW w AS (PARTITION BY k ORDER BY rating_number DESC, rich DESC, parent_asin))"""
_OSES = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(title, ''), '(?i){p}') THEN '{o}'" for p, o in parse.V.OS_FAMILIES) + " ELSE 'Unknown' END"


def _size(pattern: str, low: float, high: float) -> str:
    p = "(?i)" + pattern.replace("'", "''")
    v = f"""TRY_CAST(nullif(regexp_extract(title, '{p}', 1), '') AS DOUBLE) * CASE lower(left(regexp_extract(title, '{p}', 2), 1)) WHEN 't' THEN 1024.0 WHEN 'm' THEN 1 / 1024.0 ELSE 1 END"""
    return f"CASE WHEN {v} BETWEEN {low} AND {high} THEN {v} END"


_BUSINESS, _ULTRA, _GAMING = "|".join(parse.V.BUSINESS_HINTS), "|".join(parse.V.ULTRABOOK_HINTS), "|".join(parse.V.GAMING_HINTS)
_PREMIUM, _BUDGET = (", ".join(f"'{c}'" for c in x) for x in (parse.V.PREMIUM_CPUS, parse.V.BUDGET_CPUS))

ORACLES = {
    "search_text": f"""{_M}, hit AS (SELECT *, CASE WHEN contains(lower(coalesce(title, '')), 'kestova') THEN 2 ELSE 1 END + CASE WHEN contains(lower(coalesce(title, '')), 'laptop') THEN 2 ELSE 1 END
        + CASE WHEN contains(lower(coalesce(title, '')), 'kestova laptop') THEN 6 WHEN contains(left(lower(coalesce(title, '')), 60), 'kestova') THEN 1 ELSE 0 END + ln(1 + rating_number) / 25 AS score
        FROM mk WHERE contains({_BLOB}, 'kestova') AND contains({_BLOB}, 'laptop'))
      SELECT CAST(row_number() OVER (ORDER BY score DESC, parent_asin) AS INTEGER) AS rank, {_CARD} FROM hit QUALIFY rank <= 50""",
    "search_filters": f"{_M} SELECT {_CARD} FROM mk WHERE segment IN ('business', 'gaming') AND price BETWEEN 300 AND 2500 AND ram_gb >= 8 AND average_rating >= 3.5 AND has_sentiment",
    "search_sorted_page": f"{_M} SELECT CAST(row_number() OVER (ORDER BY price DESC NULLS LAST, parent_asin) AS INTEGER) AS rank, {_CARD} FROM mk WHERE ram_gb >= 8 QUALIFY rank BETWEEN 25 AND 48",
    "search_legacy_filters": f"""{_M} SELECT parent_asin, price, os_family, storage_gb FROM mk WHERE os_family = 'Windows' AND storage_gb >= 256 AND cpu_tier >= 5 AND screen_in BETWEEN 13 AND 16 AND (price IS NULL OR price BETWEEN 200 AND 3000) AND rating_number >= 5 AND NOT is_renewed""",
    "search_coverage": f"{_M} SELECT count(*) AS total, count(price) AS priced, round(count(price) / count(*), 6) AS coverage FROM mk WHERE segment = 'ultrabook'",
    "sample_listings": f"{_M} SELECT parent_asin, price, n_reviews FROM mk WHERE segment = 'gaming' AND price BETWEEN 500 AND 4000 AND n_reviews >= 1 ORDER BY n_reviews DESC, parent_asin LIMIT 25",
    "default_pick": f"{_M} SELECT parent_asin, n_reviews, price, has_sentiment FROM mk ORDER BY (price IS NOT NULL AND has_sentiment) DESC, n_reviews DESC, parent_asin LIMIT 1",
    "display_table": f"""{_M} SELECT parent_asin, {_PRICE_TEXT} AS price, CASE WHEN ram_gb IS NULL THEN 'unknown' ELSE printf('%.0f GB', ram_gb) END AS ram, CASE WHEN screen_in IS NULL THEN 'unknown' ELSE printf('%.1f in', screen_in) END AS screen,
      CASE WHEN average_rating IS NULL THEN 'unknown' ELSE printf('%.1f', average_rating) END AS rating FROM mk""",
    "price_ruler": f"""{CAT}, s AS (SELECT segment, min(price) AS lo, quantile_cont(price, 0.9) AS hi FROM cat GROUP BY segment) SELECT parent_asin, round(CASE WHEN hi > lo THEN greatest(0, least(100, 100 * (price - lo) / (hi - lo))) ELSE 0 END, 4) AS position FROM cat JOIN s USING (segment) WHERE price IS NOT NULL""",
    "brand_vocabulary": f"{CAT} SELECT DISTINCT brand FROM cat WHERE brand <> 'Unknown'",
    "semi_join_keep": f"{_REV} SELECT review_id, parent_asin FROM rev WHERE parent_asin IN (SELECT parent_asin FROM products WHERE parent_asin IS NOT NULL)",
    "streaming_semi_join": "SELECT review_id, parent_asin, loaded_at FROM reviews WHERE review_id IS NOT NULL AND parent_asin IN (SELECT parent_asin FROM products WHERE parent_asin IS NOT NULL)",
    "dedup_reviews": f"{_REV} SELECT review_id, user_id, asin FROM rev WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, asin, text ORDER BY review_ts NULLS FIRST, review_id) = 1",
    "review_counts": f"{CAT}, {catalog.REVIEWS_SQL}, n AS (SELECT parent_asin, count(*) AS n FROM rev GROUP BY ALL) SELECT c.parent_asin, coalesce(n.n, 0) AS n_reviews FROM cat c LEFT JOIN n USING (parent_asin)",
    "clean_documents": f"SELECT doc_id, {_CLEAN} AS text FROM documents",
    "sampled_reviews": f"{_REV} SELECT review_id FROM rev ORDER BY md5(review_id || ':42'), review_id LIMIT 500",
    "category_filter": f"{CAT} SELECT parent_asin, segment FROM cat WHERE segment = 'business' AND os_family <> 'ChromeOS'",
    "loaded_reviews": f"""{_VARIANTS}, {catalog.REVIEWS_SQL}, m AS (SELECT r.user_id, r.asin, v.survivor AS parent_asin, {_clean("r.text")} AS text, r.review_ts FROM rev r JOIN ranked v USING (parent_asin))
      SELECT user_id, asin, text, length(text) AS text_len, CAST(year(review_ts) AS SMALLINT) AS review_year FROM m WHERE length(text) >= 2 AND review_ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, asin, text ORDER BY review_ts, parent_asin) = 1""",
    "json_rows": f"{CAT} SELECT CAST(to_json({{'parent_asin': parent_asin, 'title': title, 'price': price, 'ram_gb': ram_gb, 'is_renewed': is_renewed}}) AS VARCHAR) AS json FROM cat",
    "model_signature": f"{CAT}, {_SIG} SELECT parent_asin, model_sig FROM sig",
    "dedup_variants": f"{_VARIANTS} SELECT parent_asin, n_variants FROM ranked WHERE parent_asin = survivor",
    "variant_map": f"{_VARIANTS} SELECT parent_asin, survivor FROM ranked WHERE parent_asin <> survivor",
    "repointed_reviews": f"{_VARIANTS}, {catalog.REVIEWS_SQL} SELECT r.review_id, v.survivor AS parent_asin, r.parent_asin AS orig_parent_asin FROM rev r JOIN ranked v USING (parent_asin)",
    "title_storage": f"""{CAT} SELECT parent_asin, coalesce({", ".join(_size(p, 4, 16384) for p in parse.V.STORAGE_TITLE)}) AS storage_gb, coalesce({", ".join(_size(p, 0.12, 256) for p in parse.V.RAM_TITLE)}) AS ram_gb FROM cat""",
    "title_os": f"{CAT} SELECT parent_asin, {_OSES} AS os_family, regexp_matches(concat_ws(' ', store, title), '(?i){parse.V.RENEWED}') AS is_renewed FROM cat",
    "segment_rules": f"""{CAT}, t AS (SELECT *, concat_ws(' ', brand, '', title) AS x FROM cat) SELECT parent_asin, CASE WHEN os_family = 'ChromeOS' OR regexp_matches(x, '(?i)chromebook') THEN 'chromebook'
      WHEN is_discrete_gpu AND (regexp_matches(x, '(?i)\\b(gaming|gamer|{_GAMING})\\b') OR regexp_matches(gpu_model, '(?i)\\b(rtx|gtx)\\b')) THEN 'gaming' WHEN regexp_matches(x, '(?i)\\b({_BUSINESS})\\b') THEN 'business'
      WHEN regexp_matches(x, '(?i)({_ULTRA}|\\bultrabook\\b|\\bultra ?slim\\b)') THEN 'ultrabook'
      WHEN weight_lb <= 3.3 AND (coalesce(price >= 900, false) OR (cpu_family IN ({_PREMIUM}) AND coalesce(ram_gb >= 8, false))) AND coalesce(screen_in <= 15, true) AND NOT is_discrete_gpu THEN 'ultrabook'
      WHEN coalesce(price < 400, false) OR cpu_family IN ({_BUDGET}) OR coalesce(ram_gb <= 4, false) THEN 'budget' ELSE 'mainstream' END AS assigned FROM t""",
}
