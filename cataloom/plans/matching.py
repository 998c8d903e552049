"""Competitor queries: listings whose number is divisible by 20 against all, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cataloom import catalog
from cataloom.functions import vocabulary as V
from cataloom.operators import matching, overview
from cataloom.plans.pricing import CAT
from cataloom.session import staged, table

GUARDED, UNGUARDED = matching.Options(k=10), matching.Options(k=10, guard=False)


def _both(spark, d):
    """(query listings, all listings with a vector): a listing asks when its smallest vec_id is divisible by 20."""
    listings = catalog.products(spark, d).select("parent_asin", "title", "brand", "segment", "is_renewed", "cpu_family", *[n for n, *_ in matching.FEATURES])
    # the levels of the estimate and the features read the listings again and again
    feats = staged(matching.features(staged(listings, "match-listings"), catalog.vectors(spark, d)), "match-features")
    first = table(spark, d, "product_vectors").where("parent_asin IS NOT NULL AND size(embedding) = 384").groupBy("parent_asin").agg(F.min("vec_id").alias("v")).where("v % 20 = 0")
    return feats.join(first.select("parent_asin"), "parent_asin", "left_semi"), feats


def _guarded_and_not(spark, d):
    found = staged(matching.competitors_by_mode(*_both(spark, d), GUARDED, UNGUARDED), "competitors")
    return found.where("mode = 0").drop("mode"), found.where("mode = 1").drop("mode")


def price_estimate(spark, d):
    e = matching.price_estimate(catalog.products(spark, d))
    return e.select("parent_asin", F.round("estimate", 6).alias("estimate"), "observed")


def segment_affinity(spark, d):
    return matching.affinity(spark)


def spec_features(spark, d):
    """Normalised features of every listing."""
    cols = [F.round(matching.normalised(F.col(n), s, lo, hi), 6).alias(n) for n, _, s, lo, hi in matching.FEATURES]
    return catalog.products(spark, d).select("parent_asin", *cols)


def competitors_guarded(spark, d):
    return matching.rounded(matching.competitors(*_both(spark, d), GUARDED))


def competitors_unguarded(spark, d):
    return matching.rounded(matching.competitors(*_both(spark, d), UNGUARDED))


def guard_ablation_diff(spark, d):
    return matching.ablation_diff(*_guarded_and_not(spark, d))


def leakage_sweep(spark, d):
    guarded, unguarded = _guarded_and_not(spark, d)
    return matching.leakage(guarded, "guarded").unionByName(matching.leakage(unguarded, "unguarded"))


def hardest_query(spark, d):
    return matching.hardest(matching.competitors(*_both(spark, d), UNGUARDED))


def competitor_sentiment(spark, d):
    """The first peers of each query that have a sentiment profile."""
    found = matching.competitors(*_both(spark, d), GUARDED)
    p = overview.peers_with_profile(found, table(spark, d, "product_sentiment"))
    return p.select("query", "candidate", "place", "n_reviews_scored")


def product_documents(spark, d):
    return matching.product_document(catalog.products(spark, d))


def document_fingerprint(spark, d):
    return matching.fingerprint(product_documents(spark, d), "v1")


QUERIES = {f.__name__: f for f in (price_estimate, segment_affinity, spec_features, competitors_guarded, competitors_unguarded, guard_ablation_diff, leakage_sweep, hardest_query, competitor_sentiment, product_documents, document_fingerprint)}

_RAM = "CASE WHEN ram_gb IS NULL THEN 'missing' WHEN ram_gb <= 4 THEN '4' WHEN ram_gb <= 8 THEN '8' WHEN ram_gb <= 16 THEN '16' WHEN ram_gb <= 32 THEN '32' ELSE 'more' END"


def _level(i: int, keys: str) -> str:
    return f"l{i} AS (SELECT {keys}, median(price) AS m FROM er GROUP BY {keys} HAVING count(price) >= 3)"


_ESTIMATE = f"""er AS (SELECT parent_asin, price, segment, is_renewed, cpu_family, coalesce(CAST(cpu_tier AS VARCHAR), 'na') AS tier, {_RAM} AS rb FROM cat),
  {_level(1, "segment, is_renewed, cpu_family, rb, tier")}, {_level(2, "segment, is_renewed, cpu_family, rb")}, {_level(3, "segment, is_renewed")}, {_level(4, "segment")},
  est AS (SELECT er.parent_asin, coalesce(price, l1.m, l2.m, l3.m, l4.m, (SELECT median(price) FROM cat), 500) AS estimate, price IS NOT NULL AS observed FROM er
    LEFT JOIN l1 USING (segment, is_renewed, cpu_family, rb, tier) LEFT JOIN l2 USING (segment, is_renewed, cpu_family, rb) LEFT JOIN l3 USING (segment, is_renewed) LEFT JOIN l4 USING (segment))"""


def _norm(n: str, scale: str, lo: float, hi: float) -> str:
    v = f"least({hi}, greatest({lo}, CAST({n} AS DOUBLE)))"
    if scale == "linear":
        out = f"({v} - {lo}) / ({hi} - {lo})"
    else:
        f, base = ("log2", math.log2) if scale == "log2" else ("log10", math.log10)
        out = f"({f}({v}) - {base(lo)!r}) / {base(hi) - base(lo)!r}"
    return f"CASE WHEN {n} IS NOT NULL THEN {out} END"


_F = {n: _norm(n, s, lo, hi) for n, _, s, lo, hi in matching.FEATURES}
_AFF = ", ".join(f"('{a}', '{b}', {x!r})" for a, b, x in [(s, s, 1.0) for s in V.SEGMENTS] + [(a, b, x) for (p, q), x in V.AFFINITY.items() for a, b in ((p, q), (q, p))])
_TERMS = " + ".join(f"CASE WHEN q.f_{n} IS NOT NULL AND c.f_{n} IS NOT NULL THEN abs(q.f_{n} - c.f_{n}) * {w} ELSE {0.45 * w * 0.5!r} END" for n, w, *_ in matching.FEATURES)
_WEIGHTS = " + ".join(f"CASE WHEN q.f_{n} IS NOT NULL AND c.f_{n} IS NOT NULL THEN {w} ELSE {w * 0.5!r} END" for n, w, *_ in matching.FEATURES)


def _base() -> str:
    from cataloom.plans.catalogue import _SIG

    return f"""{CAT}, {_SIG}, {catalog.VECTORS_SQL}, {_ESTIMATE}, aff(seg_q, seg_c, affinity) AS (VALUES {_AFF}),
      ft AS (SELECT s.parent_asin, s.brand, s.segment, e.estimate, e.observed, v.embedding, s.model_sig AS sig, {", ".join(f"{x} AS f_{n}" for n, x in _F.items())}
        FROM sig s JOIN vec v USING (parent_asin) JOIN est e USING (parent_asin)),
      qs AS (SELECT * FROM ft WHERE parent_asin IN (SELECT parent_asin FROM product_vectors WHERE parent_asin IS NOT NULL AND len(embedding) = 384 GROUP BY parent_asin HAVING min(vec_id) % 20 = 0))"""


def _found(name: str, guard: bool) -> str:
    keep = "AND a.affinity >= 0.25 AND abs(ln(c.estimate / q.estimate)) <= CASE WHEN q.observed AND c.observed THEN ln(2.25) ELSE ln(4.5) END" if guard else ""
    penalty = "- 0.35 * (1 - affinity) - 0.15 * least(1, abs(price_ratio - 1))" if guard else ""
    return f"""{name}_s AS (SELECT q.parent_asin AS query, c.parent_asin AS candidate, q.segment AS query_segment, c.segment AS segment, c.brand AS brand, coalesce(a.affinity, 0.5) AS affinity,
        list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS text_similarity, 1 - ({_TERMS}) / ({_WEIGHTS}) AS spec_similarity, c.estimate / q.estimate AS price_ratio
        FROM qs q JOIN ft c ON q.parent_asin <> c.parent_asin AND (q.sig = '' OR q.sig <> c.sig) LEFT JOIN aff a ON a.seg_q = q.segment AND a.seg_c = c.segment WHERE true {keep}),
      {name}_r AS (SELECT *, round(0.6 * text_similarity + 0.4 * spec_similarity {penalty}, 6) AS score FROM {name}_s),
      {name}_p AS (SELECT *, row_number() OVER (PARTITION BY query, brand ORDER BY score DESC, candidate) > 3 AS over FROM (SELECT * FROM {name}_r QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) <= 600)),
      {name} AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) AS INTEGER) AS rank FROM (SELECT * FROM {name}_p QUALIFY row_number() OVER (PARTITION BY query ORDER BY over, score DESC, candidate) <= 10))"""


_OUT = "query, candidate, segment, brand, affinity, round(text_similarity, 5) AS text_similarity, round(spec_similarity, 5) AS spec_similarity, round(price_ratio, 5) AS price_ratio, score, rank"
_LEAK = "count(*) AS pairs, count(*) FILTER (affinity < 0.25) AS cross_class, count(*) FILTER (greatest(price_ratio, 1 / price_ratio) > 3) AS price_gaps"

def _figure(c: str, digits: int) -> str:
    return f"regexp_replace(format('{{:,.{digits}f}}', {c}), '\\.0$', '')"


_PIECES = [
    "array_to_string(list_slice(regexp_split_to_array(trim(coalesce(title, ''), ' '), '\\s+'), 1, 44), ' ')", "nullif(brand, 'Unknown')", "segment || ' laptop'", "nullif(cpu_family, 'Unknown')",
    "format('{:.0f}', ram_gb) || ' GB RAM'", f"CASE WHEN storage_gb >= 1024 THEN {_figure('storage_gb / 1024', 1)} || ' TB storage' ELSE format('{{:.0f}}', storage_gb) || ' GB storage' END",
    f"{_figure('screen_in', 1)} || ' inch display'", "nullif(gpu_model, 'Unknown')", "nullif(os_family, 'Unknown')", "format('{:,.1f}', weight_lb) || ' lb'",
    "CASE WHEN price < 300 THEN 'under $300' WHEN price < 600 THEN '$300 to $600' WHEN price < 1000 THEN '$600 to $1000' WHEN price < 1800 THEN '$1000 to $1800' WHEN price IS NOT NULL THEN 'over $1800' END",
    "CASE WHEN is_renewed THEN 'renewed' ELSE 'new' END",
]
_DOCUMENT = f"array_to_string(list_filter([{', '.join(_PIECES)}], lambda p: p IS NOT NULL AND p <> ''), ' | ')"

ORACLES = {
    "product_documents": f"{CAT} SELECT parent_asin, {_DOCUMENT} AS document FROM cat",
    "price_estimate": f"{CAT}, {_ESTIMATE} SELECT parent_asin, round(estimate, 6) AS estimate, observed FROM est",
    "segment_affinity": f"SELECT * FROM (VALUES {_AFF}) t(seg_q, seg_c, affinity)",
    "spec_features": f"{CAT} SELECT parent_asin, {', '.join(f'round({x}, 6) AS {n}' for n, x in _F.items())} FROM cat",
    "competitors_guarded": f"{_base()}, {_found('g', True)} SELECT {_OUT} FROM g",
    "competitors_unguarded": f"{_base()}, {_found('u', False)} SELECT {_OUT} FROM u",
    "guard_ablation_diff": f"""{_base()}, {_found('g', True)}, {_found('u', False)},
      og AS (SELECT query, count(*) AS n FROM g WHERE (query, candidate) NOT IN (SELECT (query, candidate) FROM u) GROUP BY query),
      ou AS (SELECT query, count(*) AS n, count(*) FILTER (segment <> query_segment) AS o, count(*) FILTER (price_ratio > 2.25 OR price_ratio < 1 / 2.25) AS b, round(max(greatest(price_ratio, 1 / price_ratio)), 4) AS w FROM u WHERE (query, candidate) NOT IN (SELECT (query, candidate) FROM g) GROUP BY query)
      SELECT coalesce(og.query, ou.query) AS query, coalesce(og.n, 0) AS only_guarded, coalesce(ou.n, 0) AS only_unguarded, coalesce(o, 0) AS off_segment, coalesce(b, 0) AS out_of_band, w AS worst_ratio FROM og FULL JOIN ou ON og.query = ou.query""",
    "leakage_sweep": f"{_base()}, {_found('g', True)}, {_found('u', False)} SELECT 'guarded' AS mode, {_LEAK} FROM g UNION ALL SELECT 'unguarded', {_LEAK} FROM u",
    "hardest_query": f"""{_base()}, {_found('u', False)} SELECT query, count(*) FILTER (segment = 'chromebook' AND query_segment <> 'chromebook') AS chromebooks, count(*) FILTER (segment = 'budget' AND query_segment <> 'budget') AS budgets FROM u GROUP BY query ORDER BY 2 DESC, 3 DESC, 1 LIMIT 1""",
    "competitor_sentiment": f"""{_base()}, {_found('g', True)}, p AS (SELECT g.query, g.candidate, s.n_reviews_scored, CAST(row_number() OVER (PARTITION BY g.query ORDER BY g.rank) AS INTEGER) AS place FROM g JOIN product_sentiment s ON s.parent_asin = g.candidate)
      SELECT query, candidate, place, n_reviews_scored FROM p WHERE place <= 6""",
}
