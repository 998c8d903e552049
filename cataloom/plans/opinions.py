"""Review mining queries over all reviews and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cataloom import catalog
from cataloom.functions import vocabulary as V
from cataloom.operators import sentiment
from cataloom.session import staged, table

REV = f"WITH {catalog.REVIEWS_SQL}"


def _reviews(spark, d):
    return catalog.reviews(spark, d).where("parent_asin IS NOT NULL")


def _folded(spark, d):
    return staged(sentiment.review_aspects(sentiment.mentions(_reviews(spark, d))), "review-aspects")


def _staged(spark, d):
    """(reviews, folded aspects): read and deduplicated once."""
    r = staged(_reviews(spark, d), "opinion-reviews")
    return r, staged(sentiment.review_aspects(sentiment.mentions(r)), "review-aspects")


def clauses(spark, d):
    return sentiment.clause_table(_reviews(spark, d)).select("review_id", "pos", "clause")


def aspect_mentions(spark, d):
    return sentiment.mentions(_reviews(spark, d)).groupBy("aspect").agg(F.count(F.lit(1)).alias("clauses"), F.count_distinct("review_id").alias("reviews"), F.round(F.avg("pol"), 5).alias("mean_pol"))


def lexicon_polarity(spark, d):
    return sentiment.review_polarity(_reviews(spark, d)).select("review_id", "sent_polarity", "sent_label")


def calibrated_polarity(spark, d):
    p = sentiment.review_polarity(_reviews(spark, d))
    return p.select("review_id", F.round(sentiment.calibrated(F.col("sent_polarity")), 6).alias("calibrated"))


def review_aspects(spark, d):
    return _folded(spark, d).select("review_id", "aspect", "n", "pol", "snip")


def review_sentiment(spark, d):
    return sentiment.review_sentiment(_reviews(spark, d))


def product_sentiment_rollup(spark, d):
    r, folded = _staged(spark, d)
    p = sentiment.product_sentiment(sentiment.review_polarity(r), folded)
    return p.select("parent_asin", "n_reviews_scored", "mean_rating", "overall_polarity", "overall_pos_share", "battery_mentions", "battery_polarity", "display_mentions", "display_pos_share")


def sentiment_profile(spark, d):
    """Aspects with a mention of each product of the given table, most mentioned first."""
    return sentiment.profile(table(spark, d, "product_sentiment")).select("parent_asin", "aspect", "mentions", "rank")


def top_snippets(spark, d):
    r, folded = _staged(spark, d)
    return sentiment.top_snippets(folded, r).select("parent_asin", "aspect", "side", "rank", "review_id", "score", "snip")


def aspect_coverage(spark, d):
    return sentiment.aspect_coverage(_folded(spark, d), _reviews(spark, d))


def mixed_opinions(spark, d):
    return sentiment.mixed_opinions(_folded(spark, d))


def backend_metrics(spark, d):
    return sentiment.evaluate(sentiment.review_polarity(_reviews(spark, d)))


def accuracy_by_star(spark, d):
    return sentiment.accuracy_by_star(sentiment.review_polarity(_reviews(spark, d)))


def clause_benchmark(spark, d):
    return sentiment.binary_metrics(sentiment.clause_benchmark(_reviews(spark, d)))


def stratified_reviews(spark, d):
    """200 reviews of each rating."""
    return sentiment.stratified(_reviews(spark, d), "rating", "review_id", 200).select("rating", "review_id")


def aspect_heatmap(spark, d):
    return sentiment.aspect_heat(catalog.products(spark, d), table(spark, d, "product_sentiment"))


def aspect_cards(spark, d):
    """Each product's aspects with the reviews quoted for and against them."""
    r, folded = _staged(spark, d)
    cards = sentiment.aspect_cards(folded, sentiment.top_snippets(folded, r))
    return cards.select("parent_asin", "aspect", "mentions", "polarity", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("praise", "complaints")])


def backend_ranking(spark, d):
    """Two scorings of the same reviews, the better macro F1 first."""
    r = _reviews(spark, d)
    body = r.withColumn("sent_polarity", F.round(sentiment.lexicon_polarity(F.col("text")), 6))
    return sentiment.compare_backends({"with_headline": sentiment.review_polarity(r), "body_only": body})


def evidence_kinds(spark, d):
    """Quoted snippets by side."""
    from cataloom.operators.retrieval import evidence_counts

    r, folded = _staged(spark, d)
    return evidence_counts(sentiment.top_snippets(folded, r).withColumnRenamed("side", "kind"))


def calibration_fit(spark, d):
    """Platt parameters fitted on the aspect clauses of 1- and 5-star reviews."""
    from cataloom.operators.models import calibration

    return spark.createDataFrame([calibration(sentiment.clause_benchmark(_reviews(spark, d)))], "a double, b double")


QUERIES = {f.__name__: f for f in (clauses, aspect_mentions, lexicon_polarity, calibrated_polarity, review_aspects, review_sentiment, product_sentiment_rollup, sentiment_profile, top_snippets, aspect_coverage, mixed_opinions, backend_metrics, accuracy_by_star, clause_benchmark, stratified_reviews, aspect_heatmap, aspect_cards, backend_ranking, evidence_kinds, calibration_fit)}

_POS, _NEG = (", ".join(f"'{w}'" for w in x) for x in (sentiment.POSITIVE, sentiment.NEGATIVE))


def _score(text: str) -> str:
    words = f"regexp_extract_all(lower(coalesce({text}, '')), '[a-z]+')"
    pos, neg = f"len(list_filter({words}, lambda w: w IN ({_POS})))", f"len(list_filter({words}, lambda w: w IN ({_NEG})))"
    return f"(({pos} - {neg}) / ({pos} + {neg} + 1))"


_HEAD = "regexp_replace(trim(coalesce(review_title, ''), ' '), '[.!? ]+$', '')"
_DOC = f"CASE WHEN {_HEAD} <> '' AND trim(coalesce(text, ''), ' ') <> '' THEN {_HEAD} || '. ' || trim(text, ' ') WHEN {_HEAD} <> '' THEN {_HEAD} ELSE trim(coalesce(text, ''), ' ') END"
_POLARITY = f"""pr AS (SELECT *, {_DOC} AS doc FROM rev WHERE parent_asin IS NOT NULL), pol AS (SELECT *, round(CASE WHEN trim(coalesce(review_title, ''), ' ') <> '' THEN ({_score("doc")} + {_score("trim(review_title, ' ')")}) / 2 ELSE {_score("doc")} END, 6) AS sent_polarity FROM pr)"""
_LABEL = "CASE WHEN sent_polarity > 0.2 THEN 'positive' WHEN sent_polarity < -0.2 THEN 'negative' ELSE 'neutral' END"
# RE2 has no look-around: separators are written in and split at. Abbreviations don't end a sentence in these texts' oracle: fragments
# that end in one are glued to the next by removing the separator again.
_ABBR = "(e\\.g|i\\.e|vs|mr|mrs|dr|no|approx|etc)\\."
_CONTRAST = "|".join(sentiment.CONTRAST)
_SENT = f"regexp_replace(regexp_replace(coalesce(text, ''), '([.!?;])\\s+', '\\1' || chr(31), 'g'), '\\n+', chr(31), 'g')"
_GLUED = f"regexp_replace({_SENT}, '(?i)\\b{_ABBR}' || chr(31), '\\1. ', 'g')"
_CLAUSES = f"""cl AS (SELECT review_id, parent_asin, rating, pos - 1 AS pos, clause FROM (SELECT review_id, parent_asin, rating, unnest(list) AS clause, generate_subscripts(list, 1) AS pos FROM (
    SELECT review_id, parent_asin, rating, list_filter(list_transform(string_split(regexp_replace(array_to_string(list_filter(list_transform(string_split({_GLUED}, chr(31)), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'), ' ')), lambda s: s <> ''), chr(31)),
      '(?i)\\s+((?:{_CONTRAST})\\b)', chr(31) || '\\1', 'g'), chr(31)), lambda s: trim(s, ' ')), lambda s: length(s) >= 6)[1:40] AS list FROM rev WHERE parent_asin IS NOT NULL)))"""
_ASPECTS = ", ".join(f"""('{a}', '{sentiment.cue_pattern(c)}')""" for a, c in V.ASPECTS.items())
_MENTIONS = f"""{_CLAUSES}, asp(aspect, p) AS (VALUES {_ASPECTS}), men AS (SELECT review_id, parent_asin, rating, aspect, pos, clause, round({_score("clause")}, 6) AS pol FROM cl, asp WHERE regexp_matches(clause, p))"""
_SNIP = "arg_max(clause, (abs(pol), pos))"
_FOLDED = f"""{_MENTIONS}, fo AS (SELECT review_id, parent_asin, aspect, count(*) AS n, round(avg(pol), 6) AS pol, {_SNIP} AS snip0 FROM men GROUP BY ALL),
  fold AS (SELECT * EXCLUDE (snip0), CASE WHEN length(snip0) > 300 THEN regexp_replace(left(snip0, 300), ' [^ ]*$', '') || '...' ELSE snip0 END AS snip FROM fo)"""
_METRIC = """round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision_pos, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall_pos,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_pos, round(coalesce(tn / nullif(tn + fn, 0), 0), 6) AS precision_neg, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS recall_neg,
  round(coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0), 6) AS f1_neg, round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) AS macro_f1"""
_CELLS = "count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn"
_EVAL = "ev AS (SELECT rating >= 4 AS t, sent_polarity > 0 AS p, abs(sent_polarity) > 0.2 AS sure, rating, sent_polarity FROM pol WHERE rating >= 4 OR rating <= 2)"
_ASP_COLUMNS = [f"CAST(sum(CASE WHEN aspect = '{a}' THEN n ELSE 0 END) AS BIGINT) AS {a}_mentions" for a in ("battery", "display")]
_WIDE = ", ".join(f"max(CASE WHEN aspect = '{a}' THEN {c} END) AS asp_{a}_{c}" for a in V.ASPECTS for c in ("n", "pol", "snip"))

ORACLES = {
    "clauses": f"{REV}, {_CLAUSES} SELECT review_id, pos, clause FROM cl",
    "aspect_mentions": f"{REV}, {_MENTIONS} SELECT aspect, count(*) AS clauses, count(DISTINCT review_id) AS reviews, round(avg(pol), 5) AS mean_pol FROM men GROUP BY aspect",
    "lexicon_polarity": f"{REV}, {_POLARITY} SELECT review_id, sent_polarity, {_LABEL} AS sent_label FROM pol",
    "calibrated_polarity": f"""{REV}, {_POLARITY}, c AS (SELECT review_id, greatest(1e-6, least(1 - 1e-6, (sent_polarity + 1) / 2)) AS q FROM pol) SELECT review_id, round(2 / (1 + exp(-(0.2050 * ln(q / (1 - q)) + 0.3286))) - 1, 6) AS calibrated FROM c""",
    "review_aspects": f"{REV}, {_FOLDED} SELECT review_id, aspect, n, pol, snip FROM fold",
    "review_sentiment": f"""{REV}, {_POLARITY}, {_FOLDED}, w AS (SELECT review_id, {_WIDE}, CAST(sum(n) AS SMALLINT) AS n_aspect_mentions FROM fold GROUP BY review_id), k AS (SELECT review_id, CAST(count(*) AS SMALLINT) AS n_clauses FROM cl GROUP BY review_id)
      SELECT p.review_id, parent_asin, rating, helpful_vote, verified_purchase, review_year, sent_polarity, {_LABEL} AS sent_label, coalesce(n_clauses, 0) AS n_clauses, w.* EXCLUDE (review_id, n_aspect_mentions), coalesce(n_aspect_mentions, 0) AS n_aspect_mentions
      FROM pol p LEFT JOIN w USING (review_id) LEFT JOIN k USING (review_id)""",
    "product_sentiment_rollup": f"""{REV}, {_POLARITY}, {_FOLDED}, o AS (SELECT parent_asin, count(*) AS n_reviews_scored, round(avg(rating), 6) AS mean_rating, floor(avg(sent_polarity) * 1e6 + 0.5000001) / 1e6 AS overall_polarity, round(avg(CAST(sent_polarity > 0 AS INT)), 6) AS overall_pos_share FROM pol GROUP BY parent_asin),
      a AS (SELECT parent_asin, {", ".join(_ASP_COLUMNS)}, floor(avg(CASE WHEN aspect = 'battery' THEN pol END) * 1e6 + 0.5000001) / 1e6 AS battery_polarity, round(avg(CASE WHEN aspect = 'display' THEN CAST(pol > 0 AS INT) END), 6) AS display_pos_share FROM fold GROUP BY parent_asin)
      SELECT parent_asin, n_reviews_scored, mean_rating, overall_polarity, overall_pos_share, coalesce(battery_mentions, 0) AS battery_mentions, battery_polarity, coalesce(display_mentions, 0) AS display_mentions, display_pos_share FROM o LEFT JOIN a USING (parent_asin)""",
    "sentiment_profile": "WITH l AS (" + " UNION ALL ".join(f"SELECT parent_asin, '{a}' AS aspect, {a}_mentions AS mentions FROM product_sentiment" for a in V.ASPECTS) + ") SELECT parent_asin, aspect, mentions, CAST(row_number() OVER (PARTITION BY parent_asin ORDER BY mentions DESC, aspect) AS INTEGER) AS rank FROM l WHERE mentions > 0",
    "top_snippets": f"""{REV}, {_FOLDED}, e AS (SELECT f.*, CASE WHEN f.pol > 0 THEN 'praise' ELSE 'complaint' END AS side, round(abs(f.pol) * (1 + ln(1 + coalesce(helpful_vote, 0))) * CASE WHEN coalesce(verified_purchase, false) THEN 1.15 ELSE 1 END, 6) AS score FROM fold f JOIN rev r USING (review_id) WHERE abs(f.pol) >= 0.2),
      o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY parent_asin, aspect, side, lower(left(snip, 120)) ORDER BY score DESC, review_id) = 1)
      SELECT parent_asin, aspect, side, CAST(row_number() OVER (PARTITION BY parent_asin, aspect, side ORDER BY score DESC, review_id) AS INTEGER) AS rank, review_id, score, snip FROM o QUALIFY rank <= 3""",
    "aspect_coverage": f"{REV}, {_FOLDED} SELECT aspect, count(*) AS reviews, round(count(*) / (SELECT count(*) FROM rev WHERE parent_asin IS NOT NULL), 6) AS share, round(avg(CAST(pol > 0 AS INT)), 6) AS pos_share FROM fold GROUP BY aspect",
    "mixed_opinions": f"{REV}, {_FOLDED} SELECT review_id, count(*) AS n_aspects, max(pol) AS best, min(pol) AS worst FROM fold GROUP BY review_id HAVING count(*) >= 3 AND max(pol) > 0.5 AND min(pol) < -0.5",
    "backend_metrics": f"""{REV}, {_POLARITY}, {_EVAL}, c AS (SELECT 'strict' AS mode, 1.0::DOUBLE AS coverage, {_CELLS} FROM ev UNION ALL SELECT 'banded', (SELECT round(avg(CAST(sure AS INT)), 6) FROM ev), {_CELLS} FROM ev WHERE sure) SELECT mode, coverage, tp, fp, fn, tn, {_METRIC} FROM c""",
    "accuracy_by_star": f"{REV}, {_POLARITY}, {_EVAL} SELECT rating, count(*) AS n, round(avg(CAST(t = p AS INT)), 6) AS accuracy, round(avg(abs(sent_polarity)), 6) AS mean_abs FROM ev GROUP BY rating",
    "clause_benchmark": f"{REV}, {_MENTIONS}, c AS (SELECT {_CELLS} FROM (SELECT rating = 5 AS t, pol > 0 AS p FROM men WHERE rating IN (1, 5))) SELECT tp, fp, fn, tn, {_METRIC} FROM c",
    "stratified_reviews": f"{REV} SELECT rating, review_id FROM rev WHERE parent_asin IS NOT NULL AND rating IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rating ORDER BY md5(review_id || ':42'), review_id) <= 200",
    "aspect_heatmap": f"WITH {catalog.PRODUCTS_SQL}, l AS (" + " UNION ALL ".join(f"SELECT parent_asin, '{a}' AS aspect, CAST({a}_polarity AS DOUBLE) AS p FROM product_sentiment WHERE {a}_mentions > 0 AND {a}_polarity IS NOT NULL" for a in V.ASPECTS)
    + ") SELECT segment, aspect, count(*) AS products, round(avg(p), 5) AS polarity FROM l JOIN cat USING (parent_asin) GROUP BY segment, aspect",
    "backend_ranking": f"""{REV}, {_POLARITY}, {_EVAL}, eb AS (SELECT rating >= 4 AS t, round({_score("text")}, 6) > 0 AS p FROM pol WHERE rating >= 4 OR rating <= 2),
      c AS (SELECT 'with_headline' AS backend, {_CELLS} FROM ev UNION ALL SELECT 'body_only', {_CELLS} FROM eb) SELECT backend, 'strict' AS mode, 1.0::DOUBLE AS coverage, tp, fp, fn, tn, {_METRIC} FROM c""",
}
ORACLES["aspect_cards"] = f"""WITH sn AS ({ORACLES["top_snippets"]}), q AS (SELECT parent_asin, aspect, string_agg(CAST(review_id AS VARCHAR), ',' ORDER BY rank) FILTER (side = 'praise') AS praise, string_agg(CAST(review_id AS VARCHAR), ',' ORDER BY rank) FILTER (side = 'complaint') AS complaints FROM sn GROUP BY ALL),
  per AS (SELECT parent_asin, aspect, CAST(sum(n) AS BIGINT) AS mentions, floor(avg(pol) * 1e6 + 0.5000001) / 1e6 AS polarity FROM ({ORACLES["review_aspects"].replace("SELECT review_id, aspect, n, pol, snip FROM fold", "SELECT parent_asin, aspect, n, pol FROM fold")}) GROUP BY ALL)
  SELECT parent_asin, aspect, mentions, polarity, coalesce(praise, '') AS praise, coalesce(complaints, '') AS complaints FROM per LEFT JOIN q USING (parent_asin, aspect)"""
ORACLES["evidence_kinds"] = f"SELECT side AS kind, count(*) AS n FROM ({ORACLES['top_snippets']}) GROUP BY side"
