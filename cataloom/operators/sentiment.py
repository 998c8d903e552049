"""Clauses, aspects and polarity of reviews; rollups and evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cataloom.functions import vocabulary as V
from cataloom.functions.stats import tidy
from cataloom.sources.io import seeded

# Fixed values.
MAX_CLAUSES, MIN_CHARS, SNIPPET, BAND = 40, 6, 300, 0.20
CALIBRATION = (0.2050, 0.3286)
CONTRAST = ("but", "however", "although", "though", "whereas", "yet", "unfortunately", "albeit", "except")
ABBREVIATION = r"(?i)\b(?:e\.g|i\.e|vs|mr|mrs|dr|no|approx|etc)\.$"

#: A small lexicon of our own; a backend takes any other.
POSITIVE = """good great excellent love perfect impressive comfortable sharp fast solid sturdy bright quiet flawless dependable smooth happy best better nice
pleasure recommend worth crisp responsive snappy surprisingly""".split()
NEGATIVE = """bad poor terrible hate broken broke disappointing disappointment annoying flimsy loud slow unreliable mediocre sluggish dim failed fails failing died scratched
inconsistent unusable worst cheap returned refund noisy hot letdown""".split()


class Backend(Protocol):
    """Scores texts in [-1, 1]; ``calibration`` (a, b) or None applies to clause scores."""

    calibration: tuple[float, float] | None

    def polarity(self, texts: Sequence[str]) -> Sequence[float]: ...


REGISTRY: dict[str, Callable[[], Backend]] = {}


def register(name: str, make: Callable[[], Backend]) -> None:
    REGISTRY[name] = make


def lexicon_polarity(text: Column, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> Column:
    """(positive - negative) / (positive + negative + 1) over the words of a text: JVM-side, no Python."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    pos = F.size(F.filter(words, lambda w: w.isin(*positive)))
    neg = F.size(F.filter(words, lambda w: w.isin(*negative)))
    return (pos - neg) / (pos + neg + 1)


def backend_polarity(df: DataFrame, text: str, out: str, name: str, batch: int = 64) -> DataFrame:
    """``out`` by a registered backend, in Arrow batches sorted by length; an unknown name is an error."""
    if name not in REGISTRY:
        raise KeyError(f"no backend {name!r}; registered: {sorted(REGISTRY)}")
    make = REGISTRY[name]

    def scored(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        for pdf in parts:
            by_length = pdf[text].fillna("").str.len().sort_values(kind="stable").index
            scores = pd.Series(index=pdf.index, dtype="float64")
            for i in range(0, len(by_length), batch):
                at = by_length[i : i + batch]
                scores.loc[at] = [float(x) for x in backend.polarity(pdf.loc[at, text].fillna("").tolist())]
            yield pdf.assign(**{out: scores})

    return df.mapInPandas(scored, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` double")


def document(title: Column, text: Column) -> Column:
    """Title without closing punctuation, full stop, body."""
    head = F.regexp_replace(F.trim(F.coalesce(title, F.lit(""))), r"[.!? ]+$", "")
    body = F.trim(F.coalesce(text, F.lit("")))
    return F.when((head != "") & (body != ""), F.concat(head, F.lit(". "), body)).when(head != "", head).otherwise(body)


def clauses(text: Column, limit: int = MAX_CLAUSES) -> Column:
    """Clauses of a text in order: sentences, re-attached after an abbreviation, split before contrast words."""
    raw = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?;])\s+|\n+")
    tidy = F.filter(F.transform(raw, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("pend"))

    def step(acc: Column, s: Column) -> Column:
        joined = F.when(acc["pend"] != "", F.concat(acc["pend"], F.lit(" "), s)).otherwise(s)
        held = joined.rlike(ABBREVIATION)
        return F.struct(F.when(held, acc["out"]).otherwise(F.array_append(acc["out"], joined)).alias("out"), F.when(held, joined).otherwise(F.lit("")).alias("pend"))

    # a short-cut for the many texts without abbreviations keeps the fold off the hot path
    folded = F.aggregate(tidy, start, step)
    plain = F.struct(tidy.alias("out"), F.lit("").alias("pend"))
    best = F.when(F.exists(tidy, lambda s: s.rlike(ABBREVIATION)), folded).otherwise(plain)
    pattern = rf"(?i)\s+(?=(?:{'|'.join(CONTRAST)})\b)"
    parts = F.flatten(F.transform(best["out"], lambda s: F.split(s, pattern)))
    parts = F.array_append(F.transform(parts, lambda s: F.trim(s)), best["pend"])  # a trailing abbreviation stays whole
    return F.slice(F.filter(parts, lambda s: F.length(s) >= MIN_CHARS), 1, limit)


def cue_pattern(cues: Sequence[str]) -> str:
    import re

    return r"(?i)\b(?:" + "|".join(re.escape(c).replace(r"\ ", " ") for c in sorted(cues, key=len, reverse=True)) + r")\b"


def aspects(text: Column, cues: dict[str, Sequence[str]] = V.ASPECTS) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(cue_pattern(c)), F.lit(a)) for a, c in cues.items()]))


def snippet(text: Column, limit: int = SNIPPET) -> Column:
    """White space collapsed; cut at a word with "..." when too long."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > limit, F.concat(F.regexp_replace(F.substring(t, 1, limit), r" [^ ]*$", ""), F.lit("..."))).otherwise(t)


def calibrated(polarity: Column, params: tuple[float, float] | None = CALIBRATION) -> Column:
    if params is None:
        return polarity
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), (polarity + 1) / 2))
    return 2 / (1 + F.exp(-(params[0] * F.log(p / (1 - p)) + params[1]))) - 1


def label(polarity: Column, band: float = BAND) -> Column:
    return F.when(polarity > band, "positive").when(polarity < -band, "negative").otherwise("neutral")


# ---------------------------------------------------------------- per review


def review_polarity(reviews: DataFrame) -> DataFrame:
    """Adds sent_polarity and sent_label: the mean of document and headline, the document alone without a headline."""
    doc = lexicon_polarity(document(F.col("review_title"), F.col("text")))
    head = F.trim(F.coalesce("review_title", F.lit("")))
    p = F.when(head != "", (doc + lexicon_polarity(head)) / 2).otherwise(doc)
    return reviews.withColumn("sent_polarity", F.round(p, 6)).withColumn("sent_label", label(F.col("sent_polarity")))


def clause_table(reviews: DataFrame) -> DataFrame:
    """(review_id, parent_asin, pos, clause) of every clause."""
    return reviews.select("review_id", "parent_asin", F.posexplode(clauses(F.col("text"))).alias("pos", "clause"))


def mentions(reviews: DataFrame, params: tuple[float, float] | None = None) -> DataFrame:
    """(review_id, parent_asin, aspect, pos, clause, pol): clauses that name an aspect."""
    c = clause_table(reviews).withColumn("aspect_list", aspects(F.col("clause"))).where(F.size("aspect_list") > 0)
    pol = calibrated(lexicon_polarity(F.col("clause")), params)
    return c.select("review_id", "parent_asin", F.explode("aspect_list").alias("aspect"), "pos", "clause", F.round(pol, 6).alias("pol"))


def review_aspects(found: DataFrame) -> DataFrame:
    """(review_id, parent_asin, aspect, n, pol, snip): clauses folded; the most opinionated clause, the last on ties, is quoted."""
    return found.groupBy("review_id", "parent_asin", "aspect").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("pol"), 6).alias("pol"), snippet(F.max_by("clause", F.struct(F.abs("pol"), "pos"))).alias("snip")
    )


def review_sentiment(reviews: DataFrame) -> DataFrame:
    """The wide table: a row per review with asp_<aspect>_{n,pol,snip}."""
    folded = review_aspects(mentions(reviews))
    wide = folded.groupBy("review_id").agg(
        *[F.max(F.when(F.col("aspect") == a, F.col(c))).alias(f"asp_{a}_{c}") for a in V.ASPECTS for c in ("n", "pol", "snip")], F.sum("n").cast("short").alias("n_aspect_mentions")
    )
    base = review_polarity(reviews).select("review_id", "parent_asin", "rating", "helpful_vote", "verified_purchase", "review_year", "sent_polarity", "sent_label", F.size(clauses(F.col("text"))).cast("short").alias("n_clauses"))
    return base.join(wide, "review_id", "left").fillna(0, ["n_aspect_mentions"])


# ---------------------------------------------------------------- per product


def product_sentiment(scored: DataFrame, folded: DataFrame) -> DataFrame:
    """(parent_asin, n_reviews_scored, mean_rating, overall_polarity, overall_pos_share and per aspect mentions, polarity, pos_share)."""
    overall = scored.groupBy("parent_asin").agg(
        F.count(F.lit(1)).alias("n_reviews_scored"), F.round(F.avg("rating"), 6).alias("mean_rating"), tidy(F.avg("sent_polarity")).alias("overall_polarity"),
        F.round(F.avg((F.col("sent_polarity") > 0).cast("int")), 6).alias("overall_pos_share"),
    )
    per = folded.groupBy("parent_asin").agg(
        *[
            x
            for a in V.ASPECTS
            for x in (
                F.sum(F.when(F.col("aspect") == a, F.col("n")).otherwise(0)).alias(f"{a}_mentions"),
                tidy(F.avg(F.when(F.col("aspect") == a, F.col("pol")))).alias(f"{a}_polarity"),
                F.round(F.avg(F.when(F.col("aspect") == a, (F.col("pol") > 0).cast("int"))), 6).alias(f"{a}_pos_share"),
            )
        ]
    )
    return overall.join(per, "parent_asin", "left").fillna(0, [f"{a}_mentions" for a in V.ASPECTS])


def profile(sentiment: DataFrame) -> DataFrame:
    """(parent_asin, aspect, mentions, polarity, pos_share): only aspects with a mention, most mentioned first in ``rank``."""
    long = sentiment.select("parent_asin", F.explode(F.array(*[F.struct(F.lit(a).alias("aspect"), F.col(f"{a}_mentions").alias("mentions"), F.col(f"{a}_polarity").alias("polarity"), F.col(f"{a}_pos_share").alias("pos_share")) for a in V.ASPECTS])).alias("e"))
    rank = F.row_number().over(W.partitionBy("parent_asin").orderBy(F.desc("mentions"), "aspect"))  # 8 rows a product
    return long.select("parent_asin", "e.*").where("mentions > 0").withColumn("rank", rank)


def evidence_score(pol: Column, helpful: Column, verified: Column) -> Column:
    return F.abs(pol) * (1 + F.log1p(F.coalesce(helpful, F.lit(0)))) * F.when(F.coalesce(verified, F.lit(False)), 1.15).otherwise(1.0)


def top_snippets(folded: DataFrame, reviews: DataFrame, k: int = 3, least: float = BAND) -> DataFrame:
    """The k strongest praises and complaints per product and aspect; snippets that start alike count once."""
    rows = folded.where(F.abs("pol") >= least).join(reviews.select("review_id", "helpful_vote", "verified_purchase"), "review_id")
    rows = rows.withColumn("score", F.round(evidence_score(F.col("pol"), F.col("helpful_vote"), F.col("verified_purchase")), 6)).withColumn("side", F.when(F.col("pol") > 0, "praise").otherwise("complaint"))
    keys = ["parent_asin", "aspect", "side"]
    same = rows.withColumn("start", F.lower(F.substring("snip", 1, 120)))
    once = same.groupBy(*keys, "start").agg(F.min_by(F.struct("review_id", "snip", "pol", "score"), F.struct(-F.col("score"), "review_id")).alias("b")).select(*keys, "b.*")
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "review_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def aspect_coverage(folded: DataFrame, reviews: DataFrame) -> DataFrame:
    total = reviews.agg(F.count(F.lit(1)).alias("_all"))
    t = folded.groupBy("aspect").agg(F.count(F.lit(1)).alias("reviews"), F.round(F.avg((F.col("pol") > 0).cast("int")), 6).alias("pos_share"))
    return t.crossJoin(F.broadcast(total)).select("aspect", "reviews", F.round(F.col("reviews") / F.col("_all"), 6).alias("share"), "pos_share")  # one row


def aspect_heat(df: DataFrame, sentiment: DataFrame) -> DataFrame:
    """(segment, aspect, products, polarity): the mean polarity of the products of a segment that have a mention of the aspect."""
    long = sentiment.select("parent_asin", F.explode(F.array(*[F.struct(F.lit(a).alias("aspect"), F.col(f"{a}_mentions").alias("m"), F.col(f"{a}_polarity").cast("double").alias("p")) for a in V.ASPECTS])).alias("e"))
    known = long.where("e.m > 0 AND e.p IS NOT NULL").join(df.select("parent_asin", "segment"), "parent_asin")
    return known.groupBy("segment", F.col("e.aspect").alias("aspect")).agg(F.count(F.lit(1)).alias("products"), F.round(F.avg("e.p"), 5).alias("polarity"))


def aspect_cards(folded: DataFrame, snippets: DataFrame) -> DataFrame:
    """(parent_asin, aspect, mentions, polarity, praise, complaints): what reviews say of an aspect, and the reviews quoted for and against it, strongest first."""
    per = folded.groupBy("parent_asin", "aspect").agg(F.sum("n").alias("mentions"), tidy(F.avg("pol")).alias("polarity"))
    ids = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("rank", "review_id")))), lambda x: x["review_id"])
    quoted = snippets.groupBy("parent_asin", "aspect").agg(ids("praise").alias("praise"), ids("complaint").alias("complaints"))  # a few of each side
    none = F.array().cast("array<long>")
    return per.join(quoted, ["parent_asin", "aspect"], "left").withColumns({c: F.coalesce(c, none) for c in ("praise", "complaints")})


def mixed_opinions(folded: DataFrame, aspects_least: int = 3, strong: float = 0.5) -> DataFrame:
    """Reviews that praise one aspect and condemn another."""
    return folded.groupBy("review_id").agg(F.count(F.lit(1)).alias("n_aspects"), F.max("pol").alias("best"), F.min("pol").alias("worst")).where((F.col("n_aspects") >= aspects_least) & (F.col("best") > strong) & (F.col("worst") < -strong))


# ---------------------------------------------------------------- evaluation


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each stratum, drawn by a seeded hash; a sampling operator."""
    rank = F.row_number().over(W.partitionBy(stratum).orderBy(seeded(key, seed), key))  # a group limit acts before the shuffle
    return df.where(F.col(stratum).isNotNull()).withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")


def truth(rating: Column) -> Column:
    return F.when(rating >= 4, True).when(rating <= 2, False)


def binary_metrics(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """One row: cells, accuracy, precision, recall and F1 of both classes, macro F1; a division by zero is 0."""
    t, p = F.col(truth), F.col(predicted)
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    cells = df.where(t.isNotNull() & p.isNotNull()).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    pp, rp, pn, rn = zero(tp, tp + fp), zero(tp, tp + fn), zero(tn, tn + fn), zero(tn, tn + fp)
    fpos, fneg = zero(2 * pp * rp, pp + rp), zero(2 * pn * rn, pn + rn)
    return cells.select(
        "tp", "fp", "fn", "tn", F.round(zero(tp + tn, tp + fp + fn + tn), 6).alias("accuracy"), F.round(pp, 6).alias("precision_pos"), F.round(rp, 6).alias("recall_pos"), F.round(fpos, 6).alias("f1_pos"),
        F.round(pn, 6).alias("precision_neg"), F.round(rn, 6).alias("recall_neg"), F.round(fneg, 6).alias("f1_neg"), F.round((fpos + fneg) / 2, 6).alias("macro_f1"),
    )


def evaluate(scored: DataFrame, band: float = BAND) -> DataFrame:
    """Strict and banded metrics, a row each; banded abstains inside the band."""
    labelled = scored.withColumn("truth", truth(F.col("rating"))).where("truth IS NOT NULL").withColumn("predicted", F.col("sent_polarity") > 0)
    sure = labelled.where(F.abs("sent_polarity") > band)
    coverage = labelled.agg(F.round(F.avg((F.abs("sent_polarity") > band).cast("int")), 6).alias("coverage"))
    strict = binary_metrics(labelled).withColumn("mode", F.lit("strict")).withColumn("coverage", F.lit(1.0))
    banded = binary_metrics(sure).withColumn("mode", F.lit("banded")).crossJoin(coverage)  # one row
    return strict.unionByName(banded)


def accuracy_by_star(scored: DataFrame) -> DataFrame:
    t = scored.withColumn("truth", truth(F.col("rating"))).where("truth IS NOT NULL")
    right = ((F.col("sent_polarity") > 0) == F.col("truth")).cast("int")
    return t.groupBy("rating").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg(F.abs("sent_polarity")), 6).alias("mean_abs"))


def clause_benchmark(reviews: DataFrame) -> DataFrame:
    """Aspect clauses of 1- and 5-star reviews with the star as distant truth."""
    found = mentions(reviews.where("rating IN (1, 5)"))
    return found.join(reviews.select("review_id", (F.col("rating") == 5).alias("truth")), "review_id").withColumn("predicted", F.col("pol") > 0)


def compare_backends(scores: dict[str, DataFrame]) -> DataFrame:
    """Strict metrics of each named scoring, best macro F1 first."""
    rows = None
    for name, scored in scores.items():
        one = evaluate(scored).where("mode = 'strict'").withColumn("backend", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows.orderBy(F.desc("macro_f1"), "backend")
