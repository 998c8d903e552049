"""Questions against the catalogue: slots, hybrid scores, hard constraints with a relaxation ladder, and a plan per question type.

Everything is answered for a *table* of questions (question_id, question) in one plan: a question's slots are columns, its constraints are
predicates over them, ranks are windows per question. The questions are a stated set and are broadcast in one block; the catalogue is never collected.

Lexical scores come from an inverted index with tf-idf weights on both sides. The dense score compares a listing's stored vector with the mean of those of the
question's ``FEEDBACK`` lexically nearest listings, since no encoder of questions is at hand; a caller who has one passes its vectors instead.

Defined cases: a null question has type product_lookup and no slots; one without a known term scores 0 everywhere, and so on its priors; a listing
without a vector has its lexical score for the dense one; ties go to the smaller key; no questions or no listings give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cataloom.functions import vocabulary as V
from cataloom.operators.sentiment import cue_pattern
from cataloom.session import join_hot, staged

FEEDBACK = 5
QUESTION_BLOCK = 2000
#: Terms that more than this share of the listings hold meet the postings by broadcast; there are at most (terms a listing) / HOT_TERM of them.
HOT_TERM = 0.001

# ---------------------------------------------------------------- questions as columns


def _like(q: Column, pattern: str) -> Column:
    return F.coalesce(q.rlike("(?i)" + pattern), F.lit(False))


def _group(q: Column, pattern: str, index: int = 1) -> Column:
    g = F.regexp_extract(q, "(?i)" + pattern, index)
    return F.when(g != "", g)


def _hinted(q: Column, hints: Sequence[str]) -> Column:
    low = F.coalesce(F.lower(q), F.lit(""))
    return F.reduce(F.array(*[low.contains(h) for h in hints]), F.lit(False), lambda x, y: x | y)


def dollars(number: Column, thousands: Column) -> Column:
    """"1,200", "1.2" with k, and bare figures up to 15, which mean thousands."""
    v = F.regexp_replace(number, ",", "").try_cast("double")
    return F.when(thousands.isNotNull() | (v <= 15), v * 1000).otherwise(v)


def question_type(q: Column) -> Column:
    return (
        F.when(_like(q, V.ASKS_COMPARISON), "spec_compare")
        .when(_like(q, V.ASKS_RIVALS), "competitor")
        .when(_like(q, V.ASKS_MARKET) & ~_like(q, V.ASKS_ADVICE), "market")
        .when(_like(q, V.ASKS_ADVICE), "recommend")
        .otherwise("product_lookup")
    )


def slots(q: Column) -> dict[str, Column]:
    """All slots of a question that patterns can read, as columns."""
    none = F.lit(None).cast("string")
    a, b = dollars(_group(q, V.PRICE_BETWEEN, 1), none), dollars(_group(q, V.PRICE_BETWEEN, 2), none)
    high, low = dollars(_group(q, V.PRICE_MAX, 1), _group(q, V.PRICE_MAX, 2)), dollars(_group(q, V.PRICE_MIN, 1), _group(q, V.PRICE_MIN, 2))
    mid = F.when(high.isNull() & low.isNull(), dollars(_group(q, V.PRICE_AROUND, 1), _group(q, V.PRICE_AROUND, 2)))
    first = lambda pairs: F.coalesce(*[F.when(c, F.lit(v)) for c, v in pairs])
    every = lambda pairs: F.array_compact(F.array(*[F.when(c, F.lit(v)) for c, v in pairs]))
    segments = every((_hinted(q, h), s) for s, h in V.SEGMENT_HINTS.items())
    price_min, price_max = F.coalesce(F.least(a, b), low, 0.75 * mid), F.coalesce(F.greatest(a, b), high, 1.25 * mid)
    aspects = every((_like(q, cue_pattern(c)), a) for a, c in V.ASPECTS.items())
    kind = question_type(q)
    return {
        "question_type": kind,
        "segments": segments,
        "os_family": first((_hinted(q, h), o) for o, h in V.OS_HINTS.items()),
        "price_min": price_min,
        "price_max": price_max,
        "ram_min": _group(q, V.ASKED_RAM).try_cast("double"),
        "storage_min": F.coalesce(_group(q, V.ASKED_STORAGE_GB).try_cast("double"), _group(q, V.ASKED_STORAGE_TB).try_cast("double") * 1024),
        "screen_in": _group(q, V.ASKED_SCREEN).try_cast("double"),
        "cpu_tier": F.coalesce(_group(q, V.ASKED_TIER, 1), _group(q, V.ASKED_TIER, 2)).try_cast("double"),
        "discrete_gpu": _like(q, V.ASKED_DISCRETE) | F.array_contains(segments, "gaming"),
        "asins": F.coalesce(F.regexp_extract_all(q, F.lit(V.ASKED_ASIN), F.lit(0)), F.array().cast("array<string>")),
        "superlative": first((_like(q, p), name) for p, *_, name in V.SUPERLATIVES),
        "aspects": aspects,
        "wants_reviews": (kind != "market") | (F.size(aspects) > 0),
        "wants_price_stats": (kind == "market") | price_min.isNotNull() | price_max.isNotNull() | _hinted(q, V.PRICE_WORDS),
    }


def question_slots(questions: DataFrame, text: str) -> DataFrame:
    return questions.select("*", *[c.alias(n) for n, c in slots(F.col(text)).items()])


def question_brands(questions: DataFrame, text: str, key: str, brands: DataFrame) -> DataFrame:
    """(key, brands): brands of the vocabulary that stand in the question as words, longest first. The join is on the brand's first word."""
    words = questions.select(key, F.col(text).alias("q"), F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}&]+"))).alias("w"))
    named = brands.select("brand", F.element_at(F.split(F.lower("brand"), r"[^\p{L}\p{N}&]+"), 1).alias("w")).where("length(brand) > 1")
    hit = words.join(named, "w").where(F.expr("concat(' ', regexp_replace(lower(q), '[^\\\\p{L}\\\\p{N}&]+', ' '), ' ') LIKE concat('% ', regexp_replace(lower(brand), '[^\\\\p{L}\\\\p{N}&]+', ' '), ' %')"))
    return hit.groupBy(key).agg(F.transform(F.array_sort(F.collect_set(F.struct((-F.length("brand")).alias("n"), "brand"))), lambda x: x["brand"]).alias("brands"))


def name_phrases(q: Column, brands: Column, most: int = 4) -> Column:
    """What a question may call a product: the words from a brand up to a connective or a mark, and runs of capitalised words.

    A phrase inside a longer one goes; longest first.
    """
    text = F.coalesce(q, F.lit(""))
    after = F.transform(brands, lambda b: F.substr(text, F.greatest(F.instr(F.lower(text), F.lower(b)), F.lit(1)), F.lit(V.PHRASE_CHARS)))
    # everything from the first connective or mark behind the brand on is cut away
    tails = F.transform(F.arrays_zip(brands.alias("b"), after.alias("t")), lambda x: F.concat(F.substr(x["t"], F.lit(1), F.length(x["b"])), F.regexp_replace(F.substr(x["t"], F.length(x["b"]) + 1), rf"(?is)(?:[,.;?!]|{V.PHRASE_END}).*$", "")))
    tails = F.transform(tails, lambda t: F.array_join(F.slice(F.split(F.trim(F.regexp_replace(t, "[- ]+", " ")), " "), 1, V.PHRASE_WORDS), " "))
    found = F.concat(F.filter(tails, lambda t: t.contains(" ")), F.filter(F.regexp_extract_all(text, F.lit(V.CAPITALISED), F.lit(1)), lambda t: F.length(t) >= 4))
    found = F.array_distinct(F.filter(found, lambda t: ~F.lower(t).isin(*V.NO_ENTITY)))
    inside = lambda t: F.exists(found, lambda o: (F.length(o) > F.length(t)) & F.lower(o).contains(F.lower(t)))
    outer = F.filter(found, lambda t: ~inside(t))
    return F.slice(F.transform(F.array_sort(F.transform(outer, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: x["t"]), 1, most)


def comparison_sides(q: Column, most: int = 3) -> Column:
    """The two or three sides of a comparison."""
    body = F.regexp_replace(F.coalesce(q, F.lit("")), "(?i)" + V.COMPARISON_OPENING, "")
    sides = F.transform(F.split(body, "(?i)" + V.COMPARISON_SPLIT), lambda s: F.btrim(s, F.lit(" ?.,")))
    return F.slice(F.filter(sides, lambda s: F.length(s) > 3), 1, most)


def read(questions: DataFrame, brands: DataFrame) -> DataFrame:
    """(question_id, question, ask): all that is read from each question, as one struct."""
    named = question_brands(questions, "question", "question_id", brands)
    out = questions.join(named, "question_id", "left").withColumn("brands", F.coalesce("brands", F.array().cast("array<string>")))
    q = F.col("question")
    ask = {**slots(q), "brands": F.col("brands"), "phrases": name_phrases(q, F.col("brands")), "sides": comparison_sides(q)}
    return out.select("question_id", "question", F.struct(*[c.alias(n) for n, c in ask.items()]).alias("ask"))


# ---------------------------------------------------------------- lexical index

_ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
INDEXED = ("brand", "title", "segment", "gpu_model", "cpu_family")


def terms(text: Column) -> Column:
    """Words of two characters and more and their bigrams, lower case without accents."""
    words = F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), *_ACCENTS), F.lit("[a-z0-9_]{2,}"), F.lit(0))
    return F.concat(words, F.zip_with(words, F.slice(words, 2, 1_000_000), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b))))


def indexed_text() -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in INDEXED])


@dataclass(frozen=True)
class Index:
    """``postings`` (key, term, weight) at unit length a document, ``vocabulary`` (term, idf)."""

    postings: DataFrame
    vocabulary: DataFrame


def _counted(df: DataFrame, key: str, text: Column) -> DataFrame:
    return df.select(key, F.explode(F.array_compact(terms(text))).alias("term")).groupBy(key, "term").agg((1 + F.log(F.count(F.lit(1)))).alias("tf"))


def index(df: DataFrame, key: str, text: Column, min_df: int = 2) -> Index:
    """Sublinear tf, smoothed idf, unit length; all terms of at least ``min_df`` documents.

    A term that nearly every document holds would fill one task of a join on terms: such terms, of bounded number, are broadcast, only the others are shuffled.
    """
    # both are read several times below
    tf = staged(_counted(df, key, text), "index-counts")
    n = df.agg(F.count(F.lit(1)).alias("n_docs"))
    frequency = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df).crossJoin(F.broadcast(n))  # one row
    vocabulary = frequency.select("term", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"), (F.col("df") > HOT_TERM * F.col("n_docs")).alias("hot"))
    vocabulary = staged(vocabulary, "index-vocabulary")
    raw = join_hot(tf, vocabulary, ["term"], F.col("hot"))
    raw = raw.select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(key)))  # a document's terms
    return Index(raw.select(key, "term", (F.col("w") / norm).alias("weight")), vocabulary.drop("hot"))


def lexical_scores(found: Index, key: str, questions: DataFrame) -> DataFrame:
    """(question_id, key, lexical): cosine of the question's known terms, weighted as the documents' are, with the index."""
    asked = _counted(questions, "question_id", F.col("question")).join(found.vocabulary, "term").select("question_id", "term", (F.col("tf") * F.col("idf")).alias("qw"))
    norm = asked.groupBy("question_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    asked = asked.join(norm, "question_id").select("question_id", "term", (F.col("qw") / F.col("qn")).alias("qw"))
    return found.postings.join(F.broadcast(asked), "term").groupBy("question_id", key).agg(F.sum(F.col("weight") * F.col("qw")).alias("lexical"))  # the questions' terms


# ---------------------------------------------------------------- dense side


def feedback_vectors(lexical: DataFrame, vectors: DataFrame, best: int = FEEDBACK) -> DataFrame:
    """(question_id, vector): the mean vector of each question's lexically nearest listings that have one."""
    nearest = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc(F.round("lexical", 8)), "parent_asin"))
    top = lexical.join(vectors.select("parent_asin"), "parent_asin", "left_semi").withColumn("rn", nearest).where(F.col("rn") <= best)
    top = F.broadcast(top.select("question_id", "parent_asin"))  # FEEDBACK rows a question
    cells = vectors.join(top, "parent_asin").select("question_id", F.posexplode("embedding").alias("i", "x"))
    mean = cells.groupBy("question_id", "i").agg(F.avg("x").alias("x"))
    return mean.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("vector"))


def dense_scores(vectors: DataFrame, asked: DataFrame) -> DataFrame:
    """(question_id, parent_asin, dense): cosines of the questions' vectors with all listings', as matrix products in Arrow batches."""
    spark = vectors.sparkSession
    kind = asked.schema["question_id"].dataType.simpleString()
    parts, block = [], []

    def against(rows: list) -> DataFrame:
        q = np.array([r["vector"] for r in rows], np.float64)
        sent = spark.sparkContext.broadcast(([r["question_id"] for r in rows], q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)))

        def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
                    s = x @ q.T / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                    yield pd.DataFrame({"question_id": np.tile(ids, len(pdf)), "parent_asin": np.repeat(pdf["parent_asin"].to_numpy(), len(ids)), "dense": s.ravel()})

        return vectors.select("parent_asin", "embedding").mapInPandas(scored, f"question_id {kind}, parent_asin string, dense double")

    for r in asked.toLocalIterator():  # a stated set, a vector each
        block.append(r)
        if len(block) == QUESTION_BLOCK:
            parts.append(against(block))
            block = []
    if block or not parts:
        parts.append(against(block) if block else spark.createDataFrame([], f"question_id {kind}, parent_asin string, dense double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scores(found: Index, vectors: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, parent_asin, lexical, dense) of every listing that one of the two reaches."""
    lexical = staged(lexical_scores(found, "parent_asin", questions), "lexical-scores")
    return staged(lexical.join(dense_scores(vectors, feedback_vectors(lexical, vectors)), ["question_id", "parent_asin"], "full"), "scores")


# ---------------------------------------------------------------- search


def priors(df: DataFrame) -> DataFrame:
    """Adds ``prior``: popularity, rating (from 20 ratings on) and mined evidence."""
    top = df.agg(F.max(F.log1p("rating_number")).alias("top"))
    rating = F.when(F.col("rating_number") >= V.RATING_FROM, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.coalesce("average_rating", F.lit(3.0)) - 3) / 2))).otherwise(0.0)
    popularity = F.coalesce(F.try_divide(F.log1p("rating_number"), F.col("top")), F.lit(0.0))
    out = df.crossJoin(F.broadcast(top))  # one row
    return out.withColumn("prior", V.POPULARITY * popularity + V.RATING_PRIOR * rating + V.EVIDENCE * F.col("has_sentiment").cast("int")).drop("top")


def hybrid() -> Column:
    lexical = F.coalesce("lexical", F.lit(0.0))
    return F.round(V.DENSE * F.coalesce(F.col("dense"), lexical) + (1 - V.DENSE) * lexical + F.col("prior"), 6)


def scored(df: DataFrame, asked: DataFrame, found: DataFrame) -> DataFrame:
    """Every listing under every question, with its score: a stated set of questions against all rows."""
    rows = priors(df).crossJoin(F.broadcast(asked.select("question_id", "ask")))
    return rows.join(found, ["question_id", "parent_asin"], "left").withColumn("score", hybrid())


def constraint(use_price: bool = True) -> Column:
    """A question's hard constraints on a listing; a budget also drops listings without a price."""
    ask = lambda c: F.col(f"ask.{c}")
    any_of = lambda c: F.size(ask(c)) == 0
    held = [
        any_of("brands") | F.exists(ask("brands"), lambda b: F.lower(b) == F.lower("brand")),
        any_of("segments") | F.array_contains(ask("segments"), F.col("segment")),
        # an operating system counts only while one kind of machine is asked for
        ask("os_family").isNull() | (F.size(ask("segments")) > 1) | (F.col("os_family") == ask("os_family")),
        ask("screen_in").isNull() | (F.abs(F.col("screen_in") - ask("screen_in")) <= 1.0),
        ~(ask("discrete_gpu") & ask("question_type").isin("recommend", "product_lookup")) | F.col("is_discrete_gpu"),
        *[ask(bound).isNull() | (F.col(c) >= ask(bound)) for bound, c in (("ram_min", "ram_gb"), ("storage_min", "storage_gb"), ("cpu_tier", "cpu_tier"))],
    ]
    if use_price:
        held += [ask("price_max").isNull() | (F.col("price") <= ask("price_max")), ask("price_min").isNull() | (F.col("price") >= ask("price_min"))]
    out = F.lit(True)
    for h in held:
        out = out & F.coalesce(h, F.lit(False))
    return out


STEPS = ("all constraints", "price constraint dropped", "no constraints")


def relaxation_ladder(df: DataFrame, asked: DataFrame, k: int = 6) -> DataFrame:
    """(question_id, step, label, candidates, chosen): all constraints, without price (if one is set), none; the first with max(k, 3) rows is chosen. One pass counts all."""
    wide = df.crossJoin(F.broadcast(asked.select("question_id", "ask"))).groupBy("question_id").agg(
        F.count_if(constraint()).alias("s0"), F.count_if(constraint(False)).alias("s1"), F.count(F.lit(1)).alias("s2"),
        F.bool_or(F.col("ask.price_min").isNotNull() | F.col("ask.price_max").isNotNull()).alias("priced"),
    )
    need = max(k, 3)
    chosen = F.when(F.col("s0") >= need, 0).when(F.col("priced") & (F.col("s1") >= need), 1).otherwise(2)
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(name).alias("label"), F.col(f"s{i}").alias("candidates")) for i, name in enumerate(STEPS)])
    rows = wide.select("question_id", "priced", chosen.alias("at"), F.explode(steps).alias("r")).where("r.step <> 1 OR priced")
    return rows.select("question_id", "r.*", (F.col("r.step") == F.col("at")).alias("chosen"))


def _extreme() -> tuple[Column, Column]:
    """(sort key of the superlative asked for, ascending; whether one is)."""
    key = None
    for _, column, up, name in V.SUPERLATIVES:
        value = F.col(column).cast("double") * (1 if up else -1)
        key = (F.when if key is None else key.when)(F.col("ask.superlative") == name, value)
    return key, F.col("ask.superlative").isNotNull()


def search(rows: DataFrame, ladder: DataFrame, k: int = 6) -> DataFrame:
    """(question_id, rank, parent_asin, brand, segment, price, score, relaxation, ordering, n_candidates): the k listings of each question. ``rows`` come from ``scored``.

    A superlative orders the whole filtered set, without listings that lack the property (unless all do); at most two of a brand, unless that leaves fewer than k. The pool in which brands are
    counted holds 400 rows at least, so what a brand has too many of lies in it as well and k rows always come from it.
    """
    level = ladder.where("chosen").select("question_id", F.col("step").alias("level"), F.col("label").alias("relaxation"), F.col("candidates").alias("n_candidates"))
    kept = rows.join(F.broadcast(level), "question_id").where((F.col("level") == 2) | ((F.col("level") == 1) & constraint(False)) | ((F.col("level") == 0) & constraint()))
    key, asked = _extreme()
    kept = kept.withColumn("_key", key)
    known = kept.groupBy("question_id").agg((F.count("_key") > 0).alias("_known"))
    kept = kept.join(F.broadcast(known), "question_id").withColumn("_by", asked & F.col("_known")).where(~F.col("_by") | F.col("_key").isNotNull())
    order = [F.asc_nulls_first(F.when(F.col("_by"), F.col("_key"))), F.desc(F.when(~F.col("_by"), F.col("score"))), F.asc("parent_asin")]
    pool = kept.withColumn("_at", F.row_number().over(W.partitionBy("question_id").orderBy(*order))).where(F.col("_at") <= max(400, 40 * k))
    pool = pool.withColumn("_over", F.row_number().over(W.partitionBy("question_id", "brand").orderBy("_at")) > V.PER_BRAND)
    rank = F.row_number().over(W.partitionBy("question_id").orderBy("_over", "_at"))
    ordering = F.when(F.col("_by"), F.concat(F.lit("sorted by "), F.col("ask.superlative"))).otherwise("relevance")
    return pool.withColumn("rank", rank).where(F.col("rank") <= k).select("question_id", "rank", "parent_asin", "brand", "segment", "price", "score", "relaxation", ordering.alias("ordering"), "n_candidates")


def resolve(rows: DataFrame, floor: float = V.FLOOR) -> DataFrame:
    """(question_id, parent_asin, brand, segment, price, score): the best listing of each question among its brands, of its segments where there is one; none below the floor."""
    brand = (F.size("ask.brands") == 0) | F.array_contains("ask.brands", F.col("brand"))
    fits = F.coalesce((F.size("ask.segments") == 0) | F.array_contains("ask.segments", F.col("segment")), F.lit(False))
    best = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc(fits), F.desc("score"), "parent_asin"))
    return rows.where(brand).withColumn("rn", best).where((F.col("rn") == 1) & (F.col("score") >= floor)).select("question_id", "parent_asin", "brand", "segment", "price", "score")


# ---------------------------------------------------------------- evidence


def review_evidence(snippets: DataFrame, aspects: Sequence[str], k: int = 3) -> DataFrame:
    """(parent_asin, ...) up to k snippets a product: one praise and one complaint of each asked aspect, then the two strongest of either side over all; what starts alike counts once."""
    praise = F.col("side") == "praise"
    asked = F.array_position(F.array(*[F.lit(a) for a in aspects]).cast("array<string>"), F.col("aspect"))
    strongest = F.row_number().over(W.partitionBy("parent_asin", "side").orderBy(F.desc("score"), "review_id", "aspect"))  # a few snippets a product
    rows = snippets.withColumn("_overall", strongest)
    turn = F.when((asked > 0) & (F.col("rank") == 1), asked).when(F.col("_overall") <= 2, F.lit(1000))
    rows = rows.withColumn("_turn", turn).where("_turn IS NOT NULL").withColumn("_start", F.lower(F.substring("snip", 1, 80)))
    key = F.struct("_turn", F.when(praise, 0).otherwise(1).alias("s"), (-F.col("score")).alias("n"), "review_id", "aspect")
    once = rows.groupBy("parent_asin", "_start").agg(F.min_by(F.struct("aspect", "side", "review_id", "snip", "score", key.alias("k")), key).alias("b")).select("parent_asin", "b.*")
    rank = F.row_number().over(W.partitionBy("parent_asin").orderBy("k"))
    return once.withColumn("evidence_rank", rank).where(F.col("evidence_rank") <= k).drop("k")


def stat_line(kind: str, name: str) -> Column:
    """One line of market statistics with its denominator."""
    money = lambda c: F.coalesce(F.concat(F.lit("$"), F.format_number(F.col(c), 0)), F.lit("unknown"))
    return F.concat(
        F.lit(f"{kind} '"), F.col(name), F.lit("': median "), money("median"), F.lit(", middle half "), money("p25"), F.lit(" to "), money("p75"),
        F.lit("; priced "), F.col("n").cast("string"), F.lit(" of "), F.col("n_total").cast("string"), F.when(F.col("reliable"), "").otherwise(" (small sample)"),
    )


def market_stats(segments: DataFrame, premium: DataFrame, brands: DataFrame, asked: DataFrame, limit: int = 8) -> DataFrame:
    """(question_id, position, line): segment rows, the graphics premium when asked for, brand rows (the largest first), up to ``limit`` lines a question."""
    a = F.broadcast(asked)
    named = lambda c, of: (F.size(f"ask.{of}") == 0) | F.array_contains(f"ask.{of}", F.col(c))
    s = segments.crossJoin(a).where(named("segment", "segments")).select("question_id", F.lit(0).alias("part"), F.lit(0).alias("size"), F.col("segment").alias("name"), stat_line("Segment", "segment").alias("line"))
    text = F.concat(
        F.lit("Premium for discrete graphics in '"), F.col("segment"), F.lit("': $"), F.format_number("premium_usd", 0), F.lit(" over "), F.col("n_discrete").cast("string"), F.lit(" and "),
        F.col("n_integrated").cast("string"), F.lit(" priced listings"),
    )
    wanted = (F.col("ask.discrete_gpu") | _hinted(F.col("question"), ("gpu", "graphics"))) & ((F.col("segment") == "ALL") | F.array_contains("ask.segments", F.col("segment"))) & F.col("premium_usd").isNotNull()
    p = premium.crossJoin(a).where(wanted).select("question_id", F.lit(1).alias("part"), F.lit(0).alias("size"), F.col("segment").alias("name"), text.alias("line"))
    market = (F.size("ask.brands") > 0) | (F.col("ask.question_type") == "market")
    b = brands.crossJoin(a).where(market & named("brand", "brands")).select("question_id", F.lit(2).alias("part"), (-F.col("n_total")).alias("size"), F.col("brand").alias("name"), stat_line("Brand", "brand").alias("line"))
    position = F.row_number().over(W.partitionBy("question_id").orderBy("part", "size", "name"))  # some fifty rows a question
    return s.unionByName(p).unionByName(b).withColumn("position", position).where(F.col("position") <= limit).select("question_id", "position", "line")


# ---------------------------------------------------------------- plans by question type


def union_first(frames: Sequence[DataFrame], *keys: str) -> DataFrame:
    """Union of frames with one row per key: that of the earliest frame."""
    rows = None
    for i, f in enumerate(frames):
        one = f.withColumn("_part", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    kept = rows.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.min_by(F.struct(*rows.columns), F.struct("_part", F.xxhash64(*rows.columns))).alias("_r"))
    return kept.select("_r.*").drop("_part")


def market_examples(rows: DataFrame, k: int = 2) -> DataFrame:
    """(question_id, segment, rank, parent_asin, score): the k best listings of each segment that a question asks for, or of all."""
    rank = F.row_number().over(W.partitionBy("question_id", "segment").orderBy(F.desc("score"), "parent_asin"))  # a group limit acts before the shuffle
    fits = (F.size("ask.segments") == 0) | F.array_contains("ask.segments", F.col("segment"))
    return rows.where(fits).withColumn("rank", rank).where(F.col("rank") <= k).select("question_id", "segment", "rank", "parent_asin", "score")


def side_questions(asked: DataFrame) -> DataFrame:
    """Each side of a comparison as a question of its own: (question_id: "<id>/<side>", question, ask) with the whole question's segments and the brands that the side names."""
    side = asked.select("question_id", "ask", F.posexplode("ask.sides").alias("n", "side"))
    own = F.filter("ask.brands", lambda b: F.lower("side").contains(F.lower(b)))
    return side.select(F.concat_ws("/", F.col("question_id").cast("string"), "n").alias("question_id"), F.col("side").alias("question"), F.col("ask").withField("brands", own).alias("ask"))


def comparison(sides: DataFrame, fill: DataFrame, k: int = 2) -> DataFrame:
    """(question_id, turn, parent_asin, score): the listing of each side (``resolve`` of ``side_questions``), filled up to ``k`` by the search of the whole question."""
    parts = F.split("question_id", "/")
    first = sides.select(parts[0].alias("question_id"), parts[1].cast("int").alias("turn"), "parent_asin", "score")
    rest = fill.select(F.col("question_id").cast("string").alias("question_id"), (F.lit(100) + F.col("rank")).alias("turn"), "parent_asin", "score")
    rows = union_first([first, rest], "question_id", "parent_asin")
    n = first.groupBy("question_id").agg(F.count_distinct("parent_asin").alias("n"))
    place = F.row_number().over(W.partitionBy("question_id").orderBy("turn", "parent_asin"))
    return rows.join(n, "question_id", "left").withColumn("place", place).where(F.col("place") <= F.greatest(F.lit(k), F.coalesce("n", F.lit(0)))).select("question_id", F.col("place").alias("turn"), "parent_asin", "score")


def rivals(anchors: DataFrame, features: DataFrame, k: int = 5) -> DataFrame:
    """(question_id, role, rank, parent_asin): the listing asked about (role anchor) and its k competitors, two of a brand at most."""
    from cataloom.operators import matching

    found = matching.competitors(features.join(anchors.select("parent_asin").distinct(), "parent_asin", "left_semi"), features, matching.Options(k=k, per_brand=V.PER_BRAND))
    first = anchors.select("question_id", F.lit("anchor").alias("role"), F.lit(0).alias("rank"), "parent_asin")
    near = anchors.select("question_id", F.col("parent_asin").alias("query")).join(found, "query").select("question_id", F.lit("competitor").alias("role"), "rank", F.col("candidate").alias("parent_asin"))
    return union_first([first, near], "question_id", "parent_asin")


def notes(relaxation: Column, ordering: Column, priced: Column) -> Column:
    """Caveats that an answer has to state."""
    return F.array_compact(
        F.array(
            F.when(relaxation != STEPS[0], F.concat(F.lit("Constraints were relaxed: "), relaxation, F.lit("."))),
            F.when(ordering != "relevance", F.concat(F.lit("Listings are "), ordering, F.lit("."))),
            F.when(priced, "Only listings with a known price were considered."),
        )
    )


def retrieve(df: DataFrame, features: DataFrame, found: Index, vectors: DataFrame, asked: DataFrame, k: int = 6) -> DataFrame:
    """(question_id, question_type, role, rank, parent_asin, notes): each question by the plan that its type asks for."""
    of = lambda *kinds: asked.where(F.col("ask.question_type").isin(*kinds))
    rows = lambda some: scored(df, some, scores(found, vectors, some))
    none = F.array().cast("array<string>").alias("notes")
    plain, compare = of("recommend", "product_lookup"), of("spec_compare")
    price = asked.select("question_id", (F.col("ask.price_min").isNotNull() | F.col("ask.price_max").isNotNull()).alias("priced"))
    listed = search(rows(plain), relaxation_ladder(df, plain, k), k).join(F.broadcast(price), "question_id")
    parts = [listed.select("question_id", F.lit("listing").alias("role"), "rank", "parent_asin", notes(F.col("relaxation"), F.col("ordering"), F.col("priced")).alias("notes"))]
    sides = side_questions(compare)
    both = comparison(resolve(rows(sides)), search(rows(compare), relaxation_ladder(df, compare, 4), 4))
    parts.append(both.select(F.col("question_id").cast(asked.schema["question_id"].dataType).alias("question_id"), F.lit("side").alias("role"), F.col("turn").alias("rank"), "parent_asin", none))
    have = rows(of("competitor")).join(features.select("parent_asin"), "parent_asin", "left_semi")
    parts.append(rivals(resolve(have), features).select("question_id", "role", "rank", "parent_asin", none))
    parts.append(market_examples(rows(of("market"))).select("question_id", F.concat(F.lit("example of "), "segment").alias("role"), "rank", "parent_asin", none))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(F.broadcast(asked.select("question_id", "ask.question_type")), "question_id").select("question_id", "question_type", "role", "rank", "parent_asin", "notes")


def evidence_counts(evidence: DataFrame) -> DataFrame:
    """Blocks by kind."""
    return evidence.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
