"""Competitor search: text similarity and specification similarity under segment and price guards, in batches.

The queries are a stated set: in blocks of at most ``QUERY_BLOCK``, so many that all cores have work, they are broadcast and meet the catalogue where it lies, so nothing of it is shuffled and no segment
or price band can fill one task. Text similarities are matrix products in Arrow batches, for all options asked for at once. All pairs are scored in single precision; those that may be among a query's best
``max(400, 60 k)`` candidates are scored again in double, and only these are kept. A task that met the whole catalogue emits a query's k results, others their candidates.

Defined cases: a null or empty signature excludes nothing; an unknown property counts 0.45 at half its weight; ties go to the smaller key; no queries or no listings give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cataloom.functions import parse
from cataloom.functions import vocabulary as V

# Feature, weight, scale, clip.
FEATURES = (("cpu_tier", 1.0, "linear", 3.0, 9.0), ("ram_gb", 1.0, "log2", 2.0, 64.0), ("storage_gb", 0.8, "log2", 16.0, 4096.0), ("screen_in", 0.7, "linear", 10.0, 18.0), ("is_discrete_gpu", 1.0, "linear", 0.0, 1.0), ("price", 1.2, "log10", 80.0, 5000.0))
MISSING_DISTANCE, MISSING_WEIGHT = 0.45, 0.5
LAST_PRICE, MIN_GROUP = 500.0, 3
QUERY_BLOCK, TASK_ROWS, MET_PAIRS = 4000, 10_000, 1_000_000
NEAR = 1e-4  # scores in single precision are closer than this to those in double


@dataclass(frozen=True)
class Options:
    k: int = 10
    text_weight: float = 0.60
    guard: bool = True
    min_affinity: float = 0.25
    band: float = 2.25
    segment_penalty: float = 0.35
    price_penalty: float = 0.15
    per_brand: int | None = 3
    same_brand: bool | None = None
    exclude_same_model: bool = True
    priced_only: bool = False


def normalised(value: Column, scale: str, low: float, high: float) -> Column:
    """To [0, 1] after clipping; null stays null."""
    v = value.cast("double")
    clipped = F.when(v.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), v)))
    if scale == "linear":
        return (clipped - low) / (high - low)
    f, base = (F.log2, math.log2) if scale == "log2" else (F.log10, math.log10)
    return (f(clipped) - base(low)) / (base(high) - base(low))


def spec_similarity(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> np.ndarray:
    """1 minus the weighted mean distance of normalised features (NaN where unknown), of every a with every b; an unknown one counts 0.45 at half its weight."""
    total = weights = 0.0
    for name, weight, *_ in FEATURES:
        gap = np.abs(a[name][:, None] - b[name][None, :])
        known = ~np.isnan(gap)
        total = total + np.where(known, np.nan_to_num(gap) * weight, MISSING_DISTANCE * weight * MISSING_WEIGHT)
        weights = weights + np.where(known, weight, weight * MISSING_WEIGHT)
    return 1 - total / weights


def spec_of_pairs(a: dict[str, np.ndarray], i: np.ndarray, b: dict[str, np.ndarray], j: np.ndarray) -> np.ndarray:
    """``spec_similarity`` of the pairs (a[i], b[j])."""
    total = weights = np.zeros(len(i))
    for name, weight, *_ in FEATURES:
        gap = np.abs(a[name][i] - b[name][j])
        known = ~np.isnan(gap)
        total = total + np.where(known, gap * weight, MISSING_DISTANCE * weight * MISSING_WEIGHT)
        weights = weights + np.where(known, weight, weight * MISSING_WEIGHT)
    return 1 - total / weights


def _side(facts: dict[str, np.ndarray]) -> list[np.ndarray]:
    """(weighted features with 0 where unknown, which are known), a row a feature."""
    known = np.stack([~np.isnan(facts[n]) for n, *_ in FEATURES])
    value = np.stack([np.nan_to_num(facts[n]) * w for n, w, *_ in FEATURES])
    return [value.astype(np.float32), known.astype(np.float32)]


def near_spec(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """``spec_similarity`` in single precision, from ``_side`` of both."""
    weight = np.array([w for _, w, *_ in FEATURES], np.float32)
    total = np.zeros((a[0].shape[1], b[0].shape[1]), np.float32)
    gap = np.empty_like(total)
    for x, y in zip(a[0], b[0]):
        np.subtract.outer(x, y, out=gap)
        np.abs(gap, out=gap)
        total += gap
    both = (a[1] * weight[:, None]).T @ b[1]
    # an unknown one was taken for 0
    total -= (1 - a[1]).T @ np.abs(b[0]) + np.abs(a[0]).T @ (1 - b[1])
    total += np.float32(MISSING_DISTANCE * MISSING_WEIGHT) * (weight.sum() - both)
    return 1 - total / (weight.sum() * np.float32(MISSING_WEIGHT) + np.float32(1 - MISSING_WEIGHT) * both)


def affinity(spark: SparkSession) -> DataFrame:
    """(seg_q, seg_c, affinity) of all 36 ordered pairs."""
    rows = [(s, s, 1.0) for s in V.SEGMENTS] + [(a, b, x) for (p, q), x in V.AFFINITY.items() for a, b in ((p, q), (q, p))]
    return spark.createDataFrame(rows, "seg_q string, seg_c string, affinity double")


def ram_bucket(ram: Column) -> Column:
    return F.when(ram.isNull(), "missing").when(ram <= 4, "4").when(ram <= 8, "8").when(ram <= 16, "16").when(ram <= 32, "32").otherwise("more")


LEVELS = (("segment", "is_renewed", "cpu_family", "ram_bucket"), ("segment", "is_renewed", "cpu_family", "ram_bucket", "cpu_tier"), ("segment", "is_renewed"), ("segment",))


def price_estimate(df: DataFrame) -> DataFrame:
    """(parent_asin, estimate, observed): the price, or the median of the finest group of at least 3 prices; for filters only, never for statistics."""
    rows = df.select("parent_asin", "price", "segment", "is_renewed", "cpu_family", F.coalesce(F.col("cpu_tier").cast("string"), F.lit("na")).alias("cpu_tier"), ram_bucket(F.col("ram_gb")).alias("ram_bucket"))
    # tier first where it is known, then the coarser levels
    out = rows
    names = []
    for i, keys in enumerate((LEVELS[1], LEVELS[0], LEVELS[2], LEVELS[3])):
        stats = rows.groupBy(*keys).agg(F.median("price").alias(f"m{i}"), F.count("price").alias("n")).where(F.col("n") >= MIN_GROUP).drop("n")
        out = out.join(stats, list(keys), "left")
        names.append(f"m{i}")
    whole = rows.agg(F.median("price").alias("mall"))
    out = out.crossJoin(F.broadcast(whole))  # one row
    return out.select("parent_asin", F.coalesce("price", *names, "mall", F.lit(LAST_PRICE)).alias("estimate"), F.col("price").isNotNull().alias("observed"))


def features(df: DataFrame, vectors: DataFrame) -> DataFrame:
    """The listings that have a vector, with everything a match needs."""
    sig = parse.model_signature(F.col("title"), F.col("brand"))
    spec = [normalised(F.col(n), s, lo, hi).alias(f"f_{n}") for n, _, s, lo, hi in FEATURES]
    return df.join(vectors, "parent_asin").join(price_estimate(df), "parent_asin").select("parent_asin", "brand", "segment", "price", "estimate", "observed", "embedding", sig.alias("sig"), *spec)


class _Pool:
    """The best ``size`` candidates of each query so far, under one set of options: flat columns, merged when enough have come."""

    def __init__(self, options: Options, queries: int, size: int):
        self.o, self.size = options, size
        self.least = np.full(queries, -np.inf)  # score of the last of a full pool
        self.held: dict[str, np.ndarray] = {}
        self.new: list[dict[str, np.ndarray]] = []
        self.waiting = 0

    def add(self, found: dict[str, np.ndarray]) -> None:
        self.new.append(found)
        self.waiting += len(found["i"])
        if self.waiting > len(self.held.get("i", ())) / 2 + 10_000:
            self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        parts = [self.held] * bool(self.held) + self.new
        both = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        order = np.argsort((both["i"].astype(np.int64) << 32) - np.rint(both["score"] * 1e6).astype(np.int64))  # scores have six digits
        i, score = both["i"][order], both["score"][order]
        first = np.searchsorted(i, np.arange(len(self.least) + 1))
        place = np.arange(len(i)) - first[i]
        keep = place < self.size
        full = np.flatnonzero(np.diff(first) >= self.size)
        self.least[full] = score[first[full] + self.size - 1]
        # equal scores at the edge: the smaller keys stay
        edge = score == self.least[i]
        cut = np.bincount(i[edge & ~keep], minlength=len(self.least)) > 0
        tied = np.flatnonzero(edge & cut[i])
        if len(tied):
            room = np.bincount(i[edge & keep], minlength=len(self.least))
            keep[tied] = False
            names = pd.DataFrame({"i": i[tied], "candidate": both["candidate"][order[tied]], "at": tied}).sort_values(["i", "candidate"])
            keep[names["at"][names.groupby("i").cumcount() < room[names["i"]]]] = True
        self.held = {k: v[order[keep]] for k, v in both.items()}
        self.new, self.waiting = [], 0

    def picked(self) -> None:
        """Leave only the k results of each query."""
        h, o = self.held, self.o
        name = pd.factorize(h["candidate"], sort=True)[0]
        order = np.lexsort((name, -h["score"], h["i"]))
        i = h["i"][order]
        if o.per_brand is not None:
            over = pd.DataFrame({"i": i, "brand": pd.factorize(h["brand"][order])[0]}).groupby(["i", "brand"]).cumcount().to_numpy() >= o.per_brand
            order = order[np.lexsort((np.arange(len(i)), over, i))]
        first = np.searchsorted(i, np.arange(len(self.least) + 1))
        self.held = {k: v[order[np.arange(len(i)) - first[i] < o.k]] for k, v in h.items()}


class _Block:
    """A block of queries as arrays, and for each set of options the best candidates that a task has met so far."""

    def __init__(self, queries: pd.DataFrame, near: dict[tuple[str, str], float], options: tuple[Options, ...], pools: list[int]):
        self.q, self.near = queries, near
        self.vectors, self.facts = _arrays(queries)
        self.side = _side(self.facts)
        self.pools = [_Pool(o, len(queries), size) for o, size in zip(options, pools)]
        index = lambda column: {v: i for i, v in enumerate(pd.unique(queries[column]))}
        self.codes = {c: index(c) for c in ("parent_asin", "sig", "brand", "segment")}
        self.codes["sig"] = {v: i for v, i in self.codes["sig"].items() if v}
        self.own = {c: self.code(queries, c) for c in self.codes}
        self.estimate, self.observed = queries["estimate"].to_numpy(np.float64), queries["observed"].to_numpy(bool)

    def code(self, side: pd.DataFrame, column: str) -> np.ndarray:
        return side[column].map(self.codes[column]).fillna(-1).to_numpy(np.int64)

    def meet(self, c: pd.DataFrame) -> None:
        """Score every query with every row of ``c``: all pairs in single precision, and what may be among a query's best again in double."""
        vectors, facts = _arrays(c)
        side = _side(facts)
        other = {x: self.code(c, x) for x in ("parent_asin", "sig", "brand")}
        estimate, observed = c["estimate"].to_numpy(np.float64), c["observed"].to_numpy(bool)
        columns = {x: c[x].to_numpy() for x in ("parent_asin", "segment", "brand")}
        related = [self.affinity(c["segment"], pool.o) for pool in self.pools]
        step = max(1, MET_PAIRS // len(self.q))
        for start in range(0, len(c), step):
            at = slice(start, start + step)
            text = self.vectors @ vectors[at].T
            spec = near_spec(self.side, [x[:, at] for x in side])
            for pool, near in zip(self.pools, related):
                o, near = pool.o, near[:, at]
                s = self.near_scores(o, text, spec, near, {k: v[at] for k, v in other.items()}, estimate[at], observed[at])
                # what isn't among the best of these rows isn't among the best of all
                least = np.maximum(pool.least, -1e30)
                many = np.flatnonzero((s >= (least - NEAR).astype(np.float32)[:, None]).sum(axis=1) > 1.2 * pool.size)
                if len(many):
                    least[many] = np.maximum(least[many], np.partition(s[many], -pool.size, axis=1)[:, -pool.size])
                i, j = np.nonzero(s >= (least - NEAR).astype(np.float32)[:, None])
                likeness, k = text[i, j], j + start
                spec_of, close, ratio = spec_of_pairs(self.facts, i, facts, k), near[i, j], estimate[k] / self.estimate[i]
                score = o.text_weight * likeness + (1 - o.text_weight) * spec_of
                if o.guard:
                    score = score - o.segment_penalty * (1 - close) - o.price_penalty * np.minimum(1.0, np.abs(ratio - 1))
                ok = score >= pool.least[i] - 1e-6
                i, k = i[ok], k[ok]
                pool.add({"i": i, "score": np.round(score[ok], 6), "text": likeness[ok], "spec": spec_of[ok], "ratio": ratio[ok], "affinity": close[ok], "observed": self.observed[i] & observed[k], "candidate": columns["parent_asin"][k], "segment": columns["segment"][k], "brand": columns["brand"][k]})

    def near_scores(self, o: Options, text: np.ndarray, spec: np.ndarray, near: np.ndarray, other: dict[str, np.ndarray], estimate: np.ndarray, observed: np.ndarray) -> np.ndarray:
        """Scores of all pairs to within ``NEAR``; minus infinity for a pair that the options exclude."""
        s = text.astype(np.float32)
        s *= np.float32(o.text_weight)
        s += np.float32(1 - o.text_weight) * spec
        if o.guard:
            s -= (o.segment_penalty * (1 - near)).astype(np.float32)
            gap = np.multiply.outer((1 / self.estimate).astype(np.float32), estimate.astype(np.float32))
            gap -= 1
            np.abs(gap, out=gap)
            np.minimum(gap, 1, out=gap)
            gap *= np.float32(o.price_penalty)
            s -= gap
            # how far the logarithm of the ratio is beyond the band
            np.subtract.outer(np.log(self.estimate).astype(np.float32), np.log(estimate).astype(np.float32), out=gap)
            np.abs(gap, out=gap)
            gap -= np.where(self.observed[:, None] & observed[None, :], np.float32(math.log(o.band)), np.float32(math.log(2 * o.band)))
            s[~(near >= o.min_affinity) | (gap > NEAR)] = -np.inf
            i, j = np.nonzero(np.abs(gap) <= NEAR)
            beyond = ~(np.abs(np.log(estimate[j] / self.estimate[i])) <= np.where(self.observed[i] & observed[j], math.log(o.band), math.log(2 * o.band)))
            s[i[beyond], j[beyond]] = -np.inf
        for name in ("parent_asin", "sig") if o.exclude_same_model else ("parent_asin",):
            known = np.flatnonzero(other[name] >= 0)
            i, j = np.nonzero(self.own[name][:, None] == other[name][known])
            s[i, known[j]] = -np.inf
        if o.same_brand is not None:
            s[(self.own["brand"][:, None] == other["brand"]) != o.same_brand] = -np.inf
        if o.priced_only:
            s[:, ~observed] = -np.inf
        return s

    def affinity(self, segments: pd.Series, o: Options) -> np.ndarray:
        met = pd.unique(segments)
        table = np.array([[self.near.get((a, b), np.nan if o.guard else 0.5) for b in met] for a in self.codes["segment"]]).reshape(len(self.codes["segment"]), -1)
        column = {v: i for i, v in enumerate(met)}
        return table[self.own["segment"]][:, segments.map(column).to_numpy()]

    def result(self, whole: bool) -> Iterator[pd.DataFrame]:
        """What the task emits: ``whole`` tells that it met the entire catalogue, so that its results are final."""
        for mode, pool in enumerate(self.pools):
            pool.merge()
            if not pool.held or not len(pool.held["i"]):
                continue
            if whole:
                pool.picked()
            h = pool.held
            q = self.q.iloc[h["i"]]
            yield pd.DataFrame(
                {
                    "mode": np.full(len(q), mode, np.int32), "query": q["parent_asin"].to_numpy(), "candidate": h["candidate"], "query_segment": q["segment"].to_numpy(), "segment": h["segment"], "brand": h["brand"],
                    "affinity": h["affinity"], "text_similarity": h["text"], "spec_similarity": h["spec"], "price_ratio": h["ratio"], "price_observed": h["observed"], "score": h["score"],
                }
            )


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    return np.stack(pdf["embedding"].to_numpy()).astype(np.float64), {n: pdf[f"f_{n}"].to_numpy(np.float64) for n, *_ in FEATURES}


_FOUND = "mode int, query string, candidate string, query_segment string, segment string, brand string, affinity double, text_similarity double, spec_similarity double, price_ratio double, price_observed boolean, score double"


def tasks(queries: int, rows: int, cores: int) -> tuple[int, int]:
    """(queries of a block, parts of the catalogue), so that every core has blocks to work on; few queries meet the catalogue in parts."""
    block = min(QUERY_BLOCK, max(200, -(-queries // (2 * cores))))
    blocks = max(1, -(-queries // block))
    return block, max(1, min(-(-rows // TASK_ROWS), 2 * cores // blocks))


def competitors(queries: DataFrame, catalogue: DataFrame, options: Options = Options()) -> DataFrame:
    """(query, candidate, ..., score, rank) of the best k per query. Both sides come from ``features``.

    The diversity cap takes effect inside a pool of max(400, 60 k) best candidates and is relaxed when they are too few.
    """
    return competitors_by_mode(queries, catalogue, options).drop("mode")


def competitors_by_mode(queries: DataFrame, catalogue: DataFrame, *options: Options) -> DataFrame:
    """``competitors`` under several sets of options of the same k and diversity cap, in one pass: ``mode`` is the number of the set."""
    o = options[0]
    if any((x.k, x.per_brand) != (o.k, o.per_brand) for x in options):
        raise ValueError("sets of options differ in k or in the cap")
    scored, pool_rows = _scored(queries, catalogue, options)
    scored = scored.withColumn("score", F.round("score", 6))
    best = W.partitionBy("mode", "query").orderBy(F.desc("score"), "candidate")
    pool = scored.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= pool_rows)
    if o.per_brand is not None:
        within = F.row_number().over(W.partitionBy("mode", "query", "brand").orderBy(F.desc("score"), "candidate"))
        first = W.partitionBy("mode", "query").orderBy(F.col("over"), F.desc("score"), "candidate")
        pool = pool.withColumn("over", within > o.per_brand).withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= o.k).drop("over")
    else:
        pool = pool.where(F.col("rn") <= o.k)
    return pool.drop("rn").withColumn("rank", F.row_number().over(best))


def _scored(queries: DataFrame, catalogue: DataFrame, options: tuple[Options, ...]) -> tuple[DataFrame, int]:
    """(candidates of each mode and query, size of a query's pool): a task for each block of queries and part of the catalogue."""
    o, spark = options[0], catalogue.sparkSession
    names = ["parent_asin", "brand", "segment", "estimate", "observed", "embedding", "sig", *[f"f_{n}" for n, *_ in FEATURES]]
    pool_rows = max(400, 60 * o.k)
    near = {(s, s): 1.0 for s in V.SEGMENTS} | {pair: x for (a, b), x in V.AFFINITY.items() for pair in ((a, b), (b, a))}
    side = catalogue.select(*names)
    most, parts = tasks(queries.count(), side.count(), spark.sparkContext.defaultParallelism)
    side = side.coalesce(parts)

    send = lambda rows: spark.sparkContext.broadcast(pd.DataFrame([r.asDict() for r in rows], columns=names))
    blocks, rows = [], []
    for r in queries.select(*names).toLocalIterator():  # a stated set, in blocks
        rows.append(r)
        if len(rows) == most:
            blocks.append(send(rows))
            rows = []
    if rows:
        blocks.append(send(rows))

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = None
        for pdf in batches:
            if not len(pdf):
                continue
            if block is None:
                block = _Block(blocks[int(pdf["block"].iloc[0])].value, near, options, [pool_rows] * len(options))
            block.meet(pdf)
        if block is not None:
            yield from block.result(parts == 1)

    # a task for each block and part: a union of blocks of one part each would run as a single task
    numbers = spark.range(0, max(1, len(blocks)), 1, max(1, len(blocks))).select(F.col("id").cast("int").alias("block"))
    scored = side.hint("shuffle_replicate_nl").crossJoin(numbers).mapInPandas(met, _FOUND) if blocks else spark.createDataFrame([], _FOUND)
    return scored, pool_rows


def rounded(found: DataFrame) -> DataFrame:
    return found.select("query", "candidate", "segment", "brand", "affinity", *[F.round(c, 5).alias(c) for c in ("text_similarity", "spec_similarity", "price_ratio")], "score", "rank")


def ablation_diff(guarded: DataFrame, unguarded: DataFrame) -> DataFrame:
    """Per query: candidates in one result only, and how far the unguarded ones stray."""
    on = ["query", "candidate"]
    only_g = guarded.join(unguarded, on, "left_anti").groupBy("query").agg(F.count(F.lit(1)).alias("only_guarded"))
    ratio = F.col("price_ratio")
    only_u = (
        unguarded.join(guarded, on, "left_anti")
        .groupBy("query")
        .agg(
            F.count(F.lit(1)).alias("only_unguarded"),
            F.count_if(F.col("segment") != F.col("query_segment")).alias("off_segment"),
            F.count_if((ratio > 2.25) | (ratio < 1 / 2.25)).alias("out_of_band"),
            F.round(F.max(F.greatest(ratio, 1 / ratio)), 4).alias("worst_ratio"),
        )
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return only_g.join(only_u, "query", "full").select("query", *[zero(c) for c in ("only_guarded", "only_unguarded", "off_segment", "out_of_band")], "worst_ratio")


def leakage(found: DataFrame, mode: str) -> DataFrame:
    """Per mode: candidates of a hardly related segment, and prices more than threefold apart."""
    far = F.greatest(F.col("price_ratio"), 1 / F.col("price_ratio")) > 3
    return found.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("affinity") < 0.25).alias("cross_class"), F.count_if(far).alias("price_gaps")).withColumn("mode", F.lit(mode))


def hardest(found: DataFrame) -> DataFrame:
    """The query with the most chromebook, then budget candidates; the smallest key wins ties."""
    per = found.groupBy("query").agg(F.count_if((F.col("segment") == "chromebook") & (F.col("query_segment") != "chromebook")).alias("chromebooks"), F.count_if((F.col("segment") == "budget") & (F.col("query_segment") != "budget")).alias("budgets"))
    return per.orderBy(F.desc("chromebooks"), F.desc("budgets"), "query").limit(1)


def product_document(df: DataFrame) -> DataFrame:
    """(parent_asin, document): title of at most 44 words, then known properties, joined by " | "."""
    whole = lambda c: F.regexp_replace(F.format_number(F.col(c), 0), ",", "")
    storage = F.when(F.col("storage_gb") >= 1024, F.concat(F.regexp_replace(F.format_number(F.col("storage_gb") / 1024, 1), r"\.0$", ""), F.lit(" TB storage"))).when(F.col("storage_gb").isNotNull(), F.concat(whole("storage_gb"), F.lit(" GB storage")))
    price = F.when(F.col("price").isNull(), None).when(F.col("price") < 300, "under $300").when(F.col("price") < 600, "$300 to $600").when(F.col("price") < 1000, "$600 to $1000").when(F.col("price") < 1800, "$1000 to $1800").otherwise("over $1800")
    known = lambda c: F.when(F.col(c) != "Unknown", F.col(c))
    pieces = [
        F.array_join(F.slice(F.split(F.trim(F.coalesce("title", F.lit(""))), r"\s+"), 1, 44), " "), known("brand"), F.concat("segment", F.lit(" laptop")), known("cpu_family"),
        F.concat(whole("ram_gb"), F.lit(" GB RAM")), storage, F.concat(F.regexp_replace(F.format_number("screen_in", 1), r"\.0$", ""), F.lit(" inch display")), known("gpu_model"), known("os_family"),
        F.concat(F.format_number("weight_lb", 1), F.lit(" lb")), price, F.when(F.col("is_renewed"), "renewed").otherwise("new"),
    ]
    return df.select("parent_asin", F.array_join(F.filter(F.array(*pieces), lambda p: p.isNotNull() & (p != "")), " | ").alias("document"))


def fingerprint(df: DataFrame, model: str = "") -> DataFrame:
    """One row that tells whether stored vectors still belong to the documents: rows and an order-free digest of ids and documents."""
    digest = F.expr("bit_xor(xxhash64(parent_asin, document))")
    return df.agg(F.count(F.lit(1)).alias("n"), digest.alias("digest")).select("n", F.sha1(F.concat_ws(":", F.lit(model), F.col("n").cast("string"), F.col("digest").cast("string"))).alias("fingerprint"))
