"""Coverage-aware price statistics. A missing price is never filled into a statistic; every statistic states its denominator."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cataloom.functions import vocabulary as V
from cataloom.functions.stats import RELIABLE_N, correlation_p, normal_p, price_block, rank_table, with_ranks

COMPARABLE = 0.15
IMPLAUSIBLE_LOW, IMPLAUSIBLE_HIGH = 50.0, 10_000.0
CORRELATION_N = 30


def group_price_table(df: DataFrame, by: str, min_products: int = 1) -> DataFrame:
    """Price block of each group with renewed listings and mean rating; groups with a null key are left out."""
    return (
        df.where(F.col(by).isNotNull())
        .groupBy(by)
        .agg(*price_block(F.col("price")), F.count_if("is_renewed").alias("n_renewed"), F.round(F.avg("average_rating"), 6).alias("mean_rating"))
        .where(F.col("n_total") >= min_products)
    )


def by_median(table: DataFrame, key: str) -> DataFrame:
    return table.orderBy(F.asc_nulls_last("median"), key)


def brand_price_table(df: DataFrame, min_products: int = 5, top: int | None = None) -> DataFrame:
    """The ``top`` brands by catalogue size, with what is unpriced and each brand's share."""
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    t = group_price_table(df, "brand", min_products)
    if top is not None:
        t = t.orderBy(F.desc("n_total"), "brand").limit(top)
    return t.crossJoin(F.broadcast(total)).select(  # one row
        *t.columns, (F.col("n_total") - F.col("n")).alias("n_unpriced"), (~F.col("reliable")).alias("unreliable"), F.round(F.col("n_total") / F.col("_all"), 6).alias("share_of_catalogue")
    )


def segment_table(df: DataFrame, scored: DataFrame) -> DataFrame:
    """Segments with their share of the catalogue and how many listings have mined sentiment."""
    marked = df.join(scored.select("parent_asin", F.lit(True).alias("has_sentiment")), "parent_asin", "left")
    t = group_price_table(df, "segment")
    extra = marked.groupBy("segment").agg(F.count("has_sentiment").alias("n_with_sentiment"), F.round(F.count("has_sentiment") / F.count(F.lit(1)), 6).alias("sentiment_coverage"))
    share = F.round(F.col("n_total") / F.sum("n_total").over(W.partitionBy(F.lit(1))), 6)  # a row per segment
    return t.join(extra, "segment").withColumn("share_of_catalogue", share)


def order_brands(table: DataFrame, sort: str = "median", descending: bool = False) -> DataFrame:
    """Brand rows by median, size, coverage, rating or name; missing last either way, names without regard to case."""
    columns = {"median": F.col("median"), "n_products": F.col("n_total"), "coverage": F.col("coverage"), "rating": F.col("mean_rating"), "name": F.lower("brand")}
    if sort not in columns:
        raise ValueError(f"sort is one of {sorted(columns)}")
    c = columns[sort]
    return table.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), F.lower("brand"), "brand")


# ---------------------------------------------------------------- premium and correlation


def discrete_premium(df: DataFrame) -> DataFrame:
    """Median price with and without discrete graphics, over all and per segment (grouping sets), with Mann-Whitney U and z.

    The rank sum comes from counted prices, so no group is ranked row by row.
    """
    both = df.select(F.explode(F.array(F.lit("ALL"), F.col("segment"))).alias("segment"), "price", "is_discrete_gpu")
    base = both.groupBy("segment").agg(
        F.count_if("is_discrete_gpu").alias("n_discrete_total"),
        F.count_if(~F.col("is_discrete_gpu")).alias("n_integrated_total"),
        F.count_if(F.col("is_discrete_gpu") & F.col("price").isNotNull()).alias("n_discrete"),
        F.count_if(~F.col("is_discrete_gpu") & F.col("price").isNotNull()).alias("n_integrated"),
        F.median(F.when(F.col("is_discrete_gpu"), F.col("price"))).alias("md"),
        F.median(F.when(~F.col("is_discrete_gpu"), F.col("price"))).alias("mi"),
    )
    counted = both.where("price IS NOT NULL").groupBy("segment", "price").agg(F.count(F.lit(1)).alias("equal"), F.count_if("is_discrete_gpu").alias("d"))
    running = F.sum("equal").over(W.partitionBy("segment").orderBy("price"))
    ranks = (
        counted.withColumn("rank", running - (F.col("equal") - 1) / 2)
        .groupBy("segment")
        .agg(F.sum(F.col("rank") * F.col("d")).alias("rank_sum"), F.sum((F.col("equal").cast("double") ** 3 - F.col("equal"))).alias("ties"))
    )
    n1, n2 = F.col("n_discrete").cast("double"), F.col("n_integrated").cast("double")
    n = n1 + n2
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    usable = (n1 > 0) & (n2 > 0)
    return base.join(ranks, "segment", "left").select(
        "segment",
        "n_discrete",
        "n_integrated",
        F.round(F.try_divide(F.col("n_discrete"), F.col("n_discrete_total")), 6).alias("coverage_discrete"),
        F.round(F.try_divide(F.col("n_integrated"), F.col("n_integrated_total")), 6).alias("coverage_integrated"),
        F.round("md", 6).alias("median_discrete"),
        F.round("mi", 6).alias("median_integrated"),
        F.round(F.col("md") - F.col("mi"), 6).alias("premium_usd"),
        F.round(100 * (F.col("md") - F.col("mi")) / F.col("mi"), 6).alias("premium_pct"),
        ((F.col("n_discrete") >= RELIABLE_N) & (F.col("n_integrated") >= RELIABLE_N)).alias("reliable"),
        F.when(usable, F.round(u, 4)).alias("u"),
        F.when(usable & (n > 1), F.round((u - n1 * n2 / 2) / F.when(sigma > 0, sigma), 6)).alias("z"),
    )


def _with(df: DataFrame, columns: dict[str, Callable[[dict], float | None]]) -> DataFrame:
    """``df`` of a few rows with columns that closed forms outside SQL give."""

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
            yield pdf.assign(**{c: pd.Series([f(r) for r in rows], dtype="float64", index=pdf.index) for c, f in columns.items()})

    return df.mapInPandas(mapped, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", `{c}` double" for c in columns))


def premium_p_values(premium: DataFrame) -> DataFrame:
    """The premium's rows (a segment each) with the two-sided p of z."""
    return _with(premium, {"p_value": lambda r: None if r["z"] is None else normal_p(r["z"])})


def price_rating(df: DataFrame, min_ratings: int = 20) -> DataFrame:
    """Pearson and Spearman correlation of price and rating, over all and per segment; null under three pairs."""
    pairs = df.where((F.col("rating_number") >= min_ratings) & F.col("price").isNotNull() & F.col("average_rating").isNotNull())
    pairs = pairs.select(F.explode(F.array(F.lit("ALL"), F.col("segment"))).alias("segment"), "price", F.col("average_rating").alias("rating"))
    ranked = with_ranks(with_ranks(pairs, ["segment"], "price", "rp"), ["segment"], "rating", "rr")
    enough = F.count(F.lit(1)) >= 3
    return ranked.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"),
        F.when(enough, F.round(F.corr("price", "rating"), 6)).alias("pearson"),
        F.when(enough, F.round(F.corr("rp", "rr"), 6)).alias("spearman"),
        (F.count(F.lit(1)) >= CORRELATION_N).alias("reliable"),
    )


def correlation_p_values(found: DataFrame) -> DataFrame:
    """The correlations' rows (a segment each) with their two-sided p."""
    return _with(found, {f"{c}_p": lambda r, c=c: None if r[c] is None else correlation_p(r[c], r["n"]) for c in ("pearson", "spearman")})


def quartile(value: Column, edges: Column) -> Column:
    """Right-closed quartile 1 to 4; equal edges merge into the lowest that holds the value."""
    return F.when(value <= edges[0], 1).when(value <= edges[1], 2).when(value <= edges[2], 3).when(value.isNotNull(), 4)


def rating_by_price_quartile(df: DataFrame, min_ratings: int = 20) -> DataFrame:
    pairs = df.where((F.col("rating_number") >= min_ratings) & F.col("price").isNotNull() & F.col("average_rating").isNotNull())
    edges = pairs.agg(F.percentile("price", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)])).alias("edges"))
    return pairs.crossJoin(F.broadcast(edges)).groupBy(quartile(F.col("price"), F.col("edges")).alias("quartile")).agg(  # one row of edges
        F.count(F.lit(1)).alias("n"), F.round(F.avg("average_rating"), 6).alias("mean_rating")
    )


# ---------------------------------------------------------------- coverage and validation


def coverage_bias(df: DataFrame) -> DataFrame:
    """How priced listings differ from unpriced ones."""
    return df.groupBy(F.col("price").isNotNull().alias("priced")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("average_rating"), 6).alias("mean_rating"),
        F.round(F.avg("rating_number"), 6).alias("mean_rating_number"),
        F.median("rating_number").alias("median_rating_number"),
        F.median("ram_gb").alias("median_ram_gb"),
        F.round(F.avg(F.col("is_renewed").cast("int")), 6).alias("share_renewed"),
        F.round(F.avg(F.col("is_discrete_gpu").cast("int")), 6).alias("share_discrete"),
    )


def segment_coverage_spread(df: DataFrame) -> DataFrame:
    """Each segment's share among priced and unpriced listings and the spread between the best and the worst covered segment."""
    t = df.groupBy("segment").agg(F.count("price").alias("priced"), F.count_if(F.col("price").isNull()).alias("unpriced"))
    every = W.partitionBy(F.lit(1))  # a row per segment
    coverage = F.col("priced") / (F.col("priced") + F.col("unpriced"))
    return t.select(
        "segment",
        F.round(F.col("priced") / F.sum("priced").over(every), 6).alias("share_priced"),
        F.round(F.col("unpriced") / F.sum("unpriced").over(every), 6).alias("share_unpriced"),
        F.round(F.max(coverage).over(every) - F.min(coverage).over(every), 6).alias("coverage_spread"),
    )


def implausible_prices(df: DataFrame, low: float = IMPLAUSIBLE_LOW, high: float = IMPLAUSIBLE_HIGH) -> DataFrame:
    reason = F.when(F.col("price") < low, f"below {low:g}").when(F.col("price") > high, f"above {high:g}")
    return df.select("parent_asin", "title", "brand", "segment", "price", reason.alias("reason")).where(F.col("reason").isNotNull())


def spec_price_ratios(df: DataFrame) -> DataFrame:
    """Median and count of price per GB of memory and per 100 GB of storage."""
    ratios = {"price_per_ram_gb": F.when(F.col("ram_gb") > 0, F.col("price") / F.col("ram_gb")), "price_per_100gb": F.when(F.col("storage_gb") > 0, F.col("price") / (F.col("storage_gb") / 100))}
    long = df.select(F.explode(F.create_map(*[x for k, v in ratios.items() for x in (F.lit(k), v)])).alias("ratio", "v"))
    return long.groupBy("ratio").agg(F.count("v").alias("n"), F.round(F.median("v"), 6).alias("median"))


def validation_checks(df: DataFrame) -> DataFrame:
    """(check, passed, detail): vocabulary, order of medians, implausible prices, small samples, internal consistency, coverage."""
    spark = df.sparkSession
    segments = group_price_table(df, "segment")
    vocabulary = spark.createDataFrame([(s,) for s in V.SEGMENTS], "segment string")
    own = segments.select("segment")
    strange, absent = own.join(vocabulary, "segment", "left_anti"), vocabulary.join(own, "segment", "left_anti")

    def one(name: str, frame: DataFrame, passed: Column, detail: Column) -> DataFrame:
        return frame.agg(passed.alias("passed"), detail.alias("detail")).select(F.lit(name).alias("check"), "passed", "detail")

    names = strange.select(F.concat(F.lit("unexpected "), "segment").alias("s")).unionByName(absent.select(F.concat(F.lit("absent "), "segment").alias("s")))
    order = spark.createDataFrame(list(V.MEDIAN_ORDER), "lower string, upper string")
    medians = segments.select("segment", "median")
    pairs = order.join(medians.select(F.col("segment").alias("lower"), F.col("median").alias("low")), "lower", "left").join(medians.select(F.col("segment").alias("upper"), F.col("median").alias("high")), "upper", "left")
    wrong = F.count_if(~F.coalesce(F.col("low") < F.col("high"), F.lit(False)))
    odd = F.count_if((F.col("price") < IMPLAUSIBLE_LOW) | (F.col("price") > IMPLAUSIBLE_HIGH))
    small = F.count_if(~F.col("reliable"))
    broken = F.count_if((F.col("n") > F.col("n_total")) | (F.col("p10") > F.col("p25")) | (F.col("p25") > F.col("median")) | (F.col("median") > F.col("p75")) | (F.col("p75") > F.col("p90")))
    text = lambda c: c.cast("string")
    return (
        one("vocabulary", names, F.count(F.lit(1)) == 0, F.array_join(F.array_sort(F.collect_list("s")), ", "))
        .unionByName(one("median_order", pairs, wrong == 0, F.concat(text(wrong), F.lit(" of 6 pairs out of order"))))
        .unionByName(one("implausible", df, odd < 0.01 * F.count("price"), F.concat(text(odd), F.lit(" implausible"))))
        .unionByName(one("small_samples", segments, small == 0, F.concat(text(small), F.lit(" unreliable segments"))))
        .unionByName(one("consistency", segments, broken == 0, F.concat(text(broken), F.lit(" inconsistent segments"))))
        .unionByName(one("coverage", df, F.count("price") > 0, F.concat(text(F.count("price")), F.lit(" of "), text(F.count(F.lit(1))), F.lit(" priced"))))
    )


def column_coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, known, total, share): Unknown and blank texts count as missing, booleans as present."""
    kinds = dict(df.dtypes)

    def known(c: str) -> Column:
        if kinds[c] == "string":
            return F.count_if(F.coalesce(~F.lower(F.trim(c)).isin("", "unknown"), F.lit(False)))
        return F.count(c)

    wide = df.agg(F.count(F.lit(1)).alias("total"), *[known(c).alias(f"k_{c}") for c in columns])
    long = wide.select("total", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"k_{c}").alias("known")) for c in columns])).alias("e"))
    return long.select("e.column", "e.known", "total", F.round(F.try_divide(F.col("e.known"), F.col("total")), 6).alias("share"))


def value_counts(df: DataFrame, column: str, vocabulary: Sequence[str] | None = None, top: int | None = None) -> DataFrame:
    """(value, n, share, position): in the vocabulary's order with zeros, or by count."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    share = F.round(F.try_divide(F.col("n"), F.col("_all")), 6).alias("share")
    if vocabulary is not None:
        fixed = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(vocabulary)], "value string, position int")
        return fixed.join(counts, "value", "left").crossJoin(F.broadcast(total)).select("value", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(share, F.lit(0.0)).alias("share"), "position")
    ordered = counts.orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(top or 15)
    position = (F.row_number().over(W.orderBy(F.desc("n"), F.asc_nulls_last("value"))) - 1).alias("position")  # over the limit's rows
    return ordered.crossJoin(F.broadcast(total)).select("value", "n", share, position)


def corpus_medians(df: DataFrame) -> DataFrame:
    q = F.percentile("price", F.array(F.lit(0.1), F.lit(0.9)))
    return df.agg(
        F.count(F.lit(1)).alias("n_total"), F.median("ram_gb").alias("ram_gb"), F.median("storage_gb").alias("storage_gb"), F.median("screen_in").alias("screen_in"),
        F.round(q[0], 6).alias("price_p10"), F.round(q[1], 6).alias("price_p90"),
    )


def histogram(df: DataFrame, bins: int = 40) -> DataFrame:
    """(segment, bin, n) of known prices in equal bins between the least and the greatest price of all."""
    edges = df.agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    raw = F.floor((F.col("price") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0) * bins)
    return df.where("price IS NOT NULL").crossJoin(F.broadcast(edges)).groupBy("segment", F.least(raw, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- position and value


def price_label(ratio: Column) -> Column:
    """Strictly under 0.85 cheaper, strictly over 1.15 premium."""
    return F.when(ratio.isNull(), "unknown").when(ratio < 1 - COMPARABLE, "cheaper").when(ratio > 1 + COMPARABLE, "premium").otherwise("comparable")


def price_position(df: DataFrame, group: str, prefix: str) -> DataFrame:
    """(parent_asin, price, <prefix>_n, _median, _percentile, _delta_usd, _delta_pct, _ratio, _label) against a group's other priced listings.

    The median without the listing itself is read from three order statistics of its group, its percentile from counted
    prices; neither ranks the rows of a group one by one.
    """
    ranks = rank_table(df, [group], "price")
    low = F.floor((F.col("total") - 2) / 2)
    middle = (
        ranks.withColumn("k", low)
        .groupBy(group)
        .agg(
            F.max("total").alias("n"),
            *[F.max(F.when((F.col("below") <= F.col("k") + i) & (F.col("k") + i < F.col("below") + F.col("equal")), F.col("price"))).alias(f"s{i}") for i in range(3)],
        )
        .withColumn("k", F.floor((F.col("n") - 2) / 2))
    )
    own = df.where("price IS NOT NULL").select("parent_asin", group, "price").join(ranks.select(group, "price", "below", "equal"), [group, "price"]).join(middle, group)
    # without the listing at index i, order statistic k is s[k] below i and s[k + 1] from it on; equal prices share an index
    at = lambda i: F.when(F.col("k") + i < F.col("below"), F.col(f"s{i}")).otherwise(F.col(f"s{i + 1}"))
    median = F.when(F.col("n") < 2, None).when(F.col("n") % 2 == 0, at(0)).otherwise((at(0) + at(1)) / 2)
    out = own.withColumn("m", median).withColumn("peers", F.col("n") - 1)
    ratio = F.try_divide(F.col("price"), F.col("m"))
    return out.select(
        "parent_asin",
        F.col("peers").alias(f"{prefix}_n"),
        F.round("m", 6).alias(f"{prefix}_median"),
        F.round(F.try_divide(100 * (F.col("below") + 0.5 * (F.col("equal") - 1)), F.col("peers")), 6).alias(f"{prefix}_percentile"),
        F.round(F.col("price") - F.col("m"), 6).alias(f"{prefix}_delta_usd"),
        F.round(100 * (ratio - 1), 6).alias(f"{prefix}_delta_pct"),
        F.round(ratio, 6).alias(f"{prefix}_ratio"),
        price_label(F.round(ratio, 6)).alias(f"{prefix}_label"),
        (F.col("peers") >= RELIABLE_N).alias(f"{prefix}_reliable"),
    )


def positions(df: DataFrame) -> DataFrame:
    """Every priced listing against its segment and its brand."""
    return df.where("price IS NOT NULL").select("parent_asin", "segment", "brand", "price").join(price_position(df, "segment", "vs_segment"), "parent_asin").join(price_position(df, "brand", "vs_brand"), "parent_asin")


def value_metrics() -> dict[str, Column]:
    over = lambda c, by: F.when(by > 0, c / by)
    price = F.col("price")
    return {
        "price_per_ram_gb": over(price, F.col("ram_gb")),
        "price_per_100gb": over(price, F.col("storage_gb") / 100),
        "price_per_inch": over(price, F.col("screen_in")),
        "rating_per_100usd": over(F.col("average_rating"), price / 100),
    }


def price_vs_value(df: DataFrame) -> DataFrame:
    """Priced listings with value metrics, segment median, average-tie percent rank in the segment, and label."""
    priced = df.where("price IS NOT NULL")
    medians = priced.groupBy("segment").agg(F.median("price").alias("segment_median"))
    ranked = with_ranks(priced, ["segment"], "price", "_rank", "pct_rank").join(medians, "segment")
    ratio = F.col("price") / F.col("segment_median")
    return ranked.select(
        "parent_asin", "segment", "price", *[v.alias(k) for k, v in value_metrics().items()], F.round("segment_median", 6).alias("segment_median"),
        F.round("pct_rank", 6).alias("pct_rank"), F.round(ratio, 6).alias("ratio"), price_label(F.round(ratio, 6)).alias("label"),
    )


def outliers(value: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n lowest and n highest of a column, marked."""
    known = value.where(F.col(column).isNotNull())
    low = known.orderBy(F.asc(column), "parent_asin").limit(n).withColumn("side", F.lit("low"))
    return low.unionByName(known.orderBy(F.desc(column), "parent_asin").limit(n).withColumn("side", F.lit("high")))


def compare_products(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The named listings in the order asked, with their segment's median and percentile (themselves included). A missing key is an error."""
    spark = df.sparkSession
    asked = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "parent_asin string, position int")
    absent = [r[0] for r in asked.join(df.select("parent_asin"), "parent_asin", "left_anti").collect()]
    if absent:
        raise KeyError(f"not in the catalogue: {absent}")
    ranks = rank_table(df, ["segment"], "price")
    medians = df.groupBy("segment").agg(F.median("price").alias("segment_median"))
    rows = df.join(F.broadcast(asked), "parent_asin").join(medians, "segment")  # asked: the caller's list
    rows = rows.join(ranks, ["segment", "price"], "left")
    return rows.select(
        "position", "parent_asin", "brand", "segment", "price", F.round("segment_median", 6).alias("segment_median"),
        F.round(100 * (F.col("below") + 0.5 * F.col("equal")) / F.col("total"), 6).alias("segment_percentile"), *[v.alias(k) for k, v in value_metrics().items()],
    )
