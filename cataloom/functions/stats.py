"""Statistics that always carry their denominators, and ranks that survive a hot group."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RELIABLE_N = 5
QUANTILES = {"p10": 0.10, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.90}


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != math.inf), c)


def tidy(c: Column) -> Column:
    """Six digits; exact halves, which means of rounded figures often are, go up on every engine."""
    return F.floor(c * 1e6 + 0.5000001) / 1e6


def price_block(price: Column) -> list[Column]:
    """n, n_total, coverage, reliable, mean, std, five quantiles, iqr, min and max of a column in a group."""
    p = finite(price)
    q = F.percentile(p, F.array(*[F.lit(s) for s in QUANTILES.values()]))
    return [
        F.count(p).alias("n"),
        F.count(F.lit(1)).alias("n_total"),
        F.round(F.count(p) / F.count(F.lit(1)), 6).alias("coverage"),
        (F.count(p) >= RELIABLE_N).alias("reliable"),
        F.round(F.avg(p), 6).alias("mean"),
        F.round(F.stddev_samp(p), 6).alias("std"),
        *[F.round(q[i], 6).alias(name) for i, name in enumerate(QUANTILES)],
        F.round(q[3] - q[1], 6).alias("iqr"),
        F.min(p).alias("min"),
        F.max(p).alias("max"),
    ]


PRICE_BLOCK_SQL = """count(price) AS n, count(*) AS n_total, round(count(price) / count(*), 6) AS coverage, count(price) >= 5 AS reliable,
 round(avg(price), 6) AS mean, round(stddev_samp(price), 6) AS std, round(quantile_cont(price, 0.1), 6) AS p10, round(quantile_cont(price, 0.25), 6) AS p25,
 round(quantile_cont(price, 0.5), 6) AS median, round(quantile_cont(price, 0.75), 6) AS p75, round(quantile_cont(price, 0.9), 6) AS p90,
 round(quantile_cont(price, 0.75) - quantile_cont(price, 0.25), 6) AS iqr, min(price) AS min, max(price) AS max"""


def rank_table(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, value, below, equal, total) of each distinct value of each group; nulls left out.

    Counted before ranked: a group that holds a third of the rows reaches the window as its distinct values only.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("equal"))
    ordered = W.partitionBy(*groups).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    return counted.withColumn("below", F.sum("equal").over(ordered) - F.col("equal")).withColumn("total", F.sum("equal").over(W.partitionBy(*groups)))


def with_ranks(df: DataFrame, groups: Sequence[str], value: str, rank: str, percent: str | None = None) -> DataFrame:
    """``df`` with the average-tie rank of ``value`` in its group, and as a percentage of the group."""
    ranks = rank_table(df, groups, value).select(
        *[F.col(g).alias(f"_{g}") for g in groups],
        F.col(value).alias("_value"),
        (F.col("below") + (F.col("equal") + 1) / 2).alias(rank),
        *([(100 * (F.col("below") + (F.col("equal") + 1) / 2) / F.col("total")).alias(percent)] if percent else []),
    )
    on = [df[g].eqNullSafe(ranks[f"_{g}"]) for g in groups] + [df[value] == ranks["_value"]]
    return df.join(ranks, on, "left").drop(*[f"_{g}" for g in groups], "_value")


# ---------------------------------------------------------------- small statistics on the driver


def normal_p(z: float) -> float:
    """Two-sided p of a standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of a correlation by Student's t."""
    if n < 3 or abs(r) >= 1:
        return 0.0 if n >= 3 else math.nan
    t2 = r * r * (n - 2) / (1 - r * r)
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def marker_size(value: Column, low: Column, high: Column, least: float = 6.0, most: float = 30.0) -> Column:
    """A mark's size on a log scale between the least and the greatest value; the least size where the span is empty."""
    share = F.try_divide(F.log1p(value) - F.log1p(low), F.log1p(high) - F.log1p(low))
    return least + (most - least) * F.coalesce(share, F.lit(0.0))
