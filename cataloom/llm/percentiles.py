"""Exact percentiles per group over any number of values: a distributed sort with per-partition counts.

1. Values are counted by (group, value), combined on the map side: ties and repeated values, also a value that a third of the rows
   hold, become one counted row.
2. The counted rows are range-partitioned and sorted by (group, value), across partitions, so one hot group spans many of them; the sorted table
   is written once with its partition numbers, because a range partitioning isn't bound to repeat itself.
3. Each partition reports its count per group; a running sum over partitions gives the offset at which a partition's part of a group starts.
4. The positions of a percentile's two neighbouring order statistics fall into one partition each; only (partition, group) parts that
   hold a position are read again, and the neighbours found by a running count are interpolated linearly.

The result is exact: ``rank_error`` is 0 and stated in the result. Counted rows are also the mergeable summary: the summaries of separate
partitions or load days are put together by adding counts (``merge``), and the percentiles of the union are those of all rows.

Defined cases: null and NaN values are left out; a null group is a group of its own; a group with one value has it as every percentile;
an empty table gives no rows; -0.0 counts as 0.0; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cataloom.session import staged


def summary(df: DataFrame, group: Sequence[Column], value: Column) -> DataFrame:
    """(g: array of the group's parts, v, n): the mergeable exact summary of ``df``."""
    parts = F.array(*[g.cast("string") for g in group])
    return (
        df.select(parts.alias("g"), (value.cast("double") + F.lit(0.0)).alias("v"))
        .where(F.col("v").isNotNull() & ~F.isnan("v"))
        .groupBy("g", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merge(summaries: DataFrame) -> DataFrame:
    """The summary of the union of what the given rows summarise."""
    return summaries.groupBy("g", "v").agg(F.sum("n").alias("n"))


def percentiles(counted: DataFrame, shares: Sequence[float], partitions: int | None = None) -> DataFrame:
    """(g, n, share, value, rank_error) of each group and share, from a merged summary."""
    spark = counted.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = staged(
        counted.repartitionByRange(parts, "g", "v").sortWithinPartitions("g", "v").withColumn("part", F.spark_partition_id()), "percentile-sort"
    )
    # a row per (partition, group): a partition holds whole ranges of the order, so few groups cross its borders
    pieces = ordered.groupBy("part", "g").agg(F.sum("n").alias("n"))
    by_group = W.partitionBy("g").orderBy("part")
    pieces = pieces.withColumn("before", F.sum("n").over(by_group) - F.col("n")).withColumn("total", F.sum("n").over(W.partitionBy("g")))
    position = (F.col("total") - 1) * F.col("share")
    targets = (
        pieces.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
        .withColumn("at", F.explode(F.array_distinct(F.array(F.floor(position), F.ceil(position)))))
        .where((F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("n")))
        .select("part", "g", "before", "total", "share", "at")
    )
    wanted = targets.select("part", "g", "before").distinct()
    running = F.sum("n").over(W.partitionBy("part", "g").orderBy("v"))
    hit = ordered.join(wanted, ["part", "g"]).withColumn("hi", F.col("before") + running).withColumn("lo", F.col("hi") - F.col("n"))
    found = (
        targets.drop("before")
        .join(hit.select("part", "g", "v", "lo", "hi"), ["part", "g"])
        .where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    )
    weight = position - F.floor(position)
    return (
        found.groupBy("g", "share", "total")
        .agg(F.min("v").alias("low"), F.max("v").alias("high"))
        .select(
            "g",
            F.col("total").alias("n"),
            "share",
            (F.col("low") + (F.col("high") - F.col("low")) * weight).alias("value"),
            F.lit(0).alias("rank_error"),
        )
    )


def wide(found: DataFrame, names: dict[float, str]) -> DataFrame:
    """One row per group with a column per share."""
    return found.groupBy("g", "n").agg(*[F.max(F.when(F.col("share") == s, F.col("value"))).alias(c) for s, c in names.items()], F.max("rank_error").alias("rank_error"))
