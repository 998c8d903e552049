"""Scans and sinks."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cataloom import schemas


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.ITEMS)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.RAW_REVIEWS)


def in_category(categories: Column, wanted: str = "Laptops", excluded: str = "Laptop Accessories") -> Column:
    """Exact membership in the breadcrumb and absence of the excluded entry."""
    c = F.coalesce(categories, F.array().cast("array<string>"))
    return F.array_contains(c, wanted) & ~F.array_contains(c, excluded)


def write_filtered_items(items: DataFrame, path: str, keys_path: str) -> None:
    """Items of the category as JSON lines, and their distinct keys in order."""
    kept = items.where(in_category(F.col("categories")))
    kept.write.mode("overwrite").json(path)
    kept.select("parent_asin").where("parent_asin IS NOT NULL").distinct().orderBy("parent_asin").write.mode("overwrite").text(keys_path)


def keep_with_key(df: DataFrame, keys: DataFrame, key: str = "parent_asin") -> DataFrame:
    """Rows whose key is among ``keys``. The planner broadcasts the keys only while they are under its size limit."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def row_count(spark: SparkSession, path: str) -> int:
    """Rows by the files' footers alone."""
    return spark.read.parquet(path).count()


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_vectors(vectors: DataFrame, documents: DataFrame, path: str, model: str) -> None:
    """Vectors beside their keys, and the fingerprint of the documents they were made from."""
    from cataloom.operators.matching import fingerprint

    write_table(vectors, f"{path}/vectors")
    write_table(fingerprint(documents, model), f"{path}/fingerprint")


def vectors_are_stale(spark: SparkSession, documents: DataFrame, path: str, model: str) -> bool:
    from cataloom.operators.matching import fingerprint

    return spark.read.parquet(f"{path}/fingerprint").exceptAll(fingerprint(documents, model)).count() > 0


def json_ready(c: Column, kind: T.DataType) -> Column:
    """A value that strict JSON can hold: NaN and infinities to null, timestamps to ISO, intervals to seconds, bytes to text; arrays, maps and structs inside too."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(kind, T.DecimalType):
        return c.cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(kind, T.DateType):
        return c.cast("string")
    if isinstance(kind, T.DayTimeIntervalType):
        return c.cast(T.DayTimeIntervalType(3, 3)).cast("decimal(18,6)").cast("double")
    if isinstance(kind, T.BinaryType):
        return F.decode(c, "UTF-8")
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: json_ready(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: json_ready(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[json_ready(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return c


def to_json(df: DataFrame) -> DataFrame:
    """(json) of each row, with nulls written out."""
    row = F.struct(*[json_ready(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
    return df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))


def write_report(df: DataFrame, path: str, limit: int = 10_000) -> None:
    """A small result as one strict JSON file; more than ``limit`` rows are an error, as a report is not a table."""
    rows = [json.loads(r["json"]) for r in to_json(df).limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: write a table instead")
    Path(path).write_text(json.dumps(rows, allow_nan=False, indent=1))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by a seeded digest of the key: a sampling operator that gives the same rows on any partitioning."""
    return df.orderBy(seeded(key, seed), key).limit(n)


def seeded(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
