"""The per-record ingest stages over a stream: category filter and semi-join against a static key set."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cataloom.session import shared_dir
from cataloom.sources.io import in_category, keep_with_key


def item_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Items of the category as files land."""
    return spark.readStream.schema(schema).json(path).where(in_category(F.col("categories")))


def keep_stream(stream: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Stream-static semi-join."""
    return keep_with_key(stream, keys, key)


def deduplicated(stream: DataFrame, keys: list[str], event_time: str, delay: str = "1 hour") -> DataFrame:
    """First of each key within the watermark: the streaming form of keeping the first."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame) -> DataFrame:
    """Run what is available to its end into a table in the shared folder and read that: exactly once by the sink's log."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/cataloom/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
