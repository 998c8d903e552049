"""Session helpers: where lineage is cut and how a stage is written."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cataloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (``spark.checkpoint.dir``).

    Only where the setting is absent, as in tests on one machine, a temporary folder is made and removed at exit.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="cataloom-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def staged(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there and no executor's loss undoes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cataloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a ``staged`` table that only its maker has read and nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/cataloom/" not in folder:
            raise ValueError("only staged tables are removed")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def latest(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per key: the version with the greatest ``order`` (nulls first), ties by content. Null keys are left out.

    The aggregate combines on the map side, so a key holding a third of the rows reaches the reducer once per task.
    """
    content = F.struct(*[F.col(c) for c in columns])
    rank: Column = F.struct(F.col(order), F.xxhash64(*[F.col(c) for c in columns]))
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(content, rank).alias("_v"))
        .select(key, *[F.col(f"_v.{c}").alias(c) for c in columns])
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drawn(df: DataFrame, key: str, rows: int, total: int, seed: int = 0) -> DataFrame:
    """About ``rows`` of ``total`` rows, those whose key's hash lies under a threshold: the same keys whatever the partitions, and nothing but them is moved."""
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)) < int((1 << 40) * rows / total))


def join_hot(left: DataFrame, right: DataFrame, on: list[str], hot: Column) -> DataFrame:
    """Inner equi-join with a ``right`` side of one row per key. Keys that are ``hot``, of which there must be few, meet ``left`` by broadcast; only the others' rows are shuffled, so no hot key meets one task."""
    few = F.broadcast(right.where(hot))
    return left.join(few, on).unionByName(left.join(F.broadcast(right.where(hot).select(*on)), on, "left_anti").join(right.where(~hot), on))


def spread(df: DataFrame) -> DataFrame:
    """``df`` with at least a partition per core: a table in one small file would otherwise keep one Python worker busy."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
