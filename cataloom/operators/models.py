"""Price model (ridge) and clause calibration (logistic), by MLlib; a ridge of more features than its normal equations take is solved by conjugate gradients."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.session import staged

MOST_FEATURES = 4096  # that MLlib's normal equations take
DENSE, ROUNDS, RESIDUAL = 256, 1000, 1e-12  # of the conjugate gradients: most frequent features that the preconditioner solves exactly, most rounds, residual relative to the first
NUMERIC = ["cpu_tier", "cpu_ghz", "ram_gb", "storage_gb", "screen_in", "weight_lb"]
BOOLEAN = ["is_discrete_gpu", "is_renewed"]
CATEGORICAL = ["brand", "segment", "cpu_family", "gpu_brand", "os_family"]


def design(df: DataFrame) -> DataFrame:
    """Priced listings with y = ln(price), medians for missing numbers and a flag for each, ln(1 + x) of memory and storage."""
    priced = df.where("price IS NOT NULL")
    medians = priced.agg(*[F.coalesce(F.median(c), F.lit(0.0)).alias(f"med_{c}") for c in NUMERIC])
    rows = priced.crossJoin(F.broadcast(medians))  # one row
    return rows.select(
        "parent_asin", "price", F.log("price").alias("y"), *[F.coalesce(c, f"med_{c}").alias(f"x_{c}") for c in NUMERIC], *[F.col(c).isNull().cast("double").alias(f"na_{c}") for c in NUMERIC],
        *[F.col(c).cast("double").alias(f"x_{c}") for c in BOOLEAN], *[F.log1p(F.coalesce(c, f"med_{c}")).alias(f"log_{c}") for c in ("ram_gb", "storage_gb")], *CATEGORICAL,
    )


def assembler() -> Pipeline:
    """All one-hot levels are kept; the penalty makes the fit unique."""
    coded = [f"i_{c}" for c in CATEGORICAL]
    numeric = [f"x_{c}" for c in NUMERIC + BOOLEAN] + [f"na_{c}" for c in NUMERIC] + ["log_ram_gb", "log_storage_gb"]
    return Pipeline(
        stages=[
            StringIndexer(inputCols=CATEGORICAL, outputCols=coded, handleInvalid="keep", stringOrderType="frequencyDesc"),
            OneHotEncoder(inputCols=coded, outputCols=[f"h_{c}" for c in CATEGORICAL], dropLast=False),
            VectorAssembler(inputCols=numeric + [f"h_{c}" for c in CATEGORICAL], outputCol="features"),
        ]
    )


def ridge(rows: DataFrame, alpha: float = 1.0, label: str = "y"):
    """Equals ridge regression with penalty ``alpha``: MLlib scales the label, hence sigma / n.

    MLlib takes no more than ``MOST_FEATURES``, and where a feature is constant its normal equations are singular and it falls back on an inexact search: ``SparseRidge`` then does the fit.
    """
    first = rows.select("features").first()
    if first is not None and (first["features"].size > MOST_FEATURES or (rows.agg(Summarizer.variance(F.col("features"))).first()[0].toArray() == 0).any()):
        return SparseRidge(rows, alpha, label)
    s = rows.agg(F.stddev_pop(label).alias("s"), F.count(F.lit(1)).alias("n")).first()
    penalty = (s["s"] or 0.0) * alpha / max(s["n"], 1)
    return LinearRegression(labelCol=label, featuresCol="features", solver="normal", standardization=False, elasticNetParam=0.0, regParam=penalty).fit(rows)


class _Rows:
    """Sparse rows of a batch: (features of the entries, their rows, their values)."""

    def __init__(self, indices: list, values: list):
        counts = np.array([len(v) for v in values], np.int64)
        own = [np.arange(len(v)) if i is None else np.asarray(i) for i, v in zip(indices, values)]  # a dense vector has no indices
        self.row = np.repeat(np.arange(len(counts)), counts)
        self.feature = np.concatenate([*own, np.zeros(0, np.int64)]).astype(np.int64)
        self.value = np.concatenate([*map(np.asarray, values), np.zeros(0)]).astype(np.float64)
        self.n = len(counts)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.feature], self.n)

    def transposed(self, v: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.feature, self.value * v[self.row], size)


class SparseRidge:
    """The same fit for any number of features: preconditioned conjugate gradients on the centred normal equations, to a relative residual of ``RESIDUAL``.

    A round is a pass over the packed rows; a task returns one vector of all features. The preconditioner solves the ``DENSE`` most frequent features together and the others each alone.
    """

    def __init__(self, rows: DataFrame, alpha: float, label: str):
        self.label = label
        self.spark = rows.sparkSession
        size = self.size = rows.select("features").first()["features"].size
        packed = self._packed(rows)

        def moments(batches: Iterator[_Rows], _) -> dict[str, np.ndarray]:
            out = {"n": np.zeros(1), "y": np.zeros(1), "x": np.zeros(size), "xx": np.zeros(size), "xy": np.zeros(size), "held": np.zeros(size)}
            for b in batches:
                one = np.ones(b.n)
                out["n"] += b.n
                out["y"] += b.y.sum()
                out["x"] += b.transposed(one, size)
                out["xy"] += b.transposed(b.y, size)
                out["xx"] += np.bincount(b.feature, b.value**2, size)
                out["held"] += np.bincount(b.feature, minlength=size)
            return out

        m = self._summed(packed, moments, None)
        n = m["n"][0]
        mean, y_mean = m["x"] / n, m["y"][0] / n
        top = np.argsort(-m["held"], kind="stable")[:DENSE]
        at = np.full(size, -1, np.int64)
        at[top] = np.arange(len(top))

        def gram(batches: Iterator[_Rows], at: np.ndarray) -> dict[str, np.ndarray]:
            total = np.zeros((len(top), len(top)))
            for b in batches:
                x, own = np.zeros((b.n, len(top))), at[b.feature] >= 0
                x[b.row[own], at[b.feature[own]]] = b.value[own]
                total += x.T @ x
            return {"gram": total}

        dense = self._summed(packed, gram, at)["gram"] - n * np.outer(mean[top], mean[top]) + alpha * np.eye(len(top))
        diagonal = np.maximum(m["xx"] - n * mean**2, 0) + alpha

        def eased(r: np.ndarray) -> np.ndarray:
            out = r / diagonal
            out[top] = np.linalg.solve(dense, r[top])
            return out

        def product(batches: Iterator[_Rows], v: np.ndarray) -> dict[str, np.ndarray]:
            out = np.zeros(size)
            for b in batches:
                out += b.transposed(b.times(v), size)
            return {"product": out}

        w = np.zeros(size)
        r = m["xy"] - n * mean * y_mean
        aim = RESIDUAL * np.linalg.norm(r)
        z = eased(r)
        p, rz = z, r @ z
        self.rounds = 0
        while np.linalg.norm(r) > aim:
            if self.rounds == ROUNDS:
                raise RuntimeError(f"no fit within {ROUNDS} rounds")
            ap = self._summed(packed, product, p)["product"] - n * mean * (mean @ p) + alpha * p
            step = rz / (p @ ap)
            w, r = w + step * p, r - step * ap
            z = eased(r)
            p, rz = z + (r @ z) / rz * p, r @ z
            self.rounds += 1
        self.coefficients, self.intercept = w, float(y_mean - mean @ w)

    def _packed(self, rows: DataFrame) -> DataFrame:
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    b = _Rows(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    arrays = (b.row.astype(np.int32), b.feature.astype(np.int32), b.value, batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64))
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in arrays], names=["row", "feature", "value", "y"])

        v = F.unwrap_udt("features")
        flat = rows.select(v.getField("indices").alias("i"), v.getField("values").alias("v"), F.col(self.label).cast("double").alias("y"))
        return staged(flat.mapInArrow(pack, "row binary, feature binary, value binary, y binary"), "ridge-rows")

    def _summed(self, packed: DataFrame, part, state) -> dict[str, np.ndarray]:
        """The sum of ``part(batches, state)`` over all tasks."""
        sent = self.spark.sparkContext.broadcast(state)

        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def read() -> Iterator[_Rows]:
                for batch in batches:
                    for row, feature, value, y in zip(*(batch.column(i).to_pylist() for i in range(4))):
                        b = _Rows([], [])
                        b.row, b.feature, b.value, b.y = np.frombuffer(row, np.int32), np.frombuffer(feature, np.int32), np.frombuffer(value), np.frombuffer(y)
                        b.n = len(b.y)
                        yield b

            found = part(read(), sent.value)
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["name", "sums"])

        total: dict[str, np.ndarray] = {}
        few = packed.coalesce(2 * self.spark.sparkContext.defaultParallelism)  # so many vectors of all features reach the driver
        for r in few.mapInArrow(mapped, "name string, sums binary").collect():
            x = np.frombuffer(r["sums"])
            total[r["name"]] = total[r["name"]] + x if r["name"] in total else x
        sent.destroy()
        if "gram" in total:
            total["gram"] = total["gram"].reshape(int(len(total["gram"]) ** 0.5), -1)
        return total

    def transform(self, df: DataFrame) -> DataFrame:
        sent, intercept = self.spark.sparkContext.broadcast(self.coefficients), self.intercept

        @F.pandas_udf("double")
        def predicted(i: pd.Series, v: pd.Series) -> pd.Series:
            return pd.Series(_Rows(list(i), list(v)).times(sent.value) + intercept)

        v = F.unwrap_udt("features")
        return df.withColumn("prediction", predicted(v.getField("indices"), v.getField("values")))

    def r2(self, df: DataFrame) -> float:
        return RegressionEvaluator(labelCol=self.label, metricName="r2").evaluate(self.transform(df))


def r2(model, df: DataFrame) -> float:
    return model.r2(df) if isinstance(model, SparseRidge) else model.evaluate(df).r2


def price_model(df: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(parent_asin, price, fitted_price, residual, residual_pct, value_score): a positive score is cheaper than its parts suggest."""
    rows = design(df)
    features = assembler().fit(rows).transform(rows)
    fitted = ridge(features, alpha).transform(features)
    f = F.exp("prediction")
    return fitted.select(
        "parent_asin", "price", F.round(f, 4).alias("fitted_price"), F.round(F.col("price") - f, 4).alias("residual"), F.round(100 * (F.col("price") / f - 1), 4).alias("residual_pct"),
        F.round(F.col("prediction") - F.col("y"), 6).alias("value_score"),
    )


def price_model_report(df: DataFrame, alpha: float = 1.0, folds: int = 5, least: int = 50) -> dict[str, float | int | None]:
    """R2 within the sample and over hash folds (null under ``least`` rows)."""
    rows = design(df)
    features = assembler().fit(rows).transform(rows).withColumn("fold", F.pmod(F.xxhash64("parent_asin"), F.lit(folds)))
    n = features.count()
    out: dict[str, float | int | None] = {"n": n, "r2": r2(ridge(features, alpha), features) if n else None, "r2_cv": None}
    if n >= least:
        scores = []
        for k in range(folds):
            model = ridge(features.where(F.col("fold") != k), alpha)
            test = features.where(F.col("fold") == k)
            scores.append(r2(model, test))
        out["r2_cv"] = sum(scores) / len(scores)
    return out


def calibration(clauses: DataFrame) -> tuple[float, float]:
    """(a, b) of Platt scaling from (pol, truth): logistic regression of the truth on the logit, penalty C = 1."""
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), (F.col("pol") + 1) / 2))
    rows = clauses.where("truth IS NOT NULL").select(F.log(p / (1 - p)).alias("x"), F.col("truth").cast("double").alias("label"))
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    n = rows.count()
    model = LogisticRegression(regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, tol=1e-10, maxIter=200).fit(rows)
    return float(model.coefficients[0]), float(model.intercept)
