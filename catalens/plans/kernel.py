"""Regression with a Gaussian kernel and an epsilon-insensitive loss, as a stage of a Spark ML pipeline."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType


def gaussian(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma * squared distance) of every row of x and every row of y."""
    far = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)
    return np.exp(-gamma * np.maximum(far, 0.0))


class _KernelParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    size = Param(Params._dummy(), "size", "most landmark rows", TypeConverters.toInt)
    c = Param(Params._dummy(), "c", "weight of the loss against the smoothness", TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "errors up to this cost nothing", TypeConverters.toFloat)
    rounds = Param(Params._dummy(), "rounds", "most passes over the rows", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "stop when a round changes fitted values by less, as a share of their spread", TypeConverters.toFloat)


class KernelRegressor(Estimator, _KernelParams, DefaultParamsReadable, DefaultParamsWritable):
    """Support-vector style regression by landmarks (the Nystroem method). Approximate, and the closer the more landmarks.

    Landmarks are the ``size`` distinct rows that come first by a hash: a bounded sample, on which the kernel is exact. The
    bandwidth is 1 / (columns x variance of all feature values). The epsilon-insensitive loss is minimised by reweighted least
    squares: each round is one pass in which every task sums a matrix over its rows; the sum of those, of fixed size, is
    solved on the driver. ``fit`` reads the rows once per round, so give it a stored table.
    """

    @keyword_only
    def __init__(self, *, size: int = 256, c: float = 10000.0, epsilon: float = 0.1, rounds: int = 15, tol: float = 1e-3, seed: int = 7,
                 featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self._setDefault(size=256, c=10000.0, epsilon=0.1, rounds=15, tol=1e-3, seed=7)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> KernelRegressorModel:
        rows = dataset.select(
            vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("label"))
        zero = F.lit(0.0)
        flat = rows.select(F.aggregate("x", zero, lambda a, v: a + v).alias("s"),
                           F.aggregate("x", zero, lambda a, v: a + v * v).alias("q"), F.size("x").alias("d"))
        t = flat.agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("d").alias("n"), F.max("d").alias("d")).first()
        variance = t["q"] / t["n"] - (t["s"] / t["n"]) ** 2
        gamma = 1.0 / (t["d"] * variance) if variance > 0 else 1.0
        order = [F.xxhash64("x", F.lit(self.getSeed())), "x"]
        landmarks = np.array([r["x"] for r in rows.select("x").distinct().orderBy(*order).limit(self.getOrDefault("size")).collect()])
        # Coordinates in which the kernel of the landmarks is the plain inner product; directions of no weight are left out.
        value, vector = np.linalg.eigh(gaussian(landmarks, landmarks, gamma))
        real = value > 1e-9 * value[-1]
        axes = vector[:, real] / np.sqrt(value[real])
        ridge = np.diag([1.0 / self.getOrDefault("c")] * axes.shape[1] + [1e-9])
        weights = None
        for _ in range(self.getOrDefault("rounds")):
            gram, target, plain = self._sums(rows, landmarks, gamma, axes, weights)
            before, weights = weights, np.linalg.solve(gram + ridge, target)
            if before is not None:
                # Mean square of the change of the fitted values, and of the values.
                change, size = ((w @ plain @ w) for w in (weights - before, weights))
                if change <= self.getOrDefault("tol") ** 2 * size:
                    break
        model = KernelRegressorModel(landmarks, axes @ weights[:-1], float(weights[-1]), gamma)
        return self._copyValues(model)

    def _sums(self, rows: DataFrame, landmarks, gamma, axes, weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        width, epsilon = axes.shape[1] + 1, self.getOrDefault("epsilon")

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            gram, plain, target = np.zeros((width, width)), np.zeros((width, width)), np.zeros(width)
            for batch in batches:
                y = batch["label"].to_numpy()
                z = np.hstack([gaussian(np.stack(batch["x"].to_numpy()), landmarks, gamma) @ axes, np.ones((len(y), 1))])
                w, goal = np.ones(len(y)), y
                if weights is not None:
                    gap = y - z @ weights
                    over = np.abs(gap) - epsilon
                    w = np.where(over > 0, 1.0 / np.maximum(over, 1e-3), 0.0)
                    goal = y - np.sign(gap) * epsilon
                gram += (z * w[:, None]).T @ z
                plain += z.T @ z
                target += z.T @ (w * goal)
            sums = np.concatenate([gram.ravel(), plain.ravel(), target])
            yield pd.DataFrame({"task": [TaskContext.get().partitionId()], "sums": [sums.tobytes()]})

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, task = np.zeros(width * (2 * width + 1)), None
            for batch in batches:
                for task, sums in zip(batch["task"], batch["sums"]):
                    total += np.frombuffer(sums)
            if task is not None:
                yield pd.DataFrame({"task": [task], "sums": [total.tobytes()]})

        # One packed matrix per task, added up by fan-in: no task reads more than about the root of their number.
        parts = rows.mapInPandas(partial, "task int, sums binary")
        n = max(1, int(rows.rdd.getNumPartitions() ** 0.5))
        summed = parts.repartition(n, "task").mapInPandas(add, "task int, sums binary").toPandas()
        full = sum((np.frombuffer(x) for x in summed["sums"]), np.zeros(width * (2 * width + 1)))
        square = width * width
        return full[:square].reshape(width, width), full[2 * square :], full[square : 2 * square].reshape(width, width)


class KernelRegressorModel(Model, _KernelParams, MLReadable, MLWritable):
    """The sum of kernels around the landmarks, each with its weight, and an offset."""

    def __init__(self, landmarks: np.ndarray | None = None, weights: np.ndarray | None = None, offset: float = 0.0, gamma: float = 1.0):
        super().__init__()
        self.landmarks, self.weights, self.offset, self.gamma = landmarks, weights, offset, gamma

    def _transform(self, dataset: DataFrame) -> DataFrame:
        landmarks, weights, offset, gamma = self.landmarks, self.weights, self.offset, self.gamma

        @F.pandas_udf(DoubleType())
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(gaussian(np.stack(x.to_numpy()), landmarks, gamma) @ weights + offset)

        return dataset.withColumn(self.getPredictionCol(), score(vector_to_array(self.getFeaturesCol())))

    def write(self) -> MLWriter:
        return _KernelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _KernelReader()


class _KernelWriter(MLWriter):
    def __init__(self, model: KernelRegressorModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"offset": m.offset, "gamma": m.gamma})
        rows = [(i, x.tolist(), float(w)) for i, (x, w) in enumerate(zip(m.landmarks, m.weights))]
        frame = self.sparkSession.createDataFrame(rows, "landmark int, x array<double>, weight double")
        frame.write.parquet(f"{path}/landmarks")


class _KernelReader(MLReader):
    def load(self, path: str) -> KernelRegressorModel:
        known = DefaultParamsReader.loadMetadata(path, self.sparkSession, "catalens.plans.kernel.KernelRegressorModel")
        rows = self.sparkSession.read.parquet(f"{path}/landmarks").orderBy("landmark").collect()  # the landmarks, a bounded number
        model = KernelRegressorModel(
            np.array([r["x"] for r in rows]), np.array([r["weight"] for r in rows]), known["offset"], known["gamma"])
        model._resetUid(known["uid"])
        DefaultParamsReader.getAndSetParams(model, known)
        return model
