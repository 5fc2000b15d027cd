"""A random forest that is grown and stored a few trees at a time, so that no process ever holds the nodes of all trees as objects.

MLlib keeps every node of a forest on the driver while it grows. Here groups of trees are grown one after the other, each on bootstrap
samples of its own, and the nodes go to a table in MLlib's own layout (treeID, nodeData). To score, tasks pack each tree into arrays.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.util import DefaultParamsReader, DefaultParamsReadable, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from catalens.session import shared_dir

#: Nodes of the trees that grow at once: some 500 bytes each on the driver.
GROUP_NODES = 300_000
#: Seeds of groups lie far apart, since MLlib adds the number of the partition to them.
SEED_STEP = 1_000_003
#: One node of a packed tree: the feature (-1 in a leaf), whether that is categorical, the two children, and a value: the threshold, the
#: left categories as bits (there are at most 32, MLlib's number of bins), or the prediction of a leaf.
NODE = np.dtype([("feature", "<i2"), ("categorical", "<i2"), ("left", "<i4"), ("right", "<i4"), ("value", "<f8")])


class _ForestParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "most levels below the root", TypeConverters.toInt)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "rows of a bootstrap sample, as a share", TypeConverters.toFloat)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "features looked at per split", TypeConverters.toString)
    maxMemoryInMB = Param(Params._dummy(), "maxMemoryInMB", "statistics that a task adds up in one pass", TypeConverters.toInt)
    groupNodes = Param(Params._dummy(), "groupNodes", "most nodes of the trees that grow at once", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(numTrees=100, maxDepth=15, subsamplingRate=0.5, featureSubsetStrategy="0.75", maxMemoryInMB=64,
                         groupNodes=GROUP_NODES, seed=3)


class RandomForestInGroups(Estimator, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """MLlib's random forest regression of ``numTrees`` trees, grown in groups of at most ``groupNodes`` nodes (one tree at least).

    A tree has no more nodes than twice the rows or than its depth allows.
    Trees are bootstrapped independently, so groups make up the same kind of forest as one fit of all trees.
    """

    @keyword_only
    def __init__(self, *, numTrees=100, maxDepth=15, subsamplingRate=0.5, featureSubsetStrategy="0.75", maxMemoryInMB=64,
                 groupNodes=GROUP_NODES, seed=3):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> RandomForestModel:
        spark, get = dataset.sparkSession, self.getOrDefault
        rows = dataset.select(self.getFeaturesCol(), self.getLabelCol())
        most = min(2 ** (get("maxDepth") + 1), 2 * rows.count())
        size = max(1, get("groupNodes") // max(1, most))
        path = f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}"
        for first in range(0, get("numTrees"), size):
            grown = RandomForestRegressor(
                featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(), numTrees=min(size, get("numTrees") - first),
                maxDepth=get("maxDepth"), subsamplingRate=get("subsamplingRate"), seed=get("seed") + first * SEED_STEP,
                featureSubsetStrategy=get("featureSubsetStrategy"), maxMemoryInMB=get("maxMemoryInMB"), cacheNodeIds=True,
            ).fit(rows)
            grown.write().save(f"{path}/group-{first}")
            del grown  # releases the trees on the driver
            stored = spark.read.parquet(f"{path}/group-{first}/data")
            stored.withColumn("treeID", F.col("treeID") + F.lit(first)).write.mode("append").parquet(f"{path}/nodes")
        return self._copyValues(RandomForestModel(spark.read.parquet(f"{path}/nodes")))


def packed(nodes: DataFrame) -> DataFrame:
    """(treeID, nodes): every tree as one packed array, made by a task of its own."""
    split, leaf = F.col("nodeData.split"), F.col("nodeData.leftChild") < 0
    flat = nodes.select(
        "treeID", F.col("nodeData.id").alias("id"), F.when(leaf, -1).otherwise(split["featureIndex"]).alias("feature"),
        (~leaf & (split["numCategories"] >= 0)).cast("int").alias("categorical"),
        F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        F.when(leaf, F.col("nodeData.prediction")).when(split["numCategories"] < 0, F.get(split["leftCategoriesOrThreshold"], 0))
        .otherwise(F.aggregate(split["leftCategoriesOrThreshold"], F.lit(0.0), lambda bits, c: bits + F.pow(F.lit(2.0), c))).alias("value"))

    def pack(tree: pd.DataFrame) -> pd.DataFrame:
        tree = tree.sort_values("id")  # numbered from zero without gaps
        out = np.zeros(len(tree), NODE)
        for name in NODE.names:
            out[name] = tree[name].to_numpy()
        return pd.DataFrame({"treeID": tree["treeID"].iloc[:1], "nodes": [out.tobytes()]})

    return flat.groupBy("treeID").applyInPandas(pack, "treeID int, nodes binary")


def leaf_values(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Prediction of one packed tree for every row of ``x``: all rows go down a level at a time."""
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(rows):
        node = tree[at[rows]]
        rows, node = rows[node["feature"] >= 0], node[node["feature"] >= 0]
        cell = x[rows, node["feature"]]
        known = node["categorical"] > 0
        left = np.where(known, np.floor(node["value"] / np.exp2(np.where(known, cell, 0.0))) % 2 == 1, cell <= node["value"])
        at[rows] = np.where(left, node["left"], node["right"])
    return tree["value"][at]


class RandomForestModel(Model, _ForestParams, MLReadable, MLWritable):
    """The mean over all trees of a table of nodes. Packed, a node takes 20 bytes: at most 131 MB for 100 trees of depth 15."""

    def __init__(self, nodes: DataFrame | None = None):
        super().__init__()
        self.nodes, self._trees = nodes, None

    def trees(self) -> list[np.ndarray]:
        if self._trees is None:
            # One task's trees at a time come to the driver.
            self._trees = [np.frombuffer(r["nodes"], NODE) for r in packed(self.nodes).toLocalIterator()]
        return self._trees

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees = self.trees()

        @F.pandas_udf(DoubleType())
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                x = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, 1))
                yield pd.Series(sum(leaf_values(tree, x) for tree in trees) / len(trees))

        return dataset.withColumn(self.getPredictionCol(), score(vector_to_array(self.getFeaturesCol())))

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, model: RandomForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.nodes.write.parquet(f"{path}/data")


class _ForestReader(MLReader):
    def load(self, path: str) -> RandomForestModel:
        known = DefaultParamsReader.loadMetadata(path, self.sparkSession, "catalens.plans.forest.RandomForestModel")
        model = RandomForestModel(self.sparkSession.read.parquet(f"{path}/data"))
        model._resetUid(known["uid"])
        DefaultParamsReader.getAndSetParams(model, known)
        return model
