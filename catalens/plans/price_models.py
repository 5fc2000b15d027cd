"""Price regression: split, encoding, five models, metrics and batch scoring. The label is the natural log of price."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalens.functions.scalars import whole_price
from catalens.operators.nearest import nearest_mean
from catalens.plans.forest import RandomForestInGroups
from catalens.plans.kernel import KernelRegressor
from catalens.plans.laptops import CATEGORICAL, FEATURES, NUMERIC
from catalens.session import materialize

KEY = "unnamed_0"
# 15 % of the 65,536 four-digit hex prefixes, and the split seed.
TEST_BELOW = "2666"
SPLIT_SEED = 2


def in_test(key: str = KEY, seed: int = SPLIT_SEED) -> Column:
    """True for about 15 % of the rows. A row's side depends on its key only: no shuffle, the same on every run."""
    return F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), 1, 4) < TEST_BELOW


def model_rows(features: DataFrame) -> DataFrame:
    """Complete rows with the ``is_test`` mark.

    Stored once, as encoders, models and both sides of the split read them; a filter on the derived columns would
    otherwise be pushed down and parse every raw text twice.
    """
    return materialize(features.withColumn("is_test", in_test()), "features").dropna("any", subset=FEATURES)


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where(~F.col("is_test")), rows.where("is_test")


def encoder_stages() -> list:
    """One-hot with the alphabetically first category dropped, unseen categories an error, the rest passed through.

    In descending order the alphabetically first label comes last, and the last is the one OneHotEncoder drops.
    """
    codes = [f"{c}_code" for c in CATEGORICAL]
    hot = [f"{c}_hot" for c in CATEGORICAL]
    return [
        StringIndexer(inputCols=CATEGORICAL, outputCols=codes, stringOrderType="alphabetDesc", handleInvalid="error"),
        OneHotEncoder(inputCols=codes, outputCols=hot, dropLast=True),
        VectorAssembler(inputCols=hot + NUMERIC, outputCol="features", handleInvalid="error"),
    ]


def fit_encoder(train: DataFrame) -> PipelineModel:
    """Fitted once and shared by all models."""
    return Pipeline(stages=encoder_stages()).fit(train)


def encoded_names(encoder: PipelineModel) -> list[str]:
    """Names of the one-hot slots in vector order."""
    return [f"{c}_{v}" for c, labels in zip(CATEGORICAL, encoder.stages[0].labelsArray) for v in labels[:-1]]


def encoded_columns(encoder: PipelineModel, rows: DataFrame) -> DataFrame:
    """The one-hot slots as plain columns."""
    cells = vector_to_array("features")
    return encoder.transform(rows).select(
        KEY, *[F.get(cells, i).alias(name) for i, name in enumerate(encoded_names(encoder))]
    )


def least_squares() -> LinearRegression:
    return LinearRegression(solver="normal", regParam=0.0)


def tree() -> DecisionTreeRegressor:
    return DecisionTreeRegressor(maxDepth=8, maxBins=256)


def forest() -> RandomForestInGroups:
    """100 trees of depth 15 on half-size bootstrap samples, three quarters of the features per split.

    Trees grow in groups, and a task adds up 64 MB of statistics in a pass, so neither the driver nor a task grows with the rows.
    Cached node numbers save each pass the walk through all trees and keep the trees out of the shipped tasks.
    """
    return RandomForestInGroups(numTrees=100, subsamplingRate=0.5, featureSubsetStrategy="0.75", maxDepth=15, seed=3)


def encoded_train(encoder: PipelineModel, train: DataFrame) -> DataFrame:
    """(features, label), evenly spread and stored once: the iterative fits read it many times."""
    spark = train.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return materialize(encoder.transform(train).repartition(n, KEY).select("features", "label"), "train")


def fit(estimator, encoder: PipelineModel, train: DataFrame) -> PipelineModel:
    """Encoder and model as one object, ready to save and to score raw feature rows."""
    return PipelineModel([*encoder.stages, estimator.fit(encoded_train(encoder, train))])


def three_nearest(train: DataFrame, test: DataFrame) -> DataFrame:
    return nearest_mean(train, test, KEY, NUMERIC, CATEGORICAL, "label", 3).select(KEY, "label", "prediction")


class NearestModel:
    """The three nearest training rows as a model that is stored, loaded and scored like the others."""

    def __init__(self, train: DataFrame):
        self.train = train

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their columns and ``prediction``; they need the features alone, so requests are scored too."""
        return nearest_mean(self.train, rows, KEY, NUMERIC, CATEGORICAL, "label", 3)

    def save(self, path: str) -> None:
        self.train.select(KEY, *CATEGORICAL, *NUMERIC, "label").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> NearestModel:
        return NearestModel(spark.read.parquet(path))


def fit_all(train: DataFrame) -> dict:
    """The five models by name, on one encoder."""
    encoder = fit_encoder(train)
    rows = encoded_train(encoder, train)
    made = {"least_squares": least_squares(), "tree": tree(), "forest": forest(), "kernel": KernelRegressor()}
    fitted = {name: PipelineModel([*encoder.stages, estimator.fit(rows)]) for name, estimator in made.items()}
    return fitted | {"nearest": NearestModel(train)}


def leaderboard(models: dict, test: DataFrame) -> DataFrame:
    """(model, n, r2, mae) of every model on the same rows."""
    rows = [metrics(model.transform(test), name) for name, model in models.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def moments(predicted: DataFrame, digits: int = 6) -> DataFrame:
    """(slot, moment): mean product of the residual with every encoded feature, and with one. Least squares makes all zero."""
    cells = F.concat(vector_to_array("features"), F.array(F.lit(1.0)))
    rows = predicted.select(F.posexplode(cells).alias("slot", "x"), (F.col("label") - F.col("prediction")).alias("gap"))
    return rows.groupBy("slot").agg((F.round(F.avg(F.col("x") * F.col("gap")), digits) + 0.0).alias("moment"))


def metrics(predicted: DataFrame, name: str, digits: int = 6) -> DataFrame:
    """(model, n, r2, mae) of one prediction column, in one aggregate.

    The total sum of squares comes from the variance, so the mean need not be known first.
    """
    gap = F.col("label") - F.col("prediction")
    return predicted.agg(
        F.count("*").alias("n"),
        F.round(F.lit(1.0) - F.sum(gap * gap) / (F.var_pop("label") * F.count("label")), digits).alias("r2"),
        F.round(F.avg(F.abs(gap)), digits).alias("mae"),
    ).select(F.lit(name).alias("model"), "n", "r2", "mae")


def mean_prediction(train: DataFrame, test: DataFrame) -> DataFrame:
    """The test rows with the training mean as prediction, the floor any model should beat."""
    return test.select(KEY, "label", F.lit(train.agg(F.avg("label")).first()[0]).alias("prediction"))


def simple_least_squares(train: DataFrame, column: str, digits: int = 9) -> DataFrame:
    """Slope, intercept and R2 of the label on one column."""
    return train.agg(
        F.round(F.regr_slope("label", column), digits).alias("slope"),
        F.round(F.regr_intercept("label", column), digits).alias("intercept"),
        F.round(F.regr_r2("label", column), digits).alias("r2"),
        F.count("*").alias("n"),
    )


def score_requests(model: Transformer, requests: DataFrame) -> DataFrame:
    """(request_id, price): predicted price in whole units for any number of requests."""
    return model.transform(requests).select("request_id", whole_price(F.col("prediction")).alias("price"))
