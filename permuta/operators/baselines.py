"""Baselines from Spark ML on wide numeric features, tuned by cross-validation where a grid is given."""

from __future__ import annotations

from pyspark.ml import classification as C
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .consensus import majority_vote


#: The full grids of a study, by Spark's names of the parameters. A maxDepth of 30 is Spark's largest.
GRIDS = {
    "random_forest": {"numTrees": [100, 200, 500], "maxDepth": [5, 10, 30], "minInstancesPerNode": [1, 2], "featureSubsetStrategy": ["sqrt", "log2", "all"]},
    "boosted_trees": {"maxIter": [100, 200, 500], "maxDepth": [3, 5, 7, 10], "stepSize": [0.01, 0.05, 0.1], "subsamplingRate": [0.8, 1.0]},
    "perceptron": {"layers": [(64,), (128,), (256,), (64, 64), (128, 64), (256, 128)], "stepSize": [0.001, 0.01]},
    "logistic": {"regParam": [100.0, 10.0, 1.0, 0.1, 0.01]},
    "neighbours": {"k": (1, 3, 5, 7, 11, 15), "metrics": ("l1", "l2")},
}


def vectors(rows: DataFrame) -> DataFrame:
    """(id, label, features) of (id, label, v array)."""
    return rows.select("id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("v").cast("array<double>")).alias("features"))


def tuned(estimator, grid: dict, train: DataFrame, folds: int = 3, inner=None):
    """The best model of a grid by k-fold accuracy; the grid may be over an inner classifier's parameters."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid((inner or estimator).getParam(name), values)
    measure = MulticlassClassificationEvaluator(metricName="accuracy")
    return CrossValidator(estimator=estimator, estimatorParamMaps=builder.build(), evaluator=measure, numFolds=folds, seed=7, parallelism=2).fit(train)


def score(model, test: DataFrame) -> DataFrame:
    return model.transform(test).select("id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"))


def random_forest(train: DataFrame, test: DataFrame, grid: dict | None = None) -> DataFrame:
    """The best of a grid, such as GRIDS["random_forest"]; of two sizes if none is given."""
    return score(tuned(C.RandomForestClassifier(seed=7), grid or {"numTrees": [10, 20], "maxDepth": [6]}, train), test)


def boosted_trees(train: DataFrame, test: DataFrame, grid: dict | None = None) -> DataFrame:
    """The best of a grid, such as GRIDS["boosted_trees"]; of two depths and ten rounds if none is given."""
    trees = C.GBTClassifier(maxIter=10, seed=7)
    return score(tuned(C.OneVsRest(classifier=trees), grid or {"maxDepth": [2, 3]}, train, inner=trees), test)


def perceptron(train: DataFrame, test: DataFrame, items: int, classes: int, grid: dict | None = None) -> DataFrame:
    """The best network of a grid of hidden layers and rates, such as GRIDS["perceptron"]."""
    shapes = {k: [[items, *x, classes] for x in v] if k == "layers" else v for k, v in (grid or {"layers": [(8,), (16,)]}).items()}
    return score(tuned(C.MultilayerPerceptronClassifier(maxIter=30, seed=7, solver="gd" if "stepSize" in shapes else "l-bfgs"), shapes, train), test)


def perceptrons(train: DataFrame, test: DataFrame, items: int, classes: int, seeds: int = 7) -> DataFrame:
    """Vote of several networks with different seeds."""
    out = None
    for seed in range(seeds):
        part = score(C.MultilayerPerceptronClassifier(layers=[items, 16, classes], maxIter=30, seed=seed).fit(train), test)
        out = part if out is None else out.unionByName(part)
    return majority_vote(out, "id", "predicted").join(test.select("id", F.col("label").cast("int").alias("label")), "id")


def logistic(train: DataFrame, test: DataFrame, grid: dict | None = None) -> DataFrame:
    return score(tuned(C.LogisticRegression(maxIter=20), grid or {"regParam": [0.01, 0.1]}, train), test)


def naive_bayes(train: DataFrame, test: DataFrame) -> DataFrame:
    return score(C.NaiveBayes(modelType="gaussian").fit(train), test)


def linear_svm(train: DataFrame, test: DataFrame) -> DataFrame:
    machine = C.LinearSVC(maxIter=10)
    return score(tuned(C.OneVsRest(classifier=machine), {"regParam": [0.025, 0.1]}, train, inner=machine), test)
