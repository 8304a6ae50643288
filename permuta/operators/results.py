"""Roll-ups of result logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filter_results(rows: DataFrame, **wanted) -> DataFrame:
    """Rows whose field equals a value, or is in a list."""
    for field, value in wanted.items():
        rows = rows.where(F.col(field).isin(value) if isinstance(value, (list, tuple)) else F.col(field) == value)
    return rows


def accuracy_table(rows: DataFrame) -> DataFrame:
    """(dataset, method, error, best): the row with most training data, the dataset's lowest error marked."""
    last = rows.groupBy("dataset", "method").agg(F.max(F.struct("n_train", (-F.col("error")).alias("e"))).alias("m"))
    last = last.select("dataset", "method", (-F.col("m.e")).alias("error"))
    return last.withColumn("best", F.col("error") == F.min("error").over(Window.partitionBy("dataset")))


def ablation_table(rows: DataFrame) -> DataFrame:
    """(dataset, method, error, place): variants of a dataset ordered by error."""
    means = rows.groupBy("dataset", "method").agg(F.round(F.avg("error"), 10).alias("error"))
    return means.withColumn("place", F.row_number().over(Window.partitionBy("dataset").orderBy("error", "method")))


def crossover(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(dataset, n_train, error_a, error_b, winner): which of two methods is better at each size."""
    of = lambda m: F.round(F.avg(F.when(F.col("method") == m, F.col("error"))), 10)
    both = rows.groupBy("dataset", "n_train").agg(of(a).alias("error_a"), of(b).alias("error_b")).where("error_a is not null and error_b is not null")
    return both.withColumn("winner", F.when(F.col("error_a") < F.col("error_b"), a).when(F.col("error_a") > F.col("error_b"), b).otherwise("tie"))


def curve_points(rows: DataFrame) -> DataFrame:
    """(method, n_train, error_pct, stderr_pct)."""
    e = F.col("error") * 100
    return rows.groupBy("method", "n_train").agg(F.round(F.avg(e), 10).alias("error_pct"), F.round(F.stddev_pop(e) / F.sqrt(F.count("*")), 10).alias("stderr_pct"))


def summary_pivot(rows: DataFrame, levels: list[int]) -> DataFrame:
    """Methods by levels of training size."""
    wide = rows.groupBy("method").pivot("n_train", levels).agg(F.round(F.avg("error"), 10))
    return wide.select("method", *[F.col(str(x)).alias(f"n{x}") for x in levels])


def learning_gain(rows: DataFrame, base: str, other: str) -> DataFrame:
    """(dataset, gain): error of ``base`` over that of ``other``."""
    of = lambda m: F.avg(F.when(F.col("method") == m, F.col("error")))
    both = rows.groupBy("dataset").agg(of(base).alias("_a"), of(other).alias("_b"))
    return both.select("dataset", F.round(F.when(F.col("_b") > 0, F.col("_a") / F.col("_b")), 10).alias("gain"))
