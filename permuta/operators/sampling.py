"""Samples and splits. Order is a hash of the id, so a sample is the same whatever the partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permuta.functions.rankings import hash_uniform
from permuta.sources.tables import row_numbers


def top_fraction(moved: DataFrame, key: str, share: float) -> DataFrame:
    """The share of largest absolute motions of each key; floor(share * n) + 1 rows are kept."""
    n = F.count("*").over(Window.partitionBy(key))
    order = Window.partitionBy(key).orderBy(F.abs("motion").desc(), "item")
    return moved.withColumn("_k", F.row_number().over(order) - 1).withColumn("_n", n).where(F.col("_k") <= share * F.col("_n")).drop("_k", "_n")


def cap_per_group(rows: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """At most n rows of each group, in hash order; the limit is applied before the shuffle too."""
    order = Window.partitionBy(group).orderBy("_u", key)
    return rows.withColumn("_u", hash_uniform(seed, F.col(key))).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_u", "_k")


def stratified_sample(rows: DataFrame, label: str, key: str, n: int, seed: int) -> DataFrame:
    """max(2, n / classes) rows of each class."""
    classes = rows.select(label).distinct().count()
    return cap_per_group(rows, label, key, max(2, n // max(1, classes)), seed)


def balanced_sample(rows: DataFrame, label: str, key: str, n: int, seed: int) -> DataFrame:
    """n / 2 rows with label 1 and n / 2 with label 0."""
    return cap_per_group(rows.where(F.col(label).isin(0, 1)), label, key, n // 2, seed)


def subsample(rows: DataFrame, key: str, share: float, classes: int, seed: int) -> DataFrame:
    """max(classes, int(share * n)) rows in hash order."""
    n = max(classes, int(share * rows.count()))
    placed = row_numbers(rows.withColumn("_u", hash_uniform(seed, F.col(key))), ["_u", key], "_k")
    return placed.where(F.col("_k") <= n).drop("_u", "_k")


def stratified_split(rows: DataFrame, label: str, key: str, share: float, seed: int) -> DataFrame:
    """rows and split: the share of each label first in hash order is 'test'.

    Ranks come from counts of hash ranges, so no task holds a whole label.
    """
    cells = 1 << 10
    hashed = rows.withColumn("_u", hash_uniform(seed, F.col(key))).withColumn("_c", F.floor(F.col("_u") * cells).cast("int"))
    counts = hashed.groupBy(label, "_c").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(label).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(label)))
    inside = Window.partitionBy(label, "_c").orderBy("_u", key)
    ranked = hashed.join(counts.drop("_n"), [label, "_c"]).withColumn("_k", F.col("_before") + F.row_number().over(inside))
    return ranked.withColumn("split", F.when(F.col("_k") <= F.floor(F.col("_all") * share), "test").otherwise("train")).drop("_u", "_c", "_before", "_all", "_k")


def head_split(rows: DataFrame, key: str, share: float) -> DataFrame:
    """rows and split: the first int(share * n) rows by key are 'validation'."""
    n = int(share * rows.count())
    return row_numbers(rows, [key], "_k").withColumn("split", F.when(F.col("_k") <= n, "validation").otherwise("train")).drop("_k")


def head_splits(rows: DataFrame, key: str, share: float = 0.2, test: float = 0.5) -> DataFrame:
    """rows and split in three: of the first int(share * n) rows by key the first int(test * m) are 'test' and the others 'validation'."""
    m = int(share * rows.count())
    cut = int(test * m)
    name = F.when(F.col("_k") <= cut, "test").when(F.col("_k") <= m, "validation").otherwise("train")
    return row_numbers(rows, [key], "_k").withColumn("split", name).drop("_k")


def minibatch(rows: DataFrame, key: str, step: int, size: int, n: int, seed: int) -> DataFrame:
    """About ``size`` of n rows for a step: those whose hash of step and key is small enough."""
    return rows.where(hash_uniform(seed, F.lit(step), F.col(key)) < size / n)


def union_vocab(train: DataFrame, test: DataFrame, item: str) -> DataFrame:
    """Both splits with item codes from their common vocabulary."""
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    codes = row_numbers(both.select(item).distinct(), [item], "_k").select(item, (F.col("_k") - 1).alias("code"))
    return both.join(codes, item)


def eligible_groups(rows: DataFrame, group: str, candidates: int = 3, distinct: int = 50, total: int = 100) -> DataFrame:
    """(group, candidates, ballots, total) of groups with enough candidates, distinct ballots and ballots. rows: group, ballot, width, weight."""
    sums = rows.groupBy(group).agg(F.max("width").alias("candidates"), F.countDistinct("ballot").alias("ballots"), F.sum("weight").alias("total"))
    return sums.where((F.col("candidates") >= candidates) & (F.col("ballots") >= distinct) & (F.col("total") >= total))
