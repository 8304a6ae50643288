"""Consensus orderings, votes and error measures; every one is a sum that partial aggregation combines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vote_matrix(rows: DataFrame, group: str) -> DataFrame:
    """(group, item, pos, votes): weighted count of an item at a position."""
    return rows.groupBy(group, "item", "pos").agg(F.sum("weight").alias("votes"))


def consensus_borda(rows: DataFrame, group: str) -> DataFrame:
    """(group, item, pos, mean): items by their mean position, ties by item. rows: group, item, pos, weight."""
    sums = rows.groupBy(group, "item").agg(F.sum(F.col("weight") * F.col("pos")).alias("_n"), F.sum("weight").alias("_d"))
    mean = (F.col("_n") / F.col("_d")).cast("double")
    order = Window.partitionBy(group).orderBy("mean", "item")
    return sums.select(group, "item", mean.alias("mean")).withColumn("pos", F.row_number().over(order) - 1).select(group, "item", "pos", "mean")


def consensus_compat(rows: DataFrame, prior: DataFrame, group: str) -> DataFrame:
    """The code's variant: an identity prior counts once and row sums are divided by the column sum of the item's prior position."""
    own = prior.select(group, "item", F.col("pos").alias("_prior"))
    all_votes = rows.select(group, "item", "pos", "weight").unionByName(prior.select(group, "item", "pos", F.lit(1).cast(rows.schema["weight"].dataType).alias("weight")))
    num = all_votes.groupBy(group, "item").agg(F.sum(F.col("weight") * F.col("pos")).alias("_n"))
    den = all_votes.groupBy(group, F.col("pos").alias("_prior")).agg(F.sum("weight").alias("_d"))
    joined = own.join(num, [group, "item"]).join(den, [group, "_prior"])
    order = Window.partitionBy(group).orderBy("mean", "_prior")
    return joined.withColumn("mean", (F.col("_n") / F.col("_d")).cast("double")).withColumn("pos", F.row_number().over(order) - 1).select(group, "item", "pos", "mean")


def consensus_with_prior(rows: DataFrame, prior: DataFrame, group: str) -> DataFrame:
    """A prior ordering of weight 1 against the rows' own weights."""
    known = prior.select(group, "item", "pos", F.lit(1.0).alias("weight"))
    return consensus_borda(rows.select(group, "item", "pos", F.col("weight").cast("double").alias("weight")).unionByName(known), group)


def majority_vote(votes: DataFrame, key: str = "id", label: str = "label") -> DataFrame:
    """(key, label): the most frequent label, ties to the lowest."""
    counts = votes.groupBy(key, label).agg(F.count("*").alias("_n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(label).alias("v"))).alias("b")).select(key, F.col("b.v").alias(label))


def error_rate(rows: DataFrame, predicted: str, label: str):
    return rows.agg(F.avg((F.col(predicted) != F.col(label)).cast("int")).alias("error"))


def run_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, population deviation, minimum, maximum and standard error of runs."""
    v = F.col(value)
    return rows.groupBy(*by).agg(F.count(v).alias("n"), F.round(F.avg(v), 10).alias("mean"), F.round(F.stddev_pop(v), 10).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.stddev_pop(v) / F.sqrt(F.count(v)), 10).alias("stderr"))


def rank_agreement(a: DataFrame, b: DataFrame, key: str):
    both = a.select(key, "item", F.col("pos").alias("_a")).join(b.select(key, "item", F.col("pos").alias("_b")), [key, "item"])
    return both.groupBy(key).agg(F.avg((F.col("_a") == F.col("_b")).cast("int")).alias("agreement"))


def motion_average(moved: DataFrame, group: str, how: str = "mean", scale: float = 1.0) -> DataFrame:
    """(group, item, motion, scaled, place): motions of several filters combined per item and ordered by magnitude.

    scaled is the motion as a share of the group's largest, times the number of items and ``scale``.
    """
    how_ = {"mean": F.avg("motion").cast("double"), "median": F.median("motion").cast("double"), "mode": F.mode("motion", True).cast("double")}[how]
    per = moved.groupBy(group, "item").agg(how_.alias("motion"))
    everything = Window.partitionBy(group)
    most = F.max(F.abs("motion")).over(everything)
    scaled = F.when(most > 0, F.col("motion") * F.count("*").over(everything) * scale / most).otherwise(0.0)
    order = Window.partitionBy(group).orderBy(F.abs("motion").desc(), "item")
    return per.withColumn("scaled", scaled).withColumn("place", F.row_number().over(order) - 1)


def pairwise_preference(rows: DataFrame, key: str = "id", group: str | None = None) -> DataFrame:
    """(a, b, share): share of rankings with a before b, for a < b."""
    by = [group] if group else []
    left = rows.select(key, *by, F.col("item").alias("a"), F.col("pos").alias("_a"))
    right = rows.select(key, F.col("item").alias("b"), F.col("pos").alias("_b"))
    return left.join(right, key).where("a < b").groupBy(*by, "a", "b").agg(F.avg((F.col("_a") < F.col("_b")).cast("int")).alias("share"))


def pareto_check(preferences: DataFrame, consensus: DataFrame, group: str):
    """(group, unanimous, violations): unanimous pairs that the consensus turns round."""
    pos = consensus.select(group, "item", "pos")
    sure = preferences.where("share in (0.0, 1.0)")
    left, right = pos.select(group, F.col("item").alias("a"), F.col("pos").alias("_a")), pos.select(group, F.col("item").alias("b"), F.col("pos").alias("_b"))
    both = sure.join(left, [group, "a"]).join(right, [group, "b"])
    broken = ((F.col("share") == 1.0) & (F.col("_a") > F.col("_b"))) | ((F.col("share") == 0.0) & (F.col("_a") < F.col("_b")))
    return both.groupBy(group).agg(F.count("*").alias("unanimous"), F.count_if(broken).alias("violations"))


def smallest_gap(values: DataFrame, key: str, value: str) -> DataFrame:
    """(key, margin): smallest difference between neighbours in the order of value."""
    order = Window.partitionBy(key).orderBy(value)
    return values.withColumn("_g", F.col(value) - F.lag(value).over(order)).groupBy(key).agg(F.min("_g").alias("margin"))
