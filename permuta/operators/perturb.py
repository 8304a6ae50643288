"""Perturbations; all randomness is a hash of seed, row and place, so a lost task repeats itself exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permuta.functions.rankings import hash_normal, hash_uniform, swap_neighbours
from permuta.sources.tables import small


def augment_swaps(rows: DataFrame, copies: int, most: int, seed: int) -> DataFrame:
    """(id, copy, items): the rankings (copy 0) and copies with 1..most swaps of neighbours."""
    wide = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    swaps = F.floor(hash_uniform(seed, F.col("id"), F.col("copy")) * most).cast("int") + 1
    place = lambda k: F.floor(hash_uniform(seed + 1, F.col("id"), F.col("copy"), k) * (F.size("items") - 1)).cast("int")
    changed = swap_neighbours(F.col("items"), F.transform(F.sequence(F.lit(1), swaps), place))
    return wide.select("id", "copy", F.when((F.col("copy") == 0) | (F.size("items") < 2), F.col("items")).otherwise(changed).alias("items"))


def distort(rows: DataFrame, swap: float, delete: float, seed: int) -> DataFrame:
    """(id, items): at each place a swap with the next by chance, then deletions by chance."""
    hit = F.filter(F.sequence(F.lit(0), F.size("items") - 2), lambda p: hash_uniform(seed, F.col("id"), p) < swap)
    swapped = F.when(F.size("items") > 1, swap_neighbours(F.col("items"), hit)).otherwise(F.col("items"))
    return rows.select("id", swapped.alias("items")).select("id", F.filter("items", lambda x: hash_uniform(seed + 1, F.col("id"), x) >= delete).alias("items"))


def noisy_variants(rows: DataFrame, seed: int) -> DataFrame:
    """(id, items): up to a third of the places swapped and up to a third of the items deleted; half at least stay."""
    n = F.size("items")
    swaps = F.floor(hash_uniform(seed, F.col("id")) * (n / 3 + 1)).cast("int")
    place = lambda k: F.floor(hash_uniform(seed + 1, F.col("id"), k) * (n - 1)).cast("int")
    spots = F.when(swaps > 0, F.transform(F.sequence(F.lit(1), F.greatest(swaps, F.lit(1))), place)).otherwise(F.array().cast("array<int>"))
    keep = F.greatest(F.ceil(n / 2), n - F.floor(hash_uniform(seed + 2, F.col("id")) * (n / 3 + 1))).cast("int")
    varied = rows.select("id", F.when(n > 1, swap_neighbours(F.col("items"), spots)).otherwise(F.col("items")).alias("items"), keep.alias("_keep"))
    chosen = F.slice(F.array_sort(F.transform("items", lambda x: F.struct(hash_uniform(seed + 3, F.col("id"), x).alias("u"), x.alias("x")))), F.lit(1), F.col("_keep"))
    return varied.select("id", F.filter("items", lambda x: F.exists(chosen, lambda s: s["x"] == x)).alias("items"))


def add_noise(rows: DataFrame, scaler: DataFrame, sigma: float, seed: int) -> DataFrame:
    """(id, feature, x): x plus a normal number times sigma times the feature's deviation (1e-8 at least)."""
    noise = hash_normal(seed, F.col("id"), F.col("feature")) * sigma * F.greatest(F.col("std"), F.lit(1e-8))
    return rows.join(small(scaler), "feature").select("id", "feature", F.round(F.col("x") + noise, 6).alias("x"))


def mask_features(rows: DataFrame, scaler: DataFrame, share: float, features: int, seed: int) -> DataFrame:
    """(id, feature, x): max(1, int(features * share)) features of every row set to their mean."""
    order = Window.partitionBy("id").orderBy(hash_uniform(seed, F.col("id"), F.col("feature")), "feature")
    hidden = F.row_number().over(order) <= max(1, int(features * share))
    placed = rows.withColumn("_h", hidden).join(small(scaler), "feature")
    return placed.select("id", "feature", F.round(F.when(F.col("_h"), F.col("mean")).otherwise(F.col("x")), 9).alias("x"))


def feature_scale(rows: DataFrame, sigma: float, seed: int) -> DataFrame:
    """(id, feature, x): every feature times a log-normal factor of its own."""
    return rows.select("id", "feature", F.round(F.col("x") * F.exp(hash_normal(seed, F.col("feature")) * sigma), 9).alias("x"))


def degradation(results: DataFrame, level: str) -> DataFrame:
    """(dataset, method, level, error, lost): mean error at a level less that at level 0."""
    means = results.groupBy("dataset", "method", level).agg(F.avg("error").alias("error"))
    clean = means.where(F.col(level) == 0).select("dataset", "method", F.col("error").alias("_clean"))
    return means.join(clean, ["dataset", "method"]).select("dataset", "method", level, F.round("error", 10).alias("error"), F.round(F.col("error") - F.col("_clean"), 10).alias("lost"))
