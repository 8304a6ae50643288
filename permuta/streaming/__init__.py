"""Ranking operators on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permuta.operators import model


def predict_stream(rows: DataFrame, models: dict[int, model.Layers]) -> DataFrame:
    """Predictions for a stream of (id, v): scoring keeps no state."""
    return model.predict(rows, models)


def windowed_sums(rows: DataFrame, time: str, width: str, late: str, weight: Column | None = None) -> DataFrame:
    """(window, item, num, den) of a stream of (time, item, pos): the sums a consensus is made of, per tumbling window.

    Rows later than ``late`` behind the newest are dropped; sums are additive, so state is one row per window and item.
    """
    w = F.lit(1) if weight is None else weight
    return rows.withWatermark(time, late).groupBy(F.window(time, width), "item").agg(F.sum(w * F.col("pos")).alias("num"), F.sum(w).alias("den"))


def consensus_of(sums: DataFrame) -> DataFrame:
    """(window, item, pos, mean): each window's consensus from its finished sums."""
    from pyspark.sql import Window

    mean = F.col("num") / F.col("den")
    return sums.withColumn("mean", mean).withColumn("pos", F.row_number().over(Window.partitionBy("window").orderBy("mean", "item")) - 1).select("window", "item", "pos", "mean")
