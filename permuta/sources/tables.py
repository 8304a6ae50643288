"""A folder that all executors share, and the given tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below spark.checkpoint.dir; a temporary folder only where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """A table written once, to be broadcast if it turns out to have no more rows than that; else joins shuffle it."""
    made = materialize(df, "small")
    return F.broadcast(made) if made.count() <= most_rows else made


def row_numbers(rows: DataFrame, order: list[str], name: str, group: str | None = None) -> DataFrame:
    """rows and each one's place from 1 in ``order``, within its group if one is named, sorted in ranges.

    Ranges are numbered on their own; rows before a range come from the ranges' counts, a
    table of one row for each range and group. No task holds more than a range.
    """
    keys = [*([group] if group else []), "_part"]
    parts = materialize(rows.repartitionByRange(*keys[:-1], *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = parts.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys[:-1]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    placed = parts.withColumn(name, inside).alias("r").join(small(starts).alias("s"), same)
    return placed.select(*[F.col(f"r.{c}") for c in rows.columns], (F.col("s._before") + F.col(f"r.{name}")).alias(name))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage by writing a table and reading it again.

    Files hold repeated values packed, so their size says nothing about the rows' size in
    memory: joins sort and merge such a table unless they broadcast a side by name, as
    ``small`` does after counting.
    """
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")
