"""Numbers of lines in text files, without a task that reads a whole file.

A file is read in splits, as many tasks as it has. Lines of a split are counted where
they are read; a table of one row for each split gives what stands before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import materialize, small


def numbered_lines(spark: SparkSession, path: str | list[str], keep: Column | None = None, across: bool = False) -> DataFrame:
    """(file, line, value): every line, or every line for which ``keep`` (of value) holds, and its number from 0 in its file.

    With ``across`` lines are counted through all files, in order of their paths. Empty
    lines are lines; empty files have none. The files must not change meanwhile: they are
    read once to count and once for the lines.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"))
    if keep is not None:
        read = read.where(F.coalesce(keep, F.lit(False)))
    # Lines of one split are read one after the other, so the task's counter runs through them.
    read = read.withColumn("_at", F.monotonically_increasing_id())
    splits = materialize(read.groupBy("file", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")), "splits")
    inside = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    if across:
        files = splits.groupBy("file").agg(F.sum("_n").alias("_lines"))
        through = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        files = files.select("file", F.coalesce(F.sum("_lines").over(through), F.lit(0)).alias("_files"))
        starts = starts.join(small(files), "file").withColumn("_before", F.col("_before") + F.col("_files"))
    starts = starts.select("file", "_start", (F.col("_before") - F.col("_first")).alias("_shift"))
    return read.join(small(starts), ["file", "_start"]).select("file", (F.col("_at") + F.col("_shift")).alias("line"), "value")


def pair_lines(first: DataFrame, second: DataFrame) -> DataFrame:
    """(line, first, second) of two tables (line, value): lines of one number, as many as the shorter has."""
    return first.select("line", F.col("value").alias("first")).join(second.select("line", F.col("value").alias("second")), "line")
