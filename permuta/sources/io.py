"""Readers and writers.

Text formats are read as Spark jobs over a directory, one task or more per file;
malformed lines are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import numbered_lines, pair_lines
from .tables import row_numbers, small

#: Columns of a result log, in order; fixed values of the file format.
RESULT_COLUMNS = ("timestamp", "dataset", "method", "subsample", "n_train", "n_test", "n_classes", "n_sims", "test_error_mean", "test_error_std", "test_error_min", "test_error_max", "test_error_stderr", "val_error_mean", "val_error_std", "time_mean", "config")
TEXT_COLUMNS = ("timestamp", "dataset", "method", "config")


def read_ballots(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, weight, items) of ballot files: a count n, n names, a summary, then lines ``count,c1,c2,...``.

    A file is read in splits; its count, on line 0, is joined with its lines by the file's
    name. Files without a count, and malformed lines, are skipped.
    """
    lines = numbered_lines(spark, path)
    counts = lines.where("line = 0").select("file", F.expr("try_cast(trim(value) as int)").alias("n")).where("n is not null")
    rows = lines.join(small(counts), "file").where("line >= n + 2")
    fields = rows.select("file", "line", F.expr("transform(split(trim(value), ','), x -> try_cast(trim(x) as int))").alias("f"))
    good = fields.where((F.size("f") > 1) & ~F.exists("f", lambda x: x.isNull()))
    items = F.filter(F.slice("f", 2, F.size("f") - 1), lambda x: x > 0)
    return good.select("file", "line", F.col("f")[0].alias("weight"), items.alias("items")).where(F.size("items") > 0)


def read_orders(spark: SparkSession, path: str, length: int = 10) -> DataFrame:
    """(value, items): the last ``length`` tokens of every line that is not blank and no comment."""
    lines = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')")
    return lines.select("value", F.transform(F.slice(F.split("value", r"\s+"), -length, length), lambda x: x.cast("int")).alias("items"))


def attach_attributes(rankings: DataFrame, attributes: DataFrame, key: str, value: str, below: int) -> DataFrame:
    """Rankings with label 0 where the attribute is less than ``below``, else 1; rows without a partner go."""
    return rankings.join(attributes, key).withColumn("label", F.when(F.col(value) < below, 0).otherwise(1))


def attach_by_line(spark: SparkSession, orders: str, attributes: str, field: int, below: int, length: int = 10) -> DataFrame:
    """(line, items, label) of two text files whose lines belong together by their numbers, as many as the shorter has.

    Blank lines and comments don't count. items are the last ``length`` tokens of a line
    of the one, label is 0 where token ``field`` of the other's is less than ``below``,
    else 1; lines with fewer tokens than either needs don't count either.
    """
    tokens = F.split(F.trim("value"), r"\s+")
    whole = (F.trim("value") != "") & ~F.startswith(F.trim("value"), F.lit("#"))
    one = numbered_lines(spark, orders, whole & (F.size(tokens) >= length), across=True)
    two = numbered_lines(spark, attributes, whole & (F.size(tokens) > field), across=True)
    both = pair_lines(one, two)
    last = F.slice(F.split(F.trim("first"), r"\s+"), -length, length)
    value = F.split(F.trim("second"), r"\s+")[field].cast("int")
    return both.select("line", F.transform(last, lambda x: x.cast("int")).alias("items"), F.when(value < below, 0).otherwise(1).alias("label"))


def read_features(spark: SparkSession, data: str, labels: str, key: str, label: str) -> DataFrame:
    """(key, x array<double>, label_code) of two CSV files with headers: key and features, key and class name.

    Features stand in the order of the file's columns; what isn't a number is null. Rows
    without a partner go.
    """
    rows, names = (spark.read.option("header", True).csv(p) for p in (data, labels))
    wide = rows.select(key, F.array(*[F.expr(f"try_cast(`{c}` as double)") for c in rows.columns if c != key]).alias("x"))
    return load_features(wide, names.select(key, label), key, label)


def load_features(features: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Features with their labels as numbers in sorted order of the labels."""
    return features.join(label_encode(labels, label).select(key, F.col("code").alias("label_code")), key)


def label_encode(rows: DataFrame, label: str) -> DataFrame:
    """rows and code: the label's place among the distinct labels, from 0."""
    codes = rows.select(label).where(F.col(label).isNotNull()).distinct()
    codes = row_numbers(codes, [label], "_k").select(label, (F.col("_k") - 1).cast("int").alias("code"))
    return rows.join(small(codes), label)


def bin_label(value, first: float = 5, second: float = 6):
    """0 up to ``first``, 1 up to ``second``, else 2."""
    return F.when(value <= first, 0).when(value <= second, 1).otherwise(2)


def append_results(rows: DataFrame, path: str) -> None:
    """Append the fixed columns as CSV; others are dropped, missing ones blank."""
    cols = [F.col(c).cast("string").alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in RESULT_COLUMNS]
    rows.select(*cols).write.mode("append").option("header", True).csv(path)


def read_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All result logs, whatever their columns: numbers cast, the file's name added."""
    out = None
    for path in paths:
        part = spark.read.option("header", True).csv(path)
        part = part.select(*[F.col(c) if c in TEXT_COLUMNS else F.expr(f"try_cast(`{c}` as double)").alias(c) for c in part.columns], F.input_file_name().alias("file"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
