"""Mixing sources to target weights by word budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, materialize, named, plain, shuffle_parts

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3


def word_count(text: Column) -> Column:
    """Number of runs of bytes other than space and 0x09-0x0D; null has 0."""

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([len(x.split()) if x else 0 for x in texts.to_pylist()], pa.int64())

    return count(text.cast("binary"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> also target, for one row per source.

    The total is shared by weight; no target exceeds ``most`` times its source and the
    excess is reshared by weight. Ordered by most * size / weight the capped sources are
    a prefix, so running sums over the source table give the answer without iteration.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("_w", F.element_at(cycle, ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("_cap", (F.col("source_size") * most).cast("double")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order, everything = Window.orderBy("_ratio", F.col("source").asc_nulls_last()), Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight_left = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    levels = weighed.withColumn("_level", left / weight_left).withColumn("_open", F.col("_level") <= F.col("_ratio"))
    level = F.min(F.when(F.col("_open"), F.struct("_ratio", F.col("source").isNull(), "source", "_level"))).over(everything)["_level"]
    return levels.withColumn("target", F.least(F.col("_cap"), F.coalesce(level * F.col("_w"), F.col("_cap")))).drop("_w", "_cap", "_ratio", "_level", "_open")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 0) -> DataFrame:
    """docs (doc_id, source, size) -> also source_size, target, taken.

    Every document of a source gets the source's whole epochs. The rest of the budget
    goes to documents in the order of a hash of seed and doc_id, whose prefix sums are
    taken inside ranges of that hash and added to the ranges' own prefix sums; the
    document at the budget's end is cut there. Rows that repeat a doc_id stand beside
    each other in that order; a null doc_id hashes as the empty text and a null source
    is a source of its own, the last. Sizes of 0 take 0.
    """
    spark = docs.sparkSession
    ranges = max(16, 4 * shuffle_parts(spark))
    names = {c: n for c, n in zip(("_key", "_range", "_own"), fresh(docs.columns, "key", "range", "own"), strict=True)}
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    keyed = docs.withColumn(names["_key"], key).withColumn(names["_range"], F.floor(F.conv(F.substring(names["_key"], 1, 8), 16, 10).cast("bigint") * ranges / F.lit(1 << 32)).cast("int"))
    keyed = materialize(keyed, "mixing")
    per_range = materialize(keyed.groupBy("source", F.col(names["_range"]).alias("_range")).agg(F.sum("size").alias("_sum")), "mixing-ranges")
    per_source = targets(per_range.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, most)
    per_source = per_source.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint"))
    per_source = per_source.withColumn("_rest", F.floor(F.col("target")).cast("bigint") - F.col("_epochs") * F.col("source_size"))
    inside = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.withColumn("_before", F.coalesce(F.sum("_sum").over(inside), F.lit(0))).alias("r")
    joined = starts.join(per_source.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    starts = materialize(joined.select("r.source", "r._range", "r._before", "s.source_size", "s.target", "s._epochs", "s._rest"), "mixing-starts")
    run = Window.partitionBy("source", names["_range"]).orderBy(names["_key"], "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn(names["_own"], F.coalesce(F.sum("size").over(run), F.lit(0))).alias("d")
    both = placed.join(starts.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col(f"d.{names['_range']}") == F.col("r._range")))
    part = F.greatest(F.lit(0), F.least(F.col("d.size"), F.col("r._rest") - F.col("r._before") - F.col(f"d.{names['_own']}")))
    taken = F.col("r._epochs") * F.col("d.size") + part
    return both.select(*[F.col(f"d.`{c}`") for c in docs.columns], "r.source_size", "r.target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 0) -> DataFrame:
    """The mix itself: each document as often as it is taken whole, and once more cut where the budget ends.

    Documents without words, null or empty, take nothing and go. Other columns stay as they
    are, whatever their names. Rows that are the same in every column, maps compared as
    JSON, are one row that takes what all of them take.
    """
    row, size, total, end = fresh(docs.columns, "row", "size", "total", "end")
    # Maps have no hash of their own. Two hashes with different beginnings make 128 bits.
    alike = [F.to_json(F.struct(named([c])[0])) if "map<" in kind or "variant" in kind else named([c])[0] for c, kind in docs.dtypes]
    key = F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("source", F.lit("")), F.xxhash64(*alike), F.xxhash64(F.lit("row"), *alike)).alias(row)
    taken = mix_sources(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key), weights, most, seed)
    taken = taken.groupBy(row, F.col("size").alias(size)).agg(F.sum("taken").alias(total)).where(F.col(total) > 0)
    rows = docs.select("*", key).dropDuplicates([row]).join(taken, row)
    whole = F.floor(F.col(total) / F.col(size))
    rest = F.col(total) - whole * F.col(size)
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First words of a text, up to the end of the last of them."""
        import re

        for batch in batches:
            at, keep = batch.schema.get_field_index("text"), batch.column(batch.num_columns - 1).to_pylist()
            texts = []
            for x, n in zip(batch.column(at).to_pylist(), keep, strict=True):
                if n is not None:
                    found = re.finditer(r"[^\x20\x09-\x0D]+", x)
                    end = 0
                    for _ in range(n):
                        end = next(found).end()
                    x = x[:end]
                texts.append(x)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    copies = rows.withColumn(end, F.explode(F.concat(F.array_repeat(F.lit(None).cast("bigint"), whole.cast("int")), F.when(rest > 0, F.array(rest.cast("bigint"))).otherwise(F.array().cast("array<bigint>")))))
    out = plain(copies.select(*named(names), end)).mapInArrow(cut, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
