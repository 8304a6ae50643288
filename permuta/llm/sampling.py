"""Bounded samples of labelled rows, the only data that is ever brought to the driver for fitting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Longest text in a sample, and all its texts together, where a caller names no other bounds.
TEXT_BYTES = 1 << 20
TOTAL_BYTES = 1 << 26


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int, by_class: bool = False, text_bytes: int = TEXT_BYTES, total_bytes: int = TOTAL_BYTES) -> pd.DataFrame:
    """(doc_id, text, label) of at most ``most`` training documents, those first in the order of a hash of doc_id.

    Of several labels of one document the largest counts, of several texts the shortest,
    the first by its hash among equals. Texts of more than ``text_bytes`` are left out, and what
    exceeds ``total_bytes`` in hash order. With by_class a class has up to half of the
    sample, more where the other has less, and a column, weight, is how many labels of its
    class a row stands for. A table without labels gives no rows.

    Lengths are chosen first: the order and both bounds are settled on at most ``most``
    rows of numbers, and only the texts that stay, at most ``total_bytes``, are read.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    hashed = F.md5(F.col("doc_id").cast("string").cast("binary"))
    first = lambda rows, n: rows.orderBy(hashed, "doc_id").limit(n)
    if by_class:
        sizes = {r["yes"]: r["count"] for r in known.groupBy((F.col("label") > 0).alias("yes")).count().collect()}
        total, other = sizes.get(True, 0), sizes.get(False, 0)
        yes = min(total, max(most // 2, most - other))
        no = min(other, most - yes)
        chosen = first(known.where("label > 0"), yes).withColumn("weight", F.lit(total / max(1, yes))).unionByName(first(known.where("label <= 0"), no).withColumn("weight", F.lit(other / max(1, no))))
    else:
        chosen = first(known, most)
    named = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lengths = named.select("doc_id", F.struct(F.octet_length("text").alias("n"), F.xxhash64("text").alias("th")).alias("of")).join(F.broadcast(chosen), "doc_id")
    rows = lengths.groupBy(chosen.columns).agg(F.min("of").alias("of")).select(*chosen.columns, "of.n", "of.th", hashed.alias("order")).toPandas()
    rows = rows[rows["n"] <= text_bytes].sort_values(["order", "doc_id"])
    rows = rows[rows["n"].cumsum() <= total_bytes].reset_index(drop=True)
    if rows.empty:
        return rows.assign(text=pd.Series(dtype=object))[["doc_id", "text", *chosen.columns[1:]]]
    wanted = docs.sparkSession.createDataFrame(rows[["doc_id", "th"]], "doc_id long, th long")
    texts = named.withColumn("th", F.xxhash64("text")).join(F.broadcast(wanted), ["doc_id", "th"], "left_semi")
    texts = texts.groupBy("doc_id", "th").agg(F.min("text").alias("text")).toPandas()
    return rows.merge(texts, on=["doc_id", "th"])[["doc_id", "text", *chosen.columns[1:]]].sort_values("doc_id").reset_index(drop=True)
