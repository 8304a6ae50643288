"""The feature pipeline: what is fitted is one distributed aggregate, what is applied a join or a map.

Features are long (id, feature, x) or wide (id, x array<double>).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from permuta.functions.rankings import hash_normal, hash_uniform
from permuta.sources.tables import row_numbers, small

from .wide import MOST_BYTES, column_moments, leading_subspace, moments

PLACES = 9
#: Features up to which matrices of features x features are made: 128 MB each.
EXACT = 4096


def to_long(wide: DataFrame, key: str = "id", values: str = "x") -> DataFrame:
    return wide.select(key, F.posexplode(values).alias("feature", "x"))


def to_wide(long: DataFrame, key: str = "id") -> DataFrame:
    return long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "x"))), lambda s: s["x"]).alias("x"))


def fit_scaler(train: DataFrame) -> DataFrame:
    """(feature, mean, std) with the population deviation, in one pass."""
    return train.groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def standardize(rows: DataFrame, scaler: DataFrame) -> DataFrame:
    """Long features less their mean over their deviation; a constant feature is 0."""
    z = F.when(F.col("std") > 1e-12, (F.col("x") - F.col("mean")) / F.col("std")).otherwise(0.0)
    return rows.join(small(scaler), "feature").select("id", "feature", F.round(z, PLACES).alias("x"))


def column_rank(rows: DataFrame) -> DataFrame:
    """(id, feature, r): average-tie rank of a value within its column over the row count.

    Rows are numbered in ranges of values; a value's rank is the mean of its first and last
    number, so no task sorts a column.
    """
    placed = row_numbers(rows.select("feature", "x"), ["x"], "_k", "feature")
    values = placed.groupBy("feature", "x").agg(((F.min("_k") + F.max("_k")) / F.lit(2.0)).alias("_mean"))
    whole = rows.groupBy("feature").agg(F.count("*").alias("_all"))
    ranks = values.join(small(whole), "feature").select("feature", "x", (F.col("_mean") / F.col("_all")).alias("r"))
    return rows.join(ranks, ["feature", "x"]).select("id", "feature", "r")


def row_rank(rows: DataFrame) -> DataFrame:
    """(id, feature, pos): place of a value within its row, the largest first."""
    return rows.select("id", "feature", (F.row_number().over(Window.partitionBy("id").orderBy(F.col("x").desc(), "feature")) - 1).alias("pos"))


def poly_expand(x: Column, degree: int) -> Column:
    """All monomials of the values up to ``degree``, without the constant: lower degrees first, each in order of its factors."""
    ones = F.transform(x, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    terms, parts = ones, [x]
    for _ in range(degree - 1):
        more = lambda t: F.transform(F.slice(ones, t["i"] + 1, F.size(x)), lambda s: F.struct((t["v"] * s["v"]).alias("v"), s["i"].alias("i")))
        terms = F.flatten(F.transform(terms, more))
        parts.append(F.transform(terms, lambda t: t["v"]))
    return F.concat(*parts)


def diff_expand(x: Column) -> Column:
    """The values and their differences with the values 1 .. D/2 places before, in a circle."""
    n = F.size(x)
    rolled = lambda s: F.zip_with(x, F.concat(F.slice(x, n - s + 1, s), F.slice(x, F.lit(1), n - s)), lambda a, b: a - b)
    return F.concat(x, F.flatten(F.transform(F.sequence(F.lit(1), F.floor(n / 2).cast("int")), rolled)))


def projection(spark, features: int, dims: int, seed: int, views: int = 1) -> DataFrame:
    """(view, feature, dim, w): Gaussian weights from a hash of seed, view, feature and dimension."""
    grid = spark.range(views * features * dims).select((F.col("id") % dims).cast("int").alias("dim"), (F.floor(F.col("id") / dims) % features).cast("int").alias("feature"), F.floor(F.col("id") / (dims * features)).cast("int").alias("view"))
    return grid.select("view", "feature", "dim", hash_normal(seed, F.col("view"), F.col("feature"), F.col("dim")).alias("w"))


def project(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, view, dim, z): rows times weights; the weights are a table of features x dimensions."""
    z = F.round(F.sum(F.col("x") * F.col("w")), 6)
    return rows.join(small(weights), "feature").groupBy("id", "view", "dim").agg(z.alias("z"))


def order_by(projected: DataFrame) -> DataFrame:
    """(id, view, item, pos): dimensions of each row in ascending order of z."""
    order = Window.partitionBy("id", "view").orderBy("z", "dim")
    return projected.select("id", "view", F.col("dim").alias("item"), (F.row_number().over(order) - 1).alias("pos"))


def calibrate(projected: DataFrame) -> DataFrame:
    """Projected columns standardised once more."""
    stats = projected.groupBy("view", "dim").agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s"))
    return projected.join(small(stats), ["view", "dim"]).select("id", "view", "dim", F.round(F.when(F.col("s") > 1e-12, (F.col("z") - F.col("m")) / F.col("s")).otherwise(0.0), 5).alias("z"))


def discriminants(found: dict, dims: int, ratio: float):
    """Columns that separate the classes of moments {class: (count, sums, sums of products)}, and the scatter of all rows over their number."""
    n, total = sum(v[0] for v in found.values()), sum(v[1] for v in found.values())
    mean = total / n
    between = sum(v[0] * np.outer(v[1] / v[0] - mean, v[1] / v[0] - mean) for v in found.values())
    whole = sum(v[2] for v in found.values()) - n * np.outer(mean, mean)
    within = whole - between + 1e-6 * np.eye(len(mean))
    k = max(1, min(int(dims * ratio), len(found) - 1, len(mean), dims))
    value, vector = np.linalg.eig(np.linalg.solve(within, between))
    return vector[:, np.argsort(-value.real)[:k]].real, whole / n


def target_aware_projection(rows: DataFrame, label: str, dims: int, ratio: float, seed: int, features: int | None = None, subspace: int = 64):
    """Weights (features x dims) of discriminant and random columns, each block over its deviation.

    Up to EXACT features the scatter matrices are one distributed aggregate, whose
    eigenvectors the driver takes. Wider rows are first taken to their ``subspace``
    leading directions, found without a matrix of features x features; discriminants are
    those of that subspace.
    """
    wide = features or len(rows.select("x").first()["x"])
    rng = np.random.default_rng(seed)
    if wide <= EXACT:
        chosen, scatter = discriminants(moments(rows, label), dims, ratio)
        w = np.hstack([chosen, rng.normal(size=(wide, dims - chosen.shape[1]))])
        variances = np.einsum("id,ij,jd->d", w, scatter, w)
    else:
        space = leading_subspace(rows, subspace, seed=seed, standardise=False)
        inside = apply_weights(rows, space.mean, space.vectors, [label]).withColumnRenamed("z", "x")
        chosen = space.vectors @ discriminants(moments(inside, label), dims, ratio)[0]
        w = np.hstack([chosen, rng.normal(size=(wide, dims - chosen.shape[1]))])
        variances = column_moments(apply_weights(rows, space.mean, w).withColumnRenamed("z", "x"))[2] ** 2
    k = chosen.shape[1]
    w[:, :k] /= np.sqrt(max(variances[:k].mean(), 1e-12))
    if dims > k:
        w[:, k:] /= np.sqrt(max(variances[k:].mean(), 1e-12))
    return w


def pca_whiten(rows: DataFrame, k: int, features: int | None = None, seed: int = 0):
    """(mean, weights) of the first k principal components of standardised features, each of unit variance.

    Up to EXACT features from their exact covariance, wider ones by a randomised range
    finder of several passes.
    """
    if (features or len(rows.select("x").first()["x"])) > EXACT:
        found = leading_subspace(rows, k, passes=6, seed=seed)
        std = np.where(found.std > 0, found.std, np.inf)
        return found.mean, found.vectors / std[:, None] / np.sqrt(np.maximum(found.variances, 1e-12))
    n, s, q = moments(rows)[0]
    mean = s / n
    cov = q / n - np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    value, vector = np.linalg.eigh(cov / std[:, None] / std[None, :])
    top = np.argsort(-value)[:k]
    return mean, vector[:, top] / std[:, None] / np.sqrt(np.maximum(value[top], 1e-12))


def apply_weights(rows: DataFrame, mean, weights, keep: list[str] = ()) -> DataFrame:
    """(id, keep.., z array<double>) of wide rows, in batches; weights are sent to every task once."""
    import pandas as pd

    if weights.nbytes > MOST_BYTES:
        raise ValueError(f"weights of {weights.nbytes} bytes are too large to send to every task")
    sent = rows.sparkSession.sparkContext.broadcast((mean, weights))
    kept = ["id", *keep]

    def run(batches):
        mean, weights = sent.value
        for pdf in batches:
            if len(pdf):
                z = (np.stack(pdf["x"].to_numpy()) - mean) @ weights
                yield pdf[kept].assign(z=list(z)) if keep else pd.DataFrame({"id": pdf["id"], "z": list(z)})

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*kept, "x").mapInPandas(run, f"{kinds}, z array<double>")


def top_features(rows: DataFrame, labels: DataFrame, k: int, bins: int = 4) -> DataFrame:
    """(feature, mi): the k features with most mutual information between equal-count bins and the label."""
    placed = column_rank(rows).select("id", "feature", F.least(F.lit(bins - 1), F.floor(F.col("r") * bins)).cast("int").alias("bin"))
    cells = placed.join(labels, "id").groupBy("feature", "bin", "label").agg(F.count("*").alias("n"))
    whole, by_bin, by_label = Window.partitionBy("feature"), Window.partitionBy("feature", "bin"), Window.partitionBy("feature", "label")
    n, a, b, t = F.col("n"), F.sum("n").over(by_bin), F.sum("n").over(by_label), F.sum("n").over(whole)
    cells = cells.select("feature", (n / t * F.log((n * t) / (a * b))).alias("part"))
    return cells.groupBy("feature").agg(F.round(F.sum("part"), 9).alias("mi")).orderBy(F.col("mi").desc(), "feature").limit(k)


WORD = "abcdefghijklmnopqrstuvwxyz0123456789_"


def tokens(docs: DataFrame, letters: str = WORD, least: int = 2) -> DataFrame:
    """(doc_id, word, tf): runs of at least so many ASCII letters in lower-case text; a doc_id of several rows has each row's counts.

    Counted where the rows are, so nothing is shuffled; bow_counts sums what belongs together.
    """
    return _counted(docs, letters, least, ["doc_id"])


def word_counts(docs: DataFrame, letters: str = WORD, least: int = 2) -> DataFrame:
    """(word, tf): the words of tokens, counted in batches of documents; a word has a row for each batch that holds it."""
    return _counted(docs, letters, least, [])


def _counted(docs: DataFrame, letters: str, least: int, keep: list[str]) -> DataFrame:
    inside = np.zeros(0x100, bool)
    inside[list(letters.encode("ascii"))] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(i, 2000) for x in batches for i in range(0, x.num_rows, 2000)):
            doc, words = words_of(batch.column(batch.num_columns - 1), inside, least)
            names, codes = words.dictionary.cast(pa.string()), words.indices.to_numpy()
            many = max(1, len(names))
            cells, tf = np.unique(doc * many + codes if keep else codes, return_counts=True)
            kept = [batch.column(i).take(pa.array(cells // many)) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, names.take(pa.array(cells % many)), pa.array(tf, pa.int64())], names=[*keep, "word", "tf"])

    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInArrow(run, f"{kinds}word string, tf bigint")


def words_of(texts: pa.Array, inside: np.ndarray, least: int) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Of every run of at least so many bytes that are ``inside``, in order: its text's number and the word itself. No run goes on into the next text."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    is_word = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = is_word[1:] != is_word[:-1]
    edge[ends] = True
    cuts = np.flatnonzero(edge)
    taken = is_word[cuts[:-1]] & (np.diff(cuts) >= least)
    runs = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])
    doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(cuts, ends)))
    return doc[taken], runs.filter(pa.array(taken)).dictionary_encode()


def vocabulary(counts: DataFrame, size: int) -> DataFrame:
    """(word, total, word_id): the most frequent words, by name among equals; ids in alphabetical order. counts: word, tf."""
    top = counts.groupBy("word").agg(F.sum("tf").alias("total")).orderBy(F.col("total").desc(), "word").limit(size)
    return top.withColumn("word_id", (F.row_number().over(Window.orderBy("word")) - 1).cast("int"))


def bow_counts(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, word_id, tf), dealt by doc_id: the words that the vocabulary knows."""
    known = counts.join(small(vocab.select("word", "word_id")), "word").select("doc_id", "word_id", "tf")
    return known.repartition("doc_id").groupBy("doc_id", "word_id").agg(F.sum("tf").alias("tf"))


def bow_rank(bow: DataFrame, seed: int) -> DataFrame:
    """(doc_id, item, pos): words by count, ties by hash."""
    order = Window.partitionBy("doc_id").orderBy(F.col("tf").desc(), hash_uniform(seed, F.col("doc_id"), F.col("word_id")), "word_id")
    return bow.select("doc_id", F.col("word_id").alias("item"), (F.row_number().over(order) - 1).alias("pos"))


def bow_presence(bow: DataFrame, length: int = 64) -> DataFrame:
    """(doc_id, items): the first word ids present, ascending, filled up with zeros; ids count from 1."""
    items = F.slice(F.array_sort(F.collect_set(F.col("word_id") + 1)), 1, length)
    return bow.groupBy("doc_id").agg(items.alias("items")).select("doc_id", F.concat("items", F.array_repeat(F.lit(0), length - F.size("items"))).alias("items"))


def tfidf(bow: DataFrame, n: int) -> DataFrame:
    """(doc_id, word_id, w): tf * (ln((1 + n) / (1 + df)) + 1), each document of unit length."""
    df = bow.groupBy("word_id").agg(F.count("*").alias("df"))
    raw = bow.join(small(df), "word_id").withColumn("w", F.col("tf") * (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return raw.select("doc_id", "word_id", F.round(F.col("w") / norm, PLACES).alias("w"))


def word_frequency(counts: DataFrame) -> DataFrame:
    total = counts.agg(F.sum("tf").alias("all"))
    return counts.groupBy("word").agg(F.sum("tf").alias("n")).join(F.broadcast(total)).select("word", (F.col("n") / F.col("all")).alias("share"))


def tokenize_ids(docs: DataFrame, size: int, length: int) -> DataFrame:
    """(doc_id, ids): white-space tokens as ids by frequency (2 and up), 1 for unknown ones, 0 as filling."""
    words = docs.select("doc_id", F.posexplode(F.filter(F.split("text", "[ \t\n]+"), lambda x: x != "")).alias("at", "word"))
    top = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(size)
    ids = top.select("word", (F.row_number().over(Window.orderBy(F.col("n").desc(), "word")) + 1).alias("word_id"))
    known = words.where(F.col("at") < length).join(small(ids), "word", "left").select("doc_id", "at", F.coalesce("word_id", F.lit(1)).alias("i"))
    seq = F.transform(F.array_sort(F.collect_list(F.struct("at", "i"))), lambda s: s["i"])
    return known.groupBy("doc_id").agg(seq.alias("ids")).select("doc_id", F.concat("ids", F.array_repeat(F.lit(0), length - F.size("ids"))).alias("ids"))


#: Of each setting the value of the first condition that holds.
SETTINGS = {
    "degree": (("n_features <= 10", "3"), ("n_features <= 30", "2"), ("true", "1")),
    "embed_dim": (("n_features <= 15", "16"), ("n_classes >= 4 and n_features > 30", "64"), ("n_features <= 64", "32"), ("true", "64")),
    "iterations": (("true", "cast(least(300, greatest(200, floor(n_samples / 3))) as int)"),),
    "strategy": (("n_classes >= 3", "'diverse'"), ("true", "'random'")),
    "augmentations": (("n_features <= 30 and n_samples >= 150", "1"), ("true", "0")),
    "views": (("n_samples < 2000 and n_classes <= 26", "7"), ("true", "1")),
}


def recommend_sql() -> dict[str, str]:
    """The table as SQL expressions, for Spark and other engines alike."""
    return {name: "case " + " ".join(f"when {condition} then {value}" for condition, value in rules) + " end" for name, rules in SETTINGS.items()}


def recommend_config(profile: DataFrame) -> DataFrame:
    """Settings for each (n_features, n_classes, n_samples)."""
    return profile.select("*", *[F.expr(sql).alias(name) for name, sql in recommend_sql().items()])
