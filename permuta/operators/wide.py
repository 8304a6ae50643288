"""Sums of large arrays merged in a tree, and leading directions of very wide rows.

A matrix of rows x features is never squared to features x features. A thin random
matrix is multiplied by the rows and by their transpose again and again, each time one
pass in which a task adds up one thin matrix; the tasks' matrices meet in a tree, some
few at a time. At last the rows are taken to the thin basis, each task keeps the
triangle of its block's QR decomposition, and triangles are stacked and decomposed
again up the same tree: the last triangle holds all singular values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Arrays that meet in one step of a tree.
FAN = 16
#: Rows multiplied at once take about so many numbers.
CELLS = 1 << 22
#: The largest thin matrix that is sent to every task.
MOST_BYTES = 1 << 28


def add(arrays: list[np.ndarray]) -> np.ndarray:
    return np.sum(arrays, axis=0)


def triangle(arrays: list[np.ndarray]) -> np.ndarray:
    """The triangle of a QR decomposition of stacked triangles, as wide as they are."""
    side = int(round(np.sqrt(len(arrays[0]))))
    return square(np.linalg.qr(np.vstack([x.reshape(side, side) for x in arrays]), mode="r")).ravel()


def square(r: np.ndarray) -> np.ndarray:
    """A triangle of fewer rows than columns with rows of zeros below."""
    return np.vstack([r, np.zeros((r.shape[1] - len(r), r.shape[1]))]) if len(r) < r.shape[1] else r


def merged(parts: DataFrame, keys: list[str], combine: Callable[[list[np.ndarray]], np.ndarray] = add, fan: int = FAN) -> DataFrame:
    """Rows (keys.., slot int, data binary of doubles) -> one row per key, combined ``fan`` at a time.

    slot is the number of the task that made a row, with one row a task and key. A group
    holds ``fan`` arrays; arrays are never taken apart into cells.
    """
    kinds = ", ".join(f"{c} {parts.schema[c].dataType.simpleString()}" for c in keys)
    schema = f"{kinds + ', ' if keys else ''}slot int, data binary"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for at in range(0, len(pdf), fan):
            some = [np.frombuffer(x, np.float64) for x in pdf["data"].iloc[at : at + fan]]
            total = combine(some if total is None else [total, *some])
        return pdf.iloc[:1][[*keys, "slot"]].assign(data=[total.tobytes()])

    left = parts.rdd.getNumPartitions()
    while True:
        left = -(-left // fan)
        parts = parts.withColumn("slot", F.pmod("slot", F.lit(left)).cast("int")).groupBy(*keys, "slot").applyInPandas(run, schema)
        if left <= 1:
            return parts


def by_task(rows: DataFrame, columns: list[str], run: Callable[[Iterator[pd.DataFrame]], dict[tuple, np.ndarray]], keys: str = "") -> DataFrame:
    """One array per task and key: what ``run`` makes of the task's batches, as rows for merged(). keys: their schema."""
    names = [k.split()[0] for k in keys.split(", ")] if keys else []

    def all_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = run(b for b in batches if len(b))
        if found:
            out = pd.DataFrame([[*k, x.tobytes()] for k, x in found.items()], columns=[*names, "data"])
            yield out

    return rows.select(*columns).mapInPandas(all_, f"{keys + ', ' if keys else ''}data binary").withColumn("slot", F.spark_partition_id())


def blocks(batches: Iterator[pd.DataFrame], column: str = "x") -> Iterator[np.ndarray]:
    """Matrices of at most about CELLS numbers."""
    for pdf in batches:
        step = max(1, CELLS // max(1, len(pdf[column].iloc[0])))
        for at in range(0, len(pdf), step):
            yield np.stack(pdf[column].iloc[at : at + step].to_numpy())


@dataclass
class Subspace:
    """Means and deviations of the features, directions (features x k) of the standardised rows, their variances, and the number of rows."""

    mean: np.ndarray
    std: np.ndarray
    vectors: np.ndarray
    variances: np.ndarray
    rows: int


def column_moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, and mean and population deviation of every feature of wide rows (x array<double>)."""

    def run(batches):
        total = None
        for x in blocks(batches):
            part = np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])
            total = part if total is None else total + part
        return {} if total is None else {(): total}

    found = merged(by_task(rows, ["x"], run), []).collect()
    if not found:
        raise ValueError("no rows")
    data = np.frombuffer(found[0]["data"], np.float64)
    n, d = int(data[0]), (len(data) - 1) // 2
    mean = data[1 : 1 + d] / n
    return n, mean, np.sqrt(np.maximum(data[1 + d :] / n - mean * mean, 0))


def leading_subspace(rows: DataFrame, k: int, oversample: int = 10, passes: int = 4, seed: int = 0, standardise: bool = True) -> Subspace:
    """The k leading directions of rows (x array<double>) of any width, by a randomised range finder.

    Memory of a task and of the driver is features x (k + oversample). Each of ``passes``
    reads the rows once; more of them tell directions of near equal variance better apart.
    Constant features have no part in any direction.
    """
    n, mean, std = column_moments(rows)
    scale = np.where(std > 1e-12, std if standardise else 1.0, np.inf)
    width = min(k + oversample, len(mean), n)
    if len(mean) * width * 8 > MOST_BYTES:
        raise ValueError(f"{len(mean)} features x {width} directions are more than {MOST_BYTES} bytes")
    context = rows.sparkSession.sparkContext
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(mean), width)))[0]
    for _ in range(passes):
        sent = context.broadcast((mean, scale, basis))

        def there_and_back(batches, sent=sent):
            mean, scale, basis = sent.value
            total = None
            for x in blocks(batches):
                x = (x - mean) / scale
                part = x.T @ (x @ basis)
                total = part if total is None else total + part
            return {} if total is None else {(): total}

        found = merged(by_task(rows, ["x"], there_and_back), []).first()["data"]
        basis = np.linalg.qr(np.frombuffer(found, np.float64).reshape(len(mean), width))[0]
        sent.unpersist()
    sent = context.broadcast((mean, scale, basis))

    def triangles(batches):
        mean, scale, basis = sent.value
        total = None
        for x in blocks(batches):
            r = square(np.linalg.qr(((x - mean) / scale) @ basis, mode="r"))
            total = r.ravel() if total is None else triangle([total, r.ravel()])
        return {} if total is None else {(): total}

    r = np.frombuffer(merged(by_task(rows, ["x"], triangles), [], triangle).first()["data"], np.float64).reshape(width, width)
    _, s, turn = np.linalg.svd(r)
    vectors = (basis @ turn.T)[:, :k]
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1, 1)
    return Subspace(mean, np.where(std > 1e-12, std if standardise else 1.0, 0.0), vectors, (s**2 / n)[:k], n)


def moments(rows: DataFrame, by: str | None = None) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, sums and sums of products of wide rows (x array<double>) by class. A task keeps features x features numbers for each class it sees."""

    def run(batches):
        total: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, part in pdf.groupby(by) if by else [(0, pdf)]:
                for x in blocks(iter([part])):
                    new = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
                    at = (int(key),)
                    total[at] = total[at] + new if at in total else new
        return total

    found = {}
    for row in merged(by_task(rows, [*([by] if by else []), "x"], run, "k bigint"), ["k"]).collect():
        data = np.frombuffer(row["data"], np.float64)
        d = int(round((-1 + np.sqrt(1 + 4 * (len(data) - 1))) / 2))
        found[row["k"]] = int(data[0]), data[1 : 1 + d], data[1 + d :].reshape(d, d)
    return found
