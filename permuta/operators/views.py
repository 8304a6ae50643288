"""Views of wide rows: several affine maps, fitted from one pass of moments and applied as one matrix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .features import EXACT, discriminants, target_aware_projection
from .knn import matrix
from .wide import MOST_BYTES, column_moments, moments

#: Strategies that an ensemble takes in turn; fixed values.
DIVERSE = ("target_aware", "random", "calibrated")
PLACES = 6


@dataclass
class View:
    """A row's values in a view are x @ weights - shift, (features x dims) and (dims)."""

    kind: str
    seed: int
    weights: np.ndarray
    shift: np.ndarray

    def stacked(self) -> np.ndarray:
        """weights with -shift as a last row, for rows that end in a 1."""
        return np.vstack([self.weights, -self.shift])


def gaussian(features: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(features, dims))


def fit_views(rows: DataFrame, label: str, count: int, dims: int, seed: int = 0, kinds: tuple[str, ...] = DIVERSE, ratio: float = 0.5) -> list[View]:
    """``count`` views of rows (x array<double>, label), of ``kinds`` in turn.

    random: Gaussian columns of the standardised row. calibrated: the same, each column
    standardised again. target_aware: discriminants beside Gaussian columns, each block
    over its deviation. Scaler, calibration and discriminants of all views come from one
    pass, the moments of the classes; only rows of more than EXACT features, for which no
    matrix of features x features is made, are read once more for each fitted view.
    """
    wide = len(rows.select("x").first()["x"])
    if wide <= EXACT:
        found = moments(rows, label)
        n = sum(v[0] for v in found.values())
        mean = sum(v[1] for v in found.values()) / n
        cov = sum(v[2] for v in found.values()) / n - np.outer(mean, mean)
        std = np.sqrt(np.maximum(np.diag(cov), 0))
    else:
        _, mean, std = column_moments(rows)
    scale = np.where(std > 1e-12, std, np.inf)
    out = []
    for v in range(count):
        kind, own = kinds[v % len(kinds)], seed + v
        if kind not in DIVERSE:
            raise ValueError(f"no view strategy {kind}")
        weights = gaussian(wide, dims, own) / scale[:, None]
        if kind == "calibrated":
            spread = np.sqrt(np.maximum(np.einsum("id,ij,jd->d", weights, cov, weights), 0)) if wide <= EXACT else column_moments(affine(rows, weights))[2]
            weights = weights / np.where(spread > 1e-12, spread, np.inf)
        elif kind == "target_aware" and wide <= EXACT:
            z = {k: scaled(m, mean, scale) for k, m in found.items()}
            chosen, scatter = discriminants(z, dims, ratio)
            w = np.hstack([chosen, gaussian(wide, dims - chosen.shape[1], own)])
            sizes = np.einsum("id,ij,jd->d", w, scatter, w)
            for block in (slice(0, chosen.shape[1]), slice(chosen.shape[1], dims)):
                if sizes[block].size:
                    w[:, block] /= np.sqrt(max(sizes[block].mean(), 1e-12))
            weights = w / scale[:, None]
        elif kind == "target_aware":
            weights = target_aware_projection(rows, label, dims, ratio, own, wide)
        out.append(View(kind, own, weights, mean @ weights))
    return out


def scaled(found: tuple[int, np.ndarray, np.ndarray], mean: np.ndarray, scale: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Moments of a class's rows as they are after standardising."""
    n, s, q = found
    s2 = (s - n * mean) / scale
    q2 = (q - np.outer(s, mean) - np.outer(mean, s) + n * np.outer(mean, mean)) / np.outer(scale, scale)
    return n, s2, q2


def affine(rows: DataFrame, weights: np.ndarray, shift: np.ndarray | None = None) -> DataFrame:
    """(x array<double>) of wide rows times weights, less shift."""
    sent = rows.sparkSession.sparkContext.broadcast((weights, np.zeros(weights.shape[1]) if shift is None else shift))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, shift = sent.value
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([arrays(matrix(batch.column(0)) @ weights - shift)], names=["x"])

    return rows.select("x").mapInArrow(run, "x array<double>")


def arrays(x: np.ndarray) -> pa.Array:
    """A matrix's rows as an Arrow column of arrays."""
    x = np.ascontiguousarray(x)
    values = pa.array(x.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)), values)


def in_views(rows: DataFrame, views: list[View] | list[np.ndarray], keep: list[str] = (), ranked: bool = True) -> DataFrame:
    """(id, keep.., view, z, pos) of wide rows (id, x array<double>): values in every view, and with ``ranked`` each dimension's place in their ascending order, ties to the lower.

    All views are one matrix and one map over batches: no row is exploded or shuffled.
    """
    stacked = [v.stacked() if isinstance(v, View) else np.vstack([v, np.zeros((1, v.shape[1]))]) for v in views]
    whole = np.hstack(stacked)
    if whole.nbytes > MOST_BYTES:
        raise ValueError(f"views of {whole.nbytes} bytes are too large to send to every task")
    cuts = np.cumsum([0, *(w.shape[1] for w in stacked)])
    sent = rows.sparkSession.sparkContext.broadcast(whole)
    kept = ["id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            z = np.round(matrix(batch.column(len(kept))) @ whole[:-1] + whole[-1], PLACES)
            for v, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                part = z[:, a:b]
                place = [arrays(np.argsort(np.argsort(part, axis=1, kind="stable"), axis=1, kind="stable").astype(np.int32))] if ranked else []
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(np.full(len(part), v, np.int32)), arrays(part), *place], names=[*kept, "view", "z", *(["pos"] if ranked else [])])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*kept, "x").mapInArrow(run, f"{kinds}, view int, z array<double>" + (", pos array<int>" if ranked else ""))
