"""Leading directions of wide rows against dense solvers."""

import numpy as np
import pytest

from permuta.operators import features, wide


def frame(spark, x, labels=None):
    rows = [(i, v.tolist(), int(labels[i]) if labels is not None else 0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x array<double>, label int").repartition(5)


def low_rank(n, d, k, seed=0):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, k)) * np.array([9.0 - i for i in range(k)])) @ rng.normal(size=(k, d)) + 0.5 * rng.normal(size=(n, d)) + rng.normal(size=d)
    x[:, 7] = 3.0
    return x


def test_range_finder_agrees_with_the_dense_solver_at_twenty_thousand_features(spark):
    x = low_rank(160, 20_000, 4)
    found = wide.leading_subspace(frame(spark, x), 4)
    std = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(std > 1e-12, std, np.inf)
    _, s, v = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(found.variances, s[:4] ** 2 / 160, rtol=1e-6)
    angles = np.linalg.svd(found.vectors.T @ v[:4].T)[1]
    assert found.vectors.shape == (20_000, 4) and angles.min() > 1 - 1e-6
    assert abs(found.vectors[7]).max() < 1e-9


def test_whitening_of_wide_rows_has_unit_variance(spark):
    x = low_rank(300, features.EXACT + 10, 3, 2)
    rows = frame(spark, x)
    mean, weights = features.pca_whiten(rows, 3)
    z = np.array([r["z"] for r in features.apply_weights(rows, mean, weights).collect()])
    assert np.allclose(np.cov(z.T, bias=True), np.eye(3), atol=1e-6)


def test_wide_discriminants_separate_classes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    labels = np.arange(240) % 3
    x = rng.normal(size=(240, 400)) + 2 * rng.normal(size=(3, 400))[labels]
    rows = frame(spark, x, labels)

    def spread(w):
        z = x @ w[:, :2]
        means = np.stack([z[labels == c].mean(axis=0) for c in range(3)])
        return np.linalg.norm(means[labels] - z, axis=1).mean() / np.linalg.norm(means - means.mean(axis=0), axis=1).mean()

    exact = features.target_aware_projection(rows, "label", 6, 0.5, 1)
    monkeypatch.setattr(features, "EXACT", 100)
    ranged = features.target_aware_projection(rows, "label", 6, 0.5, 1, subspace=20)
    assert exact.shape == ranged.shape == (400, 6)
    assert spread(ranged) < 0.3
    assert np.isclose(((x - x.mean(axis=0)) @ ranged[:, :2]).var(axis=0).mean(), 1)


@pytest.mark.parametrize("tasks", [1, 3, 40])
def test_arrays_merge_in_a_tree(spark, tasks):
    rows = spark.range(200).repartition(tasks).selectExpr("id", "array(cast(id as double), 1.0) as x")

    def run(batches):
        total = sum(sum(np.stack(b["x"].to_numpy())) for b in batches)
        return {} if np.isscalar(total) else {(3,): np.asarray(total)}

    found = wide.merged(wide.by_task(rows, ["x"], run, "k bigint"), ["k"], fan=3).collect()
    assert [(r["k"], np.frombuffer(r["data"]).tolist()) for r in found] == [(3, [19900.0, 200.0])]


def test_moments_and_empty_rows(spark):
    x = np.random.default_rng(0).normal(size=(50, 6))
    found = wide.moments(frame(spark, x, np.arange(50) % 2), "label")
    assert all(np.allclose(found[c][2], x[c::2].T @ x[c::2]) and found[c][0] == 25 for c in (0, 1))
    with pytest.raises(ValueError):
        wide.column_moments(frame(spark, x[:0]))
