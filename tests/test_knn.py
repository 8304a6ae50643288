"""Exact neighbours by the pivot index against all distances."""

import numpy as np
import pytest

from permuta.operators import knn


def frame(spark, x, first=0, labels=None):
    rows = [(first + i, v.tolist(), None if labels is None else labels[i]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>, label int").repartition(5)


def brute(q, x, k, metric):
    d = np.abs(q[:, None] - x[None]).sum(axis=2) if metric == "l1" else np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2))
    d = np.round(d, 9)
    return {(i, int(j), d[i, j]) for i in range(len(q)) for j in np.argsort(d[i], kind="stable")[:k]}


@pytest.mark.parametrize("metric", ["l1", "l2"])
@pytest.mark.parametrize("k", [1, 7])
def test_search_equals_all_distances_and_leaves_blocks_out(spark, metric, k):
    rng = np.random.default_rng(k)
    centres = rng.normal(size=(12, 6)) * 20
    x, q = (np.round(centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 6)), 1) for n in (1500, 240))
    x[40:80] = x[40]
    found, counts = knn.search(frame(spark, q).drop("label"), frame(spark, x, labels=[int(i % 3) for i in range(1500)]), k, metric, pivots=16, block=32)
    rows = found.collect()
    assert {(r["id"], r["ref"], r["distance"]) for r in rows} == brute(q, x, k, metric) and len(rows) == 240 * k
    assert all(r["label"] == r["ref"] % 3 for r in rows)
    told = counts.first()
    assert told["pairs"] == 1500 * 240 and told["compared"] < told["pairs"] / 4


def test_search_of_uneven_small_and_empty_tables(spark):
    x = np.array([[0.0, 0.0], [1.0, 0.0], [5.0, 5.0]])
    q = np.array([[0.0, 1.0], [100.0, 100.0]])
    got = {(r["id"], r["ref"]) for r in knn.nearest(frame(spark, q).drop("label"), frame(spark, x), 9).collect()}
    assert got == {(0, 0), (0, 1), (1, 1), (1, 2)} or got == {(i, j) for i, j, _ in brute(q, x, 2, "l1")}
    assert knn.nearest(frame(spark, q[:0]).drop("label"), frame(spark, x), 2).collect() == []
    assert knn.nearest(frame(spark, q).drop("label"), frame(spark, x[:0]), 2).collect() == []
    alone = knn.nearest(frame(spark, q).drop("label"), frame(spark, x[:1]), 3).collect()
    assert [(r["ref"], r["label"]) for r in alone] == [(0, None)] * 2


def test_vectors_of_two_lengths_are_an_error(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0], 0)], "id long, v array<double>, label int").coalesce(1)
    with pytest.raises(Exception):
        knn.nearest(rows.drop("label"), rows, 1).collect()


@pytest.mark.parametrize("metric", ["l1", "l2"])
def test_no_table_has_a_row_for_each_pair_of_blocks(spark, monkeypatch, metric):
    """Queries in several groups and tasks, rows that repeat, far from zero and in one case beyond single precision."""
    written = {}

    def counting(df, tag, plain=knn.materialize):
        made = plain(df, tag)
        written[tag] = made.count()
        return made

    monkeypatch.setattr(knn, "materialize", counting)
    monkeypatch.setattr(knn, "HELD", 40)
    monkeypatch.setattr(knn, "COLUMN", 300)
    rng = np.random.default_rng(3)
    x, q = (rng.integers(0, 6, size=(n, 6)).astype(float) for n in (900, 200))
    for scale, shift in ((1.0, 0.0), (1.0, 1e7), (2.0**60, 0.0)):
        found, counts = knn.search(frame(spark, q * scale + shift).drop("label"), frame(spark, x * scale + shift, labels=[int(i % 3) for i in range(900)]), 5, metric, pivots=8, block=8)
        assert {(r["id"], r["ref"], r["distance"]) for r in found.collect()} == brute(q * scale + shift, x * scale + shift, 5, metric)
        assert counts.first()["compared"] <= 900 * 200 + 200 * 8
        tables = {t: n for t, n in written.items() if t != "knn-rest"}
        assert max(tables.values()) <= 2 * 900 / 8 + 50


def test_groups_hold_about_as_many_queries_each():
    sizes = {0: 10, 1: 5, 2: 500, 3: 20, 7: 90, 8: 30}
    group_of = knn.grouped(sizes, 25)
    share = {}
    for ball, (start, split) in group_of.items():
        for g in range(start, start + split):
            share[g] = share.get(g, 0) + sizes[ball] / split
    assert sorted(share) == list(range(len(share))) and sum(share.values()) == sum(sizes.values())
    assert max(share.values()) <= 2 * -(-sum(sizes.values()) // 5) and group_of[2][1] > 1
    assert knn.grouped({}, 4) == {}
