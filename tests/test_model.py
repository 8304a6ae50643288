"""The rank network: a Spark step equals a plain one, whatever the partitions, and training learns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from permuta.functions.rankings import hash_uniform
from permuta.operators import model
from permuta.sources import artefacts


def rankings(spark, n=120, items=8, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        label = i % 3
        base = np.roll(np.arange(items), label * 2).astype(float) + rng.normal(scale=0.8, size=items)
        rows.append((i, [int(x) for x in model.place(base[None])[0]], label))
    return spark.createDataFrame(rows, "id long, v array<int>, label int")


def test_step_equals_plain_numpy(spark):
    rows = rankings(spark)
    settings = model.Settings(seed=3, filters=(6, 5))
    layers = model.random_layers(settings, 8, 3)
    local = rows.select("v", "label", hash_uniform("gate2", F.col("id")).alias("c")).toPandas()
    sums = model.votes(np.stack(local["v"]).astype(np.float32), local["label"].to_numpy(), local["c"].to_numpy(), layers, settings, 32.0)
    expected = [model.apply_votes(x, *s) for x, s in zip(layers, sums)]
    for parts in (1, 3, 7):
        made = model.train_step(rows.repartition(parts), {0: (settings, layers)}, 2, 32.0)[0]
        assert all((a == b).all() for a, b in zip(made, expected))


def test_training_keeps_the_best_and_learns(spark):
    rows = rankings(spark, 240).cache()
    settings = [model.Settings(seed=s) for s in range(2)]
    best = model.fit(rows.where("id % 4 <> 0"), rows.where("id % 4 = 0"), settings, 8, 3, steps=3, batch=32.0)
    found = model.errors(rows.where("id % 4 = 0"), best)
    for m, s in enumerate(settings):
        assert found.get(m, 0) <= min(s.history) + 1e-9


def test_saved_model_predicts_the_same(spark, tmp_path):
    rows = rankings(spark, 30)
    layers = {0: model.random_layers(model.Settings(seed=1), 8, 3)}
    table = model.bank_table(spark, layers)
    table.write.parquet(str(tmp_path / "m"))
    again = model.from_table(spark.read.parquet(str(tmp_path / "m")))
    assert model.predict(rows, layers).orderBy("id").collect() == model.predict(rows, again).orderBy("id").collect()


def test_missing_positions_stand_in_the_middle():
    d = model.distances(np.array([[0, np.nan, 2, 3]], np.float32), np.array([[0, 1, 2, 3]], np.float32))
    assert d[0, 0] == 1.0


def test_each_model_sees_its_own_share_of_the_rows(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, rng.permutation(6).tolist(), i % 2) for i in range(80)], "id long, v array<int>, label int")
    start = model.random_layers(model.Settings(seed=0), 6, 2)
    got = model.train_step(rows, {m: (model.Settings(seed=m, rows=0.3, rate=5.0), start) for m in range(2)}, 0, 1.0)
    assert any((a != b).any() for a, b in zip(got[0], got[1]))


def moves(row, own):
    """Motions of a filter's items in plain Python, less their mean and rounded where it doesn't see all."""
    found = {i: float(row[i] - own[i]) for i in range(len(row)) if own[i] == own[i]}
    if len(found) < len(row):
        mean = sum(found.values()) / len(found)
        found = {i: float(round(v - mean)) for i, v in found.items()}
    return found


def plain_place(values):
    order = sorted(range(len(values)), key=lambda i: (values[i], i))
    return [float(order.index(i)) for i in range(len(values))]


def plain_votes(rows, labels, layers, rate, share, batch):
    sums = [(np.zeros(x.shape), np.zeros(x.shape)) for x in layers]

    def vote(at, f, row, weight):
        found = moves(row, layers[at][f])
        for i, v in found.items():
            aim = row[i] if len(found) == len(row) else min(max(layers[at][f][i] + v, 0), len(found) - 1)
            sums[at][0][f, i] += weight * aim
            sums[at][1][f, i] += weight

    for row, label in zip(rows, labels):
        inputs = [[float(v) for v in row]]
        for layer in layers:
            d = [sum(abs(v) for v in moves(inputs[-1], own).values()) for own in layer]
            inputs.append(plain_place(d))
        if d.index(min(d)) == label:
            continue
        vote(len(layers) - 1, label, inputs[-2], rate / batch)
        found = moves(inputs[-2], layers[-1][label])
        pull = [found.get(i, 0.0) for i in range(len(inputs[-2]))]
        for at in range(len(layers) - 2, -1, -1):
            width = layers[at].shape[1]
            down = [0.0] * width
            for f in sorted(range(len(pull)), key=lambda f: (-abs(pull[f]), f))[: min(len(pull), int(share * len(pull)) + 1)]:
                s = pull[f]
                vote(at, f, [width - 1 - v for v in inputs[at]] if s < 0 else inputs[at], abs(s) * 2 * rate / batch)
                for i, v in moves(inputs[at], layers[at][f]).items():
                    down[i] += np.sign(s) * v
            most = max(map(abs, down))
            pull = [v / most * width * 0.25 if most else 0.0 for v in down]
    return sums


def test_receptive_fields_against_plain_loops():
    rng = np.random.default_rng(4)
    for fields in ((4,), (None, 3), (4, 3, 2), (1,), (9,), ()):
        settings = model.Settings(seed=2, filters=(6, 5), fields=fields)
        layers = model.random_layers(settings, 9, 3)
        for layer, size in zip(layers, [*fields, None, None, None]):
            assert all(sorted(x[~np.isnan(x)]) == list(range(size or layer.shape[1])) for x in layer)
        rows, labels = np.stack([rng.permutation(9) for _ in range(40)]).astype(np.float32), rng.integers(0, 3, 40)
        expected = [[sum(abs(v) for v in moves(row, own).values()) for own in layers[0]] for row in rows]
        assert np.array_equal(model.distances(rows, layers[0]), expected)
        found = model.votes(rows, labels, np.ones(40), layers, settings, 16.0)
        for layer, (num, den), (n, d) in zip(layers, found, plain_votes(rows, labels, layers, settings.rate, settings.share, 16.0)):
            assert np.allclose(num, n, atol=1e-4) and np.allclose(den, d, atol=1e-5)
            assert (den[np.isnan(layer)] == 0).all()
            assert np.array_equal(np.isnan(model.apply_votes(layer, num, den)), np.isnan(layer))


def test_a_field_of_missing_positions_and_fields_that_cant_be():
    layer = np.array([[0, np.nan, 1, np.nan], [np.nan, 0, np.nan, 1]], np.float32)
    found = model.distances(np.array([[np.nan] * 4, [0, 1, 2, 3], [5, 0, 6, 1]], np.float32), layer)
    assert found.tolist() == [[0.0, 0.0], [0.0, 0.0], [0.0, 0.0]], "only the order inside the field counts"
    for fields in ((0,), (2, 2, 2)):
        with pytest.raises(ValueError):
            model.random_layers(model.Settings(filters=(3,), fields=fields), 4, 2)


def test_filters_as_a_table_are_cut_to_their_field(spark):
    whole = {(r["filter"], r["item"]): r["pos"] for r in model.init_filters(spark, 9, 5, 3).collect()}
    some = {(r["filter"], r["item"]): r["pos"] for r in model.init_filters(spark, 9, 5, 3, 4).collect()}
    assert some == {k: v for k, v in whole.items() if v < 4} and len(some) == 20


def test_networks_with_fields_learn_and_are_saved(spark, tmp_path):
    rows = rankings(spark, 400).repartition(4).cache()
    settings = [model.Settings(seed=5, filters=(12,), fields=(5,)), model.Settings(seed=6, filters=(8,), fields=(None, 6))]
    train, valid, test = rows.where("id % 5 > 1"), rows.where("id % 5 = 1"), rows.where("id % 5 = 0")
    start = model.errors(test, {m: model.random_layers(s, 8, 3) for m, s in enumerate(settings)})
    best = model.fit(train, valid, settings, 8, 3, steps=40, batch=32.0, every=5)
    found = model.errors(test, best)
    # Fields of hidden filters learn fast. Those of class filters, model 1, learn slowly: they are kept and saved, and get no worse.
    assert found[0] < 0.5 * start[0] and found[1] <= start[1] + 0.1
    assert np.isnan(best[0][0]).sum(axis=1).tolist() == [3] * 12
    artefacts.save(spark, str(tmp_path / "model"), {"best": best}, settings)
    banks, again, _ = artefacts.load(spark, str(tmp_path / "model"))
    assert [s.fields for s in again] == [(5,), (None, 6)] and model.errors(test, banks["best"]) == found
    table = model.from_table(model.bank_table(spark, best))
    assert all(np.array_equal(a, b, equal_nan=True) for m in best for a, b in zip(best[m], table[m], strict=True))
    rows.unpersist()


def test_votes_sum_as_one_after_the_other_without_add_at(monkeypatch):
    rng = np.random.default_rng(2)
    to = rng.integers(0, 7, 5000)
    for values in (rng.normal(size=(5000, 24)).astype(np.float32), rng.normal(size=(5000, 1)), rng.normal(size=(5000, 24))):
        for start in (np.zeros((7, 24)), rng.normal(size=(7, 24))):
            wanted, got = start.copy(), start.copy()
            np.add.at(wanted, to, values)
            model.add_rows(got, to, values)
            assert np.array_equal(got, wanted)
    rows, layer = (np.argsort(rng.normal(size=(n, 24)), axis=1).astype(np.float32) for n in (3000, 32))
    rows[:5, :3] = np.nan
    middle = np.where(np.isnan(rows), 12.0, rows)
    assert np.array_equal(model.distances(rows, layer), np.abs(middle[:, None] - layer[None]).sum(axis=2))
    assert model.distances(rows[:0], layer).shape == (0, 32)
