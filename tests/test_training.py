"""Views, saved models, training that goes on after a stop, minibatches by bucket, and grids in two phases."""

import inspect
import os
import shutil
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from permuta.operators import model, views
from permuta.plans import study_queries
from permuta.sources import artefacts

from .test_model import rankings


def wide(spark, n=200, d=7, classes=3, seed=0):
    rng = np.random.default_rng(seed)
    labels = np.arange(n) % classes
    x = rng.normal(size=(n, d)) * np.arange(1, d + 1) + 3 * rng.normal(size=(classes, d))[labels] + 5
    x[:, d - 1] = 2.0
    return x, labels, spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, labels))], "id long, x array<double>, label int").repartition(4)


@pytest.mark.parametrize("exact", [True, False])
def test_views_of_each_strategy_against_numpy(spark, exact, monkeypatch):
    x, labels, rows = wide(spark)
    if not exact:
        monkeypatch.setattr(views, "EXACT", 3)
        monkeypatch.setattr("permuta.operators.features.EXACT", 3)
    made = views.fit_views(rows, "label", 4, 5, 9)
    assert [v.kind for v in made] == ["target_aware", "random", "calibrated", "target_aware"]
    std = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(std > 1e-12, std, np.inf)
    random = z @ views.gaussian(7, 5, 10)
    calibrated = z @ views.gaussian(7, 5, 11)
    found = {(r["id"], r["view"]): (r["z"], r["pos"]) for r in views.in_views(rows, made).collect()}
    get = lambda v: np.array([found[i, v][0] for i in range(200)])
    assert np.allclose(get(1), random, atol=1e-6)
    assert np.allclose(get(2), calibrated / calibrated.std(axis=0), atol=1e-6)
    aware = get(0)
    assert np.allclose(aware[:, :2].var(axis=0).mean(), 1, atol=1e-3) and np.allclose(aware[:, 2:].var(axis=0).mean(), 1, atol=1e-3)
    means = np.stack([aware[labels == c, :2].mean(axis=0) for c in range(3)])
    nearest = np.linalg.norm(aware[:, None, :2] - means, axis=2).argmin(axis=1)
    assert (nearest == labels).mean() > 0.75
    for v in range(3):
        assert np.array_equal([found[i, v][1] for i in range(200)], np.argsort(np.argsort(get(v), axis=1, kind="stable"), axis=1, kind="stable"))


def test_unknown_strategies_are_an_error(spark):
    with pytest.raises(ValueError):
        views.fit_views(wide(spark)[2], "label", 1, 3, kinds=("sideways",))


def ensemble(spark):
    x, labels, rows = wide(spark)
    ranks = rows.select("id", F.col("x").alias("v"), "label")
    settings = [model.Settings(seed=k, filters=(6,), view=v.stacked(), label=v.kind) for k, v in enumerate(views.fit_views(rows, "label", 7, 5, 1))]
    return ranks, settings


def test_a_saved_ensemble_predicts_the_same(spark, tmp_path):
    rows, settings = ensemble(spark)
    best = model.fit(rows.where("id % 4 <> 0"), rows.where("id % 4 = 0"), settings, 7, 3, steps=1, batch=32.0)
    path = str(tmp_path / "model")
    assert artefacts.save(spark, path, {"best": best}, settings, {"classes": ["a", "b", "c"]}) == 1
    banks, again, note = artefacts.load(spark, path)
    assert note == {"classes": ["a", "b", "c"]} and [s.label for s in again] == [s.label for s in settings] and again[0].history == settings[0].history
    predicted = lambda b, s: sorted(map(tuple, model.predict(rows, b, views=model.views_of(s)).collect()))
    assert predicted(best, settings) == predicted(banks["best"], again)


def test_versions_that_are_unfinished_or_changed(spark, tmp_path):
    path = str(tmp_path / "model")
    with pytest.raises(FileNotFoundError):
        artefacts.load(spark, path)
    settings = [model.Settings(seed=1, filters=(4,))]
    bank = {0: model.random_layers(settings[0], 5, 2)}
    artefacts.save(spark, path, {"best": bank}, settings)
    other = {0: model.random_layers(model.Settings(seed=2, filters=(4,)), 5, 2)}
    assert artefacts.save(spark, path, {"best": other}, settings) == 2
    shutil.copytree(artefacts.versions(spark, path)[0]["folder"], str(tmp_path / "model" / "unfinished"))
    assert all((a == b).all() for a, b in zip(artefacts.load(spark, path)[0]["best"][0], other[0]))
    assert all((a == b).all() for a, b in zip(artefacts.load(spark, path, 1)[0]["best"][0], bank[0]))
    folder = artefacts.versions(spark, path)[1]["folder"] + "/banks"
    spark.createDataFrame([("best", 0, 0, 0, [1])], artefacts.TABLES["banks"]).write.mode("append").parquet(folder)
    with pytest.raises(ValueError, match="banks of version 2"):
        artefacts.load(spark, path)
    with pytest.raises(FileNotFoundError):
        artefacts.load(spark, path, 7)


def test_training_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    rows = model.bucket(rankings(spark, 240))
    train, valid = rows.where("id % 4 <> 0"), rows.where("id % 4 = 0")
    settings = lambda: [model.Settings(seed=1, filters=(6,)), model.Settings(seed=2, filters=(5,), decay=0.9, steps=4, swaps=2), model.Settings(seed=3, learn_last=False)]
    run = lambda s, state: model.fit(train, valid, s, 8, 3, 7, 32.0, 0.5, 2, state)
    whole = run(one := settings(), None)
    step, calls = model.train_step, []

    def stops(*args, **more):
        calls.append(args[2])
        if len(calls) == 6:
            raise RuntimeError("lost")
        return step(*args, **more)

    monkeypatch.setattr(model, "train_step", stops)
    with pytest.raises(RuntimeError, match="lost"):
        run(settings(), str(tmp_path / "state"))
    again = run(two := settings(), str(tmp_path / "state"))
    assert calls == [0, 1, 2, 3, 4, 5, 4, 5, 6], "the two steps since the last version are made again"
    assert [s.history for s in one] == [s.history for s in two]
    assert all((a == b).all() for m in whole for a, b in zip(whole[m], again[m], strict=True))
    with pytest.raises(ValueError, match="other settings"):
        model.fit(train, valid, settings()[:1], 8, 3, 7, 32.0, 0.5, 2, str(tmp_path / "state"))


def test_minibatches_read_their_buckets_only(spark):
    rows = model.bucket(rankings(spark, 640))
    folders = {f.rsplit("bucket=", 1)[1].split("/")[0]: 0 for f in rows.inputFiles()}
    assert len(folders) == model.BUCKETS
    size = lambda frame: sum(os.path.getsize(f.removeprefix("file://")) for f in frame.inputFiles())
    seen = []
    for step in range(8):
        some = model.chosen_buckets(step, 0.25)
        plan = rows.where(F.col("bucket").isin(some))._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [bucket" in plan
        files = {f for f in rows.inputFiles() if int(f.rsplit("bucket=", 1)[1].split("/")[0]) in some}
        assert sum(os.path.getsize(f.removeprefix("file://")) for f in files) < 0.4 * size(rows)
        seen += some
    assert sorted(seen[:32]) == sorted(seen[32:]) == list(range(32)), "every bucket once before any comes again"


def test_training_lowers_the_error_on_rows_not_seen(spark):
    rows = rankings(spark, 400).repartition(4).cache()
    settings = [model.Settings(seed=5, filters=(8,))]
    train, valid, test = rows.where("id % 5 > 1"), rows.where("id % 5 = 1"), rows.where("id % 5 = 0")
    start = model.errors(test, {0: model.random_layers(settings[0], 8, 3)})[0]
    best = model.fit(train, valid, settings, 8, 3, steps=100, batch=32.0, every=10)
    assert model.errors(test, best)[0] < 0.6 * start and model.errors(test, best)[0] < 0.15
    rows.unpersist()


def test_swapped_rows_are_rankings_near_their_own():
    rng = np.random.default_rng(0)
    rows = np.stack([rng.permutation(9) for _ in range(50)]).astype(np.float32)
    for most in (1, 3):
        out = model.swapped(rows, rng.random(50), most)
        assert (np.sort(out, axis=1) == np.arange(9)).all()
        assert (np.abs(out - rows).sum(axis=1) <= 2 * most).all() and (out != rows).any(axis=1).mean() > 0.8


def search_grid():
    """The settings of a full search: 7 shapes, 4 view sizes, 3 rates, 3 lengths, 4 kinds of augmentation, last layer learnt or not."""
    shapes = [(32,), (64,), (128,), (256,), (64, 32), (128, 64), (64, 128)]
    grid = product(shapes, (5, 10, 16, 32), (0.05, 0.1, 0.2), (200, 300, 500), (0, 1, 2, 3), (True, False))
    return [model.Settings(seed=42, filters=f, rate=r, steps=n, swaps=w, learn_last=last, view=np.random.default_rng(e).normal(size=(8, e)), label=f"{f} e={e} lr={r} it={n} sw={w} llu={last}") for f, e, r, n, w, last in grid]


def test_a_grid_in_two_phases(spark, monkeypatch):
    assert len({s.label for s in search_grid()}) == 2016
    rows = rankings(spark, 60).coalesce(1).cache()
    grid = [model.Settings(seed=6, filters=(f,), rate=r, steps=n, label=f"{f}/{r}/{n}") for f in (4, 5) for r in (0.1, 0.5) for n in (1, 2)]
    sizes = []
    step = model.train_step
    monkeypatch.setattr(model, "train_step", lambda rows, models, *a, **k: sizes.append(len(models)) or step(rows, models, *a, **k))
    projections = [np.random.default_rng(v).normal(size=(8, 6)) for v in range(3)]
    first, second = model.fit_grid(rows.where("id % 3 > 0"), rows.where("id % 3 = 0"), grid, 8, 3, 2, 16.0, group=5, keep=2, seeds=(0, 1), views=projections)
    errors = {r["label"]: r["error"] for r in first.collect()}
    assert set(errors) == {s.label for s in grid} and max(sizes) <= 5
    kept = sorted(second.collect(), key=lambda r: r["rank"])
    assert [r["label"] for r in kept] == sorted(errors, key=lambda k: (errors[k], [s.label for s in grid].index(k)))[:2]
    assert all(r["runs"] == 2 and r["first_error"] == errors[r["label"]] and 0 <= r["error"] <= 1 for r in kept)
    rows.unpersist()


def test_a_grid_trains_each_setting_for_its_own_steps(spark, monkeypatch):
    """Two steps of a setting that names five were all it got; views follow the dimensions of a setting's own."""
    rows = rankings(spark, 60).coalesce(1).cache()
    views = {e: [np.random.default_rng(10 * e + v).normal(size=(8, e)) for v in range(2)] for e in (4, 6)}
    grid = [model.Settings(seed=6, filters=(4,), steps=n, view=views[e][0], label=f"{n}/{e}") for n in (None, 5) for e in (4, 6)]
    trained = []
    step = model.train_step
    monkeypatch.setattr(model, "train_step", lambda rows, models, *a, **k: trained.extend((s.label, s.seed, s.view.shape[1]) for s, _ in models.values()) or step(rows, models, *a, **k))
    first, second = model.fit_grid(rows.where("id % 3 > 0"), rows.where("id % 3 = 0"), grid, 8, 3, 2, 16.0, keep=4, seeds=(0, 1), views=views)
    counts = {x: trained.count(x) for x in trained}
    wanted = {(s.label, seed, s.view.shape[1]): s.steps or 2 for s in grid for seed in (6, 0, 1, 1000, 1001)}
    assert counts == wanted and {r["label"]: r["error"] for r in first.collect()} == {r["label"]: r["first_error"] for r in second.collect()}
    assert sorted(r["rank"] for r in second.collect()) == [1, 2, 3, 4] and all(r["runs"] == 2 for r in second.collect())
    rows.unpersist()


def test_the_query_searches_the_whole_grid(spark, monkeypatch):
    """It had 24 settings of two steps, kept three of them, and had three views and two seeds."""
    asked = inspect.signature(model.fit_grid)
    calls = []

    def noted(*a, **k):
        calls.append(asked.bind(*a, **k))
        calls[-1].apply_defaults()
        return None, spark.createDataFrame([], "label string, rank int, first_error double, error double, std double, runs long")

    monkeypatch.setattr(model, "fit_grid", noted)
    study_queries.fit_many(spark, "/root/testdata/sf0.001").collect()
    (call,) = calls
    axes = lambda s: (s.filters, s.view.shape[1], s.rate, s.steps, s.swaps, s.learn_last)
    grid, views = call.arguments["grid"], call.arguments["views"]
    assert {axes(s) for s in grid} == {axes(s) for s in search_grid()} and len(grid) == len({s.label for s in grid}) == 2016
    assert call.arguments["keep"] == 15 and len(call.arguments["seeds"]) == 5 and call.arguments["share"] == 1
    assert {e: len(v) for e, v in views.items()} == dict.fromkeys((5, 10, 16, 32), 7) and all(v.shape[1] == e for e, x in views.items() for v in x)
