"""Fitted projections, numbering by ranges, neighbours, CSV features, saved models and baselines against numpy."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from permuta.operators import baselines, consensus, features, knn, model
from permuta.plans import queries
from permuta.sources import io
from permuta.sources.tables import row_numbers, small


def wide(spark, x, labels=None):
    labels = [0] * len(x) if labels is None else labels
    return spark.createDataFrame([(i, [float(v) for v in r], int(k)) for i, (r, k) in enumerate(zip(x, labels))], "id long, x array<double>, label int")


def test_pca_whiten(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))
    mean, weights = features.pca_whiten(wide(spark, x), 3)
    z = np.array([r["z"] for r in features.apply_weights(wide(spark, x), mean, weights).orderBy("id").collect()])
    value, vector = np.linalg.eigh(np.corrcoef(x.T))
    wanted = ((x - x.mean(axis=0)) / x.std(axis=0)) @ vector[:, ::-1][:, :3] / np.sqrt(value[::-1][:3])
    assert np.abs(np.abs(z) - np.abs(wanted)).max() < 1e-6
    assert np.abs(np.cov(z.T, bias=True) - np.eye(3)).max() < 1e-6


def test_target_aware_projection(spark):
    rng = np.random.default_rng(1)
    labels = np.arange(240) % 3
    x = rng.normal(size=(240, 5)) + 3 * np.eye(5)[labels]
    w = features.target_aware_projection(wide(spark, x, labels), "label", 4, 0.5, 3)
    centred = x - x.mean(axis=0)
    means = np.array([centred[labels == k].mean(axis=0) for k in range(3)])
    between = 80 * means.T @ means
    within = centred.T @ centred - between
    value, vector = np.linalg.eig(np.linalg.solve(within + 1e-6 * np.eye(5), between))
    best = vector[:, np.argsort(-value.real)[:2]].real
    assert w.shape == (5, 4)
    for k in range(2):
        assert abs(w[:, k] @ best[:, k]) / np.linalg.norm(w[:, k]) / np.linalg.norm(best[:, k]) > 1 - 1e-6
    assert abs((centred @ w[:, 2:]).var(axis=0).mean() - 1) < 1e-6


@pytest.mark.parametrize("group", [None, "g"])
def test_row_numbers(spark, group):
    rng = np.random.default_rng(2)
    rows = [(i, int(g), int(v)) for i, (g, v) in enumerate(rng.integers(0, [3, 40], (500, 2)))]
    frame = spark.createDataFrame(rows, "id long, g int, v int").repartition(5)
    got = {r["id"]: r["k"] for r in row_numbers(frame, ["v", "id"], "k", group).collect()}
    for g in {r[1] for r in rows} if group else {None}:
        mine = sorted((v, i) for i, h, v in rows if g is None or h == g)
        assert [got[i] for _, i in mine] == list(range(1, len(mine) + 1))
    assert row_numbers(frame.limit(0), ["v"], "k", group).count() == 0


def test_column_rank_of_ties(spark):
    x = [[1.0, 5.0], [1.0, 4.0], [2.0, 5.0], [0.0, 5.0]]
    got = {(r["id"], r["feature"]): r["r"] for r in features.column_rank(features.to_long(wide(spark, x))).collect()}
    assert [got[i, 0] for i in range(4)] == [2.5 / 4, 2.5 / 4, 1.0, 0.25] and [got[i, 1] for i in range(4)] == [0.75, 0.25, 0.75, 0.75]


def test_small_is_broadcast_by_its_size(spark):
    left = spark.range(1000).toDF("k")
    plan = lambda n: left.join(small(spark.range(50).toDF("k"), n), "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(50) and "strategy=broadcast" not in plan(49)


@pytest.mark.parametrize("metric", ["l1", "l2"])
def test_nearest(spark, metric, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 16)
    rng = np.random.default_rng(3)
    q, t = rng.integers(0, 4, (9, 5)), rng.integers(0, 4, (60, 5))
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "id long, v array<int>")
    right = spark.createDataFrame([(100 + i, v.tolist(), i % 3) for i, v in enumerate(t)], "id long, v array<int>, label int")
    got = sorted((r["id"], r["distance"], r["ref"]) for r in knn.nearest(left, right, 4, metric).collect())
    wanted = []
    for i, v in enumerate(q):
        d = np.abs(t - v).sum(axis=1) if metric == "l1" else np.sqrt(((t - v) ** 2).sum(axis=1))
        wanted += sorted((i, round(float(x), 9), 100 + j) for j, x in enumerate(d))[:4]
    assert got == sorted(wanted)


def test_read_features(spark, tmp_path):
    (tmp_path / "data.csv").write_text("sample,a,b\ns1,1.5,x\ns2,2,3e2\ns3,0,1\n")
    (tmp_path / "labels.csv").write_text("sample,Class\ns2,B\ns1,C\ns9,A\n")
    got = io.read_features(spark, str(tmp_path / "data.csv"), str(tmp_path / "labels.csv"), "sample", "Class").collect()
    assert sorted((r["sample"], r["x"], r["label_code"]) for r in got) == [("s1", [1.5, None], 2), ("s2", [2.0, 300.0], 1)]


def test_models_see_rows_through_their_views(spark):
    rng = np.random.default_rng(6)
    x = np.argsort(rng.normal(size=(40, 8)), axis=1)
    settings = [model.Settings(seed=1, filters=(4,), view=rng.normal(size=(8, 5))), model.Settings(seed=2, filters=(4,))]
    layers = {m: model.random_layers(s, 8, 3) for m, s in enumerate(settings)}
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<int>")
    got = {(r["id"], r["model"]): r["predicted"] for r in model.predict(rows, layers, views=model.views_of(settings)).collect()}
    seen = {0: np.argsort(np.argsort(np.round(x @ settings[0].view, 6), axis=1, kind="stable"), axis=1), 1: x}
    for m, rows_seen in seen.items():
        for i, row in enumerate(rows_seen):
            hidden = np.abs(layers[m][0] - row).sum(axis=1)
            ranks = np.argsort(np.argsort(hidden, kind="stable"))
            assert got[i, m] == np.abs(layers[m][1] - ranks).sum(axis=1).argmin()


def test_ensemble_is_the_majority(spark):
    votes = spark.createDataFrame([(1, 0, 2), (1, 1, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)], "id long, model int, predicted int")
    got = {r["id"]: tuple(r.asDict().values())[1] for r in model.ensemble(votes).collect()}
    assert got == {1: 2, 2: 0}, "ties go to the lower class"
    assert consensus.majority_vote(votes.limit(0), "id", "predicted").count() == 0


@pytest.mark.parametrize("method", ["random_forest", "logistic", "naive_bayes", "linear_svm"])
def test_baselines_tell_clear_classes_apart(spark, method):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, (4 * np.eye(3)[i % 3] + rng.normal(size=3)).tolist()) for i in range(150)]
    made = baselines.vectors(spark.createDataFrame(rows, "id long, label int, v array<double>")).cache()
    got = getattr(baselines, method)(made.where("id % 5 > 0"), made.where("id % 5 = 0")).collect()
    assert len(got) == 30 and np.mean([r["label"] == r["predicted"] for r in got]) > 0.9
    made.unpersist()


def test_every_query_without_sql_is_known():
    """Training and what is fitted on the driver; everything else has SQL."""
    rest = set(queries.queries()) - set(queries.oracle_sql())
    fitted = {"target_aware_encode", "pca_whiten", "train_step", "fit_fields", "fit_rank_net", "predict", "save_model", "fit_ensemble", "fit_mixture", "run_experiment", "learning_curve", "fit_many", "diverse_views"}
    assert rest == fitted | {"baseline_rf", "baseline_gbt", "baseline_mlp", "baseline_lr_nb", "baseline_svm"}


def test_words_are_counted_where_texts_are_and_equal_those_of_a_regex(spark):
    """Nothing but a document's known words is shuffled; rows of one doc_id are one document."""
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "B", "_", "1", " ", ".", "é", "界", "\x00", "K", "ab"]) for _ in range(rng.randrange(12))) for _ in range(400)] + [None, "", "ab", "ab" * 9]
    data = [(None if i % 90 == 7 else i % 300, x) for i, x in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    wanted = Counter((i, w) for i, x in data for w in re.findall("[a-z0-9_]{2,}", (x or "").lower()))
    assert "Exchange" not in features.tokens(spark.range(5).selectExpr("id as doc_id", "'a b' as text"))._jdf.queryExecution().executedPlan().toString()
    total = Counter()
    for (_, w), n in wanted.items():
        total[w] += n
    top = sorted(total, key=lambda w: (-total[w], w))[:30]
    vocab = features.vocabulary(features.word_counts(docs), 30)
    assert sorted(map(tuple, vocab.collect())) == [(w, total[w], i) for i, w in enumerate(sorted(top))]
    found = features.bow_counts(features.tokens(docs), vocab)
    known = sorted(((i, sorted(top).index(w), n) for (i, w), n in wanted.items() if w in top), key=repr)
    assert sorted(map(tuple, found.collect()), key=repr) == known
    ranked = features.bow_rank(found, 5)
    assert ranked._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r["doc_id"], r["item"]) for r in ranked.where("doc_id is not null").collect()) == sorted((i, k) for i, k, _ in known if i is not None)
