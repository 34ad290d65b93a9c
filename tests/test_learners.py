"""Models from moments against models from the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import learners as L

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = 3 + x @ [2.0, -1.0, 0.0] + rng.normal(size=300) * 0.1
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame([*rows, (300, None, 1.0, 1.0, 1.0)], "id long, a double, b double, c double, y double")


def least_squares(x, y):
    return np.linalg.lstsq(np.c_[np.ones(len(x)), x], y, rcond=None)[0]


def test_cross_validation_and_searches(data):
    x, y, df = data
    m = L.moments(df, NAMES, "y", F.col("id") % 3)
    want = []
    for f in range(3):
        held = np.arange(300) % 3 == f
        w = least_squares(x[~held][:, :2], y[~held])
        want.append(-np.mean((y[held] - w[0] - x[held][:, :2] @ w[1:]) ** 2))
    assert L.cross_validate(m, (0, 1), metric="neg_mse") == pytest.approx(want)
    for trials in (L.random_search(m, 20), L.weighted_search(m, 20), L.las_vegas_search(m, 8, err=1e-3), L.grid_search(m, [(0,), (0, 1)], [0.0, 5.0]), L.top_ratio_search(m, [1.0, 0.7])):
        assert L.best_of(trials, 1e-3).subset == (0, 1)


def test_ensembles(data):
    x, y, df = data
    s = L.stack(df, NAMES, "y", F.col("id") % 3, [(0,), (1,)])
    got = s.predict(df.where("id < 300")).orderBy("id").select("predicted").toPandas()["predicted"].to_numpy()
    folds = [np.arange(300) % 3 == f for f in range(3)]
    oof, mean = np.zeros((300, 2)), np.zeros((300, 2))
    for held in folds:
        for b in range(2):
            w = least_squares(x[~held][:, [b]], y[~held])
            oof[held, b] = w[0] + x[held, b] * w[1]
            mean[:, b] += (w[0] + x[:, b] * w[1]) / 3
    meta = least_squares(oof, y)
    assert got == pytest.approx(meta[0] + mean @ meta[1:])
    blended = L.blend(df, NAMES, "y", F.col("id") >= 200, [(0, 1, 2)])
    assert len(blended.meta) == 2 and blended.scores[0] > 0.9
    bags = L.bag(L.moments(df, NAMES, "y", F.col("id") % 16), 5, None)
    assert np.mean(bags, axis=0) == pytest.approx(least_squares(x, y), abs=0.05)
    assert L.vote_weights([0.0, 0.0]).tolist() == [0.5, 0.5]


def test_logistic_learner_from_sums_is_that_from_rows(spark):
    """Each fold's model, and one of all rows; the derivatives of its loss vanish."""
    from sparkloom.operators import logistic

    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 2)) * [1.0, 50.0] + [0.0, 300.0]
    y = (rng.random(600) < 1 / (1 + np.exp(-(x[:, 0] + (x[:, 1] - 300) / 50)))).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))] + [(-1, None, 1.0, 1)], "k long, a double, b double, y int")
    models = logistic.fit(df, ["a", "b"], "y", alpha=0.0, fold=F.col("k") % 3)
    at = np.arange(600) % 3
    for f in range(3):
        assert models[f] == pytest.approx(logistic.fit_rows(x[at != f], y[at != f], 0.0), rel=1e-4)
    w = logistic.fit(df, ["a", "b"], "y", alpha=0.0)[0]
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    assert np.abs(np.c_[np.ones(600), x].T @ (p - y)).max() < 1e-3
    got = df.where("k >= 0").agg(logistic.log_loss(logistic.probability(w, ["a", "b"]), F.col("y"))).first()[0]
    assert got == pytest.approx(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


def test_trials_in_tasks_are_those_of_a_loop(spark):
    from sparkloom.operators import logistic, selection, trials

    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=200) > 0).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))], "k long, a double, b double, c double, y int")
    fit = lambda p, x, y: logistic.fit_rows(x, y, p["alpha"])
    predict = lambda w, x: w[0] + x @ w[1:]
    metric = lambda y, z: float(((z > 0) == (y > 0.5)).mean())
    candidates = [{"alpha": 1.0, "features": ["a"]}, {"alpha": 1.0, "features": ["b", "c"]}, {"alpha": 10.0}]
    rows = trials.evaluate(df, "k", ["a", "b", "c"], "y", candidates, fit, predict, metric, folds=4)
    got = {(r.candidate, r.fold): r.effect for r in rows.collect()}
    import hashlib

    rank = np.argsort(np.argsort([hashlib.md5(f"{i}-42".encode()).hexdigest() for i in range(200)]))
    for c, own in enumerate(([0], [1, 2], [0, 1, 2])):
        for f in range(4):
            held = rank % 4 == f
            w = logistic.fit_rows(x[~held][:, own], y[~held], candidates[c]["alpha"])
            assert got[c, f] == pytest.approx(metric(y[held], predict(w, x[held][:, own])))
    assert selection.best_trial(trials.summary(rows), 0.02).first().trial in (0, 2)
    one = trials.evaluate(df, "k", ["a", "b", "c"], "y", candidates, fit, predict, metric, holdout=0.25, update=lambda w, p: {"weights": len(w)})
    assert [r.fold for r in one.collect()] == [0, 0, 0] and '"weights": 2' in one.where("candidate = 0").first().params
    with pytest.raises(ValueError):
        trials.subsets(["a"], 0, 1)


def test_trials_of_learners_from_batches(spark):
    """A learner that sees batches only, in two passes, tried on staged folds; nothing stays behind."""
    import glob
    import tempfile

    from sparkloom.operators import trials

    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 2))
    y = 1 + x @ [2.0, -1.0]
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "k long, a double, b double, y double")

    def fit(params, batches):
        mean = sum(x.sum(0) for x, _ in batches()) / sum(len(x) for x, _ in batches())
        z = [(np.c_[np.ones(len(x)), x - mean], y) for x, y in batches()]
        w = np.linalg.solve(sum(a.T @ a for a, _ in z), sum(a.T @ b for a, b in z))
        return mean, w

    before = set(glob.glob(f"{tempfile.gettempdir()}/sparkloom-*/files-*"))
    got = trials.evaluate(df, "k", ["a", "b"], "y", [{}, {"features": ["b"]}], fit, lambda m, x: m[1][0] + (x - m[0]) @ m[1][1:], lambda y, p: -float(np.mean((y - p) ** 2)), folds=3, stream=True)
    best = {r.candidate: r.effect for r in trials.summary(got).withColumnRenamed("trial", "candidate").collect()}
    assert best[0] == pytest.approx(0, abs=1e-12) and best[1] < -1
    assert set(glob.glob(f"{tempfile.gettempdir()}/sparkloom-*/files-*")) == before


def test_out_of_fold_predictions_of_any_learner(spark, tmp_path):
    """Given folds, a holdout, and rows that no fold holds out, against a loop."""
    from sparkloom.operators import trials

    rng = np.random.default_rng(9)
    x = rng.normal(size=(90, 2))
    y = x @ [1.0, 2.0] + rng.normal(size=90)
    df = spark.createDataFrame([(f"k{i}", *map(float, r), float(v), i % 4) for i, (r, v) in enumerate(zip(x, y, strict=True))], "k string, a double, b double, y double, f int").repartition(3)
    fit = lambda p, x, y: np.linalg.lstsq(np.c_[np.ones(len(x)), x], y, rcond=None)[0]
    predict = lambda w, x: w[0] + x @ w[1:]
    names = [{}, {"features": ["b"]}]
    got = {r.k: r for r in trials.out_of_fold(df, "k", ["a", "b"], "y", names, fit, predict, f"file://{tmp_path}/f", fold=F.col("f")).collect()}
    for f in range(4):
        held = np.arange(90) % 4 == f
        for c, own in enumerate(([0, 1], [1])):
            w = least_squares(x[~held][:, own], y[~held])
            for i in np.flatnonzero(held):
                assert got[f"k{i}"].fold == f and got[f"k{i}"].y == y[i] and got[f"k{i}"][f"p{c}"] == pytest.approx(w[0] + x[i, own] @ w[1:])
    part = trials.out_of_fold(df, "k", ["a", "b"], "y", names, fit, predict, f"file://{tmp_path}/h", holdout=0.3)
    assert part.count() == 27 and set(part.columns) == {"k", "y", "fold", "p0", "p1"}
    some = trials.out_of_fold(df, "k", ["a", "b"], "y", names, fit, predict, f"file://{tmp_path}/s", fold=F.when(F.col("f") < 2, F.col("f")).otherwise(-1))
    assert some.count() == 46
    scores = trials.evaluate(df, "k", ["a", "b"], "y", names, fit, predict, lambda y, p: -float(np.mean((y - p) ** 2)), fold=F.col("f"))
    mse = np.mean([np.mean([(got[f"k{i}"].p0 - y[i]) ** 2 for i in range(f, 90, 4)]) for f in range(4)])
    assert {r.trial: r.effect for r in trials.summary(scores).collect()}[0] == pytest.approx(-mse)
