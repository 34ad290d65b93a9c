"""Trees against plain growing, contributions against all coalitions, and draws against loops."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import bags, learners, logistic, trees

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(240, 4)), 1)
    x[:, 2] = rng.integers(0, 3, 240)
    y = 2 * (x[:, 0] > 0) * (x[:, 1] < 0.5) + x[:, 2] + 0.1 * rng.normal(size=240)
    x[::17, 1] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([*rows, (900, 1.0, 1.0, 1.0, 1.0, None)], "id long, a double, b double, c double, d double, y double").repartition(3)
    return x, y, df


def plain_split(x, g, h, w, cuts, l2):
    """The best split of rows in memory: feature, threshold."""
    best, gain = None, 1e-9
    worth = lambda m: (w * g)[m].sum() ** 2 / ((w * h)[m].sum() + l2) if w[m].sum() else 0.0
    for j, cs in enumerate(cuts):
        for c in cs:
            right = x[:, j] > c
            if w[right].sum() and w[~right].sum():
                now = worth(right) + worth(~right) - worth(np.ones(len(x), bool))
                if now > gain * (1 + 1e-9):
                    best, gain = (j, c, right), now
    return best


def plain_tree(x, g, h, w, cuts, depth, l2, rate):
    """(value, cover, None or (feature, threshold, left, right)) by recursion."""
    value = -rate * (w * g).sum() / ((w * h).sum() + l2)
    found = plain_split(x, g, h, w, cuts, l2) if depth else None
    if not found:
        return value, w.sum(), None
    j, c, right = found
    return value, w.sum(), (j, c, *[plain_tree(x[m], g[m], h[m], w[m], cuts, depth - 1, l2, rate) for m in (~right, right)])


def plain_value(tree, row):
    value, _, inner = tree
    return value if inner is None else plain_value(inner[3] if row[inner[0]] > inner[1] else inner[2], row)


def plain_game(tree, row, known):
    """The tree's value where only some features are known: else both sides, by cover."""
    value, cover, inner = tree
    if inner is None:
        return value
    j, c, left, right = inner
    if j in known:
        return plain_game(right if row[j] > c else left, row, known)
    return (left[1] * plain_game(left, row, known) + right[1] * plain_game(right, row, known)) / cover


def plain_shapley(tree, row, d):
    out = np.zeros(d)
    for j in range(d):
        others = [i for i in range(d) if i != j]
        for n in range(d):
            for s in itertools.combinations(others, n):
                share = math.factorial(n) * math.factorial(d - 1 - n) / math.factorial(d)
                out[j] += share * (plain_game(tree, row, {*s, j}) - plain_game(tree, row, set(s)))
    return out


def cuts_of(x):
    return [np.unique(x[~np.isnan(x[:, j]), j]) for j in range(x.shape[1])]


@pytest.mark.parametrize("classify", [False, True])
def test_boosted_trees_grow_as_plain_ones_and_contributions_are_shapley_values(data, classify):
    x, y, df = data
    if classify:
        y, df = (y > 1.5).astype(float), df.withColumn("y", (F.col("y") > 1.5).cast("double"))
    model = trees.boost(df, NAMES, "y", classify=classify, trees=3, depth=3, bins=2000, keep_every=2)
    margin = np.full(len(y), math.log(y.mean() / (1 - y.mean())) if classify else y.mean())
    grown = []
    for _ in range(3):
        p = 1 / (1 + np.exp(-margin)) if classify else margin
        tree = plain_tree(x, p - y, p * (1 - p) if classify else np.ones(len(y)), np.ones(len(y)), cuts_of(x), 3, 1.0, 0.3)
        grown.append(tree)
        margin = margin + np.array([plain_value(tree, r) for r in x])
    got = df.where("id < 900").select("id", model.raw().alias("raw"), model.predict().alias("p"), model.parts().alias("parts")).orderBy("id").collect()
    assert [r.raw for r in got] == pytest.approx(margin.tolist())
    assert [r.p for r in got] == pytest.approx((1 / (1 + np.exp(-margin)) if classify else margin).tolist())
    for i in range(0, 240, 13):
        want = sum(plain_shapley(t, x[i], 4) for t in grown)
        assert [p.phi for p in got[i].parts] == pytest.approx(want.tolist(), abs=1e-9)
        assert [p.feature for p in got[i].parts] == NAMES
        assert sum(p.phi for p in got[i].parts) == pytest.approx(got[i].raw - model.expected())


def test_forest_draws_rows_and_grows_all_trees_together(data):
    x, y, df = data
    for share in (None, 0.7):
        model = trees.forest(df, F.col("id"), NAMES, "y", trees=3, depth=3, columns=1.0, bins=2000, seed=5, share=share)
        ids = np.arange(240)
        grown = []
        for t in range(3):
            w = bags.counts(ids, t, 5, share)
            grown.append(plain_tree(x, -y, np.ones(240), w, cuts_of(x), 3, 0.0, 1.0))
        got = df.where("id < 900").select("id", model.predict().alias("p"), model.parts().alias("parts")).orderBy("id").collect()
        assert [r.p for r in got] == pytest.approx([np.mean([plain_value(t, r) for t in grown]) for r in x])
        for i in (0, 17, 99):
            assert [p.phi for p in got[i].parts] == pytest.approx(np.mean([plain_shapley(t, x[i], 4) for t in grown], axis=0).tolist(), abs=1e-9)


def test_trees_of_odd_data(spark, data):
    _, _, df = data
    with pytest.raises(ValueError):
        trees.boost(df.where("id < 0"), NAMES, "y")
    with pytest.raises(ValueError):
        trees.boost(df.withColumn("y", F.lit(1.0)), NAMES, "y", classify=True)
    same = trees.boost(df.withColumn("y", F.lit(2.0)), NAMES, "y", trees=2)
    assert same.expected() == pytest.approx(2.0) and {r.phi for r in df.select(F.explode(same.parts()).alias("p")).select("p.phi").collect()} == {0.0}
    few = trees.forest(df, F.col("id"), NAMES, "y", trees=2, columns=0.25, seed=1)
    assert all((t.feature >= -1).all() for t in few.trees)


def test_bags_draw_single_rows(data):
    x, y, df = data
    good = ~np.isnan(x).any(axis=1)
    ids, z, t = np.arange(240)[good], x[good], y[good]

    def plain(c, at):
        a = np.c_[np.ones(len(z)), z[:, at]]
        w = np.zeros(5)
        w[[0, *[1 + j for j in at]]] = np.linalg.lstsq(a * np.sqrt(c)[:, None], t * np.sqrt(c), rcond=None)[0]
        return w

    for share in (None, 0.6):
        bag = bags.fit_linear(df, F.col("id"), NAMES, "y", 50, share=share, columns=0.5, seed=3)
        for m in range(50):
            assert bag.models[m] == pytest.approx(plain(bags.counts(ids, m, 3, share), list(bags.columns_of(m, 4, 0.5, 3))))
    c = np.concatenate([bags.counts(np.arange(20000), m, 0, None) for m in range(5)])
    assert c.mean() == pytest.approx(1, abs=0.02) and c.var() == pytest.approx(1, abs=0.05)
    got = df.where("id < 900").select("id", bag.predict().alias("p")).dropna().orderBy("id").toPandas()["p"].to_numpy()
    assert got == pytest.approx(np.c_[np.ones(len(z)), z] @ np.mean(bag.models, axis=0))


def test_weighted_bags_score_on_folds_or_on_a_holdout(data):
    x, y, df = data
    good = ~np.isnan(x).any(axis=1)
    ids, z, t = np.arange(240)[good], np.c_[np.ones(good.sum()), x[good]], y[good]
    solve = lambda c: np.linalg.lstsq(z * np.sqrt(c)[:, None], t * np.sqrt(c), rcond=None)[0]
    mse = lambda c, w: -(c * (t - z @ w) ** 2).sum() / c.sum()
    held = ids % 4 == 0
    bag = bags.fit_linear(df, F.col("id"), NAMES, "y", 4, seed=2, weighted=True, holdout=F.col("id") % 4 == 0, metric="neg_mse")
    cs = [bags.counts(ids, m, 2, None) for m in range(4)]
    ws = [solve(c * ~held) for c in cs]
    assert np.array(bag.models) == pytest.approx(np.array(ws))
    assert bag.votes == pytest.approx(learners.vote_weights([mse(c * held, w) for c, w in zip(cs, ws, strict=True)]))
    bag = bags.fit_linear(df, F.col("id"), NAMES, "y", 4, seed=2, weighted=True, folds=F.col("id") % 3, metric="neg_mse")
    scores = [np.mean([mse(c * (ids % 3 == f), solve(c * (ids % 3 != f))) for f in range(3)]) for c in cs]
    assert bag.votes == pytest.approx(learners.vote_weights(scores))
    with pytest.raises(ValueError):
        bags.fit_linear(df, F.col("id"), NAMES, "y", 2, weighted=True)


def test_bags_of_logistic_models(data):
    x, y, df = data
    good = ~np.isnan(x).any(axis=1)
    ids, z, t = np.arange(240)[good], x[good], (y[good] > 1.5).astype(float)
    bag = bags.fit_logistic(df.withColumn("y", (F.col("y") > 1.5).cast("int")), F.col("id"), NAMES, "y", 3, seed=4)
    mean, std = z.mean(0), z.std(0)
    for m in range(3):
        c = bags.counts(ids, m, 4, None).astype(int)
        a, w = np.c_[np.ones(len(z)), (z - mean) / std], np.zeros(5)
        for _ in range(25):
            p = 1 / (1 + np.exp(-a @ w))
            w = logistic.newton_step(w, a.T @ (c * (p - t)), (a * (c * p * (1 - p))[:, None]).T @ a, 1.0)
        assert bag.models[m] == pytest.approx(logistic.unscaled(w, mean, std), rel=1e-5, abs=1e-6)
    got = df.where("id < 900").select("id", bag.predict().alias("p")).dropna().orderBy("id").toPandas()["p"].to_numpy()
    assert got == pytest.approx(np.mean([1 / (1 + np.exp(-(np.c_[np.ones(len(z)), z] @ w))) for w in bag.models], axis=0))
