"""Weights of words from shuffled sums against a dense fit of the same steps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import sparse_text
from sparkloom.operators import selection

WORDS = [f"w{i}" for i in range(30)]


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(200):
        words = ["the"] * int(rng.integers(1, 4)) + rng.choice(WORDS, int(rng.integers(0, 9))).tolist()
        y = float(("w1" in words) or ("w2" in words and "w3" not in words))
        rows.append((i, " ".join(words), y))
    rows += [(200, "", 1.0), (201, None, 0.0), (202, "w1 new", None)]
    return rows, spark.createDataFrame(rows, "k long, text string, y double").repartition(3)


def tokens():
    return F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")


def dense(rows, rounds, alpha):
    """The same steps over a dense matrix; returns weights by word and the intercept."""
    known = [(t.split() if t else [], y) for _, t, y in rows if y is not None]
    words = sorted({w for t, _ in known for w in t})
    x = np.array([[t.count(w) for w in words] for t, _ in known], float)
    y, size = np.array([y for _, y in known]), np.array([len(t) for t, _ in known], float)
    w, b = np.zeros(len(words)), 0.0
    curve, top = (x * (size + 1)[:, None]).sum(0) / 4, ((size + 1) / 4).sum()
    losses = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        losses.append(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum() + alpha / 2 * w @ w)
        w, b = w - (x.T @ (p - y) + alpha * w) / (curve + alpha), b - (p - y).sum() / top
    return dict(zip(words, w, strict=True)), b, losses


@pytest.mark.parametrize("share", [1.0, 1 / 2000, 1e-9])
def test_weights_are_those_of_a_dense_fit(texts, monkeypatch, tmp_path, share):
    """With no hot token, with those that are by default, and with all."""
    rows, df = texts
    monkeypatch.setattr(sparse_text, "HOT", share)
    model = sparse_text.fit(df, "k", tokens(), "y", rounds=4, tolerance=0.0, out=f"file://{tmp_path}/w")
    want, intercept, losses = dense(rows, 4, 1.0)
    got = {r.token: r.w for r in model.table().collect()}
    assert got == pytest.approx(want) and model.intercept == pytest.approx(intercept)
    assert all(a > b for a, b in zip(losses, losses[1:], strict=False))
    assert (len(model.hot) == 0) == (share == 1.0)


def test_contributions_of_words_add_up_to_the_odds(texts, tmp_path):
    rows, df = texts
    model = sparse_text.fit(df, "k", tokens(), "y", rounds=3, out=f"file://{tmp_path}/w")
    want, intercept, _ = dense(rows, 3, 1.0)
    got = {r.k: r for r in sparse_text.explain(df, "k", tokens(), model, padding="the").collect()}
    assert set(got) == set(range(203))
    for k, text, _ in rows:
        words = (text or "").split()
        assert got[k].odds == pytest.approx(intercept + sum(want.get(w, 0.0) for w in words))
        assert {p.feature: p.value for p in got[k].parts} == {w: words.count(w) for w in words if w != "the"}
        shown = math.fsum(p.phi for p in got[k].parts) + words.count("the") * want["the"]
        assert shown == pytest.approx(got[k].odds - intercept)
    assert got[202].parts[0].feature == "new" and got[202].parts[0].phi == 0.0
    top = sparse_text.explain(df, "k", tokens(), model).select("k", selection.top_of_row(F.col("parts"), 1, "max").alias("top")).where("k = 202").first()
    assert [x.feature for x in top.top] == ["w1"]


def test_no_texts(texts, tmp_path):
    with pytest.raises(ValueError):
        sparse_text.fit(texts[1].where("k < 0"), "k", tokens(), "y", out=f"file://{tmp_path}/w")
