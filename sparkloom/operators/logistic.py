"""Logistic learners: Newton steps from sums over the data, for the models of all folds at once.

The columns asked for are written once, and a step reads them once, whatever the number of models, until no weight moves; each model's gradient and second derivatives, (d + 1)(d + 4) / 2
numbers, reach the driver. Features are brought to one scale first. Rows with a null feature or target are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.learners import linear
from sparkloom.operators.tables import staged

#: Steps at most, and how far a weight (of features of one scale) moves when it has settled.
ROUNDS, SETTLED = 8, 1e-9


def newton_step(w: np.ndarray, gradient: np.ndarray, curve: np.ndarray, alpha: float) -> np.ndarray:
    penalty = alpha * np.append(0.0, np.ones(len(w) - 1))
    return w - np.linalg.solve(curve + np.diag(penalty + 1e-9), gradient + penalty * w)


def fit_rows(x: np.ndarray, y: np.ndarray, alpha: float = 1.0, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (intercept first) from rows in memory."""
    mean, std = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    z = np.c_[np.ones(len(x)), (x - mean) / std]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z @ w))
        w = newton_step(w, z.T @ (p - y), (z * (p * (1 - p))[:, None]).T @ z, alpha)
    return unscaled(w, mean, std)


def unscaled(w: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    out = np.append(w[0], w[1:] / std)
    out[0] -= out[1:] @ mean
    return out


def fit(df: DataFrame, features: list[str], target: str, *, alpha: float = 1.0, fold: Column | None = None, rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """Weights (intercept first) by held-out fold: each model learns from the rows of all other folds. Without folds one
    model, 0, learns from all rows. target is 0 or 1."""
    numbers = df.dropna(subset=[*features, target]).select(*[F.col(c).cast("double").alias(c) for c in features], F.col(target).cast("double").alias("_y"), (F.lit(-1) if fold is None else fold).cast("int").alias("_f"))
    with staged(numbers) as rows:
        return _fit(rows, features, alpha, fold is not None, rounds)


def _fit(rows: DataFrame, features: list[str], alpha: float, folds: bool, rounds: int) -> dict[int, np.ndarray]:
    first = rows.agg(*[f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))], F.collect_set("_f").alias("folds")).first()
    mean, std = (np.array([first[f"{n}_{c}"] for c in features], float) for n in "ms")
    std = np.where(std > 0, std, 1.0)
    models = sorted(first["folds"]) if folds else [0]
    z = [F.lit(1.0), *[(F.col(c) - float(m)) / float(s) for c, m, s in zip(features, mean, std, strict=True)]]
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    ws = {f: np.zeros(len(z)) for f in models}
    # weights come as a row, so that the plan of every step is the same and is compiled once
    name = lambda f, i: f"_w{f}_{i}"
    schema = ", ".join(f"{name(f, i)} double" for f in models for i in range(len(z)))
    sums = []
    for f in models:
        own = F.when(F.col("_f") != f, F.lit(1.0)).otherwise(0.0)
        p = F.col(f"_p{f}")
        sums += [F.sum(own * (p - F.col("_y")) * c).alias(f"g{f}_{i}") for i, c in enumerate(z)]
        sums += [F.sum(own * p * (1 - p) * z[i] * z[j]).alias(f"h{f}_{i}_{j}") for i, j in pairs]
    odds = {f"_p{f}": 1 / (1 + F.exp(-sum((F.col(name(f, i)) * c for i, c in enumerate(z)), F.lit(0.0)))) for f in models}
    for _ in range(rounds):
        now = rows.sparkSession.createDataFrame([[float(v) for f in models for v in ws[f]]], schema)
        got, moved = rows.crossJoin(F.broadcast(now)).withColumns(odds).agg(*sums).first(), 0.0
        for f in ws:
            curve = np.zeros((len(z), len(z)))
            for i, j in pairs:
                curve[i, j] = curve[j, i] = got[f"h{f}_{i}_{j}"]
            after = newton_step(ws[f], np.array([got[f"g{f}_{i}"] for i in range(len(z))]), curve, alpha)
            moved = max(moved, float(np.abs(after - ws[f]).max()))
            ws[f] = after
        if moved <= SETTLED:
            break
    return {f: unscaled(w, mean, std) for f, w in ws.items()}


def probability(w: np.ndarray, features: list[str]) -> Column:
    return 1 / (1 + F.exp(-linear(w, features)))


def out_of_fold(models: dict[int, np.ndarray], features: list[str], fold: Column) -> Column:
    """The probability by the model that hasn't seen the row's fold."""
    return F.coalesce(*[F.when(fold == f, probability(w, features)) for f, w in sorted(models.items())])


def log_loss(p: Column, y: Column) -> Column:
    near = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    return -F.avg(y * F.log(near) + (1 - y) * F.log(1 - near))
