"""Ensembles of models that each learn from their own draw of single rows.

How often a row counts for a model follows from a hash of the row's key and the model's number, so all models' draws are
made in one pass, a row needs no state, and a task that runs again draws the same. With replacement the count has a
Poisson law of mean 1, the limit of a bootstrap's; without it a row counts once with the probability `share`.

Linear models take one pass for any number of models: tasks sum count * z * z' for each model, and what is added over
the cluster and sent to the driver is a matrix of moments for each model and fold, whatever the number of rows. Logistic
models take a pass for each Newton step. Rows with a null feature or target are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import learners, logistic
from sparkloom.operators.tables import staged

U = np.uint64
#: The increment and multipliers of a 64-bit mixing function.
STEP, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Rows that a task multiplies at once.
ROWS = 8192
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 25)]))


def uniform(keys: np.ndarray, model: int, seed: int) -> np.ndarray:
    """A number from 0 to 1 for each 64-bit key."""
    x = keys.astype(np.int64).view(np.uint64) + U((STEP * (model + 1 + 1_000_003 * seed)) % (1 << 64))
    x = (x ^ (x >> U(30))) * U(MIX_A)
    x = (x ^ (x >> U(27))) * U(MIX_B)
    return ((x ^ (x >> U(31))) >> U(11)).astype(np.float64) / (1 << 53)


def counts(keys: np.ndarray, model: int, seed: int, share: float | None) -> np.ndarray:
    """How often each row counts: with replacement where share is None, else once or not at all."""
    u = uniform(keys, model, seed)
    return np.searchsorted(_POISSON, u, side="right").astype(float) if share is None else (u < share).astype(float)


def columns_of(model: int, d: int, columns: float, seed: int) -> tuple[int, ...]:
    """The features that a model gets: a share of them, drawn."""
    return tuple(sorted(np.random.default_rng([seed, model]).choice(d, max(1, int(d * columns)), replace=False).tolist()))


def _numbers(df: DataFrame, key: Column, features: list[str], target: str, fold: Column | None) -> DataFrame:
    rows = df.dropna(subset=[*features, target])
    return rows.select(key.cast("long").alias("_key"), (F.lit(0) if fold is None else fold).cast("int").alias("_fold"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate([*features, target])])


def _summed(rows: DataFrame, width: int, work: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[int, int, np.ndarray]]]) -> dict[tuple[int, int], np.ndarray]:
    """Adds up, by (model, fold), the arrays that work(keys, folds, values) makes of a task's rows."""

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                key, fold, *x = (c.to_numpy() for c in part.columns)
                for model, f, a in work(key, fold, np.column_stack(x)):
                    sums[model, f] = sums[model, f] + a if (model, f) in sums else a
        for (model, f), a in sums.items():
            n = a.size
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, model)), pa.array(np.full(n, f)), pa.array(np.arange(n)), pa.array(a.ravel())], names=["model", "fold", "at", "value"])

    made = rows.mapInArrow(run, "model long, fold long, at long, value double")
    out: dict[tuple[int, int], np.ndarray] = {}
    for r in made.groupBy("model", "fold", "at").agg(F.sum("value").alias("value")).collect():
        out.setdefault((r.model, r.fold), np.zeros(width))[r["at"]] = r.value
    return out


def moments(
    df: DataFrame, key: Column, features: list[str], target: str, n: int, *, share: float | None = None, seed: int = 0, fold: Column | None = None
) -> list[learners.Moments]:
    """For each model the moments of its rows, by fold."""
    size = len(features) + 2

    def work(keys, folds, x):
        z = np.column_stack([np.ones(len(x)), x])
        for f in np.unique(folds).tolist():
            own, k = z[folds == f], keys[folds == f]
            for model in range(n):
                yield model, f, (own * counts(k, model, seed, share)[:, None]).T @ own

    sums = _summed(_numbers(df, key, features, target, fold), size * size, work)
    return [{f: a.reshape(size, size) for (m, f), a in sums.items() if m == model} for model in range(n)]


@dataclass
class Bag:
    """Models' weights (intercept first), what each is worth in the vote, and whether they give log odds."""

    features: list[str]
    models: list[np.ndarray]
    votes: np.ndarray
    odds: bool = False

    def predict(self) -> Column:
        """The vote: for linear models one linear expression, for logistic ones their probabilities, weighted."""
        if not self.odds:
            return learners.linear(np.array(self.models).T @ self.votes, self.features)
        return sum((float(v) * logistic.probability(w, self.features) for v, w in zip(self.votes, self.models, strict=True)), F.lit(0.0))


def fit_linear(
    df: DataFrame, key: Column, features: list[str], target: str, n: int, *, share: float | None = None, columns: float = 1.0, seed: int = 0,
    weighted: bool = False, folds: Column | None = None, holdout: Column | None = None, metric: str = "r2",
) -> Bag:
    """n least-squares models. With weighted, a model votes by its metric: over folds of its own rows, or, if there are none, on
    the held-out rows, which then no model learns from."""
    held = folds if folds is not None else holdout.cast("int") if holdout is not None else None
    if weighted and held is None:
        raise ValueError("a weighted vote needs folds or a holdout")
    every = moments(df, key, features, target, n, share=share, seed=seed, fold=held)
    subsets = [columns_of(m, len(features), columns, seed) for m in range(n)]
    learn = [{0: m[0]} if folds is None and holdout is not None else m for m in every]
    models = [learners.fit(learners.total(m), s) for m, s in zip(learn, subsets, strict=True)]
    if not weighted:
        return Bag(features, models, np.full(n, 1 / n))
    if folds is not None:
        scores = [float(np.mean(learners.cross_validate(m, s, metric=metric))) for m, s in zip(every, subsets, strict=True)]
    else:
        scores = [learners.score(m[1], w, metric) for m, w in zip(every, models, strict=True)]
    return Bag(features, models, learners.vote_weights(scores))


def fit_logistic(
    df: DataFrame, key: Column, features: list[str], target: str, n: int, *, share: float | None = None, columns: float = 1.0, seed: int = 0,
    alpha: float = 1.0, rounds: int = 25, tolerance: float = 1e-8,
) -> Bag:
    """n logistic models of a target of 0 and 1. A pass steps all models that still move: those whose largest step is over tolerance."""
    d = len(features)
    subsets = [columns_of(m, d, columns, seed) for m in range(n)]
    with staged(_numbers(df, key, features, target, None)) as rows:
        first = rows.agg(*[f(f"_x{i}").alias(f"{s}{i}") for i in range(d) for s, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        if first is None or first["m0"] is None:
            raise ValueError("no rows to learn from")
        mean, std = (np.array([first[f"{s}{i}"] for i in range(d)]) for s in "ms")
        std = np.where(std > 0, std, 1.0)
        ws = [np.zeros(d + 1) for _ in range(n)]
        moving = list(range(n))
        for _ in range(rounds):
            now = {m: ws[m] for m in moving}

            def work(keys, folds, x, now=now):
                z = np.column_stack([np.ones(len(x)), (x[:, :d] - mean) / std])
                for m, w in now.items():
                    c = counts(keys, m, seed, share)
                    p = 1 / (1 + np.exp(-(z @ w)))
                    curve = (z * (c * p * (1 - p))[:, None]).T @ z
                    yield m, 0, np.append(z.T @ (c * (p - x[:, d])), curve.ravel())

            sums = _summed(rows, (d + 1) * (d + 2), work)
            after = []
            for m in moving:
                at = [0, *[1 + j for j in subsets[m]]]
                gradient, curve = sums[m, 0][: d + 1], sums[m, 0][d + 1 :].reshape(d + 1, d + 1)
                w = ws[m].copy()
                w[at] = logistic.newton_step(w[at], gradient[at], curve[np.ix_(at, at)], alpha)
                if np.abs(w - ws[m]).max() > tolerance:
                    after.append(m)
                ws[m] = w
            if not (moving := after):
                break
    return Bag(features, [logistic.unscaled(w, mean, std) for w in ws], np.full(n, 1 / n), odds=True)
