"""Linear learners, searches and ensembles from moments: one pass over the data serves every subset, penalty and fold.

The moments of z = (1, features, target) are the sums of z_i * z_j. A training set's moments are the total's less those
of the held-out fold, and a model's squared error on a fold follows from the fold's moments alone. A search over any
number of candidates therefore reads the data once; (d + 2)^2 numbers for each fold reach the driver, whatever the
number of rows. Rows with a null feature or target are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Moments = dict[int, np.ndarray]


def moments(df: DataFrame, features: list[str], target: str, fold: Column | None = None) -> Moments:
    """A matrix for each fold; folds are numbered, and few."""
    z = [F.lit(1.0), *[F.col(c).cast("double") for c in (*features, target)]]
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    rows = df.dropna(subset=[*features, target]).groupBy((F.lit(0) if fold is None else fold).cast("int").alias("fold"))
    out = {}
    for r in rows.agg(*[F.sum(z[i] * z[j]).alias(f"m{i}_{j}") for i, j in pairs]).collect():
        m = np.zeros((len(z), len(z)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"m{i}_{j}"]
        out[r["fold"]] = m
    return out


def total(m: Moments) -> np.ndarray:
    return np.sum(list(m.values()), axis=0)


def fit(m: np.ndarray, subset: tuple[int, ...], alpha: float = 0.0) -> np.ndarray:
    """Weights (intercept first, then all features, those outside the subset 0) of least squares with an L2 penalty."""
    at = [0, *[1 + j for j in subset]]
    a = m[np.ix_(at, at)] + alpha * np.diag([0.0] + [1.0] * len(subset))
    size = np.sqrt(np.maximum(np.diag(a), 1e-300))  # columns of one scale
    w = np.zeros(len(m) - 1)
    w[at] = np.linalg.lstsq(a / np.outer(size, size), m[at, -1] / size, rcond=1e-13)[0] / size
    return w


def squared_error(m: np.ndarray, w: np.ndarray) -> float:
    v = np.append(w, -1.0)
    return float(v @ m @ v)


def score(m: np.ndarray, w: np.ndarray, metric: str = "r2") -> float:
    """r2, or neg_mse: higher is better."""
    error = squared_error(m, w)
    if metric == "neg_mse":
        return float(-error / m[0, 0])
    return float(1 - error / (m[-1, -1] - m[0, -1] ** 2 / m[0, 0]))


def cross_validate(m: Moments, subset: tuple[int, ...], alpha: float = 0.0, metric: str = "r2") -> list[float]:
    every = total(m)
    return [score(m[f], fit(every - m[f], subset, alpha), metric) for f in sorted(m)]


@dataclass(frozen=True)
class Trial:
    """cost is the number of features: of two trials with equal effects the one that costs less is better."""

    subset: tuple[int, ...]
    alpha: float
    effect: float

    @property
    def cost(self) -> int:
        return len(self.subset)


def try_out(m: Moments, subset: tuple[int, ...], alpha: float = 0.0, metric: str = "r2") -> Trial:
    return Trial(tuple(sorted(subset)), alpha, float(np.mean(cross_validate(m, subset, alpha, metric))))


def best_of(trials: list[Trial], err: float = 0.0) -> Trial:
    """Folded in order: a better effect wins, and one within err wins if it costs less."""
    best = trials[0]
    for t in trials[1:]:
        if t.effect > best.effect + err or (abs(t.effect - best.effect) <= err and t.cost < best.cost):
            best = t
    return best


def draw(rng: np.random.Generator, pool: list[int], least: int = 1, size: int | float | None = None, p: np.ndarray | None = None) -> tuple[int, ...]:
    """Features without replacement: any number from least on, a share of the pool, or exactly size."""
    n = int(rng.integers(least, max(least + 1, len(pool)))) if size is None else int(len(pool) * size) if isinstance(size, float) else size
    return tuple(rng.choice(pool, max(1, min(n, len(pool))), replace=False, p=p).tolist())


def random_search(m: Moments, n: int, seed: int = 0, **how) -> list[Trial]:
    """The trial of all features, then n random subsets."""
    d, rng = len(total(m)) - 2, np.random.default_rng(seed)
    return [try_out(m, tuple(range(d)))] + [try_out(m, draw(rng, list(range(d)), **how)) for _ in range(n)]


def importance(m: Moments) -> np.ndarray:
    """Absolute weights times the features' deviations."""
    t = total(m)
    n, d = t[0, 0], len(t) - 2
    deviation = np.sqrt(np.maximum(np.diag(t)[1:-1] / n - (t[0, 1:-1] / n) ** 2, 0))
    return np.abs(fit(t, tuple(range(d)))[1:]) * deviation


def weighted_search(m: Moments, n: int, seed: int = 0, **how) -> list[Trial]:
    """As random_search, features drawn by the normalised sigmoid of their share of importance."""
    share = importance(m)
    p = 1 / (1 + np.exp(-share / max(share.sum(), 1e-300)))
    return random_search(m, n, seed, p=p / p.sum(), **how)


def las_vegas_search(m: Moments, patience: int, seed: int = 0, err: float = 0.0) -> list[Trial]:
    """Draws inside the best subset so far, until `patience` draws in a row bring nothing better."""
    rng = np.random.default_rng(seed)
    trials = [try_out(m, tuple(range(len(total(m)) - 2)))]
    best, idle = trials[0], 0
    while idle < patience:
        t = try_out(m, draw(rng, list(best.subset)))
        trials.append(t)
        new = best_of([best, t], err)
        best, idle = new, 0 if new is t else idle + 1
    return trials


def top_ratio_search(m: Moments, ratios: list[float]) -> list[Trial]:
    """Prefixes of the order of importance; features without any don't count."""
    share = importance(m)
    order = [int(j) for j in np.argsort(-share, kind="stable") if share[j] > 0]
    return [try_out(m, tuple(order[: max(1, int(len(order) * r))])) for r in ratios]


def grid_search(m: Moments, subsets: list[tuple[int, ...]], alphas: list[float]) -> list[Trial]:
    return [try_out(m, s, a) for s in subsets for a in alphas]


def as_table(spark: SparkSession, trials: list[Trial], features: list[str], err: float = 0.0) -> DataFrame:
    """trial, features, alpha, effect and whether the trial is the best."""
    best = best_of(trials, err)
    rows = [(i, ",".join(features[j] for j in t.subset), float(t.alpha), t.effect, t is best) for i, t in enumerate(trials)]
    return spark.createDataFrame(rows, "trial long, features string, alpha double, effect double, best boolean")


def linear(w: np.ndarray, features: list[str]) -> Column:
    return sum((F.lit(float(x)) * F.col(c) for x, c in zip(w[1:], features, strict=True) if x), F.lit(float(w[0])))


def parts_of(features: list[str], w: np.ndarray, means: np.ndarray) -> Column:
    """Contributions of a linear model as an array of (feature, phi, value) for each row."""
    return F.array(*[
        F.struct(F.lit(c).alias("feature"), (F.lit(float(x)) * (F.col(c) - F.lit(float(a)))).alias("phi"), F.col(c).cast("double").alias("value"))
        for c, x, a in zip(features, w[1:], means, strict=True)
    ])


def contributions(df: DataFrame, key: str, features: list[str], w: np.ndarray, means: np.ndarray) -> DataFrame:
    """(key, feature, phi, value) of a linear model: weight times the distance from the feature's mean."""
    return df.select(key, F.explode(parts_of(features, w, means)).alias("x")).select(key, "x.*")


@dataclass
class Stack:
    """Base models by fold, their scores, and the meta model on their out-of-fold predictions."""

    features: list[str]
    by_fold: list[dict[int, np.ndarray]]
    scores: list[float]
    meta: np.ndarray

    def names(self) -> list[str]:
        return [f"p{i}" for i in range(len(self.by_fold))]

    def out_of_fold(self, df: DataFrame, fold: Column) -> DataFrame:
        """Adds each base's prediction by the model that hasn't seen the row's fold."""
        pick = lambda ws: F.coalesce(*[F.when(fold == f, linear(w, self.features)) for f, w in sorted(ws.items())])
        return df.withColumns({n: pick(ws) for n, ws in zip(self.names(), self.by_fold, strict=True)})

    def predict(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        """Adds the meta model's prediction from the means of the fold models."""
        means = [np.mean(list(ws.values()), axis=0) for ws in self.by_fold]
        whole = np.sum([v * w for v, w in zip(self.meta[1:], means, strict=True)], axis=0)
        whole[0] += self.meta[0]
        return df.withColumn(name, linear(whole, self.features))


def stack(df: DataFrame, features: list[str], target: str, fold: Column, bases: list[tuple[int, ...]], *, choose=None) -> Stack:
    """bases: the base learners' subsets; choose takes their scores and returns the places of those to keep. Two passes."""
    m = moments(df, features, target, fold)
    every = total(m)
    scores = [float(np.mean(cross_validate(m, b))) for b in bases]
    kept = list(range(len(bases))) if choose is None else list(choose(scores))
    out = Stack(features, [{f: fit(every - m[f], bases[b]) for f in m} for b in kept], [scores[b] for b in kept], np.zeros(0))
    meta = total(moments(out.out_of_fold(df.dropna(subset=[*features, target]), fold), out.names(), target))
    out.meta = fit(meta, tuple(range(len(kept))))
    return out


def blend(df: DataFrame, features: list[str], target: str, holdout: Column, bases: list[tuple[int, ...]]) -> Stack:
    """Bases learn outside the holdout, the meta model on it."""
    m = moments(df, features, target, holdout.cast("int"))
    out = Stack(features, [{1: fit(m[0], b)} for b in bases], [score(m[1], fit(m[0], b)) for b in bases], np.zeros(0))
    part = df.where(holdout).dropna(subset=[*features, target])
    out.meta = fit(total(moments(out.out_of_fold(part, F.lit(1)), out.names(), target)), tuple(range(len(bases))))
    return out


def bag(m: Moments, n: int, share: float | None = 0.8, seed: int = 0, columns: float = 1.0) -> list[np.ndarray]:
    """n models' weights. m has moments of hash buckets of rows: a model takes a share of these, or with None as many
    with replacement. The data are read once, whatever the number of models."""
    rng, keys = np.random.default_rng(seed), sorted(m)
    d = len(total(m)) - 2
    out = []
    for _ in range(n):
        took = rng.choice(keys, len(keys), replace=True) if share is None else rng.choice(keys, max(1, int(len(keys) * share)), replace=False)
        subset = tuple(sorted(rng.choice(d, max(1, int(d * columns)), replace=False).tolist()))
        out.append(fit(np.sum([m[k] for k in took.tolist()], axis=0), subset))
    return out


def vote_weights(scores: list[float]) -> np.ndarray:
    """Sigmoids of the scores, over their sum."""
    s = 1 / (1 + np.exp(-np.asarray(scores)))
    return s / s.sum()
