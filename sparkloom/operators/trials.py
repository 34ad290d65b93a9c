"""Candidates tried in tasks by any learner, a row for each candidate and fold.

The data are written once, as Parquet by fold, to the folder that driver and executors share, and deleted when the trials
have ended. A task reads the columns of its candidate and the folds that it needs from there, so neither rows nor a
broadcast pass through the driver, and an executor that is lost costs its trials only. What the driver gets is a score for
each candidate and fold.

A learner that takes all its rows at once needs them in a task's memory. One that learns from batches (`stream`) gets
them one at a time, as often as it asks; predictions are made by batch in either case.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.ranking import hash_rank
from sparkloom.operators.tables import staged_at

#: Rows that a task reads at once.
BATCH_ROWS = 65_536

Batches = Callable[[], Iterator[tuple[np.ndarray, np.ndarray]]]
Fit = Callable[[dict, np.ndarray, np.ndarray], object] | Callable[[dict, Batches], object]
Predict = Callable[[object, np.ndarray], np.ndarray]
Metric = Callable[[np.ndarray, np.ndarray], float]


def read_folds(path: str, columns: list[str], held: int, out: bool, *more: str) -> Batches:
    """The rows in the held-out fold, or outside it, in the order in which they are laid out: features, targets and further columns."""

    def batches() -> Iterator[tuple[np.ndarray, ...]]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(path)
        rows = ds.dataset(place, filesystem=system, format="parquet", partitioning="hive")
        own = ds.field("fold") == held
        for batch in rows.to_batches(columns=[*columns, "_target", *more], filter=own if out else ~own, batch_size=BATCH_ROWS):
            if batch.num_rows:
                rest = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("_target", *more)]
                yield np.column_stack([batch.column(c).to_numpy() for c in columns]), *rest

    return batches


def together(batches: Batches, width: int) -> tuple[np.ndarray, np.ndarray]:
    parts = list(batches())
    return (np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts])) if parts else (np.empty((0, width)), np.empty(0))


def _numbers(data: DataFrame, key: str, features: list[str], target: str, fold: Column | None, folds: int, seed: int, holdout: float | None, keep: bool = False) -> tuple[DataFrame, int]:
    """Features as x0, x1, ..., _target and fold of rows without nulls, and the number of folds; with keep the key too."""
    rows = data.dropna(subset=[*features, target])
    numbers = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)] + [F.col(target).cast("double").alias("_target")] + [F.col(key).alias("_key")] * keep
    if fold is not None:
        given = rows.select(*numbers, fold.cast("int").alias("fold"))
        return given, int((given.agg(F.max("fold")).first()[0] if not holdout else 0) or 0) + 1
    placed = hash_rank(rows.select(key, *features, target), F.col(key), seed, name="_rank")
    held = F.when(F.col("_rank") < int(rows.count() * holdout), 0).otherwise(1) if holdout else F.pmod("_rank", F.lit(folds))
    return placed.select(*numbers, held.cast("int").alias("fold")), 1 if holdout else folds


def _tasks(data: DataFrame, n: int) -> DataFrame:
    spark = data.sparkSession
    return spark.range(n).repartition(max(1, min(n, 4 * spark.sparkContext.defaultParallelism)))


def evaluate(
    data: DataFrame, key: str, features: list[str], target: str, candidates: list[dict], fit: Fit, predict: Predict, metric: Metric,
    *, folds: int = 5, seed: int = 42, holdout: float | None = None, fold: Column | None = None, update: Callable[[object, dict], dict] | None = None, stream: bool = False,
) -> DataFrame:
    """candidate, params (JSON), fold, effect and seconds of every candidate on every fold.

    A candidate is a dictionary of parameters; `features` in it names its subset. With holdout there is one fold, that
    share of the rows, and update(model, params) may return the parameters that a fit has found. fold gives the rows' folds,
    from 0; a row of another number is always learned from. fit gets parameters, features and targets, or with stream
    parameters and a function that starts a pass over batches of both. metric gets the fold's targets and predictions.
    Rows with nulls are left out.
    """
    numbers, used = _numbers(data, key, features, target, fold, folds, seed, holdout)
    with staged_at(numbers, "fold") as path:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for i in batch["id"]:
                    c, f = divmod(int(i), used)
                    params = dict(candidates[c])
                    own = [f"x{features.index(name)}" for name in params.pop("features", features)]
                    start = time.perf_counter()
                    learn = read_folds(path, own, f, False)
                    model = fit(params, learn) if stream else fit(params, *together(learn, len(own)))
                    seen = [(y, predict(model, x)) for x, y in read_folds(path, own, f, True)()]
                    effect = metric(*(np.concatenate([s[k] for s in seen]) if seen else np.empty(0) for k in (0, 1)))
                    found = {**candidates[c], **(update(model, params) if update else {})}
                    out.append((c, json.dumps(found, sort_keys=True), f, float(effect), time.perf_counter() - start))
                yield pd.DataFrame(out, columns=["candidate", "params", "fold", "effect", "seconds"])

        schema = "candidate long, params string, fold long, effect double, seconds double"
        rows = _tasks(data, len(candidates) * used).mapInPandas(run, schema).collect()
    return data.sparkSession.createDataFrame([tuple(r) for r in rows], schema)


def out_of_fold(
    data: DataFrame, key: str, features: list[str], target: str, candidates: list[dict], fit: Fit, predict: Predict, out: str,
    *, folds: int = 5, seed: int = 42, holdout: float | None = None, fold: Column | None = None, stream: bool = False,
) -> DataFrame:
    """key, the target as y, fold and p0, p1, ...: each candidate's prediction of a row by the model that hasn't seen its fold.

    With holdout, or where fold gives another number to some rows, only held-out rows are predicted: what a blend learns
    from. Tasks write what they predict to the folder `out`, a batch at a time. Keys are unique.
    """
    numbers, used = _numbers(data, key, features, target, fold, folds, seed, holdout, True)
    kind = numbers.schema["_key"].dataType.simpleString()
    with staged_at(numbers, "fold") as path:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for i in batch["id"]:
                    c, f = divmod(int(i), used)
                    params = dict(candidates[c])
                    own = [f"x{features.index(name)}" for name in params.pop("features", features)]
                    learn = read_folds(path, own, f, False)
                    model = fit(params, learn) if stream else fit(params, *together(learn, len(own)))
                    for x, y, keys in read_folds(path, own, f, True, "_key")():
                        yield pd.DataFrame({"candidate": c, key: keys, "y": y, "fold": f, "p": np.asarray(predict(model, x), float)})

        schema = f"candidate int, `{key}` {kind}, y double, fold int, p double"
        _tasks(data, len(candidates) * used).mapInPandas(run, schema).write.mode("overwrite").parquet(out)
    long = data.sparkSession.read.schema(schema).parquet(out)
    return long.groupBy(key, "y", "fold").agg(*[F.max(F.when(F.col("candidate") == c, F.col("p"))).alias(f"p{c}") for c in range(len(candidates))])


def summary(trials: DataFrame) -> DataFrame:
    """trial, effect (the mean over folds) and seconds: what selection.best_trial takes."""
    return trials.groupBy(F.col("candidate").alias("trial")).agg(F.avg("effect").alias("effect"), F.sum("seconds").alias("seconds"))


def grid(space: dict[str, list]) -> list[dict]:
    """All combinations."""
    out: list[dict] = [{}]
    for name, values in space.items():
        out = [{**c, name: v} for c in out for v in values]
    return out


def subsets(features: list[str], least: int | float, n: int, seed: int = 0) -> list[dict]:
    """All features, then n random subsets of at least `least` of them, a number or a share."""
    if isinstance(least, float) and not 0 < least <= 1 or isinstance(least, int) and not 0 < least <= len(features):
        raise ValueError("least must be a share, or a number of features")
    low = max(1, int(len(features) * least)) if isinstance(least, float) else least
    rng = np.random.default_rng(seed)
    drawn = [sorted(rng.choice(len(features), int(rng.integers(low, len(features) + 1)), replace=False).tolist()) for _ in range(n)]
    return [{"features": list(features)}, *({"features": [features[j] for j in d]} for d in drawn)]
