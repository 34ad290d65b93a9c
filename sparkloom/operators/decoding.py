"""Decoding of tag scores along sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Tags up to which products of a position's moves cost less than a step of Python; positions that are worked on at once.
FEW_TAGS, POSITIONS = 8, 100_000


def best_path(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """The path with the highest sum of scores[t, k] and moves[from, to]; of equal ones the smaller tags from the end."""
    if not len(scores):
        return []
    at, back = scores[0], []
    for row in scores[1:]:
        reach = at[:, None] + moves
        back.append(reach.argmax(axis=0))
        at = reach.max(axis=0) + row
    path = [int(at.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def log_partition(scores: np.ndarray, moves: np.ndarray) -> float:
    """The logarithm of the sum over all paths of exp(score)."""
    if not len(scores):
        return 0.0
    at = scores[0]
    for row in scores[1:]:
        at = np.logaddexp.reduce(at[:, None] + moves, axis=0) + row
    return float(np.logaddexp.reduce(at))


def _log_sums(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    most[~np.isfinite(most)] = 0.0
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - most).sum(axis=axis)) + most.squeeze(axis)


def log_partitions(rows: list[np.ndarray], moves: np.ndarray) -> np.ndarray:
    """log_partition of each row's scores. Where tags are few, all positions of all rows are chained at once, two by two."""
    out = np.zeros(len(rows))
    if len(moves) > FEW_TAGS:
        return np.array([log_partition(s, moves) for s in rows], float)
    sizes = np.array([len(s) for s in rows], np.int64)
    there = np.flatnonzero(sizes)
    for some in np.split(there, np.flatnonzero(np.diff(np.cumsum(sizes[there]) // POSITIONS)) + 1):
        if not len(some):
            continue
        steps, n = np.concatenate([rows[i] for i in some]), sizes[some]
        first = np.cumsum(n) - n
        at = steps[:, None, :] + moves  # from tag to tag; to the first position from nowhere
        at[first] = steps[first][:, None, :]
        while n.max() > 1:
            place, of = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n), np.repeat(n, n)
            left = place % 2 == 0
            paired = left & (place + 1 < of)
            pairs, made = np.flatnonzero(paired), at[left]
            made[paired[left]] = _log_sums(at[pairs][:, :, :, None] + at[pairs + 1][:, None, :, :], 2)
            at, n = made, (n + 1) // 2
        out[some] = _log_sums(at[:, 0, :], 1)
    return out


def path_score(scores: np.ndarray, moves: np.ndarray, path: np.ndarray) -> float:
    return float(scores[np.arange(len(path)), path].sum() + moves[path[:-1], path[1:]].sum()) if len(path) else 0.0


def _dense(flat, tags: int) -> np.ndarray:
    return np.asarray(flat if flat is not None else [], float).reshape(-1, tags)


def viterbi(scores: Column, moves: np.ndarray) -> Column:
    """The best path (array of tags from 0) of each row; scores: one position's tags after another's, null: none."""
    @F.pandas_udf("array<int>")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([best_path(_dense(s, len(moves)), moves) for s in b])

    return decode(scores)


def crf_loss(scores: Column, path: Column, moves: np.ndarray) -> Column:
    """log of all paths' weight less the score of the path that is given."""
    @F.pandas_udf("double")
    def loss(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ss, ps in batches:
            dense = [_dense(s, len(moves)) for s in ss]
            gold = [path_score(s, moves, np.asarray(p if p is not None else [], int)) for s, p in zip(dense, ps, strict=True)]
            yield pd.Series(log_partitions(dense, moves) - np.array(gold, float))

    return loss(scores, path)
