"""Quality classification by positive-unlabelled learning.

A logistic model over a whole text's measures and hashed word n-grams minimises the non-negative unbiased risk

    prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))

from trusted positives (P), unlabelled text (U) and the class prior. Where the second term falls below zero, steps go
against it, as the method has it. Labels other than positive ones are never read.

The prior is estimated from P and U alone: a model learns to tell P from U on one half of either; on the other half, the
share of U above a threshold over the share of P above it is, for the positives' best threshold, an upper bound of the
prior which is tight if some texts are surely positive. The threshold is the one whose bound is least once it is raised
by what the halves' sizes leave uncertain.

Training reads a bounded sample: at most SAMPLE positives and SAMPLE unlabelled documents, those of least hash of doc_id
(of equal ones, of the text's hash), so it doesn't depend on how rows are laid out. Null texts are measured as empty
ones; they get a score as well. Null labels are no labels; of several labels of a document the highest counts. Without
positives or unlabelled texts every score is the prior, which then is a half. Rows with the same doc_id are documents
each. A column of docs with the name of a result column is replaced.
"""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import map_texts
from sparkloom.llm.hashing import Substrings, U, mix

SAMPLE = 6000
THRESHOLD = 0.3
ROUNDS = 400
#: Classes of bytes that are counted: capitals, small letters, digits, space, sentence marks, other marks, non-ASCII.
_CLASS = np.array([
    0 if 65 <= c <= 90 else 1 if 97 <= c <= 122 else 2 if 48 <= c <= 57 else 3 if c in (9, 10, 13, 32) else 4 if chr(c) in ".,;:'\"?-" else 6 if c >= 128 else 5
    for c in range(256)
])
MEASURES = 16
#: Places that words and pairs of words are hashed to.
PLACES = 512
FEATURES = 3 * MEASURES + PLACES
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.array([c in (9, 10, 11, 12, 13, 32) for c in range(256)])


def measure(text: bytes | None) -> list[float]:
    """Shares of kinds of bytes, words and lines; the whole text is read."""
    text = text or b""
    n = max(1, len(text))
    by = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=by, minlength=7)
    words = text.split()
    m = max(1, len(words))
    lines = text.split(b"\n")
    letters = max(1.0, kinds[0] + kinds[1] + kinds[6])
    return [
        kinds[0] / letters, kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n,
        by.max() / n, min(40.0, (n - kinds[3]) / m) / 10, np.log1p(m) / 10, len(set(words)) / m, sum(map(eq, words, words[1:])) / m,
        1 - len(set(lines)) / len(lines), np.log1p(len(lines)) / 10, float(by[33]) / m, float(kinds[5]) / m,
    ]


def ngrams(texts: list[bytes | None]) -> np.ndarray:
    """For each text the logarithms of how often its words and pairs of words fall into each place, as a unit vector."""
    out = np.zeros((len(texts), PLACES), np.float32)
    buffer = np.frombuffer(b" ".join([*(t or b"" for t in texts), b""]).translate(_LOWER), np.uint8)
    solid = np.zeros(len(buffer) + 1, np.int8)
    solid[:-1] = ~_SPACE[buffer]
    edge = np.diff(solid, prepend=np.int8(0))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(lo):
        return out
    starts = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    doc = np.searchsorted(starts, lo, side="right") - 1
    word = mix(Substrings(buffer).at(lo, hi) + (hi - lo).astype(np.uint64))
    pair = mix(word[:-1] * U(3) + word[1:])[doc[1:] == doc[:-1]]
    at = np.concatenate([doc * PLACES + (word % U(PLACES)).astype(np.int64), doc[:-1][doc[1:] == doc[:-1]] * PLACES + (pair % U(PLACES)).astype(np.int64)])
    out = np.log1p(np.bincount(at, minlength=out.size)).reshape(out.shape)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def features(texts: list[bytes | None]) -> np.ndarray:
    """Measures, their roots and squares, and n-grams."""
    x = np.array([measure(t) for t in texts], np.float32).reshape(len(texts), MEASURES)
    return np.concatenate([x, np.sqrt(np.abs(x)), x * x, ngrams(texts)], axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Scale:
    """Features of one spread, limited, and a constant."""

    def __init__(self, x: np.ndarray):
        self.mean, self.std = x.mean(0), x.std(0) + 1e-6

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.clip((x - self.mean) / self.std, -6, 6), np.ones((len(x), 1), np.float32)], 1)


def risk(p: np.ndarray, u: np.ndarray, w: np.ndarray, prior: float) -> tuple[float, float]:
    """The two terms of the risk, with the logistic loss: that of positives, and that of negatives, which may fall below zero."""
    zp, zu = p @ w, u @ w
    return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()


def descend(p: np.ndarray, u: np.ndarray, prior: float | None, rounds: int, step: float = 0.03, decay: float = 2e-3) -> np.ndarray:
    """Weights that minimise the risk, by full-batch Adam; without a prior those that tell P from U."""
    w = np.zeros(p.shape[1])
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        zp, zu = p @ w, u @ w
        if prior is None:
            g = (u.T @ _sigmoid(zu) / len(u) - p.T @ _sigmoid(-zp) / len(p)) / 2
        else:
            up = -prior * (p.T @ _sigmoid(-zp)) / len(p)
            down = u.T @ _sigmoid(zu) / len(u) - prior * (p.T @ _sigmoid(zp)) / len(p)
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            g = up + down if negative >= 0 else -down
        g = g + decay * np.append(w[:-1], 0)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= step * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = ROUNDS // 2, sure: float = 0.1) -> float:
    """The share of positives in the unlabelled rows, as the module says; with probability 1 - sure the bound holds."""
    found = []
    for half in (0, 1):
        (p_in, p_out), (u_in, u_out) = ((x[half::2], x[1 - half :: 2]) for x in (positive, unlabelled))
        if not all(map(len, (p_in, p_out, u_in, u_out))):
            continue
        scale = Scale(np.concatenate([p_in, u_in]))
        w = descend(scale(p_in), scale(u_in), None, rounds)
        zp, zu = np.sort(scale(p_out) @ w), np.sort(scale(u_out) @ w)
        above_p = 1 - np.arange(len(zp)) / len(zp)
        above_u = 1 - np.searchsorted(zu, zp, side="left") / len(zu)
        unsure = sum(np.sqrt(np.log(4 / sure) / (2 * len(z))) for z in (zp, zu))
        best = np.argmin((above_u + unsure) / above_p)
        found.append(above_u[best] / above_p[best])
    return float(np.clip(np.mean(found) if found else 0.5, 0.01, 0.99))


def learn(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = ROUNDS) -> dict:
    scale = Scale(np.concatenate([positive, unlabelled]))
    return {"w": descend(scale(positive), scale(unlabelled), prior, rounds), "scale": scale, "prior": prior}


def score_rows(model: dict, x: np.ndarray) -> np.ndarray:
    return _sigmoid(model["scale"](x) @ model["w"]) if model["scale"] else np.full(len(x), model["prior"])


def _drawn(rows: DataFrame, doc_id: str, text: str, sample: int, n: int) -> np.ndarray:
    """Features of the `sample` rows of least hash; a share of the hashes that has them is measured."""
    place = F.pmod(F.xxhash64(doc_id, F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    some = rows.select(place.alias("place"), F.xxhash64(text).alias("tie"), F.col(text).alias("text")).where(F.col("place") <= (sample + 8 * sample**0.5) / max(1, n))

    def make():
        return lambda texts: {"x": [r.tobytes() for r in features(texts)]}

    got = map_texts(some, make, [T.StructField("x", T.BinaryType())], "text", ["place", "tie"]).orderBy("place", "tie").limit(sample).toPandas()
    return np.array([np.frombuffer(x, np.float32) for x in got["x"]], np.float32).reshape(len(got), FEATURES)


def fit(docs: DataFrame, labels: DataFrame, trains: Column, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> dict:
    """trains: which rows of docs and of labels, by doc_id, may be learned from."""
    trusted = labels.where(trains & (F.col(label) == 1)).select(doc_id).distinct()
    rows = docs.select(doc_id, text).where(trains)
    n_pos, n_docs = trusted.count(), rows.count()
    place = F.pmod(F.xxhash64(doc_id, F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    # about `sample` ids, whatever their number: short enough to send to every task
    few = trusted.where(place <= (sample + 8 * sample**0.5) / max(1, n_pos))
    positive = _drawn(rows.join(F.broadcast(few), doc_id, "left_semi"), doc_id, text, sample, n_pos)
    unlabelled = _drawn(rows, doc_id, text, sample, n_docs)
    if not len(positive) or not len(unlabelled):
        return {"w": None, "scale": None, "prior": 0.5}
    return learn(positive, unlabelled, estimate_prior(positive, unlabelled))


def score(docs: DataFrame, model: dict, *, text: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """Adds score (0 to 1, higher: better) and predicted (1 from threshold on). The model is a few vectors."""
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def make():
        def work(texts):
            got = score_rows(model, features(texts)).astype(float).tolist()
            return {"score": got, "predicted": [int(s >= threshold) for s in got]}

        return work

    return map_texts(docs, make, fields, text, keep)
