"""Boosted trees and forests from histograms, and exact contributions of their features.

Trees grow level by level. In a pass each task steps its rows down the trees as far as they have grown and adds up, by
tree, node, feature and bin, gradients, second derivatives and counts; the cluster adds the tasks' sums, and the driver
picks each node's split from them. So a level is one pass over the data, for all trees of a forest at once, and what
moves is a histogram for each task, whatever the number of rows. Bins lie between quantiles of a feature.

A value that is missing goes left, as the lowest do. Rows with a null target are left out. Trees are arrays in the order
of a heap: the children of node i are 2 i + 1 and 2 i + 2. Rows of a forest's trees are drawn as in `bags`.

A feature's contribution to a row is its Shapley value in the game whose players are the features: a split on a feature
outside the coalition passes on to both sides by the shares of the training rows that went there. A leaf is a product of
one factor for each feature on its path, so its share of the values comes from sums over the sizes of coalitions, in
time polynomial in the depth. Contributions add up to prediction less expectation.
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.bags import counts
from sparkloom.operators.tables import staged

#: Quantiles are off by this share of a bin at most.
QUANTILE_ERROR = 0.05
#: Of splits whose gains are this close, in parts of the best, the first feature's first bin is taken.
TIE = 1e-9
#: Cells of bins up to which rows are counted by cell before trees are boosted: what passes read is no more than these.
CELLS = 1 << 22


@dataclass
class Tree:
    """feature is -1 at a leaf; a row goes right where its value is over the threshold. cover counts training rows."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n), np.zeros(n), np.zeros(n))

    def node_of(self, x: np.ndarray) -> np.ndarray:
        """The node where each row of x ends."""
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(int(math.log2(len(self.feature) + 1)) - 1):
            f = self.feature[node]
            with np.errstate(invalid="ignore"):
                right = x[rows, np.maximum(f, 0)] > self.threshold[node]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return node

    def leaves(self) -> Iterator[tuple[int, dict[int, list[tuple[float, bool, float]]]]]:
        """Each leaf, with (threshold, whether right, share of the rows) of the splits on its path, by feature."""
        todo: list[tuple[int, dict]] = [(0, {})]
        while todo:
            i, path = todo.pop()
            if self.feature[i] < 0:
                yield i, path
                continue
            for right in (False, True):
                child = 2 * i + 1 + right
                share = float(self.cover[child] / self.cover[i])
                step = (float(self.threshold[i]), right, share)
                todo.append((child, {**path, int(self.feature[i]): [*path.get(int(self.feature[i]), []), step]}))

    def expected(self) -> float:
        return sum(self.value[i] * math.prod(s for steps in path.values() for _, _, s in steps) for i, path in self.leaves())

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """The Shapley value of each feature, for each row of x."""
        out = np.zeros(x.shape)
        for leaf, path in self.leaves():
            m = len(path)
            if not m or not self.value[leaf]:
                continue
            weight = [math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)]
            inside, outside = {}, {}
            for f, steps in path.items():
                with np.errstate(invalid="ignore"):
                    inside[f] = np.logical_and.reduce([(x[:, f] > t) == right for t, right, _ in steps]).astype(float)
                outside[f] = math.prod(s for _, _, s in steps)
            for f in path:
                # sums[k]: over the coalitions of k other features, what the leaf's factors multiply to
                sums = [np.ones(len(x))]
                for g in path:
                    if g != f:
                        more = [s * outside[g] for s in sums] + [np.zeros(len(x))]
                        for k, s in enumerate(sums):
                            more[k + 1] = more[k + 1] + s * inside[g]
                        sums = more
                out[:, f] += self.value[leaf] * (inside[f] - outside[f]) * sum(w * s for w, s in zip(weight, sums, strict=True))
        return out


@dataclass
class Model:
    """Trees whose values, times scale, add to the base; with odds the sum is a log odds."""

    features: list[str]
    base: float
    scale: float = 1.0
    odds: bool = False
    trees: list[Tree] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.scale * sum((t.value[t.node_of(x)] for t in self.trees), np.zeros(len(x)))

    def expected(self) -> float:
        return self.base + self.scale * sum(t.expected() for t in self.trees)

    def contributions(self, x: np.ndarray) -> np.ndarray:
        return self.scale * sum((t.contributions(x) for t in self.trees), np.zeros(x.shape))

    def _inputs(self) -> Column:
        return F.struct(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(self.features)])

    def shares(self) -> Column:
        """A struct of raw and phi0, phi1, ... of the features, as plain numbers: one pass for both."""
        names = [f"phi{i}" for i in range(len(self.features))]

        @F.pandas_udf(", ".join(f"{n} double" for n in ("raw", *names)))
        def made(x: pd.DataFrame) -> pd.DataFrame:
            values = x.to_numpy(float)
            out = pd.DataFrame(self.contributions(values), columns=names)
            out.insert(0, "raw", self.margin(values))
            return out

        return made(self._inputs())

    def raw(self) -> Column:
        """The sum of the trees for a row."""

        @F.pandas_udf("double")
        def predicted(x: pd.DataFrame) -> pd.Series:
            return pd.Series(self.margin(x.to_numpy(float)))

        return predicted(self._inputs())

    def predict(self, shares: Column | None = None) -> Column:
        """The mean for a regression, a probability for a classification; of a row's shares, where they have been made."""
        raw = self.raw() if shares is None else shares["raw"]
        return 1 / (1 + F.exp(-raw)) if self.odds else raw

    def parts(self, shares: Column | None = None) -> Column:
        """(feature, phi, value) of each feature, for selection.top_of_row; phi adds up to raw() less expected()."""
        of = self.shares() if shares is None else shares
        return F.array(*[F.struct(F.lit(c).alias("feature"), of[f"phi{i}"].alias("phi"), F.col(f"`{c}`").cast("double").alias("value")) for i, c in enumerate(self.features)])


@dataclass
class _Growing:
    tree: Tree
    number: int
    open: dict[int, tuple[int, ...]]  # nodes of this level, with the features that each may split on


def _cuts(rows: DataFrame, d: int, bins: int) -> list[np.ndarray]:
    """Borders between bins: a value falls in the bin of the first border that isn't less. One pass."""
    found = rows.approxQuantile([f"_x{i}" for i in range(d)], [k / bins for k in range(1, bins + 1)], QUANTILE_ERROR / bins)
    return [np.unique(np.array(q, float)) for q in found]


def _histograms(rows: DataFrame, model: Model, growing: list[_Growing], cuts: list[np.ndarray], share: float | None, seed: int, drawn: bool, since: int) -> dict:
    """{(tree, node, feature): sums by bin of gradient, second derivative and count}, from one pass.

    The rows' margin holds the trees before `since`.
    """
    d, width = len(cuts), max(len(c) for c in cuts) + 1
    odds, trees, late = model.odds, growing, Model(model.features, 0.0, model.scale, trees=model.trees[since:])
    places = [{n: i for i, n in enumerate(sorted(g.open))} for g in trees]

    def run(batches):
        sums = [np.zeros((len(p), d, width, 3)) for p in places]
        for batch in batches:
            if not batch.num_rows:
                continue
            key, y, margin, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            x = np.column_stack(columns).astype(float)
            f = margin + late.margin(x)
            binned = [np.where(np.isnan(x[:, j]), 0, np.minimum(np.searchsorted(cuts[j], x[:, j]), width - 1)) for j in range(d)]
            if odds:
                p = 1 / (1 + np.exp(-f))
                gradient, curve = p - y, p * (1 - p)
            else:
                gradient, curve = f - y, np.ones(len(y))
            for g, place, total in zip(trees, places, sums, strict=True):
                node = g.tree.node_of(x)
                slot = np.full(len(g.tree.feature), -1)
                slot[list(place)] = list(place.values())
                at = slot[node]
                w = counts(key, g.number, seed, share) if drawn else key
                took = np.flatnonzero((at >= 0) & (w > 0))
                for j in range(d):
                    cell = at[took] * width + binned[j][took]
                    for k, v in enumerate((w * gradient, w * curve, w)):
                        total[:, j, :, k] += np.bincount(cell, v[took], len(place) * width).reshape(-1, width)
        for g, place, total in zip(trees, places, sums, strict=True):
            for n, i in place.items():
                j, b = np.nonzero(total[i, :, :, 2])
                made = {"tree": np.full(len(j), g.number), "node": np.full(len(j), n), "feature": j, "bin": b}
                yield pa.RecordBatch.from_pydict({**{k: v.astype(np.int64) for k, v in made.items()}, **{c: total[i, j, b, k] for k, c in enumerate("ghn")}})

    made = rows.mapInArrow(run, "tree long, node long, feature long, bin long, g double, h double, n double")
    out: dict = {}
    for r in made.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"]).collect():
        out.setdefault((r.tree, r.node, r.feature), np.zeros((width, 3)))[r.bin] = r.g, r.h, r.n
    return out


def _worth(s: np.ndarray, l2: float) -> np.ndarray:
    return s[..., 0] ** 2 / np.maximum(s[..., 1] + l2, 1e-300)


def _split(hist: dict, g: _Growing, node: int, cuts: list[np.ndarray], l2: float, least: float) -> tuple[int, int, np.ndarray, np.ndarray] | None:
    """Feature, bin and the sums to the left and right of a node's best split."""
    best, gain = None, 0.0
    for f in g.open[node]:
        if (g.number, node, f) not in hist:
            continue
        sums = hist[g.number, node, f]
        left = np.cumsum(sums, axis=0)[: len(cuts[f])]
        right = sums.sum(axis=0) - left
        both = _worth(left, l2) + _worth(right, l2)
        gains = np.where((left[:, 2] >= least) & (right[:, 2] >= least), both - _worth(sums.sum(axis=0), l2), -np.inf)
        if len(gains) and gains.max() > max(gain * (1 + TIE), TIE * both.max()):
            b = int(np.flatnonzero(gains >= gains.max() * (1 - TIE))[0])
            best, gain = (f, b, left[b], right[b]), float(gains.max())
    return best


def _grow(rows: DataFrame, model: Model, growing: list[_Growing], cuts, *, depth: int, l2: float, rate: float, least: float, columns: float, share, seed: int, drawn: bool, since: int = 0) -> None:
    """Grows trees to their depth, a level in each pass."""
    value = lambda s: -rate * s[0] / max(s[1] + l2, 1e-300)
    d = len(cuts)

    def allowed(tree: int, node: int) -> tuple[int, ...]:
        if columns >= 1:
            return tuple(range(d))
        return tuple(sorted(np.random.default_rng([seed, tree, node]).choice(d, max(1, int(d * columns)), replace=False).tolist()))

    for g in growing:
        g.open = {0: allowed(g.number, 0)}
    for level in range(depth):
        live = [g for g in growing if g.open]
        if not live:
            break
        hist = _histograms(rows, model, live, cuts, share, seed, drawn, since)
        for g in live:
            after: dict[int, tuple[int, ...]] = {}
            for node in g.open:
                if not level:
                    sums = next((h.sum(axis=0) for (t, _, _), h in hist.items() if t == g.number), np.zeros(3))
                    g.tree.value[0], g.tree.cover[0] = value(sums), sums[2]
                if found := _split(hist, g, node, cuts, l2, least):
                    f, b, *sides = found
                    g.tree.feature[node], g.tree.threshold[node] = f, cuts[f][b]
                    for child, s in zip((2 * node + 1, 2 * node + 2), sides, strict=True):
                        g.tree.value[child], g.tree.cover[child] = value(s), s[2]
                        after[child] = allowed(g.number, child)
            g.open = after


def _rows(df: DataFrame, features: list[str], target: str, key: Column | None) -> DataFrame:
    number = [F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(features)]
    rows = df.where(F.col(target).isNotNull())
    return rows.select((F.lit(1) if key is None else key).cast("long").alias("_key"), F.col(target).cast("double").alias("_y"), F.lit(0.0).alias("_margin"), *number)


def _cells(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """rows with bins for values, and one row, which counts as many as `_key`, for all that are in the same bins: a tree tells
    them apart no more, and their targets count by their mean."""
    widths = [len(c) + 1 for c in cuts]

    def run(batches):
        for batch in batches:
            y, *columns = (c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns)
            cell = np.zeros(len(y), np.int64)
            for x, c, width in zip(columns, cuts, widths, strict=True):
                cell = cell * width + np.where(np.isnan(x), 0, np.searchsorted(c, x))
            found, at = np.unique(cell, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(at)), pa.array(np.bincount(at, y))], names=["cell", "n", "y"])

    names = [f"_x{i}" for i in range(len(cuts))]
    sums = rows.select("_y", *names).mapInArrow(run, "cell long, n long, y double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    bins = [F.floor(F.col("cell") / math.prod(widths[i + 1 :])) % w for i, w in enumerate(widths)]
    return sums.select(F.col("n").alias("_key"), (F.col("y") / F.col("n")).alias("_y"), F.lit(0.0).alias("_margin"), *[b.cast("double").alias(n) for b, n in zip(bins, names, strict=True)])


def _usable(cuts: list[np.ndarray]) -> None:
    if not cuts or not any(len(c) for c in cuts):
        raise ValueError("no rows with features to learn from")


def boost(
    df: DataFrame, features: list[str], target: str, *, classify: bool = False, trees: int = 20, depth: int = 3, rate: float = 0.3, l2: float = 1.0, bins: int = 32,
    least: float = 1, keep_every: int = 10,
) -> Model:
    """Trees that each follow the gradient of what those before leave: squared error, or log loss of a target of 0 and 1.

    A tree takes `depth` passes over the rows. Tasks add up the trees since the margin was last written, which is every
    `keep_every` trees.
    """
    with contextlib.ExitStack() as stack:
        rows = stack.enter_context(staged(_rows(df, features, target, None)))
        mean = rows.agg(F.avg("_y")).first()[0]
        if mean is None:
            raise ValueError("no rows to learn from")
        if classify and not 0 < mean < 1:
            raise ValueError("a classification needs both classes")
        cuts = _cuts(rows, len(features), bins)
        _usable(cuts)
        own = cuts
        if math.prod(len(c) + 1 for c in cuts) <= CELLS:
            rows, cuts = stack.enter_context(staged(_cells(rows, cuts))), [np.arange(len(c), dtype=float) for c in cuts]
        model, since = Model(features, math.log(mean / (1 - mean)) if classify else float(mean), odds=classify), 0
        rows = rows.withColumn("_margin", F.lit(model.base))
        for t in range(trees):
            if t and t % keep_every == 0:
                late = Model([f"_x{i}" for i in range(len(features))], 0.0, trees=model.trees[since:])
                rows = stack.enter_context(staged(rows.withColumn("_margin", F.col("_margin") + late.raw())))
                since = t
            g = _Growing(Tree.empty(depth), t, {})
            _grow(rows, model, [g], cuts, depth=depth, l2=l2, rate=rate, least=least, columns=1.0, share=None, seed=0, drawn=False, since=since)
            model.trees.append(g.tree)
    if cuts is not own:
        for tree in model.trees:
            for i in np.flatnonzero(tree.feature >= 0):
                tree.threshold[i] = own[tree.feature[i]][int(tree.threshold[i])]
    return model


def forest(
    df: DataFrame, key: Column, features: list[str], target: str, *, trees: int = 20, depth: int = 4, share: float | None = None, columns: float = 0.6, bins: int = 32, least: float = 1, seed: int = 0
) -> Model:
    """The mean of trees that each learn from their own rows, drawn by key, and split on drawn features: of a number, or of a
    target of 0 and 1, for which it is a probability. All trees grow together, in `depth` passes."""
    with staged(_rows(df, features, target, key)) as rows:
        cuts = _cuts(rows, len(features), bins)
        _usable(cuts)
        growing = [_Growing(Tree.empty(depth), t, {}) for t in range(trees)]
        _grow(rows, Model(features, 0.0), growing, cuts, depth=depth, l2=0.0, rate=1.0, least=least, columns=columns, share=share, seed=seed, drawn=True)
    return Model(features, 0.0, 1 / trees, trees=[g.tree for g in growing])
