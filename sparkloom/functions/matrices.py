"""Matrices as arrays of rows: small dense ones inside a row of a table, as expressions; decompositions by numpy in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.arrays import dot, total


def places(n: int | Column) -> Column:
    """0 to n - 1; n is at least 1."""
    return F.sequence(F.lit(0), (F.lit(n) if isinstance(n, int) else n) - 1)


def generate(rows: int, columns: int, f) -> Column:
    return F.transform(places(rows), lambda i: F.transform(places(columns), lambda j: f(i, j)))


def eye(n: int, k: int = 0) -> Column:
    return generate(n, n, lambda i, j: (j - i == k).cast("double"))


def linspace(low: float, high: float, n: int) -> Column:
    return F.transform(places(n), lambda i: F.lit(float(low)) + i * ((high - low) / max(n - 1, 1)))


def logspace(low: float, high: float, n: int) -> Column:
    """Powers of ten, without the end."""
    return F.transform(places(n), lambda i: F.pow(F.lit(10.0), F.lit(float(low)) + i * ((high - low) / n)))


def reshape(a: Column, columns: int) -> Column:
    """Rows of `columns` elements; the array's size is a multiple of it."""
    return F.transform(places((F.size(a) / columns).cast("int")), lambda i: F.slice(a, i * columns + 1, columns))


def transpose(m: Column) -> Column:
    return F.transform(places(F.size(F.get(m, F.lit(0)))), lambda j: F.transform(m, lambda r: F.get(r, j)))


def ravel(m: Column, order: str = "C") -> Column:
    return F.flatten(m if order == "C" else transpose(m))


def diagonal(m: Column) -> Column:
    return F.transform(m, lambda r, i: F.get(r, i))


def diagflat(a: Column) -> Column:
    return F.transform(a, lambda x, i: F.transform(a, lambda _, j: F.when(i == j, x).otherwise(0.0)))


def trace(m: Column) -> Column:
    return total(diagonal(m))


def tril(m: Column, k: int = 0) -> Column:
    return F.transform(m, lambda r, i: F.transform(r, lambda x, j: F.when(j <= i + k, x).otherwise(0.0)))


def triu(m: Column, k: int = 0) -> Column:
    return F.transform(m, lambda r, i: F.transform(r, lambda x, j: F.when(j >= i + k, x).otherwise(0.0)))


def fliplr(m: Column) -> Column:
    return F.transform(m, F.reverse)


def flipud(m: Column) -> Column:
    return F.reverse(m)


def rot90(m: Column) -> Column:
    """A quarter turn against the clock."""
    return F.reverse(transpose(m))


def matmul(a: Column, b: Column) -> Column:
    return F.transform(a, lambda r: F.transform(transpose(b), lambda c: dot(r, c)))


def outer(a: Column, b: Column) -> Column:
    return F.transform(a, lambda x: F.transform(b, lambda y: x * y))


def cross(a: Column, b: Column) -> Column:
    """Of vectors of three."""
    at = lambda i, j: F.get(a, F.lit(i)) * F.get(b, F.lit(j)) - F.get(a, F.lit(j)) * F.get(b, F.lit(i))
    return F.array(at(1, 2), at(2, 0), at(0, 1))


def tile(a: Column, n: int) -> Column:
    return F.concat(*[a] * n)


def repeat(a: Column, n: int) -> Column:
    return F.flatten(F.transform(a, lambda x: F.array_repeat(x, n)))


def row_sums(m: Column) -> Column:
    return F.transform(m, total)


def _qr_r(m: np.ndarray) -> np.ndarray:
    """R with a diagonal that isn't negative."""
    r = np.linalg.qr(m)[1]
    sign = np.sign(np.einsum("kii->ki", r))
    return (np.where(sign == 0, 1, sign)[:, :, None] * r).reshape(len(m), -1)


#: Decompositions by name, of a stack of square matrices: a row of numbers for each, matrices in row-major order.
LINALG = {
    "det": lambda m: np.linalg.det(m)[:, None],
    "slogdet": lambda m: np.stack(np.linalg.slogdet(m), 1),
    "inv": lambda m: np.linalg.inv(m).reshape(len(m), -1),
    "rank": lambda m: np.linalg.matrix_rank(m)[:, None],
    "cond": lambda m: np.linalg.cond(m)[:, None],
    "svd_values": lambda m: np.linalg.svd(m, compute_uv=False),
    "eig_symmetric": lambda m: np.linalg.eigvalsh((m + m.transpose(0, 2, 1)) / 2),
    "eig_real": lambda m: np.sort(np.linalg.eigvals(m).real, axis=1),
    "cholesky_of_gram": lambda m: np.linalg.cholesky(m @ m.transpose(0, 2, 1) + np.eye(m.shape[1])).reshape(len(m), -1),
    "qr_r": _qr_r,
}


def linalg(flat: Column, name: str) -> Column:
    """LINALG[name] of the square matrix with these elements in row-major order; null for null, other shapes and failures.

    Matrices of one shape are worked on together; where one of them fails, those of its shape are worked on one by one.
    """
    f = LINALG[name]

    def of(stack: np.ndarray) -> list:
        try:
            return f(stack).astype(float).tolist()
        except np.linalg.LinAlgError:
            return [None] if len(stack) == 1 else [x for one in stack for x in of(one[None])]

    @F.pandas_udf("array<double>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            sizes = np.array([0 if a is None else len(a) for a in b])
            out = np.full(len(b), None, object)
            for size in np.unique(sizes[sizes > 0]):
                n = round(float(size) ** 0.5)
                at = np.flatnonzero(sizes == size)
                if n * n == size:
                    for i, x in zip(at, of(np.array([np.asarray(b.iloc[i], float) for i in at]).reshape(-1, n, n)), strict=True):
                        out[i] = x
            yield pd.Series(out)

    return apply(flat)
