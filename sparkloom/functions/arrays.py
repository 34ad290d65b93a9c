"""Array functions with the semantics of dense numeric arrays, as expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLES = "array<double>"


#: Elements after which an array that grows step by step is begun anew.
BLOCK = 256


def cumulate(a: Column, op) -> Column:
    """Running results of op over the elements, in their order.

    An array that grows is copied at each step, so it grows within blocks; each starts from what all before it have made.
    """
    last = lambda x: F.element_at(x, -1)
    blocks = F.floor((F.size(a) + BLOCK - 1) / BLOCK).cast("int")
    items = lambda k: F.when(k == 0, F.slice(a, 2, BLOCK - 1)).otherwise(F.slice(a, k * BLOCK + 1, BLOCK))
    heads = F.aggregate(F.sequence(F.lit(1), blocks), F.slice(a, 1, 1), lambda h, k: F.concat(h, F.array(F.aggregate(items(k - 1), last(h), op))))
    grown = lambda h, k: F.aggregate(items(k), F.slice(h, k + 1, 1), lambda acc, x: F.concat(acc, F.array(op(last(acc), x))))
    block = lambda h, k: F.when(k == 0, grown(h, k)).otherwise(F.slice(grown(h, k), 2, BLOCK))
    made = F.get(F.transform(F.array(heads), lambda h: F.flatten(F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: block(h, k)))), 0)
    return F.when(F.size(a) > 0, made).otherwise(a)


def cumsum(a: Column) -> Column:
    return cumulate(a, lambda x, y: x + y)


def cumprod(a: Column) -> Column:
    return cumulate(a, lambda x, y: x * y)


def diff(a: Column) -> Column:
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.zip_with(F.slice(a, 2, n), F.slice(a, 1, n), lambda x, y: x - y)


def roll(a: Column, k: int) -> Column:
    """Elements moved k places to the right, those at the end to the front."""
    cut = F.pmod(F.lit(-k), F.greatest(F.size(a), F.lit(1)))
    return F.concat(F.slice(a, cut + 1, F.size(a)), F.slice(a, F.lit(1), cut))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def variance(a: Column) -> Column:
    """Population variance."""
    return F.try_divide(F.aggregate(F.transform(a, lambda x: (x - mean(a)) * (x - mean(a))), F.lit(0.0), lambda s, x: s + x), F.size(a))


def clip(a: Column, low: float, high: float) -> Column:
    return F.transform(a, lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def argsort(a: Column) -> Column:
    """Places from 0 in ascending order of their elements, ties by place."""
    pairs = F.array_sort(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return F.transform(pairs, lambda p: p["i"])


def trim_zeros(a: Column) -> Column:
    keep = F.transform(a, lambda x, i: F.when(x != 0, i + 1))
    low, high = F.array_min(keep), F.array_max(keep)
    return F.when(low.isNull(), F.slice(a, 1, 0)).otherwise(F.slice(a, low, high - low + 1))


def modulo(x: Column, y: Column) -> Column:
    """The remainder with the divisor's sign."""
    return x - y * F.floor(x / y)


def searchsorted(bins: list[float], x: Column, right: bool = False) -> Column:
    """How many bins lie below x, or with right at or below it."""
    return F.size(F.filter(F.array(*[F.lit(float(b)) for b in bins]), lambda b: b <= x if right else b < x))


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def histogram_bin(x: Column, low: float, high: float, n: int) -> Column:
    """Bin from 0 of equal bins, closed below, the last one closed on both sides; null outside."""
    k = F.floor((x - low) * n / (high - low)).cast("int")
    return F.when((x >= low) & (x <= high), F.least(k, F.lit(n - 1)))


def text(a: Column, digits: int = 6) -> Column:
    """The elements rounded and joined, so that engines agree."""
    return F.array_join(F.transform(a, lambda x: F.format_number(x, digits)), ";")


def percentile(a: Column, q: float) -> Column:
    """With linear interpolation between neighbours; null for an empty array."""
    at = (F.size(a) - 1) * F.lit(float(q))
    low = F.floor(at).cast("int")
    s = F.array_sort(a)
    return F.get(s, low) + (at - low) * (F.coalesce(F.get(s, low + 1), F.get(s, low)) - F.get(s, low))


def covariance(a: Column, b: Column) -> Column:
    """Of a sample."""
    return F.try_divide(dot(a, b) - F.try_divide(total(a) * total(b), F.size(a)), F.size(a) - 1)


def correlation(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b) / F.size(a) - mean(a) * mean(b), F.sqrt(variance(a) * variance(b)))


def bincount(a: Column, n: int) -> Column:
    """How often each of 0 to n - 1 occurs."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.size(F.filter(a, lambda x: x == k)))
