"""Column profiles and filters that need no label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType, T.ByteType, T.DecimalType)


def is_missing(df: DataFrame, name: str, sentinel=None) -> Column:
    if sentinel is not None:
        return F.coalesce(F.col(name) == F.lit(sentinel), F.lit(False))
    floats = isinstance(df.schema[name].dataType, T.DoubleType | T.FloatType)
    return F.col(name).isNull() | F.isnan(name) if floats else F.col(name).isNull()


def _long(row: DataFrame, names: list[str], value: str) -> DataFrame:
    """A row of scores as rows (feature, value)."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias(value)) for n in names])).alias("x")).select("x.*")


def missing_ratio(df: DataFrame, names: list[str] | None = None, sentinel=None) -> DataFrame:
    """(feature, ratio): one pass over the data; nulls and NaNs, or the sentinel, are missing."""
    names = names or df.columns
    row = df.agg(*[F.avg(is_missing(df, n, sentinel).cast("double")).alias(n) for n in names])
    return _long(row, names, "ratio")


def std_score(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(feature, std): the sample standard deviation of numeric columns, nulls skipped."""
    names = names or [f.name for f in df.schema if isinstance(f.dataType, NUMERIC)]
    return _long(df.agg(*[F.stddev_samp(F.col(n).cast("double")).alias(n) for n in names]), names, "std")


def above(scores: DataFrame, value: str, threshold: float, keep_equal: bool = False) -> DataFrame:
    return scores.where(F.col(value) >= threshold if keep_equal else F.col(value) > threshold)


def top(scores: DataFrame, value: str, n: int) -> DataFrame:
    """The n best features, ties by name; scores has a row for each feature."""
    return scores.orderBy(F.desc(value), "feature").limit(n)


def profile(df: DataFrame) -> DataFrame:
    """(feature, kind, n_rows, n_distinct, n_missing)."""
    parts = []
    for f in df.schema:
        parts.append(F.struct(F.lit(f.name).alias("feature"), F.lit(f.dataType.simpleString()).alias("kind"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct(f.name).alias("n_distinct"), F.count_if(is_missing(df, f.name)).alias("n_missing")))
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")
