"""Ranks of values, equal-frequency bins and quantile transforms over whole columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.ranking import running_totals


def value_ranks(df: DataFrame, column: str) -> DataFrame:
    """column, same and below: the rows with each value and those with a smaller one. Nulls have no rank."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("same"))
    return running_totals(counts, column, {"below": "same"})


def equal_frequency_bins(df: DataFrame, column: str, k: int, name: str = "bin") -> DataFrame:
    """Adds the bin, from 0: floor(rows below * k / rows). Equal values share a bin; null has none."""
    ranks = value_ranks(df, column)
    n = df.agg(F.count(column).alias("_n"))
    return df.join(ranks, column, "left").crossJoin(F.broadcast(n)).withColumn(name, F.floor(F.col("below") * k / F.col("_n")).cast("int")).select(*df.columns, name)


def quantile_uniform(df: DataFrame, column: str, name: str = "u") -> DataFrame:
    """Adds the mid-rank over rows - 1, from 0 to 1; null where there is a single row or no value."""
    ranks = value_ranks(df, column)
    n = df.agg(F.count(column).alias("_n"))
    u = F.try_divide(F.col("below") + (F.col("same") - 1) / 2, F.col("_n") - 1)
    return df.join(ranks, column, "left").crossJoin(F.broadcast(n)).withColumn(name, u).select(*df.columns, name)


def quantiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row of q0, q1, ...: exact quantiles with linear interpolation, nulls and NaNs left out; null without values."""
    values = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).select(F.col(column).cast("double").alias("_x"))
    n = values.agg(F.count(F.lit(1)).alias("_n"))
    at = value_ranks(values, "_x").crossJoin(F.broadcast(n))
    holds = lambda r: F.max(F.when((F.col("below") <= r) & (r < F.col("below") + F.col("same")), F.col("_x")))
    out = []
    for i, q in enumerate(shares):
        place = (F.col("_n") - 1) * F.lit(float(q))
        low = F.floor(place)
        out += [holds(low).alias(f"_l{i}"), holds(F.ceil(place)).alias(f"_h{i}"), F.max(place - low).alias(f"_p{i}")]
    return at.agg(*out).select(*[(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_p{i}")).alias(f"q{i}") for i in range(len(shares))])
