"""Mutual information of a number and a class, from distances to neighbours.

For a row, d is the distance to the k-th nearest value of its own class (of all others of the class, if these are fewer),
and m counts the rows of any class that are nearer than d, itself included, or, where d is 0, that are as near. The
estimate is digamma(N) + mean digamma(k) - mean digamma(class size) - mean digamma(m), 0 at least. Rows of a class of
their own, and with nulls, are left out.

Rows are numbered by class and value over all tasks and dealt to blocks of numbers that overlap by k, so that no class is
one task's. m comes from running totals over values and the ends of the intervals around them, in one order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.ranking import numbered, running_totals
from sparkloom.operators.tables import staged

#: Rows of a block.
BLOCK = 100_000


def digamma(x: Column) -> Column:
    """Of a number of 1 or more: by recurrence to six more, and the asymptotic series there."""
    y = x + 6
    series = F.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8)
    return series - sum((1 / (x + i) for i in range(6)), F.lit(0.0))


def kth_distance(df: DataFrame, key: str, value: str, label: str, k: int, block: int = BLOCK) -> DataFrame:
    """df with k, that of a row or less in a small class, and d, the distance to its k-th nearest of the class."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    rows = numbered(df.join(sizes, label).where("n_class > 1"), [F.col(label), F.col(value), F.col(key)], "_r")
    own = F.floor(F.col("_r") / block)
    near = F.concat(F.array(own), F.when(F.col("_r") % block < k, F.array(own - 1)).otherwise(F.array().cast("array<long>")), F.when(F.col("_r") % block >= block - k, F.array(own + 1)).otherwise(F.array().cast("array<long>")))
    window = Window.partitionBy("_b", label).orderBy("_r")
    around = [F.abs(F.col(value) - f(value, j).over(window)) for j in range(1, k + 1) for f in (F.lag, F.lead)]
    found = rows.withColumn("_b", F.explode(near)).withColumn("_d", F.array_sort(F.filter(F.array(*around), lambda x: x.isNotNull())))
    of = F.least(F.lit(k), F.col("n_class") - 1).cast("int")
    return found.where(F.col("_b") == own).withColumns({"k": of, "d": F.element_at("_d", of)}).drop("_r", "_b", "_d")


def mutual_information(df: DataFrame, key: str, value: str, label: str, *, k: int = 3, block: int = BLOCK) -> DataFrame:
    """A row: n (rows that count) and mutual_information, in nats. key tells rows apart; k is less than a block."""
    if not 0 < k < block:
        raise ValueError("k must be positive and less than a block")
    rows = df.select(F.col(key).alias("_id"), F.col(value).cast("double").alias("x"), F.col(label).alias("c")).dropna()
    with staged(kth_distance(rows, "_id", "x", "c", k, block)) as found:
        # at the same value: ends that count what is less, values, ends that count what isn't more
        ends = F.array(
            F.struct(F.col("x").alias("v"), F.lit(1).alias("o"), F.lit(1).alias("one"), F.lit(0).alias("sign")),
            F.struct((F.col("x") - F.col("d")).alias("v"), F.when(F.col("d") > 0, 2).otherwise(0).alias("o"), F.lit(0).alias("one"), F.lit(-1).alias("sign")),
            F.struct((F.col("x") + F.col("d")).alias("v"), F.when(F.col("d") > 0, 0).otherwise(2).alias("o"), F.lit(0).alias("one"), F.lit(1).alias("sign")),
        )
        marks = found.select("_id", F.explode(ends).alias("e")).select("_id", "e.*")
        below = running_totals(marks, [F.col("v"), F.col("o"), F.col("_id"), F.col("sign")], {"n": "one"})
        m = below.where("sign <> 0").groupBy("_id").agg(F.sum(F.col("n") * F.col("sign")).alias("m"))
        parts = found.join(m, "_id").agg(
            F.count(F.lit(1)).alias("n"), F.avg(digamma(F.col("k").cast("double")) - digamma(F.col("n_class").cast("double")) - digamma(F.col("m").cast("double"))).alias("rest")
        )
        row = parts.select("n", F.greatest(F.when(F.col("n") > 0, digamma(F.col("n").cast("double")) + F.col("rest")), F.lit(0.0)).alias("mutual_information")).first()
    return df.sparkSession.createDataFrame([tuple(row)], "n long, mutual_information double")
