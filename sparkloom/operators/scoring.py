"""Scores of features against a label, from counts and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counts(df: DataFrame, feature: str, label: str) -> DataFrame:
    """A row for each value and label, with totals; far fewer rows than df. Counts are doubles: their products pass 64 bits."""
    cells = df.groupBy(F.col(feature).alias("v"), F.col(label).alias("y")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    by_v = cells.groupBy("v").agg(F.sum("n").alias("n_v"))
    by_y = cells.groupBy("y").agg(F.sum("n").alias("n_y"))
    total = cells.agg(F.sum("n").alias("n_all"))
    return cells.join(by_v, "v").join(by_y, "y").crossJoin(F.broadcast(total))


def information_gain(df: DataFrame, feature: str, label: str) -> DataFrame:
    """info_gain in bits: the label's entropy less that within the feature's values."""
    c = _counts(df, feature, label)
    joint = F.sum(F.col("n") / F.col("n_all") * F.log2(F.col("n") * F.col("n_all") / (F.col("n_v") * F.col("n_y"))))
    return c.agg(joint.alias("info_gain"))


def gini_gain(df: DataFrame, feature: str, label: str) -> DataFrame:
    c = _counts(df, feature, label)
    inner = F.sum(F.col("n") * F.col("n") / (F.col("n_v") * F.col("n_all")))
    y = F.col("n_y") / F.col("n_all")
    # each label's share counts once: its cells' parts add up to it
    outer = F.sum(y * F.col("n") / F.col("n_all"))
    return c.agg((inner - outer).alias("gini_gain"))


def chi_square(df: DataFrame, feature: str, label: str) -> DataFrame:
    """chi2 over all cells, those without rows included: sum of n^2 / expected, less the number of rows."""
    c = _counts(df, feature, label)
    return c.agg((F.sum(F.col("n") * F.col("n") * F.col("n_all") / (F.col("n_v") * F.col("n_y"))) - F.max("n_all")).alias("chi2"))


def anova_f(df: DataFrame, feature: str, label: str) -> DataFrame:
    """F statistic of a numeric feature over the label's classes."""
    x = F.col(feature).cast("double")
    g = df.groupBy(label).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    t = g.agg(F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    s = g.crossJoin(F.broadcast(t)).groupBy("n_all", "k").agg(F.sum(F.col("n") * (F.col("m") - F.col("mean")) ** 2).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"))
    return s.select(F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n_all") - F.col("k"))).alias("f"))


def pearson(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, r), in one pass."""
    row = df.agg(*[F.corr(F.col(f).cast("double"), F.col(target).cast("double")).alias(f) for f in features])
    return row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("r")) for f in features])).alias("x")).select("x.*")


def regression_f(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, f): r^2 / (1 - r^2) * (n - 2)."""
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    r2 = F.col("r") * F.col("r")
    return pearson(df, features, target).crossJoin(F.broadcast(n)).select("feature", F.try_divide(r2 * (F.col("n_rows") - 2), 1 - r2).alias("f"))


def confusion(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    return df.agg(
        F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"),
        F.count_if(truth & ~predicted).alias("fn"), F.count_if(~truth & ~predicted).alias("tn"),
    )


def prf(cells: DataFrame, beta: float = 1.0) -> DataFrame:
    """precision, recall, accuracy and f_beta from tp, fp, fn, tn; null where nothing can be divided."""
    b = beta * beta
    return cells.select(
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("accuracy"),
        F.try_divide((1 + b) * F.col("tp"), (1 + b) * F.col("tp") + b * F.col("fn") + F.col("fp")).alias("f_beta"),
    )


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """P(positive's score > negative's) with ties as halves, from running counts by distinct score."""
    from sparkloom.operators.ranking import running_totals

    by = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    below = running_totals(by, "s", {"q_below": "q"})
    wins = F.sum(F.col("p") * (2 * F.col("q_below") + F.col("q")))
    return below.agg(F.try_divide(wins, 2 * F.sum("p") * F.sum("q")).alias("auc"))
