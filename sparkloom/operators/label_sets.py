"""Scores of predicted sets of labels: averaged by sample, by label, weighted by label, or over all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _f1(hit: Column, true: Column, predicted: Column) -> Column:
    return _ratio(2 * hit, true + predicted)


def by_sample(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """precision, recall, f1 and jaccard: of each row's sets, then their means. A ratio without a denominator is 0; null is an
    empty set, and labels count once in a set. No shuffle but that of the means."""
    none = lambda c: F.array_distinct(F.filter(F.coalesce(c, F.array().cast(df.schema[c].dataType)), lambda x: x.isNotNull()))
    sets = df.select(none(true).alias("t"), none(predicted).alias("p"))
    sizes = sets.select(F.size(F.array_intersect("t", "p")).alias("h"), F.size("t").alias("t"), F.size("p").alias("p"))
    h, t, p = F.col("h"), F.col("t"), F.col("p")
    scores = {"precision": _ratio(h, p), "recall": _ratio(h, t), "f1": _f1(h, t, p), "jaccard": _ratio(h, t + p - h)}
    return sizes.agg(*[F.avg(v).alias(n) for n, v in scores.items()])


def by_label(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """label, hit, support (rows that have it), predicted (rows that are said to) and its precision, recall and f1."""
    pair = lambda c, kind: df.select(F.explode(F.array_distinct(c)).alias("label"), F.lit(kind).alias("kind"))
    rows = pair(true, "t").unionByName(pair(predicted, "p")).unionByName(df.select(F.explode(F.array_intersect(true, predicted)).alias("label"), F.lit("h").alias("kind")))
    counts = rows.where("label is not null").groupBy("label").agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("h", "hit"), ("t", "support"), ("p", "predicted"))])
    h, t, p = F.col("hit"), F.col("support"), F.col("predicted")
    return counts.withColumns({"precision": _ratio(h, p), "recall": _ratio(h, t), "f1": _f1(h, t, p)})


def averages(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """average (micro, macro, weighted, samples), precision, recall and f1."""
    labels = by_label(df, true, predicted)
    h, t, p = F.sum("hit"), F.sum("support"), F.sum("predicted")
    names = ("precision", "recall", "f1")
    micro = labels.agg(F.lit("micro").alias("average"), _ratio(h, p).alias("precision"), _ratio(h, t).alias("recall"), _f1(h, t, p).alias("f1"))
    macro = labels.agg(F.lit("macro").alias("average"), *[F.avg(c).alias(c) for c in names])
    weighted = labels.agg(F.lit("weighted").alias("average"), *[_ratio(F.sum(F.col(c) * F.col("support")), t).alias(c) for c in names])
    samples = by_sample(df, true, predicted).select(F.lit("samples").alias("average"), *names)
    return micro.unionByName(macro).unionByName(weighted).unionByName(samples)
