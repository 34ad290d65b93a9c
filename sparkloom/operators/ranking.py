"""Ranks and running totals over whole tables without one task that holds them all."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that are numbered in one task, on average, and the least number of buckets.
BUCKET_ROWS, BUCKETS = 1_000_000, 64
#: Rows of the sample from which a border between buckets is taken.
PER_CUT = 64
#: Rows of a table by bucket up to which it is sent to all tasks.
SENT_ROWS = 1_000_000


def kept(df: DataFrame) -> DataFrame:
    """df computed once for several passes: checkpointed where the session has a folder for it, else kept on local disks."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        return df.checkpoint()
    return df.persist(StorageLevel.DISK_ONLY)


def sent(df: DataFrame) -> DataFrame:
    """df for a join: sent to all tasks if it is small, else left to be shuffled."""
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


def below(value: Column, cuts: list, kind: T.DataType) -> Column:
    """How many of the sorted cuts, of this type, are less than value; a row is compared with twice the root of their number."""
    if not cuts:
        return F.lit(0)
    literal = lambda c: (F.struct(*map(F.lit, c)) if isinstance(c, tuple) else F.lit(c)).cast(kind)
    step = math.isqrt(len(cuts))
    groups = [[literal(c) for c in cuts[i : i + step]] for i in range(0, len(cuts), step)]
    less = lambda some: F.size(F.filter(some, lambda c: c < value))
    at = F.greatest(less(F.array(*[g[0] for g in groups])) - 1, F.lit(0))
    return F.get(F.transform(F.array(at), lambda k: k * step + less(F.get(F.array(*[F.array(*g) for g in groups]), k))), 0)


def _with_offsets(df: DataFrame, by: list[str], bucket: str, totals: dict[str, Column], rows: int) -> DataFrame:
    """df with, for each total, that of the buckets before a row's own: from a row for each group and bucket."""
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*by, bucket).agg(*[c.alias(f"_sum_{n}") for n, c in totals.items()])
    offsets = sums.select(*by, bucket, *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in totals])
    return df.join(F.broadcast(offsets) if not by and rows <= SENT_ROWS else offsets, [*by, bucket])


def hash_rank(df: DataFrame, key: Column, seed: int = 42, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """The place of every row, from 0, in the order of md5(key-seed), within each group of `by`.

    Rows are numbered within buckets of the hash's first digits, of which there are as many as the rows ask for; the
    buckets' offsets come from counts.
    """
    by = by or []
    digits = max(2, math.ceil(math.log(max(1, df.count() / BUCKET_ROWS), 16)))
    coded = df.withColumn("_hash", F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))).withColumn("_bucket", F.substring("_hash", 1, digits))
    within = Window.partitionBy(*by, "_bucket").orderBy("_hash")
    joined = _with_offsets(coded, by, "_bucket", {"n": F.count(F.lit(1))}, 16**digits)
    return joined.withColumn(name, (F.row_number().over(within) - 1 + F.col("_off_n")).cast("long")).drop("_hash", "_bucket", "_off_n")


def _bucketed(df: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """Adds _key, the order as a struct, and _bucket, its range among borders from a sample by hash of bounded size."""
    keyed = df.withColumn("_key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    n = df.count()
    buckets = max(BUCKETS, -(-n // BUCKET_ROWS))
    share = min(1.0, PER_CUT * buckets / max(1, n))
    drawn = keyed.where(F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30)))).select("_key").orderBy("_key").collect()
    cuts = [tuple(r[0]) for r in drawn[:: max(1, len(drawn) // buckets)]][1:]
    return keyed.withColumn("_bucket", below(F.col("_key"), list(dict.fromkeys(cuts)), keyed.schema["_key"].dataType)), buckets


def running_totals(df: DataFrame, order: str | list[Column], values: dict[str, str]) -> DataFrame:
    """Adds, for each name, the sum of a column over all rows with a smaller `order`; order must be unique.

    Rows are dealt to ranges of `order`; the ranges' offsets come from their sums. df is computed once.
    """
    df = kept(df)
    coded, rows = _bucketed(df, [F.col(order)] if isinstance(order, str) else order)
    before = Window.partitionBy("_bucket").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    joined = _with_offsets(coded, [], "_bucket", {n: F.sum(c) for n, c in values.items()}, rows)
    return joined.select(*df.columns, *[(F.col(f"_off_{n}") + F.coalesce(F.sum(c).over(before), F.lit(0))).alias(n) for n, c in values.items()])


def numbered(df: DataFrame, order: list[Column], name: str, first: int = 0) -> DataFrame:
    """Adds the place of each row in the order, from `first` on; order must be unique."""
    out = running_totals(df.withColumn("_one", F.lit(1).cast("long")), order, {"_below": "_one"})
    return out.withColumn(name, F.col("_below") + first).drop("_one", "_below")
