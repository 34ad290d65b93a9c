"""Samples with and without replacement, by label, exact in size and reproducible from the seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import ranking

#: Draws that a single row is expanded to; more rows of them are made by steps.
STEP = 10_000


def draw_number(seed: Column | str) -> Column:
    """A number of 48 bits from the md5 of a string."""
    return F.conv(F.substring(F.md5(seed), 1, 12), 16, 10).cast("long")


def ranked(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    return ranking.hash_rank(df, F.col(key), seed, by=[label])


def sizes(df: DataFrame, label: str, ratios: dict) -> DataFrame:
    """label, rows and size: int(rows * ratio); labels without a ratio keep their rows."""
    ratio = F.coalesce(*[F.when(F.col(label) == F.lit(k), F.lit(float(r))) for k, r in ratios.items()], F.lit(1.0))
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows")).withColumn("size", F.floor(F.col("rows") * ratio).cast("long"))


def sample_by_label(df: DataFrame, key: str, label: str, ratios: dict, seed: int = 42) -> DataFrame:
    """The rows of df and copies: n of each row.

    Ratios up to 1 draw without replacement, the first ranks of the hash; higher ones draw with replacement, each draw
    by its own number. Draws are spread over tasks in steps, so a large label isn't drawn in one task.
    """
    n = ranking.sent(sizes(df, label, ratios))  # a row for each label
    rows = ranked(df, key, label, seed).join(n, label)
    under = rows.where((F.col("size") <= F.col("rows")) & (F.col("rank") < F.col("size"))).withColumn("copies", F.lit(1).cast("long"))
    steps = n.where(F.col("size") > F.col("rows")).select(label, "rows", "size", F.explode(F.expr(f"sequence(0L, (size - 1) div {STEP})")).alias("_step"))
    draws = steps.repartition(F.col(label), F.col("_step")).select(label, "rows", F.explode(F.expr(f"sequence(_step * {STEP}, least(size, (_step + 1) * {STEP}) - 1)")).alias("_j"))
    taken = draws.select(label, (draw_number(F.concat_ws("-", F.col("_j").cast("string"), F.col(label).cast("string"), F.lit(str(seed)))) % F.col("rows")).alias("rank"))
    over = rows.join(taken.groupBy(label, "rank").agg(F.count(F.lit(1)).alias("copies")), [label, "rank"])
    return under.select(*df.columns, "copies").unionByName(over.select(*df.columns, "copies"))


def weighted_sample(df: DataFrame, key: str, label: str, weight: Column, n: int, seed: int = 42) -> DataFrame:
    """n rows of each label without replacement, successive draws by exp(weight): the least -ln(u) / exp(weight) win.

    Only the n best of each partition's share are kept before the labels meet: salts first, labels then.
    """
    u = (draw_number(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed)))) + 0.5) / float(1 << 48)
    rows = df.withColumn("_e", -F.log(u) / F.exp(weight)).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(64)))
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(label, "_salt").orderBy("_e", key))).where(F.col("_r") <= n)
    return first.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy("_e", key))).where(F.col("_r") <= n).drop("_r", "_e", "_salt")


def split(df: DataFrame, key: str, ratios: list[float], by: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Adds part: the cut of the hash's order at int(n * cumulative ratio), within each group of `by`. Ratios sum to 1."""
    if abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("the ratios must sum to 1")
    by = by or []
    rows = ranking.hash_rank(df, F.col(key), seed, by=by)
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    sums = [round(sum(ratios[: i + 1]), 12) for i in range(len(ratios) - 1)]
    part = sum(((F.col("rank") >= F.floor(F.col("_n") * s)).cast("int") for s in sums), F.lit(0))
    joined = rows.join(ranking.sent(n), by) if by else rows.crossJoin(F.broadcast(n))
    return joined.withColumn("part", part).drop("rank", "_n")
