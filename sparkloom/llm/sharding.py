"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

The tree has regions of racks of shards; a node weighs as much as the shards below it. At each level a row draws
-ln(u) / weight for each of the options there, u being a hash of its key, the level and the option, and goes down into
the least: first among the regions, then among the racks of that region alone, then among the shards of that rack. So a
row costs as many draws as there are options on its way. Options win in proportion to their weights, and if a weight
changes, the draws of all other nodes of its level stay as they are: with a heavier rack, rows move into that rack from
its region's other racks and into its region from other regions, and no row moves between nodes whose weights stay.

The law is `key`: the key and the tree decide. A tree grows by a region of its own for the new shard (`grown`), which
therefore takes rows only into itself.

Slots number the rows of a shard without gaps: the placed rows, which are short, are written, dealt to buckets of a
shard and numbered there; the buckets' starts come from counts. Buckets are drawn by row, not by key, so a key or a
text that a third of the rows share is numbered in as many tasks as any other; which slot a row gets depends on the
layout of the input. A null key is hashed as null is; a null text has no bytes. Rows that are equal in all columns get
different slots. Input columns other than key and text are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import written

Tree = list[list[list[int]]]
SHARDS = 24
RACK = 4
REGION = 2
#: Rows of one shard that are numbered together, on average.
BUCKET_ROWS = 50_000


def tree_of(shards: int, rack: int = RACK, region: int = REGION) -> Tree:
    """Shards 0 to shards - 1 as regions of racks; each but the last is full."""
    racks = [list(range(i, min(i + rack, shards))) for i in range(0, shards, rack)]
    return [racks[i : i + region] for i in range(0, len(racks), region)]


def grown(tree: Tree) -> Tree:
    """The tree with one more shard, which stands in a region of its own."""
    return [*tree, [[1 + max(s for region in tree for rack in region for s in rack)]]]


def descend(key: Column, tree: Tree, weights: dict[int, float] | None = None) -> Column:
    """The shard at which the row's way through the tree ends."""
    weight = lambda shards: float(sum((weights or {}).get(s, 1.0) for s in shards))
    leaf = lambda s: F.struct(F.lit(s).alias("name"), F.lit(weight([s])).alias("weight"))
    rack = lambda r: F.struct(F.lit(r[0]).alias("name"), F.lit(weight(r)).alias("weight"), F.array(*map(leaf, r)).alias("below"))
    region = lambda g: F.struct(F.lit(g[0][0]).alias("name"), F.lit(weight(sum(g, []))).alias("weight"), F.array(*map(rack, g)).alias("below"))

    def least(options: Column, level: int) -> Column:
        """The option of least draw; nodes are named after their first shard."""
        u = lambda o: (F.xxhash64(key, F.lit(level), o["name"]).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)
        draws = F.transform(options, lambda o, i: F.struct((-F.log(u(o)) / o["weight"]).alias("draw"), i.alias("i")))
        return F.get(options, F.array_min(draws)["i"])

    # each level's winner is bound once: a lambda computes what it names anew
    bound: Callable = lambda value, then: F.get(F.transform(F.array(value), then), 0)
    down = bound(least(F.array(*map(region, tree)), 0), lambda g: bound(least(g["below"], 1), lambda r: least(r["below"], 2)["name"]))
    return down


def shard(docs: DataFrame, *, key: str = "doc_id", text: str = "text", tree: Tree | None = None, weights: dict[int, float] | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard (with one more shard) of every row."""
    tree = tree or tree_of(SHARDS)
    shards = sum(len(rack) for region in tree for rack in region)
    rows = written(
        docs.select(
            F.col(key),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
            F.lit("key").alias("law"),
            descend(F.col(key), tree, weights).alias("shard"),
            descend(F.col(key), grown(tree), weights).alias("grown_shard"),
            F.xxhash64(F.monotonically_increasing_id()).alias("_lot"),
        )
    )
    buckets = -(-max(1, rows.count()) // (shards * bucket_rows))
    placed = rows.withColumn("_bucket", F.pmod("_lot", F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n")).select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_bucket").orderBy(key, "text_crc32", "size", "_lot")
    # both sides are dealt by shard and bucket
    numbered = placed.withColumn("_row", F.row_number().over(within) - 1).join(starts, ["shard", "_bucket"])
    return numbered.select(key, "size", "text_crc32", "law", "shard", (F.col("_start") + F.col("_row")).cast("long").alias("slot"), "grown_shard")
