"""Vocabularies and fixed-length id sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.ranking import numbered

PAD, UNK = "[PAD]", "[UNK]"


def chars(text: Column) -> Column:
    """Code points of the trimmed text; an empty or null text has none."""
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), ""), lambda c: c != "")


def words(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda c: c != "")


def token_counts(df: DataFrame, tokens: Column) -> DataFrame:
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def first_seen(df: DataFrame, order: str, tokens: Column) -> DataFrame:
    """token, id and n: ids from 1 by first occurrence in (order, position). PAD is 0 and UNK comes last.

    Tokens are aggregated within documents, over longs alone, before they are shuffled; the numbering sees a row for
    each distinct token.
    """
    each = df.select(F.col(order).alias("o"), F.posexplode(tokens).alias("p", "token")).groupBy("o", "token").agg(F.min("p").alias("p"), F.count(F.lit(1)).alias("n"))
    seen = each.groupBy("token").agg(F.min(F.struct("o", "p")).alias("at"), F.sum("n").alias("n"))
    return with_specials(numbered(seen, [F.col("at.o"), F.col("at.p")], "id", 1).select("token", "id", "n"))


def first_chars(df: DataFrame, order: str, text: Column) -> DataFrame:
    """As first_seen, of characters: each text's distinct ones are found in it, so that no row stands for an occurrence."""
    trimmed = df.select(F.col(order).alias("o"), F.trim(F.coalesce(text, F.lit(""))).alias("t"))
    each = trimmed.select("o", "t", F.explode(F.array_distinct(F.split("t", ""))).alias("token")).where("token <> ''")
    count = F.floor((F.length("t") - F.length(F.replace(F.col("t"), F.col("token"), F.lit(""))))).cast("long")
    placed = each.select("token", F.struct("o", F.instr("t", F.col("token")).alias("p")).alias("at"), count.alias("n"))
    seen = placed.groupBy("token").agg(F.min("at").alias("at"), F.sum("n").alias("n"))
    return with_specials(numbered(seen, [F.col("at.o"), F.col("at.p")], "id", 1).select("token", "id", "n"))


def with_specials(vocab: DataFrame) -> DataFrame:
    extra = vocab.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).select(
        F.explode(F.array(F.struct(F.lit(PAD).alias("token"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("n")), F.struct(F.lit(UNK).alias("token"), (F.col("m") + 1).cast("long").alias("id"), F.lit(0).cast("long").alias("n")))).alias("x")
    ).select("x.*")
    return vocab.unionByName(extra)


def capped(counts: DataFrame, min_freq: int = 1, max_size: int | None = None) -> DataFrame:
    """Tokens with min_freq occurrences, the max_size most frequent (ties by token), with ids from 1 in that order."""
    kept = counts.where(F.col("n") >= min_freq)
    if max_size:
        kept = kept.orderBy(F.desc("n"), "token").limit(max_size)
    return numbered(kept, [-F.col("n"), F.col("token")], "id", 1).select("token", "id", "n")


def legacy(counts: DataFrame, min_freq: int = 1) -> DataFrame:
    """token and id, from 0 by count; UNK follows and PAD is last."""
    kept = capped(counts, min_freq).select("token", (F.col("id") - 1).alias("id"))
    n = kept.agg(F.count(F.lit(1)).alias("m"))
    ends = n.select(F.explode(F.array(F.struct(F.lit(UNK).alias("token"), F.col("m").alias("id")), F.struct(F.lit(PAD).alias("token"), (F.col("m") + 1).alias("id")))).alias("x")).select("x.*")
    return kept.unionByName(ends)


def pad_mask(length: Column, size: int) -> Column:
    """Ones for the real part, zeros for the padding."""
    real = F.least(length, F.lit(size))
    return F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), F.lit(size) - real))


def extended(old: DataFrame, counts: DataFrame) -> DataFrame:
    """Ids of `old` stay; new tokens follow by count."""
    new = counts.join(old.select("token"), "token", "left_anti")
    start = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m"))
    placed = numbered(new, [-F.col("n"), F.col("token")], "r", 1).crossJoin(F.broadcast(start))
    return old.select("token", "id").unionByName(placed.select("token", (F.col("m") + F.col("r")).cast("long").alias("id")))


#: Entries up to which a vocabulary is sent to every task as one map, which is searched from its start; larger ones are joined.
MAP_ENTRIES = 2000


def _padded(ids: Column, length: int) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0).cast("long"), length)), 1, length)


def encode_chars(df: DataFrame, key: str, text: Column, vocab: DataFrame, length: int, carry: list[str] | None = None) -> DataFrame:
    """As encode, of characters: ids stand in a table by code point, which Unicode bounds. Tokens that are no character
    aside from UNK don't count."""
    known = vocab.where((F.length("token") == 1) | (F.col("token") == UNK))
    unk = known.where(F.col("token") == UNK).agg(F.max("id").alias("_u"))
    codes = known.where(F.length("token") == 1).agg(F.map_from_entries(F.collect_list(F.struct(F.ascii("token"), "id"))).alias("_m"))
    full = F.transform(F.sequence(F.lit(0), F.coalesce(F.array_max(F.map_keys("_m")), F.lit(0))), lambda c: F.coalesce(F.try_element_at("_m", c), F.col("_u")))
    table = codes.crossJoin(unk).select(full.alias("_v"), "_u")
    cut = F.filter(F.split(F.substring(F.trim(F.coalesce(text, F.lit(""))), 1, length), ""), lambda c: c != "")
    base = df.select(key, *(carry or []), cut.alias("_t")).crossJoin(F.broadcast(table))
    ids = F.transform("_t", lambda c: F.coalesce(F.get("_v", F.ascii(c)), F.col("_u")))
    return base.select(key, *(carry or []), _padded(ids, length).alias("ids"), F.size("_t").cast("long").alias("real_len"))


def encode(df: DataFrame, key: str, tokens: Column, vocab: DataFrame, length: int, carry: list[str] | None = None) -> DataFrame:
    """key, ids (of `length`, padded with 0) and real_len. Unknown tokens get the id of UNK.

    A small vocabulary is looked up in a map without exploding the texts; else the tokens are joined and gathered again.
    """
    cut = F.slice(tokens, 1, length)
    base = df.select(key, *(carry or []), cut.alias("_t"), F.least(F.size(cut), F.lit(length)).cast("long").alias("real_len"))
    few = vocab.select("token", "id").limit(MAP_ENTRIES + 1).collect()
    if len(few) <= MAP_ENTRIES:
        table = df.sparkSession.createDataFrame(few, "token string, id long").coalesce(1).agg(F.map_from_entries(F.collect_list(F.struct("token", "id"))).alias("_v"))
        found = lambda t: F.coalesce(F.try_element_at("_v", t), F.element_at("_v", F.lit(UNK)))
        return base.crossJoin(F.broadcast(table)).select(key, *(carry or []), _padded(F.transform("_t", found), length).alias("ids"), "real_len")
    unk = vocab.where(F.col("token") == UNK).first()["id"]
    rows = base.select(key, F.posexplode("_t").alias("_p", "_token")).join(vocab.select(F.col("token").alias("_token"), F.col("id").alias("_id")), "_token", "left")
    ids = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", F.coalesce("_id", F.lit(unk)).alias("_id")))), lambda x: x["_id"]).alias("_ids"))
    return base.join(ids, key, "left").select(key, *(carry or []), _padded(F.coalesce("_ids", F.array().cast("array<bigint>")), length).alias("ids"), "real_len")
