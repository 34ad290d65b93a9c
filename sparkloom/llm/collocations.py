"""Phrases of words that occur together often, from positional inverted lists.

Documents are read into blocks of a bounded number of words. A block holds, for each of its phrases, the list of the
places where it occurs; lists of one word come first. A phrase one word longer is where a frequent phrase and, one place
on, another that ends with the adjacent word both stand: a merge of their sorted lists. The length of a phrase's lists in
all blocks is its exact frequency, and what is rarer than asked for is left before the next step, since no longer phrase
that holds it can be frequent.

Lists stay in their blocks. Between blocks go only a row for each block and phrase: one exchange by phrase adds the
lengths up and names the phrase by the first block and list that has it, and one by block brings back which lists are
frequent. A phrase is known by the names of its first and last parts, not by a hash. So no vocabulary is sent to all
tasks, and a word that stands everywhere has one row for each block.

A null text counts as empty and a null language as `und`. Repeated rows count each time. Texts of any length may come: one that
fills a block goes on in the next, which starts with the words before it and doesn't count what these hold by themselves.
An empty table has no phrases. Columns other than those of text and language aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import SLICE_BYTES, drop, written
from sparkloom.llm.hashing import U, mix

#: Words of a block, and the most that may be asked for.
BLOCK_WORDS, MOST_WORDS = 3_000_000, 1 << 23
#: Rows of keys in one Arrow batch.
KEY_ROWS = 50_000
#: Parts in which keys are exchanged, one after another, so that the disk holds a part of them at a time.
KEY_PARTS = 4
#: Parts in which blocks are dealt out again for the next size, one after another as well.
BLOCK_PARTS = 2
#: Parts that the rows of a hot phrase are dealt to in joins, and those of a language before the last ranking.
SALTS, HEATS = 8, 64
#: A list's number in its block has this many bits; its name is the block's number and this.
LIST_BITS = 24
#: A phrase that makes up this share of all words or more is hot; there can't be more of them than the share goes into one.
HOT = 1 / 1000
#: A block's lists: all places, each list's length and how many of it count, packed, and for phrases of several words the
#: packed pairs of their parts among `names`; for words, these, one in a line, and the packed places of their languages.
_BLOCK = "block long, lead int, lists binary, lengths binary, own binary"
_WORDS, _PHRASES = f"{_BLOCK}, words binary, langs array<string>, spoken binary", f"{_BLOCK}, pairs binary, names binary"
_END = b","


def _table() -> bytes:
    """Lower-cases A-Z, makes a tab a space, and all that ends a piece one mark."""
    table = bytearray(range(256))
    for c in range(ord("A"), ord("Z") + 1):
        table[c] = c + 32
    for c in b".,;:!?\n\x0b\x0c\r":
        table[c] = _END[0]
    table[ord("\t")] = ord(" ")
    return bytes(table)


def _chunks(data: bytes) -> Iterator[bytes]:
    """A translated text in chunks that end between words."""
    at = 0
    while len(data) - at > SLICE_BYTES:
        end = max(data.rfind(b" ", at + 1, at + SLICE_BYTES), data.rfind(_END, at + 1, at + SLICE_BYTES))
        if end < 0:
            ends = [x for x in (data.find(b" ", at + SLICE_BYTES), data.find(_END, at + SLICE_BYTES)) if x >= 0]
            end = min(ends, default=len(data))
        yield data[at:end]
        at = end
    yield data[at:]


class _Numbers(dict):
    """Numbers words as they come, from a counter that languages share."""

    def __init__(self, counter: Iterator[int]):
        super().__init__({_END: -1})
        self.counter = counter

    def __missing__(self, word: bytes) -> int:
        self[word] = n = next(self.counter)
        return n


_KINDS = {"long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "binary": pa.binary()}


def _batch(schema: str, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([(n, _KINDS[k]) for n, k in (f.split() for f in schema.split(", "))]))


class _Block:
    """Words of some documents, by place; -1 ends a piece."""

    def __init__(self, block: int, lang: str = "", lead: list[bytes] | None = None):
        self.block, self.counter = block, count()
        self.numbers: dict[str, _Numbers] = {}
        self.parts: list[np.ndarray] = []
        self.size, self.lead = 0, len(lead or [])
        if lead:
            self.add(lang, lead)

    def add(self, lang: str, words: list[bytes]) -> None:
        numbers = self.numbers.get(lang) or self.numbers.setdefault(lang, _Numbers(self.counter))
        self.parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def rows(self) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate(self.parts) if self.parts else np.empty(0, np.int32)
        places = np.flatnonzero(ids >= 0).astype(np.int32)
        ids = ids[places]
        if len(ids):
            named = sorted((n, lang, w) for lang, numbers in self.numbers.items() for w, n in numbers.items() if n >= 0)
            order = np.argsort(ids, kind="stable")
            row, _, _ = _lists(self.lead, 1, ids[order], places[order])
            langs = list(self.numbers)
            spoken = packed(np.array([langs.index(x[1]) for x in named], np.int32))
            yield _batch(_WORDS, [{"block": self.block, **row, "words": squeezed(b"\n".join(x[2] for x in named)), "langs": langs, "spoken": spoken}])


def squeezed(data: bytes) -> bytes:
    """Compressed, after its length."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def whole(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def packed(x: np.ndarray) -> bytes:
    """Differences of integers, compressed."""
    return squeezed(np.diff(x, prepend=x.dtype.type(0)).tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(np.frombuffer(whole(data), kind), dtype=kind)


def _lists(lead: int, size: int, keys: np.ndarray, places: np.ndarray, last: bool = False) -> tuple[dict[str, bytes | int | None], np.ndarray, np.ndarray]:
    """A block's lists of places by sorted keys, packed (without the places at the last size), the first of each, and how many count."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    ends = np.append(first[1:], len(keys))
    sums = np.concatenate([[0], np.cumsum(places >= lead - size + 1)])  # a phrase counts where its last word does
    own = (sums[ends] - sums[first]).astype(np.int32)
    row = {"lead": lead, "lists": None if last else packed(places.astype(np.int32)), "lengths": packed((ends - first).astype(np.int32)), "own": packed(own)}
    return row, first, own


def blocks(docs: DataFrame, text: str, lang: str, longest: int, words: int = BLOCK_WORDS) -> DataFrame:
    """The lists of single words."""
    source = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("binary").alias("text")).where("text is not null")

    def run(batches):
        from pyspark import TaskContext

        table, number = _table(), count(TaskContext.get().partitionId() << 16)
        now = _Block(next(number))
        for batch in batches:
            for named, data in zip(batch.column(0), batch.column(1), strict=True):
                named, tail = named.as_py(), []
                for chunk in _chunks(data.as_py().translate(table)):
                    found = chunk.replace(_END, b" , ").split()
                    now.add(named, found)
                    tail = (tail + found[-longest:])[-longest:]
                    if now.size >= words:
                        yield from now.rows()
                        at = max((i for i, w in enumerate(tail) if w == _END), default=-1)
                        now = _Block(next(number), named, tail[max(at + 1, len(tail) - longest + 1) :])
                now.add(named, [_END])
        yield from now.rows()

    return source.mapInArrow(run, _WORDS)


def merged(lists: DataFrame, frequent: DataFrame, size: int, last: bool, part: int = 0, parts: int = 1) -> DataFrame:
    """The lists of phrases of `size` words, where two frequent ones of a word less stand one place apart. Of the blocks of
    one of `parts` parts."""
    block = F.shiftright("place", LIST_BITS).alias("block")
    own = F.struct((F.col("place") % (1 << LIST_BITS)).cast("int").alias("local"), "name")
    here = lambda c: F.pmod(c, F.lit(parts)) == part
    known = frequent.where(here(F.shiftright("place", LIST_BITS))).groupBy(block).agg(F.collect_list(own).alias("known")).select("block", F.col("known.local").alias("local"), F.col("known.name").alias("name"))
    rows = lists.where(F.col("lists").isNotNull() & here(F.col("block"))).select("block", "lead", "lists", "lengths").join(known, "block")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block, lead, every, lengths = (batch.column(c)[i].as_py() for c in range(4))
                local, name = (batch.column(c)[i].values.to_numpy() for c in (4, 5))
                local, name = local[order := np.argsort(name)], name[order]
                every, lengths = unpacked(every, np.int32), unpacked(lengths, np.int32)
                n, starts = lengths[local], (np.cumsum(lengths, dtype=np.int32) - lengths)[local]
                take = np.repeat(starts - (np.cumsum(n, dtype=np.int32) - n), n) + np.arange(n.sum(), dtype=np.int32)
                places, phrase = every[take], np.repeat(np.arange(len(local), dtype=np.int32), n)
                del every, take
                order = np.argsort(places, kind="stable")  # merges sorted runs
                places, phrase = places[order], phrase[order]
                at = np.flatnonzero(places[1:] == places[:-1] + 1)
                if len(at):
                    key, places = phrase[at].astype(np.int64) * len(local) + phrase[at + 1], places[at]
                    del phrase, order
                    order = np.argsort(key, kind="stable")
                    key, places = key[order], places[order]
                    row, first, _ = _lists(lead, size, key, places, last)
                    yield _batch(_PHRASES, [{"block": block, **row, "pairs": packed(key[first]), "names": packed(name)}])

    return rows.mapInArrow(run, _PHRASES)


def word_keys(lists: DataFrame) -> DataFrame:
    """place, a (the language), b (the word) and n of each list of single words."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block, own, words, langs, spoken = (batch.column(c)[i].as_py() for c in range(5))
                own, words, langs = unpacked(own, np.int32), whole(words).split(b"\n"), pa.array(langs, pa.string()).take(pa.array(unpacked(spoken, np.int32)))
                for at in range(0, len(own), KEY_ROWS):
                    part = own[at : at + KEY_ROWS].astype(np.int64)
                    place = np.arange(at, at + len(part)) + (block << LIST_BITS)
                    columns = [pa.array(place), langs.slice(at, len(part)), pa.array(words[at : at + len(part)], pa.binary()), pa.array(part)]
                    yield pa.RecordBatch.from_arrays(columns, names=["place", "a", "b", "n"])

    return lists.select("block", "own", "words", "langs", "spoken").mapInArrow(run, "place long, a string, b binary, n long")


def keys_of(lists: DataFrame, part: int) -> DataFrame:
    """place, a, b and n of each list of phrases of several words: its name if it comes first, its parts and how many count.
    Those of one of KEY_PARTS parts, by a hash of the phrase."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block, own, pairs, names = (batch.column(c)[i].as_py() for c in range(4))
                own, pairs, names = unpacked(own, np.int32), unpacked(pairs, np.int64), unpacked(names, np.int64)
                for at in range(0, len(own), KEY_ROWS):
                    pair = pairs[at : at + KEY_ROWS]
                    place = np.arange(at, at + len(pair)) + (block << LIST_BITS)
                    columns = place, names[pair // len(names)], names[pair % len(names)], own[at : at + KEY_ROWS].astype(np.int64)
                    of = mix(columns[1].astype(np.uint64) ^ mix(columns[2].astype(np.uint64))) % U(KEY_PARTS) == part
                    yield pa.RecordBatch.from_arrays([pa.array(c[of]) for c in columns], names=["place", "a", "b", "n"])

    return lists.select("block", "own", "pairs", "names").mapInArrow(run, "place long, a long, b long, n long")


def frequencies(keys: DataFrame, least: int) -> DataFrame:
    """place and name of the lists of frequent phrases, and with a phrase's first list, whose place is its name, a, b and f."""
    same = Window.partitionBy("a", "b")
    found = keys.select("*", F.sum("n").over(same).alias("f"), F.min("place").over(same).alias("name")).where(F.col("f") >= least)
    return found.select("place", "name", *[F.when(F.col("name") == F.col("place"), F.col(c)).alias(c) for c in ("a", "b", "f")])


def _once(frequent: DataFrame) -> DataFrame:
    return frequent.where("name = place").select("name", "a", "b", "f")


def _longer(short: DataFrame, frequent: DataFrame, words: int) -> DataFrame:
    """Phrases with their frequency and those of all that they begin or end with, from phrases of a word less.

    Many phrases may begin or end with a hot one: these are dealt to SALTS parts, and what they are joined with to each.
    """
    hot = [r.name for r in short.where(F.col("f") >= max(1.0, words * HOT)).select("name").collect()]
    copies = F.when(F.col("name").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))) if hot else F.array(F.lit(0))
    salted = short.withColumn("salt", F.explode(copies))
    x = salted.select(F.col("name").alias("a"), F.col("salt").alias("x_salt"), "lang", "phrase", "heads", F.col("f").alias("head"))
    y = salted.select(F.col("name").alias("b"), F.col("salt").alias("y_salt"), "tails", F.col("last"), F.col("f").alias("tail"))
    salt = lambda c, by: F.when(F.col(c).isin(hot), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0).cast("int") if hot else F.lit(0)
    both = _once(frequent).withColumns({"x_salt": salt("a", "b"), "y_salt": salt("b", "a")}).join(x, ["a", "x_salt"]).join(y, ["b", "y_salt"])
    return both.select(
        "name", "a", "b", "lang", F.concat("phrase", F.lit(b" "), "last").alias("phrase"), "last", "f",
        F.concat("heads", F.array("head")).alias("heads"), F.concat("tails", F.array("tail")).alias("tails"),
    )


def cut_score(f: Column, heads: Column, tails: Column) -> Column:
    """score, k, l and r of the cut with the least score, the first of equal ones; in exact integers."""
    both = F.arrays_zip(heads.alias("l"), F.reverse(tails).alias("r"))
    wide = lambda c: c.cast("decimal(19,0)")
    return F.array_min(
        F.transform(
            both,
            lambda x, k: F.struct(
                F.call_function("div", wide(f) * F.lit(2_000_000).cast("decimal(7,0)"), wide(x["l"]) + wide(x["r"])).alias("score"), (k + 1).alias("k"), x["l"].alias("l"), x["r"].alias("r")
            ),
        )
    )


def mine(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 30, percent: int = 80, longest: int = 4, top: int = 2000, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first `top` phrases of 2 to `longest` words.

    Phrases occur `least` times or more; one that stands inside a longer one with `percent` of its frequency goes. The
    words of a phrase are joined by a space, its score is that of its weakest cut, and n counts the words of a language.
    """
    if longest < 2 or not 0 < block_words <= MOST_WORDS:
        raise ValueError("phrases have two words at least, and a block at most MOST_WORDS")
    tables = [written(blocks(docs, text, lang, longest, block_words))]
    lists = tables[0]
    keys = word_keys(lists)
    words = written(keys.groupBy(F.col("a").alias("lang")).agg(F.sum("n").alias("n")))
    number = words.agg(F.sum("n")).first()[0] or 0
    parts = [written(frequencies(keys, least))]
    frequent = parts[0]
    short = _once(frequent).select("name", F.col("a").alias("lang"), F.col("b").alias("phrase"), F.col("b").alias("last"), "f", F.array().cast("array<long>").alias("heads"), F.array().cast("array<long>").alias("tails"))
    short = written(short)
    found, used = [], [words, short]
    for size in range(2, longest + 1):
        after = [written(merged(lists, frequent, size, size == longest, i, BLOCK_PARTS)) for i in range(BLOCK_PARTS)]
        drop(*tables, *parts)
        tables, lists = after, reduce(DataFrame.unionByName, after)
        parts = [written(frequencies(keys_of(lists, i), least)) for i in range(KEY_PARTS)]
        frequent = reduce(DataFrame.unionByName, parts)
        long = written(_longer(short, frequent, number))
        used.append(long)
        if size > 2:
            found.append(_lasting(short, long, percent))
        short = long
    drop(*tables, *parts)
    found.append(short)
    columns = ["lang", "phrase", "f", "heads", "tails"]
    every = found[0].select(columns)
    for more in found[1:]:
        every = every.unionByName(more.select(columns))
    cut = every.select("lang", "phrase", F.col("f").alias("a"), cut_score(F.col("f"), F.col("heads"), F.col("tails")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    heat = F.pmod(F.xxhash64("phrase"), F.lit(HEATS))
    first = cut.withColumn("_heat", heat).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_heat").orderBy(*best))).where(F.col("rank") <= top).drop("_heat")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    result = ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score")
    result = written(result)
    drop(*used)
    return result


def _lasting(short: DataFrame, long: DataFrame, percent: int) -> DataFrame:
    """Phrases that aren't as good as always part of one a word longer. Those two words longer needn't be asked: what
    stands between them is at least as frequent."""
    parts = long.select(F.col("a").alias("name"), "f").unionByName(long.select(F.col("b").alias("name"), "f"))
    most = parts.groupBy("name").agg(F.max("f").alias("most"))
    wide = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(19,0)")
    return short.join(most, "name", "left").where(wide("most") * 100 < wide("f") * percent)
