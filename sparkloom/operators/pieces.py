"""Words cut into pieces of a vocabulary where they stand: in the arrays of their rows, without a shuffle.

A task works on each distinct word of a batch once and keeps what it has made of words, up to a bound in bytes, for the
batches after. Vocabularies and merges are sent to all tasks, behind a count of their entries.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

MARK, UNK, LONGEST = "##", "[UNK]", 100
#: Entries that a vocabulary which is sent to all tasks may have.
MOST_ENTRIES = 2_000_000
#: Bytes of words and pieces that a task keeps, and rows that it works on at once.
KEPT_BYTES, ROWS = 32 << 20, 256
#: Bytes of a batch that Spark sends to a task's Python: by rows alone, batches of long texts would be as large as these.
BATCH_BYTES = 4 << 20


def cut(word: str, vocab: set[str], longest: int = LONGEST) -> list[str]:
    """Longest matches from the left, MARK before all but the first; UNK for a long word or one with a rest."""
    out, start = [], 0
    while start < len(word) <= longest:
        head = MARK if start else ""
        end = next((e for e in range(len(word), start, -1) if head + word[start:e] in vocab), None)
        if end is None:
            return [UNK]
        out.append(head + word[start:end])
        start = end
    return out or [UNK]


def merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Joins the neighbouring pair of least rank, wherever it stands, until no pair has a rank.

    Pairs wait in a heap by rank and place, and symbols know their neighbours, so a word costs its length times the
    logarithm of that.
    """
    n = len(symbols)
    text, after, before = list(symbols), [*range(1, n), -1], [-1, *range(n - 1)]
    alive = [True] * n
    heap = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]  # noqa: B905
    heapq.heapify(heap)

    def rank_at(i: int) -> int | None:
        return ranks.get((text[i], text[after[i]])) if alive[i] and after[i] >= 0 else None

    while heap:
        rank, at = heap[0][0], []
        while heap and heap[0][0] == rank:
            at.append(heapq.heappop(heap)[1])
        new = []
        for i in at:  # from the left; a symbol that ended a pair doesn't begin the next
            if rank_at(i) != rank:
                continue
            j = after[i]
            text[i], alive[j], after[i] = text[i] + text[j], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            new.append(i)
        for i in {k for j in new for k in (j, before[j]) if k >= 0}:
            if (r := rank_at(i)) is not None:
                heapq.heappush(heap, (r, i))
    return [t for t, here in zip(text, alive, strict=True) if here]


# Bytes stand as the letters of Latin-1 that print; the others take the letters from 256 on.
def byte_letters() -> list[str]:
    """The letter of each byte."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class _Kept:
    """Results by word, emptied when they have grown past a bound."""

    def __init__(self, of: Callable[[str], list]):
        self.of, self.made, self.size = of, {}, 0

    def __call__(self, word: str) -> list:
        if (out := self.made.get(word)) is None:
            out = self.of(word)
            self.size += 4 * len(word) + 64 * (len(out) + 2)
            if self.size > KEPT_BYTES:
                self.made, self.size = {}, 4 * len(word) + 64 * (len(out) + 2)
            self.made[word] = out
        return out


def short_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches have no more than BATCH_BYTES; a lower bound of the user's stays. No result depends
    on it, and plans run after they are returned, so the setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(name)
    if not (now.rstrip("b").isdigit() and 0 < int(now.rstrip("b")) <= BATCH_BYTES):
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df


def in_rows(df: DataFrame, key: str, items: Column, name: str, kind: str, made: Callable[[], Callable[[pa.Array], pa.Array]]) -> DataFrame:
    """key and an array that has, for each item of a row's array, what is made of it, in order: a list for each item.

    made() gives, in a task, what maps a batch's items to lists. Null arrays have no items, and null items no results.
    """
    source = short_batches(df.select(F.col(key), items.alias("_items")))
    schema = f"array<{kind}>"
    typed = source.select(key, F.array().cast(schema).alias(name)).schema
    to = to_arrow_type(typed[1].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = made()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                lists = batch.column(1)
                flat, sizes = lists.flatten(), pc.fill_null(lists.value_lengths(), 0).to_numpy()
                out = of(flat)
                n = np.concatenate([[0], np.cumsum(pc.fill_null(out.value_lengths(), 0).to_numpy())])
                ends = n[np.concatenate([[0], np.cumsum(sizes)])]
                made_lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), out.flatten().cast(to.value_type))
                yield pa.RecordBatch.from_arrays([batch.column(0), made_lists], names=[key, name])

    return source.mapInArrow(run, typed)


def by_word(df: DataFrame, key: str, words: Column, made: Callable[[], Callable[[str], list]], kind: str, name: str = "pieces") -> DataFrame:
    """key and, as `name`, the results of all words of a row, in order; made() gives, in a task, what makes a word's."""
    results = pa.list_(pa.int32() if kind == "int" else pa.string())

    def each():
        of = _Kept(made())

        def lists(flat: pa.Array) -> pa.Array:
            coded = flat.dictionary_encode()
            cuts = pa.array([of(w) for w in coded.dictionary.to_pylist()], results)
            return cuts.take(coded.indices)

        return lists

    return in_rows(df, key, words, name, kind, each)


def _sent(df: DataFrame, known):
    if len(known) > MOST_ENTRIES:
        raise ValueError("the vocabulary is too large to be sent to all tasks")
    return df.sparkSession.sparkContext.broadcast(known)


def word_pieces(df: DataFrame, key: str, tokens: Column, vocab) -> DataFrame:
    """key and pieces of each row's tokens, in order; no tokens give no pieces. vocab is a tokenizer's list."""
    known = _sent(df, frozenset(vocab))
    return by_word(df, key, tokens, lambda: lambda w: cut(w, known.value), "string")


def merged_pieces(df: DataFrame, key: str, words: Column, merges: list[tuple[str, str]], *, end: str | None = None, in_bytes: bool | None = None, specials: Iterable[str] = ()) -> DataFrame:
    """key and pieces of each row's words by merges in the order of their ranks: of the letters of a word's bytes, or of its
    characters (by default where there is an end mark, which the last one carries). Specials are pieces as they stand."""
    return by_word(df, key, words, _merging(df, merges, end, in_bytes, specials), "string")


def _merging(df: DataFrame, merges: list[tuple[str, str]], end: str | None, in_bytes: bool | None, specials: Iterable[str]) -> Callable[[], Callable[[str], list[str]]]:
    """What gives, in a task, what cuts a word."""
    ranks, whole = _sent(df, {p: i for i, p in enumerate(merges)}), frozenset(specials)
    of_bytes = end is None if in_bytes is None else in_bytes

    def made():
        letters = byte_letters()

        def of(word: str) -> list[str]:
            symbols = [letters[b] for b in word.encode()] if of_bytes else list(word)
            if word in whole:
                return ["".join(symbols)]
            return merge([*symbols[:-1], symbols[-1] + (end or "")] if symbols else [], ranks.value)

        return of

    return made


def merged_ids(
    df: DataFrame, key: str, words: Column, merges: list[tuple[str, str]], vocab: dict[str, int], unknown: int | None = 0, *, end: str | None = None, in_bytes: bool | None = None, specials: Iterable[str] = ()
) -> DataFrame:
    """As ids_of of merged_pieces, in one pass: a word's ids are kept as its pieces would be, and pieces never leave a task."""
    cutting, known = _merging(df, merges, end, in_bytes, specials), _sent(df, vocab)

    def made():
        cut_up, ids = cutting(), known.value

        def of(word: str) -> list[int]:
            out = [ids.get(p, unknown) for p in cut_up(word)]
            if None in out:
                raise ValueError(f"not in the vocabulary: a piece of {word}")
            return out

        return of

    return by_word(df, key, words, made, "int", "ids")


def around_specials(text: Column, specials: Iterable[str], words: Callable[[Column], Column]) -> Column:
    """The words of a text between its special tokens, and these, in order. Where several begin, the longest is taken."""
    pattern = "|".join(re.escape(s) for s in sorted(set(specials), key=lambda s: (-len(s), s)))
    if not pattern:
        return words(text)
    whole = F.coalesce(text, F.lit(""))
    parts = F.arrays_zip(F.split(whole, pattern, -1).alias("p"), F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)).alias("s"))
    return F.flatten(F.transform(parts, lambda x: F.concat(words(x["p"]), F.when(x["s"].isNotNull(), F.array(x["s"])).otherwise(F.array().cast("array<string>")))))


def decode_bytes(pieces: Column) -> Column:
    """The text of byte-level pieces that make whole characters: letters back to bytes."""
    letters = byte_letters()
    moved = [(c, chr(b)) for b, c in enumerate(letters) if ord(c) >= 256 and b]  # translate takes a NUL for nothing
    shifted = F.translate(F.array_join(pieces, ""), "".join(c for c, _ in moved), "".join(b for _, b in moved))
    shifted = F.replace(shifted, F.lit(letters[0]), F.lit("\0"))
    return F.decode(F.encode(shifted, "ISO-8859-1"), "UTF-8")


def read_merges(path: str) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """The vocabulary and the merges, best first, of a tokenizer's JSON file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    return model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]


def with_specials(vocab: dict[str, int], specials: Iterable[str]) -> dict[str, int]:
    """The vocabulary with special tokens, as their bytes' letters, under ids of their own after all others."""
    letters, out = byte_letters(), dict(vocab)
    for s in specials:
        out.setdefault("".join(letters[b] for b in s.encode()), max(out.values(), default=-1) + 1)
    return out


def _single(values: pa.Array, found: pa.Array) -> pa.Array:
    """A list of one value for each index found, and of none elsewhere."""
    there = found.is_valid().to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(there)]).astype(np.int32)), values.take(found.drop_null()))


def ids_of(df: DataFrame, key: str, pieces: str, vocab: dict[str, int], unknown: int | None = 0) -> DataFrame:
    """key and ids of each row's pieces, in order; a piece that the vocabulary lacks gets `unknown`, or is an error if that is None."""
    known = _sent(df, vocab)

    def made():
        words, ids = pa.array(list(known.value), pa.string()), pa.array(list(known.value.values()), pa.int32())

        def of(flat: pa.Array) -> pa.Array:
            found = ids.take(pc.index_in(flat, value_set=words))
            if unknown is None and found.null_count:
                raise ValueError(f"not in the vocabulary: {flat.filter(found.is_null())[0]}")
            return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32)), pc.fill_null(found, unknown) if unknown is not None else found)

        return of

    return in_rows(df, key, F.col(pieces), "ids", "int", made)


def tokens_of(df: DataFrame, key: str, ids: str, vocab: dict[str, int], skip: tuple[int, ...] = ()) -> DataFrame:
    """key and tokens of each row's ids, in order, without those to skip and those that the vocabulary lacks."""
    known = _sent(df, {i: t for t, i in vocab.items() if i not in skip})

    def made():
        numbers, words = pa.array(list(known.value), pa.int32()), pa.array(list(known.value.values()), pa.string())
        return lambda flat: _single(words, pc.index_in(flat.cast(pa.int32()), value_set=numbers))

    return in_rows(df, key, F.col(ids), "tokens", "string", made)
