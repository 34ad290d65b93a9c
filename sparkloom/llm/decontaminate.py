"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds every word sequence of the benchmark items of a block. Each task streams its documents through
it and tracks the longest match that ends at each word. Where a word pair is not in the automaton the match falls
back to one word, so only runs of known pairs that are long enough for a window need to be streamed; those runs are
found with array operations. This skips no match.

Blocks hold about `block_words` words of the benchmark, so that the automaton that is broadcast has a proven size whatever
the benchmark's or an item's; with more blocks, documents are written once and read against one block after the other.

Null or empty texts have no words and are never contaminated. Null or empty items have no windows. Items that share
an id count once. A document column with the name of a result column is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import map_texts, without, written

WINDOW = 13
#: A document is contaminated if its share of hit words is 1 / SHARE at least.
SHARE = 20
BLOCK_WORDS = 100_000
#: Upper case to lower case; all that is no word character to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class WordAutomaton:
    """Suffix automaton of several word sequences; knows which windows end in each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]) for name, words in items if words]
        for _, seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        #: A state's whole-window ancestor, as matches may be longer than a window.
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        self.base = [0] * len(self.length)
        for v in order:
            up = self.link[v]
            self.base[v] = self.base[up] if self.length[up] >= window else v
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for name, seq in coded:
            v = size = 0
            for c in seq:
                v, size = self.step(v, size, c)
                if size >= window:
                    self.items.setdefault(self.base[v], set()).add(name)
            if len(seq) < window:
                self.short.setdefault(v, []).append((len(seq), name))
        for v in order:
            if above := self.short.get(self.link[v]):
                self.short[v] = self.short.get(v, []) + above
        self.least = min([window, *(len(seq) for _, seq in coded)]) if coded else 0
        self.n = len(self.vocab) + 1
        pairs = [a * self.n + b for a, v in self.next[0].items() for b in self.next[v]]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self._slot(np.array(pairs, np.uint64))] = True

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[last] + 1 == length[q] else self._clone(last, q, c)
        cur = len(length)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[p] + 1 == length[q] else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        copy = len(self.length)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return (pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)

    def step(self, v: int, size: int, c: int) -> tuple[int, int]:
        """The state and length of the longest match after one more word."""
        while v and c not in self.next[v]:
            v = self.link[v]
            size = self.length[v]
        if c in self.next[v]:
            return self.next[v][c], size + 1
        return 0, 0

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged [start, end) word spans covered by windows, and the items that these belong to."""
        if not self.least or len(words) < self.least:
            return [], set()
        ids = np.fromiter(map(self.vocab.get, words, repeat(0)), np.uint64, len(words))
        known = ids > 0
        tied = np.zeros(len(ids) + 1, bool)
        tied[1:-1] = known[1:] & known[:-1] & self.bits[self._slot(ids[:-1] * np.uint64(self.n) + ids[1:])]
        starts = np.flatnonzero(~tied[:-1])
        ends = np.append(starts[1:], len(ids))
        long = (ends - starts >= self.least) & known[starts]
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        for lo, hi in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            v = size = 0
            for i, c in enumerate(ids[lo:hi].tolist(), lo):
                v, size = self.step(v, size, c)
                far = 0
                if size >= self.window:
                    far = size
                    names |= self.items.get(self.base[v], set())
                for n, name in self.short.get(v, ()):
                    if n <= size:
                        far = max(far, n)
                        names.add(name)
                if far:
                    start = i + 1 - far
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i + 1))
        return spans, names


def blocks_of(benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of about block_words words; items are read one partition at a time. A longer item is cut into
    pieces that overlap by what a window needs, so that every window lies in one."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), F.col(text).alias("text"))
    block, size = [], 0
    for r in items.toLocalIterator():
        words = words_of(r.text.encode() if r.text else None)
        for at in range(0, max(1, len(words) - window + 1), block_words):
            piece = words[at : at + block_words + window - 1]
            block.append((r.name, piece))
            size += len(piece)
            if size >= block_words:
                yield block
                block, size = [], 0
    if block:
        yield block


def _joined(spans: Column) -> Column:
    """Sorted spans as maximal ones."""
    end = lambda s: F.element_at(s, 2)
    return F.aggregate(
        spans,
        F.array().cast("array<array<int>>"),
        lambda a, s: F.when(
            (F.size(a) > 0) & (end(F.element_at(a, -1)) >= s[0]),
            F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.array(F.element_at(a, -1)[0], F.greatest(end(F.element_at(a, -1)), end(s))))),
        ).otherwise(F.concat(a, F.array(s))),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    share: int = SHARE,
    block_words: int = BLOCK_WORDS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds n_words, n_hit, n_items, items, word_spans and contaminated to every document.

    n_hit counts the words inside any occurrence of `window` consecutive words of an item, or of a whole item that
    is shorter; items names the items with such occurrences, sorted as strings. A document is contaminated if
    share * n_hit >= n_words and n_hit > 0.
    """
    fields = [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
    sc = docs.sparkSession.sparkContext
    blocks = blocks_of(benchmark, item_id, item_text, window, block_words)
    first, second = next(blocks, []), next(blocks, None)

    def matcher(block: list[tuple[str, list[bytes]]]):
        shared = sc.broadcast(WordAutomaton(block, window))

        def make():
            automaton = shared.value

            def work(texts):
                out = {"n_words": [], "word_spans": [], "items": []}
                for x in texts:
                    words = words_of(x)
                    spans, names = automaton.match(words)
                    out["n_words"].append(len(words))
                    out["word_spans"].append([list(s) for s in spans])
                    out["items"].append(sorted(names))
                return out

            return work

        return shared, make

    if second is None:
        found = map_texts(docs, matcher(first)[1], fields, text, keep)
    else:
        # the documents are written once with a number; each block leaves the few rows that it matches
        base = written(without(docs, "n_words", "word_spans", "items").withColumn("_row", F.monotonically_increasing_id()))
        parts = []
        for block in chain([first, second], blocks):
            shared, make = matcher(block)
            parts.append(written(map_texts(base, make, fields, text, ["_row"]).where(F.size("items") > 0)))
            shared.unpersist()
        hits = reduce(DataFrame.unionByName, parts).groupBy("_row").agg(F.sort_array(F.flatten(F.collect_list("word_spans"))).alias("word_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        kept = [c for c in (base.columns if keep is None else keep) if c != "_row"]
        counted = map_texts(base, lambda: lambda texts: {"n_words": [len(words_of(x)) for x in texts]}, fields[:1], text, [*kept, "_row"])
        none = F.array()
        found = counted.join(hits, "_row", "left").withColumns({
            "word_spans": _joined(F.coalesce("word_spans", none.cast("array<array<int>>"))), "items": F.coalesce("items", none.cast("array<string>")),
        }).drop("_row")
    n_hit = F.aggregate("word_spans", F.lit(0).cast("long"), lambda a, s: a + (s[1] - s[0]).cast("long"))
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))
    )


def clean_text(text: str, spans: list[list[int]]) -> str:
    """text without the words in these spans and what stands between them."""
    at = [m.span() for m in re.finditer(rb"[^ ]+", text.encode().translate(_FOLD))]
    raw, out, end = text.encode(), [], 0
    for lo, hi in spans:
        out.append(raw[end : at[lo][0]])
        end = at[hi - 1][1]
    return b"".join([*out, raw[end:]]).decode()


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns."""
    return df.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


__all__ = ["WordAutomaton", "clean_text", "decontaminate", "digest", "words_of"]
