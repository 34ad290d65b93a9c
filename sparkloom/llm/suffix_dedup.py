"""Removal of repeated byte strings by distributed prefix doubling.

A byte goes if a string of `size` bytes that covers it also starts earlier: in a document with a smaller doc_id, or
earlier in the same one. Ranks double from half the size to the size. In each round Spark sorts positions by a pair of
ranks, then by document and place, over all tasks; a position whose pair is unlike its neighbours' is unique and leaves,
and of equal pairs the first is the earliest. What neighbours in other tasks are is known from a row for each task, so a
pair that a third of the positions share is sorted in as many tasks as any other.

The second round's pair is of the ranks of the half-size strings at offsets 0 and `size - half`, which spans `size`
bytes. The first round doesn't need every position: in each string of `size` bytes the half-size substring with the
least hash (the first of them) is its anchor, and equal strings have equal anchors at equal places. The strings that
share an anchor are consecutive and together span one context. The first round's pair is of the anchor and its context:

* of equal contexts all but the first are repeated as a whole;
* a first context whose anchor has no other context holds no string that starts earlier;
* only the strings of first contexts whose anchors have several go into the second round.

A half-size string's rank is a hash of 64 bits, so a pair is taken for another with odds of 2^-128; hashes are sums
modulo 2^64, which are weak for strings of over a thousand bytes only, and contexts have less than twice `size`.

Rows that a batch has already shown to be repeated aren't sent, so that a passage which a third of the documents share
has one row for each batch, not for each document.

Null texts count as empty; texts shorter than `size` keep all bytes. A null doc_id comes before all others. Rows that
share a doc_id, or have none, come in the order of a hash of their texts, so that they are documents of their own and no
hot key; rows with the same id and text are one document, and all of them keep what it keeps. Columns other than doc_id
and text are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import drop, short_batches, slices, written
from sparkloom.llm.hashing import Substrings, U, mix
from sparkloom.operators.ranking import sent

SIZE = 100
_PAIRS = "a long, b long, doc_id long, at int, known boolean"
_TIED = "a long, b long, doc_id long, tie long, at int, known boolean"
NULL_ID = -(1 << 63)


class Runs:
    """Strings of `size` bytes in a slice of documents, by anchor. Positions count in the joined texts."""

    def __init__(self, texts: list[bytes], size: int):
        self.size, self.half = size, size // 2
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        n = len(self.text)
        self.low = self.high = self.doc = np.empty(0, np.int64)
        if n < size:
            return
        self.hashes = Substrings(self.text)
        halves = self.hashes.all_of(self.half)
        # the hash's high bits, then the position: the least is the leftmost anchor
        least = (mix(halves) & ~U((1 << 32) - 1)) | np.arange(len(halves), dtype=np.uint64)
        span, done = size - self.half + 1, 1
        while done < span:
            step = min(done, span - done)
            least = np.minimum(least[:-step], least[step:])
            done += step
        anchor = (least & U((1 << 32) - 1)).astype(np.int64)
        sizes = np.diff(self.starts)
        valid = np.zeros(n + 1, np.int8)
        whole = sizes >= size
        np.add.at(valid, self.starts[:-1][whole], 1)
        np.add.at(valid, self.starts[1:][whole] - size + 1, -1)
        valid = np.cumsum(valid[: len(anchor)]).astype(bool)
        first = valid.copy()
        first[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
        first[self.starts[:-1][whole]] = True
        last = valid.copy()
        last[:-1] &= first[1:] | ~valid[1:]
        self.low, self.high = np.flatnonzero(first), np.flatnonzero(last)
        self.doc = np.searchsorted(self.starts, self.low, side="right") - 1
        self.anchor = anchor[self.low]
        self.key = halves[self.anchor]
        place = mix((self.anchor - self.low).astype(np.uint64) * U(1 << 32) + (self.high - self.low).astype(np.uint64))
        self.context = mix(self.hashes.at(self.low, self.high + size) ^ place)

    def halves_at(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        off = self.size - self.half
        return self.hashes.at(start, start + self.half), self.hashes.at(start + off, start + off + self.half)


def firsts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where a pair of keys occurs for the first time."""
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    out = np.zeros(len(order), bool)
    out[order[new]] = True  # lexsort is stable: the first row of a group is the earliest
    return out


def _ordered(batch: pa.RecordBatch, once: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], pa.RecordBatch]]:
    """Slices of a batch in the order of doc_id and tie; each document once, if asked for."""
    ids, ties = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tie"))
    order = np.lexsort((ties, ids))
    if once and len(order):
        order = order[np.concatenate([[True], (np.diff(ids[order]) != 0) | (np.diff(ties[order]) != 0)])]
    batch = batch.take(pa.array(order))
    for part in slices(batch, "text"):
        ids, ties = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tie"))
        yield ids, ties, [t or b"" for t in part.column("text").to_pylist()], part


def _places(r: Runs, lists: list[np.ndarray]) -> np.ndarray:
    """Places of each document's strings in the joined texts. Those of a longer text with the same doc_id aren't its own."""
    sizes = np.diff(r.starts)
    return np.concatenate([m[m + r.size <= n] + at for m, n, at in zip(lists, sizes, r.starts[:-1], strict=True)]).astype(np.int64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


_SWEPT = "edge boolean, doc_id long, tie long, at int, several boolean, a long, b long, known boolean, last_a long, last_b long, open_doc long, open_tie long, open_at int, part int"


def _sweep(batches, repeated: bool):
    """Reads a task's rows (a, b, doc_id, tie, at, known) in this order and yields the first row of each pair, and whether its a
    has several b; or, with repeated, all others and those known to be. Of the task's own first row, and of the first row
    of the last a if that has one b as yet, a row at the edge says what they and their neighbours are."""
    from pyspark import TaskContext

    names = [f.split()[0] for f in _SWEPT.split(", ")]
    prev = head = pending = before = None
    more = head_known = False

    def rows(doc, tie, at, several):
        n = len(doc)
        none = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())]
        own = [pa.array(np.asarray(x, np.int64)) for x in (doc, tie)]
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, bool)), *own, pa.array(np.asarray(at, np.int32)), pa.array(np.asarray(several, bool)), *none], names=names)

    for batch in batches:
        a, b, doc, tie, at = (batch.column(c).to_numpy() for c in ("a", "b", "doc_id", "tie", "at"))
        known = batch.column("known").to_numpy(zero_copy_only=False)
        if not len(a):
            continue
        # the same position may come twice, from rows that are one document
        whole = a, b, doc, tie, at
        new = np.concatenate([[before != tuple(int(x[0]) for x in whole)], np.logical_or.reduce([x[1:] != x[:-1] for x in whole])])
        before = tuple(int(x[-1]) for x in whole)
        if not new.any():
            continue
        a, b, doc, tie, at, known = (x[new] for x in (*whole, known))
        new_a, new_b = np.ones(len(a), bool), np.ones(len(a), bool)
        new_a[1:] = a[1:] != a[:-1]
        new_b[1:] = new_a[1:] | (b[1:] != b[:-1])
        if prev is not None:
            new_a[0] = a[0] != prev[0]
            new_b[0] = new_a[0] or b[0] != prev[1]
        first = np.flatnonzero(new_b)
        several = ~new_a[first]
        several[:-1] |= ~new_a[first[1:]]
        if pending is not None and len(first):
            is_several = not new_a[first[0]]
            if pending == head:
                more = is_several
            elif not repeated:
                yield rows([pending[2]], [pending[3]], [pending[4]], [is_several])
            pending = None
        emit = np.ones(len(first), bool)
        if head is None:
            head, head_known = (int(a[0]), int(b[0]), int(doc[0]), int(tie[0]), int(at[0])), bool(known[0])
            emit[0], more = False, bool(several[0])
        if len(first) and new_a[first[-1]]:
            i = first[-1]
            pending, emit[-1] = (int(a[i]), int(b[i]), int(doc[i]), int(tie[i]), int(at[i])), False
        prev = int(a[-1]), int(b[-1])
        if repeated:
            other = np.flatnonzero(~new_b | known)
            other = other[(doc[other] != head[2]) | (tie[other] != head[3]) | (at[other] != head[4])]
            yield rows(doc[other], tie[other], at[other], np.zeros(len(other), bool))
        else:
            yield rows(doc[first[emit]], tie[first[emit]], at[first[emit]], several[emit])
    if head is not None:
        a, b, doc, tie, at = head
        after = pending[2:] if pending is not None and pending != head else (None, None, None)
        edge = [True, doc, tie, at, more, a, b, head_known, *prev, *after, TaskContext.get().partitionId()]
        types = [pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(edge, types, strict=True)], names=names)


def _edges(tasks: list) -> tuple[list, list]:
    """From each task's row at the edge: the first rows (doc_id, tie, at, several) that were left open, and those repeated."""
    tasks = sorted(tasks, key=lambda r: r.part)

    def goes_on(i: int, a: int, b: int) -> bool:
        """Whether a has another b in the tasks after i."""
        for r in tasks[i + 1 :]:
            if r.a != a:
                return False
            if r.b != b or r.several:
                return True
            if r.last_a != a:
                return False
        return False

    firsts, repeated = [], []
    for i, r in enumerate(tasks):
        before = tasks[i - 1] if i else None
        if r.known or before and (before.last_a, before.last_b) == (r.a, r.b):
            repeated.append((r.doc_id, r.tie, r.at, False))
        else:
            other = before is not None and before.last_a == r.a
            firsts.append((r.doc_id, r.tie, r.at, other or r.several or r.last_a == r.a and goes_on(i, r.a, r.b)))
        if r.open_doc is not None:
            firsts.append((r.open_doc, r.open_tie, r.open_at, goes_on(i, r.last_a, r.last_b)))
    return firsts, repeated


def ranked(pairs: DataFrame, repeated: bool) -> tuple[DataFrame, DataFrame]:
    """doc_id, tie, at and several of the earliest position of each pair (a, b), or of all others; and the table to drop.
    Pairs without a tie have none in the result either."""
    tied = "tie" in pairs.columns
    order = ["a", "b", "doc_id", "tie", "at"]
    rows = (pairs if tied else pairs.withColumn("tie", F.lit(0).cast("long"))).repartitionByRange(*order).sortWithinPartitions(*order)
    swept = written(rows.mapInArrow(lambda batches: _sweep(batches, repeated), _SWEPT))
    open_rows = _edges(swept.where("edge").collect())[int(repeated)]  # a row or two for each task
    more = pairs.sparkSession.createDataFrame(open_rows, "doc_id long, tie long, at int, several boolean")
    found = swept.where("not edge").select("doc_id", "tie", "at", "several").unionByName(more)
    return found if tied else found.drop("tie"), swept


def _tied(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, tie and text. Rows without an id, or with one that others have, differ by a hash of their text: the tie, 0 for all
    others. So what is known of one row isn't sent to all that share its id."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    shared = sent(written(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id", F.lit(True).alias("_shared"))))
    tie = F.when(F.col("_shared"), F.xxhash64(F.coalesce("text", F.lit(b"")))).otherwise(F.lit(0).cast("long"))
    return rows.join(shared, "doc_id", "left").select("doc_id", tie.alias("tie"), "text")


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with_kept, the remaining bytes of every document."""
    rows = _tied(docs, doc_id, text)

    def contexts(batches):
        for batch in batches:
            for ids, ties, texts, _ in _ordered(batch, True):
                r = Runs(texts, size)
                if len(r.low):
                    at = np.flatnonzero(firsts(r.key, r.context))
                    yield pa.RecordBatch.from_arrays(
                        [_signed(r.key[at]), _signed(r.context[at]), pa.array(ids[r.doc[at]]), pa.array(ties[r.doc[at]]), pa.array((r.low - r.starts[r.doc])[at].astype(np.int32)), pa.array(np.zeros(len(at), bool))],
                        names=["a", "b", "doc_id", "tie", "at", "known"],
                    )

    first, swept = ranked(rows.mapInArrow(contexts, _TIED), False)
    mark = F.col("at").cast("long") * 2 + F.col("several").cast("long")
    marks = written(first.groupBy("doc_id", "tie").agg(F.collect_list(mark).alias("marks")))
    drop(swept)
    marked = rows.join(marks, ["doc_id", "tie"], "left")

    def strings(batches):
        for batch in batches:
            for ids, ties, texts, part in _ordered(batch, True):
                wanted = [np.array(m or [], np.int64) for m in part.column("marks").to_pylist()]
                if not any((m & 1).any() for m in wanted):
                    continue
                r = Runs(texts, size)
                starts = _places(r, [m[(m & 1) == 1] >> 1 for m in wanted])
                run = np.flatnonzero(np.isin(r.low, starts))
                count = r.high[run] - r.low[run] + 1
                at = np.repeat(r.low[run] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                doc = np.repeat(r.doc[run], count)
                a, b = r.halves_at(at)
                new = firsts(a, b)
                # what repeats within the slice is known to: it gets a key of its own
                own = mix(ids[doc].astype(np.uint64) ^ mix(ties[doc].astype(np.uint64) ^ mix(at.astype(np.uint64))))
                yield pa.RecordBatch.from_arrays(
                    [_signed(np.where(new, a, own)), _signed(np.where(new, b, ~own)), pa.array(ids[doc]), pa.array(ties[doc]), pa.array((at - r.starts[doc]).astype(np.int32)), pa.array(~new)],
                    names=["a", "b", "doc_id", "tie", "at", "known"],
                )

    twice, _ = ranked(marked.select("doc_id", "tie", "text", "marks").mapInArrow(strings, _TIED), True)
    again = twice.groupBy("doc_id", "tie").agg(F.collect_list("at").alias("again"))
    last = marked.join(again, ["doc_id", "tie"], "left").select("doc_id", "tie", "text", "marks", "again")

    def cut(batches):
        for batch in batches:
            for ids, ties, texts, part in _ordered(batch):
                r = Runs(texts, size)
                over = np.zeros(len(r.text) + 1, np.int32)
                lists = part.column("marks").to_pylist(), part.column("again").to_pylist()
                kept = _places(r, [np.array(m or [], np.int64) >> 1 for m in lists[0]])
                gone = ~np.isin(r.low, kept)
                single = _places(r, [np.array(m or [], np.int64) for m in lists[1]])
                np.add.at(over, np.concatenate([r.low[gone], single]), 1)
                np.add.at(over, np.concatenate([r.high[gone], single]) + size, -1)
                removed = np.cumsum(over[:-1]) > 0
                out = {"doc_id": ids, "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
                for lo, hi in zip(r.starts[:-1].tolist(), r.starts[1:].tolist(), strict=True):
                    x = removed[lo:hi]
                    out["n_bytes"].append(hi - lo)
                    out["n_removed"].append(int(x.sum()))
                    out["n_spans"].append(int(x[:1].sum() + (x[1:] & ~x[:-1]).sum()))
                    out["kept"].append(r.text[lo:hi][~x].tobytes())
                out["kept_sha256"] = [hashlib.sha256(k).hexdigest() for k in out["kept"]]
                if not with_kept:
                    del out["kept"]
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long" + ", kept binary" * with_kept + ", kept_sha256 string"
    result = short_batches(last).mapInArrow(cut, schema)
    return result.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
