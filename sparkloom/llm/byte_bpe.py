"""Byte-level BPE encoding and decoding with numpy matrices.

A text is cut into pieces by the pattern. Pieces that a task has not met yet are put into padded matrices of token ids,
one for each bucket of lengths. In each round every row merges its leftmost pair of least rank; pairs are looked up in
an open-addressing hash table, and rows without a pair left are taken out. A piece of over LONG bytes, for which a matrix
would need as many rounds and columns as the piece has bytes, takes the same merges in the same order from a heap.

Ids of pieces are kept in each task, packed and up to a bound in bytes; those met of late outlive the others. Null
texts count as empty and have no ids. A document column with the name of a result column is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sparkloom.llm.common import map_texts

LONG = 256
CELLS = 1 << 17
#: Bytes that each of a task's two tables of ids may take, and bytes of text whose pieces are held at once.
KEPT_BYTES, CUT_BYTES = 12 << 20, 1 << 20
#: About what a table takes for a piece beside its key and its ids.
ENTRY_BYTES = 100
NONE = np.int64(1 << 40)


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks by token of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """From pairs of token ids to the id of the joined token, by open addressing."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    keys.append(a << 20 | b)
                    values.append(rank)
        size = 1 << max(4, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self.mask = size - 1
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int64)
        keys, values = np.array(keys, np.int64), np.array(values, np.int64)
        self.probes = 0
        at = self._start(keys)
        while len(keys):
            self.probes += 1
            free = self.keys[at] < 0
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            put = np.zeros(len(at), bool)
            put[first] = True
            put &= free
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & self.mask

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ids of joined tokens, or NONE; negative ids have none."""
        keys = np.where((a < 0) | (b < 0), np.int64(-2), a << 20 | b)
        at = self._start(keys)
        out = np.where(self.keys[at] == keys, self.values[at], NONE)
        left = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0) & (keys >= 0))
        flat, out, at = keys.ravel(), out.ravel(), at.ravel()
        if keys.ndim > 1:
            left = np.flatnonzero(((self.keys[at] != flat) & (self.keys[at] >= 0) & (flat >= 0)))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            here = self.keys[at[left]]
            same = here == flat[left]
            out[left[same]] = self.values[at[left[same]]]
            left = left[~same & (here >= 0)]
        return out.reshape(keys.shape)


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.pairs, self.rank_of = PairTable(ranks), None

    def merge_rows(self, ids: np.ndarray) -> list[list[int]]:
        """Each row's ids after all merges; rows are padded with -1."""
        n, width = ids.shape
        done: list[list[int]] = [[]] * n
        row = np.arange(n)
        cost = self.pairs.find(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((n, 1), NONE)
        column = np.arange(width)
        while len(row):
            j = cost.argmin(1)
            least = np.take_along_axis(cost, j[:, None], 1)[:, 0]
            over = least == NONE
            if over.any():
                for r, line in zip(row[over].tolist(), ids[over].tolist(), strict=True):
                    done[r] = [x for x in line if x >= 0]
                keep = ~over
                row, ids, cost, j, least = row[keep], ids[keep], cost[keep], j[keep], least[keep]
                if not len(row):
                    break
            k = np.arange(len(row))
            after = np.minimum(column[None, :] + (column[None, :] > j[:, None]), width - 1)
            shifted = np.take_along_axis(ids, after, 1)
            shifted[:, -1] = np.where(j < width - 1, -1, shifted[:, -1])
            shifted[k, j] = least
            ids = shifted
            moved = np.take_along_axis(cost, np.minimum(after[:, : cost.shape[1]], cost.shape[1] - 1), 1)
            moved[:, -1] = NONE
            right = np.minimum(j + 1, width - 1)
            moved[k, np.minimum(j, cost.shape[1] - 1)] = np.where(j + 1 < width, self.pairs.find(ids[k, j], np.where(j + 1 < width, ids[k, right], -1)), NONE)
            left = j > 0
            moved[k[left], j[left] - 1] = self.pairs.find(ids[k[left], j[left] - 1], ids[k[left], j[left]])
            cost = moved
        return done

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges in the same order, the leftmost pair of least rank first, from a heap: n log n steps."""
        if self.rank_of is None:
            used = self.pairs.keys >= 0
            self.rank_of = dict(zip(self.pairs.keys[used].tolist(), self.pairs.values[used].tolist(), strict=True))
        rank, n = self.rank_of.get, len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i]
            # a pair that has changed since has another rank, or none
            if ids[i] < 0 or j >= n or rank(ids[i] << 20 | ids[j]) != r:
                continue
            ids[i], ids[j], right[i] = r, -1, right[j]
            if right[i] < n:
                left[right[i]] = i
                if (new := rank(r << 20 | ids[right[i]])) is not None:
                    heapq.heappush(heap, (new, i))
            if left[i] >= 0 and (new := rank(ids[left[i]] << 20 | r)) is not None:
                heapq.heappush(heap, (new, left[i]))
        return [x for x in ids if x >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = [whole]
            elif len(piece) > LONG:
                out[i] = self.merge_long(self.single[np.frombuffer(piece, np.uint8)].tolist())
            else:
                buckets.setdefault(-(-len(piece) // 4) * 4 if len(piece) <= 32 else 1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, members in buckets.items():
            step = max(1, CELLS // width)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                flat = np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)
                sizes = np.array([len(pieces[i]) for i in part])
                ids = np.full((len(part), width), -1, np.int64)
                ids[np.arange(width)[None, :] < sizes[:, None]] = self.single[flat]
                for i, line in zip(part, self.merge_rows(ids), strict=True):
                    out[i] = line
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Kept:
    """Ids of pieces, as little-endian int32. There are two tables: if the new one is full it becomes the old one, whose
    pieces come back when they are met again. So memory is bounded by KEPT_BYTES, not by how many different pieces a task
    meets or how long they are; beside that only the pieces of one call are held."""

    def __init__(self, bpe: ByteBPE):
        self.bpe, self.size = bpe, 0
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _put(self, piece: str, ids: bytes) -> None:
        self.new[piece] = ids
        self.size += sys.getsizeof(piece) + sys.getsizeof(ids) + ENTRY_BYTES

    def of(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """A table that has all of these."""
        if self.size > KEPT_BYTES:
            self.old, self.new, self.size = self.new, {}, 0
        unmet = []
        for piece in {p for p in pieces if p not in self.new}:
            if (ids := self.old.pop(piece, None)) is not None:
                self._put(piece, ids)
            else:
                unmet.append(piece)
        for piece, ids in zip(unmet, self.bpe.encode_pieces([p.encode() for p in unmet]), strict=True):
            self._put(piece, np.array(ids, "<i4").tobytes())
        return self.new


def _runs(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    """Texts in order, in runs of about CUT_BYTES."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text or b"")
        if size >= CUT_BYTES:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, text: str = "text", with_ids: bool = True, keep: list[str] | None = None
) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256, and with_ids also ids, to every document.

    The vocabulary is broadcast; it has a fixed number of entries.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []

    def make():
        bpe = ByteBPE(shared.value, pattern)
        find, kept = bpe.pattern.findall, Kept(bpe)
        decimal = {i: str(i) for i in bpe.bytes_of}.__getitem__

        def work(texts):
            out = {f.name: [] for f in fields}
            for run in _runs(texts):
                cut = [find(x.decode()) if x else [] for x in run]
                known = kept.of(p for pieces in cut for p in pieces)
                for pieces in cut:
                    ids = np.frombuffer(b"".join([known[p] for p in pieces]), "<i4")
                    listed = ids.tolist()
                    out["n_tokens"].append(len(listed))
                    out["ids_sha256"].append(hashlib.sha256(",".join(map(decimal, listed)).encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(bpe.decode(listed)).hexdigest())
                    if with_ids:
                        out["ids"].append(ids)
            return out

        return work

    return map_texts(docs, make, fields, text, keep)
