"""Token ids in files of patched frame-of-reference blocks.

Documents are dealt to ranges of doc_id and sorted within them; each range is tokenised and written as a run of
segments. The files are Parquet tables in the shared folder: Spark commits them, so a lost executor's half-written
file is never read, and stores that only Spark reaches will do. One row is one segment, whose `payload` is an image
of at most SEGMENT_IDS ids or a single document:

    header   magic "PFR1", number of ids (u32), number of blocks (u32)
    index    start byte of each block (u32)
    block    minimum (u32), width in bits (u8), number of ids (u16), number of exceptions (u16),
             the low bits of id - minimum packed at that width, then positions (u16) and values (u32) of exceptions

The width is the bits that PERCENTILE of a block's differences need; larger ones are exceptions. `ends` gives each
document's number of ids in its segment. All numbers are little-endian.

Documents with the same doc_id are ordered by text. A null doc_id comes first, a null text counts as empty and has the
end id alone. Columns other than doc_id and text are not stored. A segment's row is read as a whole; the index of
blocks serves readers inside a segment.
"""

from __future__ import annotations

import json
import math
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import own_settings, shared_dir, short_batches, slices

BLOCK = 4096
PERCENTILE = 95
SEGMENT_IDS = 1 << 18
#: Bytes of text in a range of doc_id, on average.
RANGE_BYTES = 24 << 20
#: Units of weight that the text of a range has; a document weighs one at least.
WEIGHTS = 4096
#: Bytes of encoded pieces that a worker keeps, in each of two caches and two generations; bytes that an entry adds to its own.
KEPT_BYTES, ENTRY = 40 << 20, 60
END_ID = 2


def pack(ids: np.ndarray) -> bytes:
    """The image of a segment."""
    n_blocks = -(-len(ids) // BLOCK)
    body, starts = [], []
    at = 12 + 4 * n_blocks
    for k in range(n_blocks):
        block = ids[k * BLOCK : (k + 1) * BLOCK].astype(np.uint32)
        low = block.min()
        rest = block - low
        width = int(np.partition(rest, (len(rest) - 1) * PERCENTILE // 100)[(len(rest) - 1) * PERCENTILE // 100]).bit_length()
        odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
        bits = (rest[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
        data = struct.pack("<IBHH", low, width, len(block), len(odd)) + np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes() + odd.astype("<u2").tobytes() + rest[odd].astype("<u4").tobytes()
        starts.append(at)
        at += len(data)
        body.append(data)
    return struct.pack("<4sII", b"PFR1", len(ids), n_blocks) + np.array(starts, "<u4").tobytes() + b"".join(body)


def unpack_block(image: bytes, k: int) -> np.ndarray:
    """Block k alone, found through the index."""
    (at,) = struct.unpack_from("<I", image, 12 + 4 * k)
    low, width, n, n_odd = struct.unpack_from("<IBHH", image, at)
    at += 9
    size = -(-n * width // 8)
    bits = np.unpackbits(np.frombuffer(image, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
    out = bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32)) if width else np.zeros(n, np.uint32)
    if n_odd:
        out[np.frombuffer(image, "<u2", n_odd, at + size)] = np.frombuffer(image, "<u4", n_odd, at + size + 2 * n_odd)
    return out.astype(np.uint32) + np.uint32(low)


def unpack(image: bytes) -> np.ndarray:
    magic, n, n_blocks = struct.unpack_from("<4sII", image, 0)
    if magic != b"PFR1":
        raise ValueError("not a segment of token ids")
    parts = [unpack_block(image, k) for k in range(n_blocks)]
    ids = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    if len(ids) != n:
        raise ValueError("a segment is incomplete")
    return ids


class Recent(dict):
    """Values by key, made when first asked for, in a bounded number of bytes. When these are used up, what was not
    asked for since the last time goes."""

    def __init__(self, make: Callable, most: int = KEPT_BYTES):
        self.make, self.most, self.used, self.old = make, most, 0, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if self.used >= self.most:
            self.old = dict(self)
            self.clear()
            self.used = 0
        self[key] = value
        self.used += 2 * ENTRY + len(key) + len(value)
        return value


# The letters that stand for bytes in byte-level vocabularies are those of Latin-1 that print; the other
# bytes take the letters from 256 on.
def byte_letters() -> dict[int, str]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: What letters, numbers and white space are in texts of ASCII and Latin letters, once these are small.
_LATIN_CLASSES = {r"\p{L}": "a-zß-öø-ÿ", r"\p{N}": "0-9", r"\s": r" \t\n\r\x0b\x0c"}


class WordEncoder:
    """From texts to ids by the tokenizers library. What stands between white space is encoded once each, if the
    tokenizer's file says that it folds case, composes letters and drops white space; else whole texts are encoded.

    Texts of ASCII and Latin letters alone are cut by the file's own pattern, and its model is asked for each new piece.
    Texts that hold one of the file's added tokens go through the whole tokenizer. One encoder serves all tasks of a worker.
    """

    _of: ClassVar[dict] = {}
    #: Texts in which composed and small forms go letter by letter.
    _LATIN = re.compile("[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
    _LETTERS = byte_letters()

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        self.words, self.pieces = Recent(self._whole), Recent(self._piece)
        said = json.loads(tokenizer_json)
        self.added = [t["content"] for t in said.get("added_tokens") or []]
        pattern = split_pattern(said)
        self.by_word = pattern is not None
        if pattern is not None:
            for name, latin in _LATIN_CLASSES.items():
                pattern = pattern.replace(name, latin)
            self.findall = re.compile(pattern).findall

    @classmethod
    def shared(cls, tokenizer_json: str) -> WordEncoder:
        if tokenizer_json not in cls._of:
            cls._of = {tokenizer_json: cls(tokenizer_json)}
        return cls._of[tokenizer_json]

    def _whole(self, word: bytes) -> bytes:
        return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self._LETTERS))]
        return array("I", ids).tobytes()

    def encode(self, text: bytes | None) -> np.ndarray:
        raw = text or b""
        whole = raw.decode()
        if not self.by_word or any(t in whole for t in self.added):
            data = self._whole(raw)
        elif self._LATIN.fullmatch(whole):
            data = b"".join(map(self.pieces.__getitem__, self.findall(whole.lower())))
        else:
            data = b"".join(map(self.words.__getitem__, raw.split()))
        return np.frombuffer(data, "=u4")


def split_pattern(said: dict) -> str | None:
    """The pattern by which a tokenizer's file cuts words, if it works on folded, composed text and drops white space."""
    folds = [n.get("type") for n in (said.get("normalizer") or {}).get("normalizers", [])]
    steps = (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if folds != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in steps] != ["Split", "ByteLevel"] or said.get("model", {}).get("type") != "BPE":
        return None
    space = said["normalizer"]["normalizers"][1]
    cut, letters = steps
    good = space["pattern"] == {"Regex": r"\s+"} and space["content"] == " " and cut["behavior"] == "Removed" and cut["invert"] and not letters["add_prefix_space"] and not letters["use_regex"]
    pattern = cut["pattern"].get("Regex", "")
    # pieces of this pattern have no white space: every class either excludes it or names letters, numbers and marks
    return pattern if good and r"[^\s\p{L}\p{N}]+" in pattern and " " not in pattern else None


def part_of(doc_id: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts lie below doc_id; a row is compared with twice the root of their number. Null: 0."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    below = lambda known: F.size(F.filter(known, lambda c: c < doc_id))
    at = F.greatest(below(F.lit([g[0] for g in groups])) - 1, F.lit(0))
    inside = F.transform(F.array(at), lambda k: k * step + below(F.get(F.array(*map(F.lit, groups)), k)))
    return F.coalesce(F.get(inside, 0), F.lit(0)).cast("int")


def write_ids(
    docs: DataFrame, tokenizer_json: str, path: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, range_bytes: int = RANGE_BYTES
) -> None:
    """Writes every document's ids and the end id under path, in ascending doc_id order.

    Ranges have about range_bytes of text each: the cuts between them are quantiles of doc_id, each document weighing as
    much as its text. They are a number for each range; for very large corpora give a larger range_bytes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    ranges = max(1, (rows.agg(F.sum(size)).first()[0] or 0) // range_bytes)
    cuts = []
    if ranges > 1:
        weight = F.explode(F.sequence(F.lit(0), F.floor(size / (range_bytes // WEIGHTS)).cast("int")))
        weighed = rows.where("doc_id is not null").select("doc_id", weight)
        cuts = sorted({int(x) for x in weighed.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []})
    dealt = rows.withColumn("part", part_of(F.col("doc_id"), cuts)).repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "doc_id", "text")
    shared = spark.sparkContext.broadcast(tokenizer_json)

    def run(batches):
        encode = WordEncoder.shared(shared.value).encode
        held, part, n, segment = [], None, 0, 0

        def flush():
            ids = np.concatenate([x for _, x in held])
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "segment": pa.array([segment], pa.int32()), "n_ids": pa.array([len(ids)], pa.int64()),
                "doc_ids": pa.array([[d for d, _ in held]], pa.list_(pa.int64())), "ends": pa.array([np.cumsum([len(x) for _, x in held]).tolist()], pa.list_(pa.int64())),
                "payload": pa.array([pack(ids)], pa.binary()),
            })

        for batch in (part for whole in batches for part in slices(whole, "text")):
            columns = batch.to_pydict()
            for d, p, ids in zip(columns["doc_id"], columns["part"], map(encode, columns["text"]), strict=True):
                if held and (p != part or n + len(ids) + 1 > SEGMENT_IDS):
                    yield flush()
                    segment = segment + 1 if p == part else 0
                    held, n = [], 0
                part = p
                held.append((d, np.append(ids, np.uint32(end_id))))
                n += len(ids) + 1
        if held:
            yield flush()

    schema = "part int, segment int, n_ids long, doc_ids array<long>, ends array<long>, payload binary"
    with own_settings(spark):
        dealt.select("doc_id", "part", "text").mapInArrow(run, schema).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files alone."""
    files = spark.read.parquet(path)
    # one row for each segment's counts, then one for each range: few and short
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inner = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        files.select("part", "segment", "n_ids")
        .withColumn("seg_start", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)))
        .join(starts, "part")
        .select("part", "segment", (F.col("part_start") + F.col("seg_start")).alias("offset"))
    )

    def run(batches):
        for part in (part for whole in batches for part in slices(whole, "payload", 16)):
            for row in part.to_pylist():
                ids = unpack(row["payload"]).astype("<u4")
                ends = row["ends"]
                begins = [0, *ends[:-1]]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([row["part"]] * len(ends), pa.int32()), "segment": pa.array([row["segment"]] * len(ends), pa.int32()),
                    "doc_id": pa.array(row["doc_ids"], pa.int64()), "local_start": pa.array(begins, pa.int64()),
                    "n_tokens": pa.array([e - b for b, e in zip(begins, ends, strict=True)], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(ids[b:e].tobytes()) for b, e in zip(begins, ends, strict=True)], pa.int64()),
                })

    rows = short_batches(files.select("part", "segment", "doc_ids", "ends", "payload")).mapInArrow(
        run, "part int, segment int, doc_id long, local_start long, n_tokens long, ids_crc32 long"
    )
    return rows.join(offsets, ["part", "segment"]).select("doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str, **names: str) -> DataFrame:
    """Writes the ids of docs into the shared folder and reads them back."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(docs, tokenizer_json, path, **names)
    return read_ids(spark, path)
