"""What a task of the byte-level BPE keeps is bounded in bytes, and results don't depend on it."""

import random
import tracemalloc

import brute
import public_tokenizers
from sparkloom.llm import byte_bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def task(spark, monkeypatch):
    """The function that a task maps over slices of texts."""
    got = []
    with monkeypatch.context() as m:
        m.setattr(byte_bpe, "map_texts", lambda docs, make, *_: got.append(make))
        byte_bpe.encode(spark.range(0), byte_bpe.read_ranks(spark, RANKS), public_tokenizers.PATTERN)
    return got[0]()


def test_kept_pieces_are_bounded_in_bytes(spark, monkeypatch):
    draw = random.Random(3)
    texts = [" ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=250)) for _ in range(400)).encode() for _ in range(20)]
    work = task(spark, monkeypatch)
    tracemalloc.start()
    try:
        counts = [n for text in texts for n in work([text])["n_tokens"]]
        kept = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert min(counts) > 400
    assert kept < 24 << 20


def test_results_do_not_depend_on_what_is_kept(spark, monkeypatch):
    of = brute.byte_bpe(RANKS, public_tokenizers.PATTERN)
    texts = ["alpha beta gamma " * 30, "", None, "Straße naïve 12345 \n\n x", "alpha delta " + "zq" * 400, "beta gamma epsilon 漢字かな交じり", "a"] * 3
    for kept, cut in ((0, 1), (600, 40), (1 << 20, 1 << 20)):
        monkeypatch.setattr(byte_bpe, "KEPT_BYTES", kept)
        monkeypatch.setattr(byte_bpe, "CUT_BYTES", cut)
        work = task(spark, monkeypatch)
        for part in (texts[:5], texts[5:], texts, []):
            out = work([None if t is None else t.encode() for t in part])
            assert list(zip(out["n_tokens"], out["ids_sha256"], out["decoded_sha256"], strict=True)) == [of(t) for t in part]
            assert [len(x) for x in out["ids"]] == out["n_tokens"]
