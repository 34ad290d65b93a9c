"""Label sets, horizons, neighbours, readers and corpora against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import horizons, label_sets, neighbours
from sparkloom.sources import corpora, readers


def test_label_sets(spark):
    rows = [([1, 2], [2, 3]), ([1], [1]), ([], [4]), (None, None), ([2, 2], None), ([5, None], [5, 5])]
    df = spark.createDataFrame(rows, "t array<int>, p array<int>")
    sets = [({x for x in t or [] if x is not None}, {x for x in p or [] if x is not None}) for t, p in rows]
    ratio = lambda a, b: a / b if b else 0.0
    got = label_sets.by_sample(df, "t", "p").first()
    assert got.precision == pytest.approx(np.mean([ratio(len(t & p), len(p)) for t, p in sets]))
    assert got.recall == pytest.approx(np.mean([ratio(len(t & p), len(t)) for t, p in sets]))
    assert got.f1 == pytest.approx(np.mean([ratio(2 * len(t & p), len(t) + len(p)) for t, p in sets]))
    assert got.jaccard == pytest.approx(np.mean([ratio(len(t & p), len(t | p)) for t, p in sets]))
    every = {r.average: r for r in label_sets.averages(df, "t", "p").collect()}
    assert set(every) == {"micro", "macro", "weighted", "samples"}
    hits, true, said = (sum(f(t, p) for t, p in sets) for f in (lambda t, p: len(t & p), lambda t, p: len(t), lambda t, p: len(p)))
    assert every["micro"].f1 == pytest.approx(2 * hits / (true + said)) and every["weighted"].recall == pytest.approx(hits / true)


def test_horizons_of_a_hot_key_in_spans(spark):
    """A key with most of the rows is dealt to several parts; rows at their borders see what lies before them."""
    rng = random.Random(7)
    rows = [(i, "hot" if rng.random() < 0.8 else rng.choice("ab"), rng.choice([None, *range(3000)]) if i % 50 == 0 else rng.randrange(3000), rng.randrange(9)) for i in range(600)]
    rows += [(1000 + i, "hot", 400, 1) for i in range(30)] + [(2000, None, 5, 1), (2001, "a", None, 3), (2002, "neg", -130, 2), (2003, "neg", -35, 3)]
    df = spark.createDataFrame(rows, "i long, k string, t long, v int")
    out = horizons.over_horizons(df, "k", F.col("t"), {"short": 10, "long": 100}, {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, span=250, spread="part")
    got = {r.i: r for r in out.collect()}
    assert len(got) == len(rows) and len({r.part for r in got.values() if r.k == "hot"}) >= 12
    for i, k, t, _ in rows:
        for name, s in (("short", 10), ("long", 100)):
            near = [b[3] for b in rows if t is not None and b[2] is not None and b[1] == k and t - s <= b[2] <= t]
            want = (len(near), sum(near), max(near)) if near else (None, None, None)
            assert (got[i][f"n_{name}"], got[i][f"s_{name}"], got[i][f"m_{name}"]) == want
    with pytest.raises(ValueError):
        horizons.over_horizons(df, "k", F.col("t"), {"a": 10}, {"n": ("count", F.lit(1))}, span=10)


def plain_information(x, c, k):
    digamma = lambda n: sum(1 / i for i in range(1, n)) - 0.5772156649015329
    good = [i for i in range(len(x)) if c.count(c[i]) > 1]
    total = 0.0
    for i in good:
        own = sorted(abs(x[i] - x[j]) for j in good if j != i and c[j] == c[i])
        near = min(k, len(own))
        d = own[near - 1]
        m = sum(abs(x[i] - x[j]) < d if d else x[i] == x[j] for j in good)
        total += digamma(near) - digamma(len(own) + 1) - digamma(m)
    return max(0.0, digamma(len(good)) + total / len(good))


@pytest.mark.parametrize("block", [4, 37, 100_000])
def test_information_of_neighbours(spark, block):
    rng = np.random.default_rng(3)
    c = [str(int(v)) for v in rng.integers(0, 4, 500)]
    x = [float(v) for v in np.round(rng.normal(size=500) * 64 + np.array([40 * int(v) for v in c])) / 16]  # ties, and exact differences
    rows = list(zip(range(500), x, c, strict=True))
    df = spark.createDataFrame([*rows, (500, 1.0, "alone"), (501, None, "1"), (502, 2.0, None)], "i long, x double, c string")
    got = neighbours.mutual_information(df, "i", "x", "c", block=block).first()
    assert got.n == 500 and got.mutual_information == pytest.approx(plain_information(x, c, 3), abs=1e-9)
    if block == 37:
        own = [v for v, k in zip(x, c, strict=True) if k == "1"]
        assert neighbours.mutual_information(df.where("c = '1'"), "i", "x", "c").first().mutual_information == pytest.approx(plain_information(own, ["1"] * len(own), 3), abs=1e-9)
        assert neighbours.mutual_information(df.where("i < 0"), "i", "x", "c").first().n == 0
    values = [1.0, 2.0, 5.0, 40.0, 1e6]
    psi = spark.createDataFrame([(v,) for v in values], "x double").select(neighbours.digamma(F.col("x"))).collect()
    assert [r[0] for r in psi[:4]] == pytest.approx([sum(1 / i for i in range(1, int(v))) - 0.5772156649015329 for v in values[:4]], abs=1e-10)
    assert psi[4][0] == pytest.approx(math.log(1e6) - 5e-7, abs=1e-10)


@pytest.mark.parametrize("last, n", [("keep", 9), ("drop", 7), ("carry", 8)])
def test_readers_go_on_where_one_stopped(spark, tmp_path, last, n):
    df = spark.createDataFrame([(i, f"r{i}") for i in range(23)], "k long, v string")

    def run(folder, batches, reader=None):
        out = []
        for _ in range(batches):
            reader = reader or readers.Reader(df, "k", 7, folder, last=last)
            batch, after = reader.take()
            out.append([(r["pass"], r.k, r.v) for r in batch.orderBy("batch_place").collect()])
            assert [r.batch for r in batch.select("batch").distinct().collect()] == [after.batch - 1]
            reader.commit(after)
        return out

    whole = f"file://{tmp_path}/{last}-whole"
    once = run(whole, n, readers.Reader(df, "k", 7, whole, last=last))
    folder = f"file://{tmp_path}/{last}-parts"
    first = run(folder, 3)
    readers.Reader(df, "k", 7, folder, last=last).take()[0].count()  # taken, not committed: a stop
    assert first + run(folder, n - 3) == once
    sizes = {"keep": [7, 7, 7, 2], "drop": [7, 7, 7], "carry": [7] * n}[last]
    assert [len(b) for b in once] == (sizes * n)[:n]
    by_pass = [[k for b in once for p, k, _ in b if p == turn] for turn in range(2)]
    assert len(set(by_pass[0])) == len(by_pass[0]) == (21 if last == "drop" else 23) and by_pass[0] != by_pass[1][: len(by_pass[0])]
    with pytest.raises(ValueError):
        readers.Reader(df.where("k < 0"), "k", 7, folder)


def test_readers_without_shuffle(spark, tmp_path):
    df = spark.createDataFrame([(i,) for i in (5, 1, 9, 3)], "k long")
    reader, seen = readers.Reader(df, "k", 3, f"file://{tmp_path}/r", shuffle=False), []
    for _ in range(3):
        batch, after = reader.take()
        seen.append([r.k for r in batch.orderBy("batch_place").collect()])
        reader.commit(after)
    assert seen == [[1, 3, 5], [9], [1, 3, 5]] and reader.cursor() == readers.Cursor(3, 1, 3)


def test_corpora_by_their_rules(spark, tmp_path):
    files = {
        "ptb/train.txt": "a b\n\nB c\n", "ptb/valid.txt": "a\n", "ptb/test.txt": "z z\n", "enwik8/train.txt": "x  y\n", "enwik8/valid.txt": "x\n", "enwik8/test.txt": "w\n",
        "wt103/train.txt": "m\n", "wt103/valid.txt": "n\n", "wt103/test.txt": "o\n", "other/train.txt": "no\n", "lm1b/valid.txt": "p q\n", "lm1b/test.txt": "r\n",
        f"lm1b/{corpora.RULES['lm1b'].train[:-1]}1": "s\n", f"lm1b/{corpora.RULES['lm1b'].train[:-1]}2": "t\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    root = f"file://{tmp_path}"
    assert list(corpora.found(spark, root)) == ["enwik8", "lm1b", "ptb", "wt103"]
    rows = corpora.read(spark, root, lower=True)
    lines = {}
    for r in rows.orderBy("corpus", "split", "at").collect():
        lines.setdefault((r.corpus, r.split), []).append(" ".join(r.tokens))
    assert lines["ptb", "train"] == ["a b <eos>", "<eos>", "b c <eos>"] and lines["enwik8", "train"] == ["x y"]
    assert sorted(lines["lm1b", "train"]) == ["<S> s <S>", "<S> t <S>"] and lines["lm1b", "valid"] == ["<S> p q <S>"]
    counts = {(r.corpus, r.token): r.n for r in corpora.vocabularies(rows).collect()}
    want = {("ptb", "a"): 2, ("ptb", "b"): 2, ("ptb", "c"): 1, ("ptb", "z"): 2, ("ptb", "<eos>"): 5, ("enwik8", "x"): 2, ("enwik8", "y"): 1, ("enwik8", "w"): 1, ("wt103", "m"): 1, ("wt103", "<eos>"): 1}
    assert counts == want
    with pytest.raises(ValueError):
        corpora.read(spark, f"{root}/other")


def test_chi_square_of_counts_whose_products_pass_64_bits(spark):
    from sparkloom.operators import scoring

    df = spark.range(2_200_000).select(F.lit(1).alias("v"), F.lit("a").alias("y"))
    assert scoring.chi_square(df, "v", "y").first()["chi2"] == 0


def test_trial_averages_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    """0.7 and 0.6 average to 0.65 exactly; thousands of each, as doubles, do not."""
    from sparkloom.plans import registry

    rows = spark.range(0, 6000, 1, 1).select(F.lit(1).cast("long").alias("user_id"), F.when(F.col("id") % 2 == 0, 0.7).otherwise(0.6).alias("value"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert [r["effect"] for r in registry.queries()["trial_scores"](spark, str(tmp_path)).collect()] == [0.7]


def test_basic_tokens_make_each_text_once(spark):
    from sparkloom.functions import text as T

    df = spark.createDataFrame([("Ça va, 漢字 한국 ÀÉ কো",), (None,), ("plain",)], "t string")
    out = df.select(T.basic_tokens(F.col("t")).alias("w"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert [r["w"] for r in out.collect()][1:] == [[], ["plain"]]
    assert out.first()["w"][:5] == ["ca", "va", ",", "漢", "字"]


def test_batches_of_words_have_a_bound_in_bytes(spark):
    from sparkloom.operators import pieces

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        pieces.word_pieces(spark.range(1), "id", F.array(F.lit("a")), ["a"])
        assert int(spark.conf.get(name)) == pieces.BATCH_BYTES
    finally:
        spark.conf.set(name, before)


def test_entities_need_no_shuffle(spark):
    from sparkloom.operators import sequences

    df = spark.createDataFrame([(1, ["I-X", "B-X", "I-X", "I-Y", "I-X", "B-Y"]), (2, None), (3, []), (4, ["I-Y", "O", "B-X"])], "id long, tags array<string>")
    out = sequences.bio_entities(df, "id", "tags")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(1, "X", 1, 2), (1, "Y", 5, 5), (4, "X", 2, 2)]
