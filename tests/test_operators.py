"""Operators without SQL against plain versions, and files there and back."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import matrices as M
from sparkloom.functions import text as T
from sparkloom.operators import decoding as D
from sparkloom.operators import pieces as P
from sparkloom.operators import sampling, search, selection, state
from sparkloom.operators import sequences as Q
from sparkloom.operators import vocabulary as V
from sparkloom.sources import files

MOVES = np.array([[0.5, -0.2, 0.1], [-0.4, 0.6, 0.0], [0.2, 0.1, 0.3]])


def test_viterbi_and_partition_are_those_of_all_paths():
    rng = np.random.default_rng(3)
    for n in range(1, 6):
        s = rng.normal(size=(n, 3))
        every = {p: D.path_score(s, MOVES, np.array(p)) for p in itertools.product(range(3), repeat=n)}
        assert tuple(D.best_path(s, MOVES)) == max(every, key=every.get)
        assert D.log_partition(s, MOVES) == pytest.approx(np.logaddexp.reduce(list(every.values())))
    assert D.best_path(np.zeros((0, 3)), MOVES) == []


def test_decoding_of_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0, 2.0, 0.0], [0, 1]), (2, [], []), (3, None, [])], "id int, s array<double>, p array<int>")
    out = {r["id"]: r for r in df.select("id", D.viterbi(F.col("s"), MOVES).alias("b"), D.crf_loss(F.col("s"), F.col("p"), MOVES).alias("loss")).collect()}
    assert [out[i]["b"] for i in (1, 2, 3)] == [D.best_path(np.array([[1.0, 0, 0], [0, 2.0, 0]]), MOVES), [], []]
    assert out[1]["loss"] > 0 and out[2]["loss"] == out[3]["loss"] == 0


def test_word_pieces(spark):
    df = spark.createDataFrame([(1, ["unaffable", "cat", "xq"]), (2, []), (3, ["a" * 101])], "id int, w array<string>")
    out = dict(P.word_pieces(df, "id", F.col("w"), ["un", "##aff", "##able", "cat", "x", "a", "##a"]).collect())
    assert out == {1: ["un", "##aff", "##able", "cat", "[UNK]"], 2: [], 3: ["[UNK]"]}


def test_basic_and_pre_tokens(spark):
    df = spark.createDataFrame([("Héllo,\tWÖRLD\x00 中文!",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.basic_tokens(F.col("t"))).collect()] == [["hello", ",", "world", "中", "文", "!"], [], []]
    texts = ["I'll go  there, ok? 12 x\n\n y  ", "", "a b"]
    out = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.pre_tokens(F.col("t"))).collect()]
    assert out[0][:6] == ["I", "'ll", " go", " ", " there", ","] and ["".join(x) for x in out] == texts


@pytest.mark.parametrize("name", sorted(M.LINALG))
def test_decompositions(spark, name):
    m = np.random.default_rng(1).normal(size=(4, 4))
    df = spark.createDataFrame([(m.ravel().tolist(),), ([1.0, 2.0],), ([],), (None,)], "a array<double>")
    out = [r[0] for r in df.select(M.linalg(F.col("a"), name)).collect()]
    assert out[1:] == [None] * 3
    if name == "inv":
        assert np.allclose(np.reshape(out[0], (4, 4)) @ m, np.eye(4))
    if name == "svd_values":
        assert np.prod(out[0]) == pytest.approx(abs(np.linalg.det(m)))
    if name == "qr_r":
        r = np.reshape(out[0], (4, 4))
        assert np.allclose(r.T @ r, m.T @ m)
    if name == "cholesky_of_gram":
        c = np.reshape(out[0], (4, 4))
        assert np.allclose(c @ c.T, m @ m.T + np.eye(4))


def test_a_singular_matrix_has_no_inverse(spark):
    assert spark.createDataFrame([([1.0, 2.0, 2.0, 4.0],)], "a array<double>").select(M.linalg(F.col("a"), "inv")).first()[0] is None


def test_searches_find_the_peak():
    space = {"x": search.Box(0, 1), "y": search.Box(1e-3, 1e3, log=True)}
    f = lambda p: -((p["x"] - 0.7) ** 2) - 0.1 * (np.log10(p["y"]) - 1) ** 2
    for run in (search.bayesian, search.parzen):
        trials = run(space, f, steps=25, seed=2)
        assert len(trials) == 30 and search.best(trials).effect > max(t.effect for t in trials[:5]) - 1e-12
        assert search.best(trials).effect > -0.05
        assert [t.params for t in trials] == [t.params for t in run(space, f, steps=25, seed=2)]


def test_adam_is_the_plain_loop(spark):
    g = [0.5, -1.0, 3.0]
    m = v = 0.0
    p = 1.0
    for x in g:
        x *= min(1.0, 2.0 / (abs(x) + 1e-6))
        m, v = 0.9 * m + 0.1 * x, 0.999 * v + 0.001 * x * x
        p -= 0.01 * (m / (v**0.5 + 1e-6) + 0.1 * p)
    out = spark.createDataFrame([(g,)], "g array<double>").select(state.adam(F.col("g"), 1.0, rate=0.01, decay=0.1, clip=2.0).alias("s")).select("s.*").first()
    assert tuple(out) == pytest.approx((m, v, p))


def test_bio_tags_of_bad_and_empty_spans(spark):
    kind = "array<struct<tag:string,start:int,end:int>>"
    rows = [(1, 4, [("P", 0, 1), ("L", 3, 3)]), (2, 2, []), (3, 0, []), (4, 3, [("P", 0, 1), ("L", 1, 2)]), (5, 2, [("P", 1, 2)]), (6, 2, None)]
    out = dict(Q.bio_tags(spark.createDataFrame(rows, f"id int, n int, s {kind}"), "id", "n", "s").collect())
    assert out == {1: ["B-P", "I-P", "O", "B-L"], 2: ["O", "O"], 3: [], 4: None, 5: None, 6: ["O", "O"]}


def test_large_and_small_vocabularies_encode_alike(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None), (4, "c zz a a")], "id int, text string")
    vocab = V.with_specials(V.capped(V.token_counts(df.where("id < 4"), V.words(F.col("text")))))
    run = lambda: sorted(map(tuple, V.encode(df, "id", V.words(F.col("text")), vocab, 3).collect()))
    small = run()
    monkeypatch.setattr(V, "MAP_ENTRIES", 1)
    assert run() == small and small[3] == (4, [3, 4, 1], 3)


def test_sample_sizes(spark, monkeypatch):
    monkeypatch.setattr(sampling, "STEP", 7)
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)] + [(99, "c")], "id int, y string")
    n = sampling.sample_by_label(df, "id", "y", {"a": 2.25, "b": 0.3}).groupBy("y").agg(F.sum("copies")).collect()
    assert dict(n) == {"a": 45, "b": 6, "c": 1}
    parts = sampling.split(df, "id", [0.5, 0.5], by=["y"]).groupBy("y", "part").count().collect()
    assert {(r[0], r[1]): r[2] for r in parts} == {("a", 0): 10, ("a", 1): 10, ("b", 0): 10, ("b", 1): 10, ("c", 1): 1}
    with pytest.raises(ValueError):
        sampling.split(df, "id", [0.5, 0.4])


def test_groups_of_features(spark):
    phi = spark.createDataFrame([(1, "a", 3.0), (1, "b", 1.0), (1, "c", 2.5), (1, "d", 0.1)], "row int, feature string, phi double")
    pick = lambda k, g: {r["feature"] for r in selection.top_by_group(phi, "row", k, g).collect()}
    assert pick(2, {"x": ["a", "b"], "y": ["c", "d"]}) == {"a", "c"}
    assert pick(3, {"x": ["a", "b"], "y": ["c", "d"]}) == {"a", "b", "c"}
    with pytest.raises(ValueError):
        pick(1, {"x": ["a"], "y": ["a"]})


def test_running_sums_of_long_arrays(spark):
    """In the order of the elements, bit for bit, and in a time that grows with the length."""
    import time

    from sparkloom.functions import arrays as A

    rng = np.random.default_rng(7)
    rows = [(n, [float(x) for x in rng.normal(size=n)]) for n in (0, 1, 2, 255, 256, 257, 512, 513, 1000)] + [(-1, None)]
    df = spark.createDataFrame(rows, "n int, a array<double>")
    got = {r.n: (r.s, r.p) for r in df.select("n", A.cumsum(F.col("a")).alias("s"), A.cumprod(F.col("a")).alias("p")).collect()}
    assert got[-1] == (None, None)
    for n, a in rows[:-1]:
        assert got[n] == (list(itertools.accumulate(a)), list(itertools.accumulate(a, lambda x, y: x * y)))
    long = spark.createDataFrame([(1, [1.0] * 100_000)], "n int, a array<double>")
    start = time.perf_counter()
    assert long.select(F.element_at(A.cumsum(F.col("a")), -1)).first()[0] == 100_000.0
    assert time.perf_counter() - start < 20


def test_tokenizers_saved(spark, tmp_path):
    vocab = spark.createDataFrame([("b", 1), ("a", 0), ("ab", 2)], "token string, id long")
    merges = spark.createDataFrame([(i, f"l{i}", f"r{i}") for i in range(30)], "rank long, left string, right string").repartition(5)
    files.write_tokenizer(vocab, merges, ["<|end|>", "<pad>"], f"file://{tmp_path}/t")
    back = files.read_tokenizer(spark, f"file://{tmp_path}/t")
    assert dict(back[0].collect()) == {"a": 0, "b": 1, "ab": 2} and back[2] == ["<|end|>", "<pad>"]
    assert sorted(map(tuple, back[1].collect())) == [(i, f"l{i}", f"r{i}") for i in range(30)]
    (tmp_path / "m").write_text("#version: 0.2\na b\n\nb c\n")
    assert sorted(map(tuple, files.read_merges(spark, f"file://{tmp_path}/m").collect())) == [(0, "a", "b"), (1, "b", "c")]
    files.write_tokenizer(vocab.where("id <> 1"), merges, [], f"file://{tmp_path}/u")
    with pytest.raises(ValueError):
        files.read_tokenizer(spark, f"file://{tmp_path}/u")


def test_early_stop_over_blocks(spark, monkeypatch):
    """As a loop over the checks, for blocks of any size."""
    rng = np.random.default_rng(6)

    def loop(metrics, patience, compare):
        ref, bad, best = None, 0, None
        for i, m in enumerate(metrics):
            best = m if best is None else max(best, m)
            if ref is None or m > ref:
                ref, bad = m, 0
            else:
                bad += 1
                ref = m if compare == "previous" else ref
            if bad >= patience:
                return 10 * i, best
        return None, best

    for n, patience, block in ((40, 3, 4), (40, 5, 1), (60, 30, 7), (1, 1, 5), (0, 2, 5)):
        monkeypatch.setattr(selection, "BLOCK_CHECKS", block)
        metrics = [float(x) for x in np.round(rng.normal(size=n).cumsum(), 1)]
        df = spark.createDataFrame([(10 * i, m) for i, m in enumerate(metrics)], "step long, metric double").repartition(3)
        for compare in ("best", "previous"):
            assert tuple(selection.early_stop(df, patience, compare).first()) == loop(metrics, patience, compare)


def test_groups_inside_a_row_are_those_of_windows(spark):
    rng = np.random.default_rng(5)
    names = list("abcdef")
    rows = [(i, [(f, float(np.round(rng.normal(), 1))) for f in rng.permutation(names).tolist()]) for i in range(40)] + [(99, [])]
    df = spark.createDataFrame(rows, "row int, parts array<struct<feature:string,phi:double>>")
    phi = df.select("row", F.explode("parts").alias("x")).select("row", "x.*")
    for groups in ({"x": ["a", "b"], "y": ["c", "d", "e"]}, {}, {"x": names}, {"x": ["f"], "empty": []}):
        ordered = selection.groups_of_row(F.col("parts"), groups, names)
        for k in (1, 2, 3, 5, 9):
            got = df.select("row", F.explode(selection.quota_of_row(ordered, k)).alias("x")).select("row", "x.part.feature", "x.group").collect()
            want = selection.top_by_group(phi, "row", k, groups).select("row", "feature", "group").collect()
            assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    with pytest.raises(ValueError):
        selection.groups_of_row(F.col("parts"), {"x": ["a"], "y": ["a"]}, names)


def test_files_there_and_back(spark, tmp_path):
    (tmp_path / "in.txt").write_text("text\tlabel\nhello\t1\nonly\na\tb\tc\nbye\tx\n\n", encoding="utf8")
    rows = files.read_delimited(spark, f"{tmp_path}/in.txt", header="text\tlabel")
    good, bad = files.good_and_bad(rows, F.expr("try_cast(label as int)"))
    assert sorted(map(tuple, good.select("text", "label").collect()), key=str) == [("hello", 1), ("only", None)]
    assert sorted(r["line"] for r in bad.collect()) == ["", "a\tb\tc", "bye\tx"]
    files.write_delimited(spark.createDataFrame([("a\tb\nc", None, 2)], "x string, y string, z int"), f"{tmp_path}/out", ["x", "y", "z"])
    assert [r[0] for r in spark.read.text(f"{tmp_path}/out").collect()] == ["a b c\t\t2"]
    files.write_vocabulary(spark.createDataFrame([("a", 1)], "token string, id long"), f"{tmp_path}/v")
    assert [tuple(r) for r in files.read_vocabulary(spark, f"{tmp_path}/v").collect()] == [("a", 1)]


def test_tagged_lines(spark, tmp_path):
    label = {"name": {"Bob": [[0, 2], [8, 10]]}, "city": {"Rome": [[4, 7]]}}
    (tmp_path / "t.json").write_text(json.dumps({"text": "Bob Rome Bob", "label": label}) + "\nnot json\n")
    got = files.read_tagged(spark, f"{tmp_path}/t.json")
    assert {tuple(s) for s in got.first()["spans"]} == {("name", 0, 2), ("name", 8, 10), ("city", 4, 7)} and got.count() == 1
    spans = spark.createDataFrame([("Bob Rome Bob", [("name", 0, 2), ("name", 9, 11), ("city", 4, 7)])], "text string, s array<struct<tag:string,start:int,end:int>>")
    files.write_json_lines(spans.select(files.surfaces(F.col("text"), F.col("s")).alias("label")), f"{tmp_path}/o")
    out = json.loads(spark.read.text(f"{tmp_path}/o").first()[0])
    assert out == {"label": {"name": {"Bob": [[0, 2], [9, 11]]}, "city": {"Rome": [[4, 7]]}}}


def test_byte_level_pieces_are_those_of_the_tokenizers_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    vocab, merges = P.read_merges(path)
    texts = ["Hello there, it's 2024!", "  naïve café\n\tdéjà vu", "東京 \U0001f600 Straße", "", "aaaaaaaaaaaaaaaa bbbb", "x\x00y"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    pieces = P.merged_pieces(df, "k", T.pre_tokens(F.col("text")), merges)
    ids = P.ids_of(pieces, "k", "pieces", vocab)
    tok = Tokenizer.from_file(path)
    assert {r.k: list(r.ids) for r in ids.collect()} == {i: tok.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    back = P.tokens_of(ids, "k", "ids", vocab).select("k", P.decode_bytes(F.col("tokens")).alias("t"))
    assert {r.k: r.t for r in back.collect()} == dict(enumerate(texts))
    assert P.byte_letters()[ord("a")] == "a" and len(set(P.byte_letters())) == 256


def test_merges_join_the_best_pair_everywhere():
    ranks = {("a", "a"): 0, ("aa", "b"): 1, ("b", "c"): 2}
    assert P.merge(list("aaab"), ranks) == ["aa", "a", "b"]
    assert P.merge(list("aabaab"), ranks) == ["aab", "aab"]
    assert P.merge(list("aabc"), ranks) == ["aab", "c"]
    assert P.merge(["x"], ranks) == ["x"] and P.merge([], ranks) == []


def test_merges_from_a_heap_are_those_of_passes():
    """As a pass over the word for each merge, for any order of ranks, and in a time that grows with the length."""
    import random
    import time

    def passes(symbols, ranks):
        while len(symbols) > 1:
            best = min(zip(symbols, symbols[1:], strict=False), key=lambda p: ranks.get(p, len(ranks)))
            if best not in ranks:
                break
            out, i = [], 0
            while i < len(symbols):
                if tuple(symbols[i : i + 2]) == best:
                    out.append("".join(best))
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    rng = random.Random(3)
    for _ in range(300):
        parts = ["a", "b", "c", "ab", "aa", "bc", "aab", "ca"]
        pairs = list({(rng.choice(parts), rng.choice(parts)) for _ in range(12)})
        ranks = {p: i for i, p in enumerate(pairs)}
        word = rng.choices("abc", k=rng.randint(0, 30))
        assert P.merge(list(word), ranks) == passes(list(word), ranks)
    ranks = {("a" * 2**i, "a" * 2**i): i for i in range(20)}
    start = time.perf_counter()
    assert "".join(P.merge(["a"] * 100_000, ranks)) == "a" * 100_000
    assert time.perf_counter() - start < 5


def test_special_tokens_stay_whole_and_the_longest_is_taken(spark):
    specials = ["<a>", "<a><b>", "é|x"]
    df = spark.createDataFrame([(1, "p<a><b>q<a>r"), (2, "<a>"), (3, ""), (4, None), (5, "é|xé|x s")], "k long, text string")
    words = P.around_specials(F.col("text"), specials, lambda c: F.filter(F.split(c, " "), lambda w: w != ""))
    got = {r.k: r.w for r in df.select("k", words.alias("w")).collect()}
    assert got == {1: ["p", "<a><b>", "q", "<a>", "r"], 2: ["<a>"], 3: [], 4: [], 5: ["é|x", "é|x", "s"]}
    vocab = P.with_specials({"p": 0, "q": 1, "r": 2, "s": 3}, specials)
    ids = P.ids_of(P.merged_pieces(df, "k", words, [], specials=specials), "k", "pieces", vocab, None)
    assert {r.k: list(r.ids) for r in ids.collect()} == {1: [0, 5, 1, 4, 2], 2: [4], 3: [], 4: [], 5: [6, 6, 3]}
    back = P.tokens_of(ids, "k", "ids", vocab, (4, 5)).select("k", P.decode_bytes(F.col("tokens")).alias("t"))
    assert {r.k: r.t for r in back.collect()} == {1: "pqr", 2: "", 3: "", 4: "", 5: "é|xé|xs"}
    with pytest.raises(Exception, match="not in the vocabulary"):
        P.ids_of(df.select("k", F.array(F.lit("z")).alias("pieces")), "k", "pieces", vocab, None).collect()


def test_standardised_text(spark):
    df = spark.createDataFrame([("wait… it´s — done\n\n next  (x)",)], "t string")
    assert df.select(T.standardise(F.col("t"))).first()[0] == "wait... it's - done \n next ( x )"


def test_word_lists_and_labels(spark, tmp_path):
    (tmp_path / "w").write_text("b\na\n\nb \nc\na\n")
    assert {r.token: r.id for r in files.read_word_list(spark, f"file://{tmp_path}/w").collect()} == {"b": 1, "a": 2, "c": 3}
    (tmp_path / "l").write_text('{"label": "101", "label_desc": "x"}\n{"label": "7", "label_desc": "y"}\n')
    assert [tuple(r) for r in files.read_labels(spark, f"file://{tmp_path}/l").orderBy("label").collect()] == [("101", "x", 0), ("7", "y", 1)]


def test_ranks_and_totals_over_many_buckets(spark, monkeypatch):
    from sparkloom.operators import bins, ranking

    monkeypatch.setattr(ranking, "BUCKET_ROWS", 10)
    df = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 97).alias("g"), F.concat(F.lit("t"), F.col("id") % 1000).alias("s")).repartition(3)
    got = {r.k: r.n for r in ranking.numbered(df, [-F.col("g"), F.col("s"), F.col("k")], "n", 1).collect()}
    assert got == {k: i for i, k in enumerate(sorted(range(2000), key=lambda k: (-(k % 97), f"t{k % 1000}", k)), 1)}
    ranks = {r.k: r["rank"] for r in ranking.hash_rank(df, F.col("k"), 5).collect()}
    import hashlib

    assert ranks == {k: i for i, k in enumerate(sorted(range(2000), key=lambda k: hashlib.md5(f"{k}-5".encode()).hexdigest()))}
    q = bins.quantiles(df.withColumn("g", F.when(F.col("k") != 5, F.col("g").cast("double"))), "g", [0.0, 0.333, 0.999, 1.0]).first()
    assert list(q) == pytest.approx(np.quantile([k % 97 for k in range(2000) if k != 5], [0.0, 0.333, 0.999, 1.0]))
    assert bins.quantiles(df.where("k < 0"), "g", [0.5]).first()[0] is None


def test_accents_go_from_all_scripts(spark):
    import unicodedata

    text = "Ünïcödé ệ Å Ω 한국어 값 각 が ド क़ ো שּׁ ﬀ ² ½ Ⅷ ｶﾞ \U0001d15e 豈 ǆ ß İ \u0344x e\u0301 \U0001f600"
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    df = spark.createDataFrame([(text,), ("",), (None,), ("plain",)], "t string")
    assert [r[0] for r in df.select(T.strip_accents(F.col("t"))).collect()] == [plain, "", None, "plain"]
