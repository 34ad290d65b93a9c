"""Fill-in-middle, collocations and licence scans against their plain versions."""

import random
import time

import brute
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import collocations, fill_middle, licenses, suffix_dedup, topk_join
from sparkloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string"
CLASH = ["n", "form", "output", "n_words", "labels", "score", "license_places", "rank", "phrase", "a"]


def table(spark, texts):
    """Texts under ids of their own, in any order, with columns of the results' names."""
    rows = [(i, t, None if i % 5 == 0 else "en") for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("theirs") for c in CLASH})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


ODD = [
    None, "", "a", "Z", "1", " ", "é", "\U0001f600", "ab" * 5, "a1b2", "<P>", "x<S", "<", "<P", "a<P>b", "tail<M>", "P S M < > <S >", "PPP<<PSM>>", "naïve Straße\r\n\t東京 tower\U0001f600b",
    "\x00a\x00", "word " * 50_000, "1" * 70_000, "a" * 70_000, "é" * 30_000 + "x" + "é" * 30_000,
]


def test_fill_in_middle(spark, monkeypatch):
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + ["short one"] * 200
    names = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    got = {r.doc_id: {c: r[c] for c in names} for r in fill_middle.fill_in_middle(table(spark, texts), with_output=False).collect()}
    assert got == {i: brute.fill_in_middle(i, t) for i, t in enumerate(texts)}
    assert {r["form"] for r in got.values()} == {"plain", "psm", "spm"}


def test_fill_in_middle_returns_whole_outputs_and_restores_them(spark, empty):
    df = table(spark, ODD)
    out = fill_middle.fill_in_middle(df, plain_percent=0, spm_percent=50)
    assert out.columns == [c for c in df.columns if c not in ("n", "form", "output")] + ["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"]
    for r in out.collect():
        assert fill_middle.restore(r.output, r.form) == (ODD[r.doc_id] or "") and brute.sha(r.output) == r.output_sha256
        assert r.restored_sha256 == brute.sha(ODD[r.doc_id] or "")
        assert (r.prefix_chars is None) == (r.form == "plain") == (not ODD[r.doc_id] or any(m in ODD[r.doc_id] for m in fill_middle.MARKS))
    assert fill_middle.fill_in_middle(empty).count() == 0
    same = spark.createDataFrame([(None, "a b c d", "x"), (None, "a b c d", "x"), (3, "q r s", "x"), (3, "q r s", "x")], SCHEMA)
    rows = [tuple(r) for r in fill_middle.fill_in_middle(same).collect()]
    assert len(rows) == 4 and len(set(rows)) == 2


def test_events_of_a_text_in_chunks(monkeypatch):
    """Chunks of any size give the events of the whole; sentinels over their borders are found."""
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice(["a", "Bc", " ", "é", "<", ">", "<P>", "<S", "M>", "1", "\U0001f600", "P"]) for _ in range(rng.randint(0, 40)))
        monkeypatch.setattr(fill_middle, "CHUNK", 1 << 20)
        bounds, first, marked = fill_middle.Events().scan(text)
        assert marked == any(m in text for m in fill_middle.MARKS)
        monkeypatch.setattr(fill_middle, "CHUNK", rng.randint(1, 7))
        cut = fill_middle.Events().scan(text)
        assert cut[0].tolist() == bounds.tolist() and cut[1:] == (first, marked)
        units = fill_middle.Units(bounds, first)
        want = brute.re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        assert len(units) == len(want) and [units.end_of(i) for i in range(len(want) + 1)] == [len("".join(want[:i])) for i in range(len(want) + 1)]


def phrases(df, **how):
    return {tuple(r) for r in collocations.mine(df, **how).collect()}


@pytest.fixture(scope="module")
def chatter():
    rng = random.Random(4)
    words = ["the", "The", "cat", "sat", "on", "mat", "new", "york", "city", "été", "\U0001f600", "of"]
    fixed = ["new york city", "the cat sat on", "on the mat", "of of of of of"]
    texts = [None, "", " \t ", "...", "solo", "\n\r\x0b\x0c", "a\tb a\tb. a b"]
    for _ in range(150):
        texts.append("".join((rng.choice(fixed) if rng.random() < 0.5 else rng.choice(words)) + rng.choice([" ", " ", " ", ". ", "\t", "\n", ", ", ";", "  "]) for _ in range(rng.randint(1, 40))))
    return texts + texts[20:40] * 3


@pytest.mark.parametrize("least, percent, longest, top", [(30, 80, 4, 2000), (5, 80, 4, 7), (2, 100, 3, 50), (8, 1, 2, 10), (4, 60, 5, 2000)])
def test_collocations(spark, chatter, least, percent, longest, top):
    df = table(spark, chatter)
    rows = [(r.text, r.lang) for r in df.collect()]
    assert phrases(df, least=least, percent=percent, longest=longest, top=top) == brute.collocations(rows, least, percent, longest, top)


@pytest.mark.parametrize("words", [1, 7, 50, 3000])
def test_collocations_in_blocks_of_any_size(spark, chatter, monkeypatch, words):
    """Blocks that end inside pieces, and chunks of a few bytes, lose and repeat nothing."""
    df = table(spark, chatter)
    rows = [(r.text, r.lang) for r in df.collect()]
    seen = collocations.blocks(df, "text", "lang", 4, words).where("lists is not null").count()
    assert seen >= min(3000 // words, 100) or words == 3000
    assert phrases(df, least=10, block_words=words) == brute.collocations(rows, 10, 80, 4, 2000)


def test_collocations_of_a_long_piece(spark):
    """A text whose one piece fills several blocks, in chunks that are cut between words."""
    text = " ".join(["alpha beta gamma"] * 2000 + ["x" * 300] * 50)
    df = spark.createDataFrame([(1, text, None)], SCHEMA)
    chunks = list(collocations._chunks(text.encode() * 300))
    assert b"".join(chunks) == text.encode() * 300 and len(chunks) > 1
    assert phrases(df, block_words=700) == brute.collocations([(text, None)], 30, 80, 4, 2000)


def test_collocations_of_nothing_and_of_exact_scores(spark, empty):
    assert collocations.mine(empty).collect() == []
    assert collocations.mine(spark.createDataFrame([(1, "one two", "en")], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        collocations.mine(empty, longest=1)
    big = 9_000_000_000_000
    cut = spark.range(1).select(collocations.cut_score(F.lit(big), F.array(F.lit(big), F.lit(big + 3)), F.array(F.lit(big + 1), F.lit(big + 2))).alias("c")).first().c
    want = min((2_000_000 * big // (a + b), k, a, b) for k, (a, b) in enumerate([(big, big + 2), (big + 3, big + 1)], 1))
    assert (cut.score, cut.k, cut.l, cut.r) == want


NOTICES = [" ".join(t.split()) for _, t, _ in licenses.NOTICES]


@pytest.fixture(scope="module")
def licensed(spark):
    rng = random.Random(9)
    filler = "lorem ipsum the of a file software and with use this notice terms under".split()
    some = lambda n: " ".join(rng.choices(filler, k=n))
    texts = [None, "", "...", "MIT License", "mit-license MIT LICENSE; mit\nlicense", "permit license", "Apache License 2.0 and the GNU General Public License", "the general  public, license", "mit x license", "license mit", "ÉMIT license"]
    for t in NOTICES:
        texts += [t, f"{some(30)} {t.upper()} {some(30)}", f"{t} {t}", t[: len(t) // 2], some(5) + " " + t.replace(" ", "\n# ")]
        w = t.split()
        del w[len(w) // 3]
        texts += [" ".join(w), " ".join(rng.sample(w, len(w)))]
    return texts + [some(rng.randint(1, 80)) for _ in range(60)] + ["mit license " * 3000, "software " * 5000]


def scanned(df, **how):
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return {r.doc_id: {c: r[c] for c in names} for r in licenses.digest(licenses.scan(df, licenses.fit(df, **how))).collect()}


def test_license_scans(spark, licensed):
    got = scanned(table(spark, licensed))
    want = brute.licenses(licensed, licenses.NOTICES, licenses.PHRASES, licenses.ANCHORS, licenses.SLACK, licenses.MIN_SHARE)
    assert set(got) == set(range(len(licensed)))
    for i, w in enumerate(want):
        assert got[i] == w | {"score": pytest.approx(w["score"])}, licensed[i][:80]
    labels = {x for r in got.values() for x in r["labels"].split(",")}
    assert labels >= {"mit", "apache", "gpl", "bsd", "isc", "mpl", "unlicense", "cc-by", "cc-by-nc", "lgpl", "agpl"}


def test_license_scans_keep_other_columns_and_long_texts_take_linear_time(spark, empty):
    df = table(spark, ["mit license", None])
    out = licenses.scan(df, licenses.fit(df))
    assert set(out.columns) == set(df.columns) | {"n_words", "license_places", "labels", "score"} and out.where("form = 'theirs'").count() == 2
    assert licenses.scan(empty, licenses.fit(empty)).count() == 0
    words = "permission is granted free of charge mit license "
    took = []
    for n in (2_000, 16_000):
        long = spark.createDataFrame([(1, words * n, "en")], SCHEMA)
        templates = licenses.fit(df)
        start = time.perf_counter()
        assert scanned_count(long, templates) == n
        took.append(time.perf_counter() - start)
    assert took[1] < 40 * took[0]


def scanned_count(df, templates):
    return licenses.digest(licenses.scan(df, templates)).first().n_base


def test_queries_cover_their_tables(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r.asDict() for r in QUERIES["op13_license_scans"](spark, SF).collect()}
    want = brute.licenses([t for _, t, _ in docs], licenses.NOTICES, licenses.PHRASES, licenses.ANCHORS, licenses.SLACK, licenses.MIN_SHARE)
    assert got == {d: w | {"doc_id": d, "score": pytest.approx(w["score"])} for (d, _, _), w in zip(docs, want, strict=True)}
    assert {tuple(r) for r in QUERIES["op12_collocations"](spark, SF).collect()} == brute.collocations([(t, k) for _, t, k in docs], 30, 80, 4, 2000)
    assert {r.doc_id: r.output_sha256 for r in QUERIES["op11_fill_middle"](spark, SF).collect()} == {d: brute.fill_in_middle(d, t)["output_sha256"] for d, t, _ in docs}


def test_topk_with_huge_rows_and_queries_keeps_its_blocks(spark):
    """One row of 1e60, as a candidate and as a query, adds a block or two; lengths that the sample misses are cut as others."""
    from test_llm_operators import plain_topk

    rng = random.Random(12)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(1, 600)]
    seen: dict[str, dict] = {}
    for name, more in (("plain", []), ("row", [(601, [1e60, *[0.5] * 5])]), ("query", [(600, [-1e60, *[0.5] * 5]), (650, [3e9] * 6)]), ("length", [(i, [rng.uniform(-1, 1)] * 9) for i in range(700, 707)])):
        every = rows + more
        table = spark.createDataFrame(every, "vec_id long, embedding array<double>").repartition(3)
        seen[name] = {}
        got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk_join.topk(table, block=64, seen=seen[name]).collect()}
        want = plain_topk(every)
        assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}, name
        assert {k: v for k, v in got.items() if k[0] < 600 and abs(v[1]) < 2**62} == {k: v for k, v in want.items() if k[0] < 600 and abs(v[1]) < 2**62}
    assert seen["row"]["blocks"] >= seen["plain"]["blocks"] >= 10 and seen["query"]["blocks"] >= seen["plain"]["blocks"]


def test_topk_of_lengths_that_the_sample_misses(spark, monkeypatch):
    from test_llm_operators import plain_topk

    rng = random.Random(13)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(300)]
    monkeypatch.setattr(topk_join, "_spaces", lambda rows, scale, pivots: {})
    table, seen = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), {}
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk_join.topk(table, block=32, seen=seen).collect()}
    assert got == plain_topk(rows) and seen["blocks"] >= 8


def test_suffix_dedup_of_shared_and_missing_ids(spark):
    """Rows with one id or none are documents in the order of a hash of their texts; equal ones keep what one keeps."""
    rng = random.Random(14)
    passages = [" ".join(f"p{rng.randrange(10**6)}" for _ in range(20)) for _ in range(8)]
    texts = [" ".join(rng.choice([*passages, " ".join(f"u{rng.randrange(10**9)}" for _ in range(10))]) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    rows = [(rng.choice([None, None, 7, 7, 100 + i, -5]), t) for i, t in enumerate(texts)] + [(None, texts[0])] * 3 + [(7, texts[1])] * 2 + [(None, ""), (None, None), (7, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ranks = sorted({(suffix_dedup.NULL_ID if r.doc_id is None else r.doc_id, r.h, r.text or "") for r in df.withColumn("h", F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))).collect()})
    want = brute.removed([(i, t) for i, (_, _, t) in enumerate(ranks)], 100)
    by_text = {(d, t): want[i] for i, (d, _, t) in enumerate(ranks)}
    expected = sorted((d is None, d or 0, *by_text[suffix_dedup.NULL_ID if d is None else d, t or ""]) for d, t in rows)
    got = suffix_dedup.dedup(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == expected


def test_suffix_dedup_of_many_rows_without_an_id_takes_no_longer(spark):
    rng = random.Random(15)
    texts = [" ".join(f"w{rng.randrange(10**7)}" for _ in range(80)) for _ in range(2000)]
    took = {}
    for name, ids in (("warm", range(2000)), ("own", range(2000)), ("none", [None] * 2000), ("same", [3] * 2000)):
        df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(4)
        start = time.perf_counter()
        assert suffix_dedup.dedup(df).where("n_removed > 0").count() == 0
        took[name] = time.perf_counter() - start
    assert max(took["none"], took["same"]) < 2 * took["own"] + 2


def test_steps_of_hashes_come_back():
    import numpy as np

    from sparkloom.llm import jaccard_join

    g = np.sort(np.unique(np.random.default_rng(1).integers(0, 1 << 64, 1000, dtype=np.uint64)))
    cuts = np.array([0, 1, 400, 999])
    step = jaccard_join._steps(g, cuts)
    ends = [*cuts[1:].tolist(), len(g)]
    packed = [step[a:b].T.tobytes() for a, b in zip(cuts.tolist(), ends, strict=True)]
    assert jaccard_join._hashes(packed, [b - a for a, b in zip(cuts.tolist(), ends, strict=True)]).tolist() == g.tolist()


def test_shingles_of_copies_are_not_shuffled(spark, monkeypatch):
    """Documents that stay out of the join leave before the exchange, and partitions follow the text."""
    from sparkloom.llm import jaccard_join

    plans, shuffled, make = [], [], jaccard_join.written

    def seen(df):
        plans.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString()))
        shuffled.append(int(spark.conf.get("spark.sql.shuffle.partitions")))
        return make(df)

    monkeypatch.setattr(jaccard_join, "written", seen)
    monkeypatch.setattr(jaccard_join, "PARTITION_BYTES", 1 << 8)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words)] * 20 + [" ".join([*words, str(i)]) for i in range(5)] + ["other words are here now", None]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = jaccard_join.jaccard_components(table(spark, texts)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: 0 if i < 25 else i for i in range(27)}
    own = next(p for columns, p in plans if columns[:2] == ["doc", "shingle"] and "doc_id" not in columns)
    assert "flags" in own and "Aggregate" not in own
    assert min(shuffled) > int(before) == int(spark.conf.get("spark.sql.shuffle.partitions"))
