"""Queries without SQL against plain Python and numpy, on whole tables."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest

from sparkloom.functions import matrices as M
from sparkloom.operators import decoding as D
from sparkloom.operators import pieces as P
from sparkloom.plans import registry
from sparkloom.plans.sequence import MOVES

SF = "/root/testdata/sf0.001"
NUM = ["l_quantity", "l_discount", "l_tax"]
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def rows(spark, name: str) -> pd.DataFrame:
    return registry.queries()[name](spark, SF).toPandas()


@pytest.fixture(scope="module")
def lines():
    return pd.read_parquet(f"{SF}/lineitem.parquet")


@pytest.fixture(scope="module")
def texts():
    d = pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(d["doc_id"], d["text"], strict=True))


def ridge(x, y, alpha=0.0):
    """Weights, intercept first, by the normal equations of centred columns."""
    xm, ym = x.mean(0), y.mean()
    w = np.linalg.solve((x - xm).T @ (x - xm) + alpha * np.eye(x.shape[1]), (x - xm).T @ (y - ym))
    return np.append(ym - xm @ w, w)


def r2(x, y, w):
    return 1 - ((y - w[0] - x @ w[1:]) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def folds(lines, columns, alpha=0.0):
    x, y, f = lines[columns].to_numpy(float), lines["l_extendedprice"].to_numpy(float), lines["l_orderkey"].to_numpy() % 5
    return {k: ridge(x[f != k], y[f != k], alpha) for k in range(5)}, x, y, f


def effect(lines, columns, alpha=0.0):
    models, x, y, f = folds(lines, columns, alpha)
    return np.mean([r2(x[f == k], y[f == k], w) for k, w in models.items()])


@pytest.mark.parametrize("name", ["grid_search", "random_subset_search", "weighted_subset_search", "las_vegas_subset_search", "top_ratio_subsets"])
def test_searches(spark, lines, name):
    got = rows(spark, name)
    want = [effect(lines, r.features.split(","), r.alpha) for r in got.itertuples()]
    assert got["effect"].to_numpy() == pytest.approx(np.array(want), abs=1e-7)
    assert got["best"].sum() == 1 and got.loc[got["best"], "effect"].iloc[0] >= got["effect"].max() - 1e-6


@pytest.mark.parametrize("name", ["ml_bayes", "ml_tpe"])
def test_box_searches(spark, lines, name):
    got = rows(spark, name)
    want = [effect(lines, NUM[: r.features], r.alpha) for r in got.itertuples()]
    assert got["effect"].to_numpy() == pytest.approx(np.array(want), abs=1e-7)
    assert got.loc[got["best"], "effect"].iloc[0] == got["effect"].max()


def test_stack_of_least_squares(spark, lines):
    bases = [NUM[:1], NUM]
    by = [folds(lines, b) for b in bases]
    y, f = by[0][2], by[0][3]
    oof = np.stack([np.array([m[k][0] + row @ m[k][1:] for row, k in zip(x, f, strict=True)]) for m, x, _, _ in by], 1)
    meta = ridge(oof, y)
    means = np.stack([np.mean([w[0] + x @ w[1:] for w in m.values()], axis=0) for m, x, _, _ in by], 1)
    want = lines[KEYS].assign(p=meta[0] + means @ meta[1:]).sort_values([*KEYS, "p"])
    got = rows(spark, "stack_meta_ols").sort_values([*KEYS, "predicted"])
    assert got["predicted"].to_numpy() == pytest.approx(want["p"].to_numpy(), rel=1e-6)


def test_learners_chosen_by_score(spark, lines):
    scores = [effect(lines, c) for c in (NUM[:1], NUM[1:2], [NUM[0], NUM[2]])]
    assert rows(spark, "select_top2_learners").sort_values("learner")["score"].to_numpy() == pytest.approx(np.array(sorted(scores, reverse=True)[:2]), abs=1e-7)


def test_contributions_by_threshold(spark, lines):
    x = lines[NUM].to_numpy(float)
    phi = ridge(x, lines["l_extendedprice"].to_numpy(float))[1:] * (x - x.mean(0))
    want = []
    for key, p in zip(lines[KEYS].itertuples(index=False), phi, strict=True):
        order = sorted(range(3), key=lambda j: (-p[j] if p.sum() >= 0 else p[j], NUM[j]))  # noqa: B023
        want += [("/".join(map(str, key)), NUM[j], r, round(p[j], 4)) for r, j in enumerate(order[:2], 1)]
    got = [(r.row, r.feature, r.rank, round(r.phi, 4)) for r in rows(spark, "top_threshold").itertuples()]
    assert [g[:3] for g in sorted(got)] == [w[:3] for w in sorted(want)]
    assert [g[3] for g in sorted(got)] == pytest.approx([w[3] for w in sorted(want)], abs=1e-2)


def test_bags_are_means_of_models(spark, lines):
    """Every prediction is one linear function of the features, whose mean is near the target's."""
    for name in ("bag_mean", "bag_weighted"):
        got = rows(spark, name).merge(lines.drop_duplicates(KEYS), on=KEYS)
        x = np.c_[np.ones(len(got)), got[NUM].to_numpy(float)]
        w = np.linalg.lstsq(x, got["predicted"].to_numpy(), rcond=None)[0]
        assert np.median(np.abs(x @ w - got["predicted"])) < 1.0
        assert got["predicted"].mean() == pytest.approx(lines["l_extendedprice"].mean(), rel=0.02)


def test_logistic_queries(spark, lines):
    from sparkloom.operators import logistic

    y, f = (lines["l_returnflag"] == "R").to_numpy(int), lines["l_orderkey"].to_numpy() % 5
    p = {}
    for name, columns in (("p0", NUM[:1]), ("p1", NUM)):
        x = lines[columns].to_numpy(float)
        p[name] = np.zeros(len(x))
        for k in range(5):
            w = logistic.fit_rows(x[f != k], y[f != k])
            p[name][f == k] = 1 / (1 + np.exp(-(w[0] + x[f == k] @ w[1:])))
    loss = {k: -np.mean(y[f == k] * np.log(p["p1"][f == k]) + (1 - y[f == k]) * np.log(1 - p["p1"][f == k])) for k in range(5)}
    assert {r.fold: r.log_loss for r in rows(spark, "logistic_cv").itertuples()} == {k: pytest.approx(v, abs=1e-4) for k, v in loss.items()}
    z = np.stack([p["p0"], p["p1"]], 1)
    w = logistic.fit_rows(z, y)
    want = np.sort(1 / (1 + np.exp(-(w[0] + z @ w[1:]))))
    assert np.sort(rows(spark, "stack_classifier")["p"].to_numpy()) == pytest.approx(want, abs=2e-3)


def test_decoded_paths_and_losses(spark, texts):
    of = lambda w: (len(w) / 10.0, float(bool(w) and "A" <= w[0] <= "Z"), 1.0 - len(w) / 8.0)
    scores = {d: np.array([of(w) for w in t.split(" ")]) for d, t in texts.items() if t is not None}
    got = {r.doc_id: r.path for r in rows(spark, "viterbi").itertuples() if r.path is not None}
    losses = {r.doc_id: r.loss for r in rows(spark, "crf_loss").itertuples()}
    for d, s in scores.items():
        path = list(map(int, got[d]))
        assert D.path_score(s, MOVES, np.array(path)) == pytest.approx(D.path_score(s, MOVES, np.array(D.best_path(s, MOVES))))
        gold = np.array([len(w) % 3 for w in texts[d].split(" ")])
        assert losses[d] == pytest.approx(D.log_partition(s, MOVES) - D.path_score(s, MOVES, gold), abs=1e-5)


def test_pre_tokens_and_ids(spark, texts):
    import collections

    import public_tokenizers
    import regex
    from tokenizers import Tokenizer

    find = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
    want = collections.Counter(w for t in texts.values() for w in find(t or ""))
    assert {r.token: r.n for r in rows(spark, "gpt2_pretokens").itertuples()} == dict(want)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    ids = {d: tok.encode(t or "", add_special_tokens=False).ids for d, t in texts.items()}
    got = {r.doc_id: (r.n, r.ids) for r in rows(spark, "gpt2_ids").itertuples()}
    assert got == {d: (len(i), hashlib.md5(",".join(map(str, i)).encode()).hexdigest()) for d, i in ids.items()}


def test_ids_with_special_tokens_are_the_librarys(spark, texts):
    import public_tokenizers
    from tokenizers import AddedToken, Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.add_special_tokens([AddedToken(t, special=True, normalized=False) for t in ("<|en|>", "<|de|>")])
    lang = dict(pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "lang"]].itertuples(index=False))
    ids = {d: tok.encode(f"<|{lang[d]}|>{t or ''}<|endoftext|>", add_special_tokens=False).ids for d, t in texts.items()}
    got = {r.doc_id: (r.n, r.ids) for r in rows(spark, "gpt2_special_ids").itertuples()}
    assert got == {d: (len(i), hashlib.md5(",".join(map(str, i)).encode()).hexdigest()) for d, i in ids.items()}


def test_ids_of_words_are_the_librarys(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: tok.encode(t or "", add_special_tokens=False).ids for d, t in texts.items()}
    got = {r.doc_id: (r.n, r.ids) for r in rows(spark, "gpt_word_ids").itertuples()}
    assert got == {d: (len(i), hashlib.md5(",".join(map(str, i)).encode()).hexdigest()) for d, i in ids.items()}


def test_word_pieces_of_documents(spark, texts):
    import collections
    import re
    import unicodedata

    marks = lambda c: not c.isalnum() and (c.isascii() and c.isprintable() and c != " " or unicodedata.category(c)[0] == "P")

    def tokens(t: str) -> list[str]:
        t = "".join(" " if c in "\t\n\r" or unicodedata.category(c) == "Zs" else "" if unicodedata.category(c)[0] == "C" or c == "�" else c for c in t)
        t = "".join(c for c in unicodedata.normalize("NFD", t.lower()) if unicodedata.category(c) != "Mn")
        return re.sub("[一-鿿]", r" \g<0> ", "".join(f" {c} " if marks(c) else c for c in t)).split()

    words = {d: tokens(t or "") for d, t in texts.items()}
    count = collections.Counter(w for ws in words.values() for w in ws)
    frequent = sorted((w for w, n in count.items() if n >= 20), key=lambda w: (-count[w], w))[:5000]
    vocab = {*frequent, *(m + c for t in texts.values() for c in (t or "").lower().strip(" ") for m in ("", "##"))}
    got = {r.doc_id: (r.n, r.pieces) for r in rows(spark, "wordpiece").itertuples()}
    for d, ws in words.items():
        pieces = [p for w in ws for p in P.cut(w, vocab)]
        assert got[d] == (len(pieces), hashlib.md5(" ".join(pieces).encode()).hexdigest()), d


@pytest.mark.parametrize("name", sorted(M.LINALG))
def test_decompositions_of_vectors(spark, name):
    v = pd.read_parquet(f"{SF}/embeddings.parquet")
    got = {r.vec_id: r.value for r in rows(spark, f"linalg_{name}").itertuples()}
    for i, e in list(zip(v["vec_id"], v["embedding"], strict=True))[:40]:
        m = np.asarray(e, float).reshape(8, 8)
        x = np.array(got[i].split(","), float)
        if name == "inv":
            assert np.allclose(x.reshape(8, 8) @ m, np.eye(8), atol=1e-3)
        elif name == "qr_r":
            assert np.allclose(x.reshape(8, 8).T @ x.reshape(8, 8), m.T @ m, atol=1e-4)
        elif name == "cholesky_of_gram":
            assert np.allclose(x.reshape(8, 8) @ x.reshape(8, 8).T, m @ m.T + np.eye(8), atol=1e-4)
        elif name == "svd_values":
            assert np.allclose(x**2, np.sort(np.linalg.eigvalsh(m.T @ m))[::-1], atol=1e-4)
        elif name == "det":
            assert math.isclose(x[0], np.prod(np.linalg.eigvals(m)).real, abs_tol=1e-5)
        elif name == "slogdet":
            assert math.isclose(x[0] * math.exp(x[1]), np.linalg.det(m), abs_tol=1e-5)
        elif name == "rank":
            assert x[0] == 8
        elif name == "cond":
            s = np.linalg.svd(m, compute_uv=False)
            assert math.isclose(x[0], s[0] / s[-1], rel_tol=1e-4)
        else:
            want = np.linalg.eigvals((m + m.T) / 2 if name == "eig_symmetric" else m).real
            assert np.allclose(x, np.sort(want), atol=1e-4)
