"""Queries on cross-validation, searches, ensembles, explanations, schedules and position codes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import learners as L
from sparkloom.operators import logistic as G
from sparkloom.operators import search as S
from sparkloom.operators import selection as C
from sparkloom.operators import trials as U
from sparkloom.plans.base import query, table
from sparkloom.sources.files import scratch

NUM = ["l_quantity", "l_discount", "l_tax"]
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_LINE = "SELECT l_extendedprice AS y, l_quantity AS x, l_orderkey % 5 AS f, l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem"
_FOLDS = f"WITH d AS ({_LINE}), k AS (SELECT unnest(range(5)) AS f), m AS (SELECT k.f, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM k JOIN d ON d.f <> k.f GROUP BY k.f) "


def _fold():
    return F.col("l_orderkey") % 5


def _lines(spark, sf):
    return table(spark, sf, "lineitem")


def _moments(spark, sf):
    return L.moments(_lines(spark, sf), NUM, "l_extendedprice", _fold())


@query(_FOLDS + "SELECT d.f::BIGINT AS fold, round(-avg((y - a * x - b) ** 2), 1) AS neg_mse FROM d JOIN m USING (f) GROUP BY d.f")
def cv_scores(spark, sf):
    scores = L.cross_validate(_moments(spark, sf), (0,), metric="neg_mse")
    return spark.createDataFrame(list(enumerate(scores)), "fold long, neg_mse double").withColumn("neg_mse", F.round("neg_mse", 1))


@query()
def grid_search(spark, sf):
    return L.as_table(spark, L.grid_search(_moments(spark, sf), [(0,), (0, 1), (0, 1, 2)], [0.0, 10.0, 1000.0]), NUM)


@query()
def random_subset_search(spark, sf):
    return L.as_table(spark, L.random_search(_moments(spark, sf), 8, 1), NUM)


@query()
def weighted_subset_search(spark, sf):
    return L.as_table(spark, L.weighted_search(_moments(spark, sf), 8, 1), NUM)


@query()
def las_vegas_subset_search(spark, sf):
    return L.as_table(spark, L.las_vegas_search(_moments(spark, sf), 5, 1, 1e-6), NUM)


@query()
def top_ratio_subsets(spark, sf):
    return L.as_table(spark, L.top_ratio_search(_moments(spark, sf), [0.95, 0.7, 0.4]), NUM)


def _stack(spark, sf):
    return L.stack(_lines(spark, sf), NUM, "l_extendedprice", _fold(), [(0,), (0, 1, 2)])


@query(_FOLDS + "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(a * x + b, 3) AS p0 FROM d JOIN m USING (f)")
def stack_oof_features(spark, sf):
    return _stack(spark, sf).out_of_fold(_lines(spark, sf), _fold()).select(*KEYS, F.round("p0", 3).alias("p0"))


@query()
def stack_meta_ols(spark, sf):
    return _stack(spark, sf).predict(_lines(spark, sf)).select(*KEYS, "predicted")


@query()
def select_top2_learners(spark, sf):
    two = lambda scores: np.argsort(-np.array(scores), kind="stable")[:2].tolist()
    s = L.stack(_lines(spark, sf), NUM, "l_extendedprice", _fold(), [(0,), (1,), (0, 2)], choose=two)
    return spark.createDataFrame(list(enumerate(s.scores)), "learner long, score double")


@query(f"WITH d AS ({_LINE}), m AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM d WHERE l_orderkey % 10 < 7), h AS (SELECT *, a * x + b AS p FROM d, m WHERE l_orderkey % 10 >= 7), t AS (SELECT regr_slope(y, p) AS a, regr_intercept(y, p) AS b FROM h) SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(t.a * p + t.b, 3) AS predicted FROM h, t")
def blend_holdout(spark, sf):
    held = F.col("l_orderkey") % 10 >= 7
    d = _lines(spark, sf)
    return L.blend(d, ["l_quantity"], "l_extendedprice", held, [(0,)]).predict(d.where(held)).select(*KEYS, F.round("predicted", 3).alias("predicted"))


@query(f"WITH d AS ({_LINE}), m AS (SELECT regr_slope(y, x) AS a, avg(x) AS c FROM d) SELECT concat_ws('/', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row, 'l_quantity' AS feature, round(a * (x - c), 3) AS phi FROM d, m")
def linear_phi(spark, sf):
    d = _lines(spark, sf).withColumn("row", F.concat_ws("/", *KEYS))
    m = L.total(L.moments(d, ["l_quantity"], "l_extendedprice"))
    return L.contributions(d, "row", ["l_quantity"], L.fit(m, (0,)), m[0, 1:-1] / m[0, 0]).select("row", "feature", F.round("phi", 3).alias("phi"))


@query()
def top_threshold(spark, sf):
    d = _lines(spark, sf).withColumn("row", F.concat_ws("/", *KEYS))
    m = L.total(L.moments(d, NUM, "l_extendedprice"))
    phi = d.select("row", L.parts_of(NUM, L.fit(m, (0, 1, 2)), m[0, 1:-1] / m[0, 0]).alias("parts"))
    base = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["phi"])
    top = phi.withColumn("base", base).select("row", F.posexplode(C.top_of_row(F.col("parts"), 2, "threshold", F.col("base"), 0.0)).alias("rank", "x"))
    return top.select("row", "x.feature", (F.col("rank") + 1).alias("rank"), "x.phi")


@query("""WITH s AS (SELECT unnest(range(1000))::BIGINT AS step), p AS (SELECT step, step / 1000.0::DOUBLE AS x, 0.1::DOUBLE AS w FROM s)
SELECT step, round(CASE WHEN x < w THEN x / w ELSE 1 END, 9) AS constant, round(CASE WHEN x < w THEN x / w ELSE greatest((1 - x) / (1 - w), 0) END, 9) AS linear,
round(CASE WHEN x < w THEN x / w ELSE 0.5 * (1 + cos(pi() * (x - w) / (1 - w))) END, 9) AS cosine FROM p""")
def warmup_schedules(spark, sf):
    x, w = F.col("id") / 1000.0, 0.1
    warm = lambda rest: F.round(F.when(x < w, x / w).otherwise(rest), 9)
    return spark.range(1000).select(F.col("id").alias("step"), warm(F.lit(1.0)).alias("constant"), warm(F.greatest((1 - x) / (1 - w), F.lit(0.0))).alias("linear"), warm(0.5 * (1 + F.cos(F.pi() * (x - w) / (1 - w)))).alias("cosine"))


@query("SELECT p AS pos, i AS dim, round(CASE WHEN i % 2 = 0 THEN sin(p / pow(10000, i / 16.0::DOUBLE)) ELSE cos(p / pow(10000, (i - 1) / 16.0::DOUBLE)) END, 6) AS value FROM range(50) a(p), range(16) b(i)")
def position_encoding(spark, sf):
    angle = F.col("pos") / F.pow(F.lit(10000.0), (F.col("dim") - F.col("dim") % 2) / 16.0)
    grid = spark.range(50).select(F.col("id").alias("pos"), F.explode(F.expr("sequence(0L, 15L)")).alias("dim"))
    return grid.select("pos", "dim", F.round(F.when(F.col("dim") % 2 == 0, F.sin(angle)).otherwise(F.cos(angle)), 6).alias("value"))


@query(_FOLDS + ", w AS (SELECT avg(a) AS a, avg(b) AS b FROM m) SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(w.a * x + w.b, 3) AS p FROM d, w")
def stack_fold_mean(spark, sf):
    s = L.stack(_lines(spark, sf), ["l_quantity"], "l_extendedprice", _fold(), [(0,)])
    return _lines(spark, sf).select(*KEYS, F.round(L.linear(np.mean(list(s.by_fold[0].values()), axis=0), ["l_quantity"]), 3).alias("p"))


@query("WITH s AS (SELECT regr_r2(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_discount) AS b FROM lineitem), t AS (SELECT 1 / (1 + exp(-a)) AS a, 1 / (1 + exp(-b)) AS b FROM s) SELECT 0::BIGINT AS learner, round(a / (a + b), 6) AS weight FROM t UNION ALL SELECT 1, round(b / (a + b), 6) FROM t")
def metric_to_weight(spark, sf):
    m = L.total(_moments(spark, sf))
    w = L.vote_weights([L.score(m, L.fit(m, (j,))) for j in (0, 1)])
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "learner long, weight double").withColumn("weight", F.round("weight", 6))


_SPACE = {"alpha": S.Box(1e-3, 1e8, log=True), "features": S.Box(1, 3.999, cast=int)}


def _searched(spark, sf, search):
    m = _moments(spark, sf)
    trials = search(_SPACE, lambda p: L.try_out(m, tuple(range(p["features"])), p["alpha"]).effect, seed=1)
    top = S.best(trials)
    rows = [(i, t.params["alpha"], t.params["features"], t.effect, t is top) for i, t in enumerate(trials)]
    return spark.createDataFrame(rows, "trial long, alpha double, features int, effect double, best boolean")


@query()
def ml_bayes(spark, sf):
    return _searched(spark, sf, S.bayesian)


@query()
def ml_tpe(spark, sf):
    return _searched(spark, sf, S.parzen)


@query("""WITH p AS (SELECT s::BIGINT AS step, s / 1000.0::DOUBLE AS x FROM range(0, 1000) t(s)), c AS (SELECT *, (x - 0.1) / 0.9 * 4 AS h, x * 4 - floor(x * 4) AS u FROM p)
SELECT step, round(CASE WHEN x < 0.1 THEN x / 0.1 ELSE 0.5 * (1 + cos(pi() * (h - floor(h + 1e-9)))) END, 6) AS hard, round(CASE WHEN u < 0.1 THEN u / 0.1 ELSE 0.5 * (1 + cos(pi() * (u - 0.1) / 0.9)) END, 6) AS warm FROM c""")
def restart_schedules(spark, sf):
    """Cosine in four cycles: after one warm-up, and with a warm-up in each."""
    x = F.col("id") / 1000.0
    h, u = (x - 0.1) / 0.9 * 4, x * 4 - F.floor(x * 4)
    half = lambda v: 0.5 * (1 + F.cos(F.pi() * v))
    return spark.range(1000).select(F.col("id").alias("step"), F.round(F.when(x < 0.1, x / 0.1).otherwise(half(h - F.floor(h + 1e-9))), 6).alias("hard"), F.round(F.when(u < 0.1, u / 0.1).otherwise(half((u - 0.1) / 0.9)), 6).alias("warm"))


def _returned(spark, sf):
    """Whether a line was returned, and a row's own number for each order."""
    return _lines(spark, sf).withColumn("y", (F.col("l_returnflag") == "R").cast("int"))


@query()
def logistic_cv(spark, sf):
    """Log loss of each held-out fold; a step reads the data once for all folds."""
    d = _returned(spark, sf)
    models = G.fit(d, NUM, "y", fold=_fold())
    return d.groupBy(_fold().alias("fold")).agg(F.round(G.log_loss(G.out_of_fold(models, NUM, _fold()), F.col("y")), 6).alias("log_loss"))


@query()
def stack_classifier(spark, sf):
    """Two logistic bases' out-of-fold probabilities, and a logistic model on these."""
    d = _returned(spark, sf)
    bases = [NUM[:1], NUM]
    by_fold = [G.fit(d, b, "y", fold=_fold()) for b in bases]
    meta = d.withColumns({f"p{i}": G.out_of_fold(m, b, _fold()) for i, (m, b) in enumerate(zip(by_fold, bases, strict=True))})
    w = G.fit(meta, ["p0", "p1"], "y")[0]
    return meta.select(*KEYS, F.round(G.probability(w, ["p0", "p1"]), 6).alias("p"))


def _logistic(params, x, y):
    return G.fit_rows(x, y, params["alpha"])


def _predicted(w, x):
    return 1 / (1 + np.exp(-(w[0] + x @ w[1:])))


def _accuracy(y, p):
    return float(((p > 0.5) == (y > 0.5)).mean())


def _balances(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("most"))
    return table(spark, sf, "customer").join(o, "c_custkey").select("c_custkey", "n", "mean", "most", (F.col("most") > 250000).cast("int").alias("y"))


@query()
def distributed_param_search(spark, sf):
    """A grid tried by a learner that needs rows, candidates by folds in tasks."""
    t = U.evaluate(_balances(spark, sf), "c_custkey", ["n", "mean"], "y", U.grid({"alpha": [0.01, 1.0, 100.0]}), _logistic, _predicted, _accuracy)
    return t.select("candidate", "params", "fold", F.round("effect", 6).alias("effect"))


@query()
def distributed_feature_search(spark, sf):
    """Random subsets of features, each candidate with its own, on one holdout."""
    candidates = [{**c, "alpha": 1.0} for c in U.subsets(["n", "mean", "most"], 1, 6, 1)]
    t = U.evaluate(_balances(spark, sf), "c_custkey", ["n", "mean", "most"], "y", candidates, _logistic, _predicted, _accuracy, holdout=0.3)
    return t.select("candidate", "params", F.round("effect", 6).alias("effect"))


def _any_stack(spark, sf, **how):
    """Two learners that need rows, and a logistic model, from sums, of their predictions of rows that they haven't seen."""
    d, bases = _balances(spark, sf), [{"alpha": 1.0, "features": ["n"]}, {"alpha": 1.0}]
    oof = U.out_of_fold(d, "c_custkey", ["n", "mean"], "y", bases, _logistic, _predicted, scratch(spark), **how)
    w = G.fit(oof.withColumn("y", F.col("y").cast("int")), ["p0", "p1"], "y")[0]
    return oof.select("c_custkey", "fold", F.round("p0", 6).alias("p0"), F.round("p1", 6).alias("p1"), F.round(G.probability(w, ["p0", "p1"]), 4).alias("p"))


@query()
def stack_any_learner(spark, sf):
    """A stack over folds that a column gives."""
    return _any_stack(spark, sf, fold=F.col("c_custkey") % 4)


@query()
def blend_any_learner(spark, sf):
    """A blend: learners see what isn't held out, their votes are learned from what is."""
    return _any_stack(spark, sf, holdout=0.3)


@query()
def stack_metrics_only(spark, sf):
    """Only the scores of a stack's learners on given folds, and the weights that they vote with."""
    t = U.evaluate(_balances(spark, sf), "c_custkey", ["n", "mean"], "y", [{"alpha": 1.0, "features": ["n"]}, {"alpha": 1.0}], _logistic, _predicted, _accuracy, fold=F.col("c_custkey") % 4)
    return C.sigmoid_weights(U.summary(t).select(F.col("trial").alias("learner"), F.col("effect").alias("score")), "score").select("learner", F.round("score", 6).alias("score"), F.round("weight", 6).alias("weight"))
