"""Queries on bags of rows, trees, learners of words, and what features and words contribute."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import bags as B
from sparkloom.operators import selection as C
from sparkloom.operators import sparse_text as W
from sparkloom.operators import trees as R
from sparkloom.plans.base import query, table
from sparkloom.sources.files import scratch

NUM = ["l_quantity", "l_discount", "l_tax"]
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
MODELS, SEED, SHARE = 7, 3, 0.8
_WRAP = f"{1 << 64}::UHUGEINT"
#: The rows of each model's draw: a hash of key and model, from 0 to 1, is less than the share.
_DRAWN = f"""WITH d AS (SELECT l_extendedprice AS y, l_quantity AS x, l_orderkey * 8 + l_linenumber AS k, l_orderkey % 10 >= 7 AS held, {", ".join(KEYS)} FROM lineitem),
    z0 AS (SELECT m, x, y, held, ((k::UHUGEINT + {B.STEP}::UHUGEINT * (m + 1 + {1_000_003 * SEED})::UHUGEINT) % {_WRAP})::UBIGINT AS z FROM d, (SELECT unnest(range({MODELS})) AS m)),
    z1 AS (SELECT m, x, y, held, (xor(z, z >> 30)::UHUGEINT * {B.MIX_A}::UHUGEINT % {_WRAP})::UBIGINT AS z FROM z0),
    z2 AS (SELECT m, x, y, held, (xor(z, z >> 27)::UHUGEINT * {B.MIX_B}::UHUGEINT % {_WRAP})::UBIGINT AS z FROM z1),
    e AS (SELECT m, x, y, held FROM z2 WHERE (xor(z, z >> 31) >> 11) / {1 << 53}.0 < {SHARE}), """
_VOTED = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(a * x + b, 3) AS predicted FROM d, g"


def _id():
    return F.col("l_orderkey") * 8 + F.col("l_linenumber")


def _lines(spark, sf):
    return table(spark, sf, "lineitem")


def _bagged(spark, sf, **how):
    d = _lines(spark, sf)
    bag = B.fit_linear(d, _id(), ["l_quantity"], "l_extendedprice", MODELS, share=SHARE, seed=SEED, **how)
    return d.select(*KEYS, F.round(bag.predict(), 3).alias("predicted"))


@query(_DRAWN + "f AS (SELECT m, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM e GROUP BY m), g AS (SELECT avg(a) AS a, avg(b) AS b FROM f) " + _VOTED)
def bag_mean(spark, sf):
    """The mean of models that each learn from their own draw of rows."""
    return _bagged(spark, sf)


@query(
    _DRAWN
    + """f AS (SELECT m, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM e WHERE NOT held GROUP BY m),
    s AS (SELECT m, any_value(a) AS a, any_value(b) AS b, 1 - sum((y - a * x - b) ** 2) / (sum(y ** 2) - sum(y) ** 2 / count(*)) AS r2 FROM e JOIN f USING (m) WHERE held GROUP BY m),
    v AS (SELECT a, b, 1 / (1 + exp(-r2)) AS w FROM s), g AS (SELECT sum(a * w) / sum(w) AS a, sum(b * w) / sum(w) AS b FROM v) """
    + _VOTED
)
def bag_weighted(spark, sf):
    """Models vote by their score on held-out rows of their draw."""
    return _bagged(spark, sf, weighted=True, holdout=F.col("l_orderkey") % 10 >= 7)


def _returned(spark, sf):
    return _lines(spark, sf).withColumn("y", (F.col("l_returnflag") == "R").cast("int"))


@query()
def bag_classifier(spark, sf):
    """The mean probability of logistic models that each learn from a bootstrap of rows and a share of the features."""
    d = _returned(spark, sf)
    bag = B.fit_logistic(d, _id(), NUM, "y", 5, columns=0.7, seed=1)
    return d.select(*KEYS, F.round(bag.predict(), 6).alias("p"))


@query("""WITH d AS (SELECT l_extendedprice AS y, l_quantity AS x, l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem), q AS (SELECT x, sum(y) AS s, count(*) AS n FROM d GROUP BY x),
    c AS (SELECT x AS t, sum(s) OVER (ORDER BY x) AS sl, sum(n) OVER (ORDER BY x) AS nl, sum(s) OVER () AS st, sum(n) OVER () AS nt FROM q),
    b AS (SELECT *, sl / nl AS ml, (st - sl) / (nt - nl) AS mr, st / nt AS m FROM c WHERE nl < nt ORDER BY sl ** 2 / nl + (st - sl) ** 2 / (nt - nl) DESC, t LIMIT 1)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(CASE WHEN x > t THEN mr ELSE ml END, 2) AS predicted, round(CASE WHEN x > t THEN mr ELSE ml END - m, 2) AS phi FROM d, b""")
def tree_stump_phi(spark, sf):
    """One split: the prediction is a side's mean, and the contribution what it differs from the mean of all."""
    d = _lines(spark, sf)
    model = R.boost(d, ["l_quantity"], "l_extendedprice", trees=1, depth=1, rate=1.0, l2=0.0, bins=512)
    return d.select(*KEYS, F.round(model.raw(), 2).alias("predicted"), F.round(F.get(model.parts(), F.lit(0))["phi"], 2).alias("phi"))


def _explained(d, model):
    """Prediction, expectation and the contribution of each feature, by row."""
    rows = d.select(*KEYS, model.shares().alias("s"))
    phi = [F.round(f"s.phi{i}", 6).alias(f"phi_{c}") for i, c in enumerate(model.features)]
    return rows.select(*KEYS, F.round("s.raw", 6).alias("raw"), F.lit(round(model.expected(), 6)).alias("expected"), *phi)


def _boosted(spark, sf):
    d = _returned(spark, sf).withColumn("ship", F.datediff("l_shipdate", F.lit("1992-01-01")))
    return d, R.boost(d, [*NUM, "ship"], "y", classify=True, trees=4, depth=3)


@query()
def tree_boost_phi(spark, sf):
    """Boosted trees of a class, and each feature's share of a row's log odds."""
    return _explained(*_boosted(spark, sf))


@query()
def tree_forest_phi(spark, sf):
    """A forest of a number, and each feature's share of a row's prediction."""
    d = _lines(spark, sf)
    return _explained(d, R.forest(d, _id(), NUM, "l_extendedprice", trees=8, depth=4))


@query()
def tree_reasons(spark, sf):
    """The two features that most raise a row's log odds where it is likely returned, and that most lower them elsewhere, in words."""
    d, model = _boosted(spark, sf)
    phrase = lambda x: F.concat(x["feature"], F.lit(" value is "), x["value"].cast("string"))
    top = C.top_of_row(F.col("parts"), 2, "threshold", F.col("p"), 0.5)
    rows = d.select("*", model.shares().alias("s")).select(*KEYS, model.predict(F.col("s")).alias("p"), model.parts(F.col("s")).alias("parts"))
    return rows.select(*KEYS, F.round("p", 6).alias("p"), F.array_join(F.transform(top, phrase), ",").alias("reason"))


_TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda w: w <> '')"


def _words():
    return F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"), lambda w: w != "")


def _text_explained(spark, sf, rounds):
    d = table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id", "left")
    model = W.fit(d, "doc_id", _words(), "y", rounds=rounds, tolerance=0.0, out=scratch(spark))
    return W.explain(table(spark, sf, "documents"), "doc_id", _words(), model)


@query(f"""WITH d AS (SELECT doc_id, {_TOKENS} AS t, quality AS y FROM documents LEFT JOIN labels USING (doc_id)),
    r AS (SELECT doc_id, y, len(t) AS size, token, count(*) AS n FROM d, unnest(t) u(token) GROUP BY ALL),
    g AS (SELECT token, -sum(n * (0.5::DOUBLE - y)) / (sum(n * (size + 1)) / 4::DOUBLE + 1) AS w FROM r WHERE y IS NOT NULL GROUP BY token),
    b AS (SELECT -sum(0.5::DOUBLE - y) / (sum(len(t) + 1) / 4::DOUBLE) AS b FROM d WHERE y IS NOT NULL),
    s AS (SELECT doc_id, sum(n * coalesce(w, 0)) AS z FROM r LEFT JOIN g USING (token) GROUP BY doc_id)
    SELECT doc_id, (SELECT count(DISTINCT x) FROM unnest(t) q(x)) AS n_words, round(coalesce(z, 0) + b, 6) AS odds FROM d LEFT JOIN s USING (doc_id), b""")
def text_odds_one_step(spark, sf):
    """The odds of a text's quality after one step of the learner of words, which SQL can say too."""
    return _text_explained(spark, sf, 1).select("doc_id", F.size("parts").cast("long").alias("n_words"), F.round("odds", 6).alias("odds"))


@query()
def text_explain(spark, sf):
    """The three words of a text that add most to the odds of its quality, what they add, and the odds."""
    top = F.transform(C.top_of_row(F.col("parts"), 3, "max"), lambda x: F.struct(x["feature"].alias("word"), F.round(x["phi"], 6).alias("phi")))
    return _text_explained(spark, sf, 6).select("doc_id", top.alias("top"), F.round("odds", 6).alias("odds"))
