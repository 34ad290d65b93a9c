"""Queries on columns, labels, splits, trials and arrays."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import arrays as A
from sparkloom.operators import bins as B
from sparkloom.operators import profile as P
from sparkloom.operators import ranking as R
from sparkloom.operators import scoring as S
from sparkloom.operators import selection as C
from sparkloom.operators.ranking import sent
from sparkloom.plans.base import query, table

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def r6(c):
    return F.round(c, 6)


def _joined(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "lang", "n_chars", "quality", "toxic")


_RATIO = "SELECT feature, round(ratio, 6) AS ratio FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS ratio FROM documents LEFT JOIN labels USING (doc_id)" for c in ("lang", "n_chars", "quality", "toxic")
) + ")"
_STD = "SELECT feature, round(std, 6) AS std FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, stddev_samp({c}) AS std FROM lineitem" for c in NUM) + ")"


def _ratio(spark, sf):
    return P.missing_ratio(_joined(spark, sf), ["lang", "n_chars", "quality", "toxic"]).withColumn("ratio", r6("ratio"))


def _std(spark, sf):
    return P.std_score(table(spark, sf, "lineitem"), NUM).withColumn("std", r6("std"))


@query(_RATIO)
def null_ratio_after_left_join(spark, sf):
    return _ratio(spark, sf)


@query("SELECT feature, round(ratio, 6) AS ratio FROM (SELECT 'l_discount' AS feature, avg((l_discount = 0)::INT) AS ratio FROM lineitem UNION ALL SELECT 'l_tax', avg((l_tax = 0)::INT) FROM lineitem)")
def sentinel_ratio(spark, sf):
    return P.missing_ratio(table(spark, sf, "lineitem"), ["l_discount", "l_tax"], 0.0).withColumn("ratio", r6("ratio"))


@query(f"SELECT feature FROM ({_RATIO}) WHERE ratio <= 0.5")
def null_filter_keep(spark, sf):
    return _ratio(spark, sf).where("ratio <= 0.5").select("feature")


@query(f"SELECT feature FROM ({_RATIO}) ORDER BY 1 - ratio DESC, feature LIMIT 3")
def null_filter_top_n(spark, sf):
    return P.top(_ratio(spark, sf).withColumn("full", 1 - F.col("ratio")), "full", 3).select("feature")


@query(_STD)
def std_score(spark, sf):
    return _std(spark, sf)


@query(f"SELECT feature FROM ({_STD}) WHERE std > 1")
def std_filter_keep(spark, sf):
    return P.above(_std(spark, sf), "std", 1.0).select("feature")


@query(f"SELECT feature FROM ({_STD}) ORDER BY std DESC, feature LIMIT 2")
def std_filter_top_n(spark, sf):
    return P.top(_std(spark, sf), "std", 2).select("feature")


@query("SELECT feature, n_rows, n_distinct, n_missing FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n_rows, count(DISTINCT {c}) AS n_distinct, count(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")) + ")")
def data_profile(spark, sf):
    return P.profile(table(spark, sf, "orders")).drop("kind")


@query("SELECT DISTINCT o_orderstatus AS label FROM orders")
def distinct_labels(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderstatus").alias("label")).distinct()


@query("SELECT count(DISTINCT quality) = 2 AS is_binary FROM labels")
def binary_label_gate(spark, sf):
    return table(spark, sf, "labels").agg((F.countDistinct("quality") == 2).alias("is_binary"))


_CELLS = """WITH d AS (SELECT l_linenumber AS v, l_returnflag AS y FROM lineitem), c AS (SELECT v, y, count(*)::DOUBLE AS n FROM d GROUP BY v, y),
t AS (SELECT n, sum(n) OVER (PARTITION BY v) AS nv, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS na FROM c) """


@query(_CELLS + "SELECT round(sum(n / na * log2(n * na / (nv * ny))), 6) AS info_gain FROM t")
def info_gain(spark, sf):
    return S.information_gain(table(spark, sf, "lineitem"), "l_linenumber", "l_returnflag").select(r6("info_gain").alias("info_gain"))


@query(_CELLS + "SELECT round(sum(n * n / (nv * na)) - sum(ny / na * n / na), 6) AS gini_gain FROM t")
def gini_gain(spark, sf):
    return S.gini_gain(table(spark, sf, "lineitem"), "l_linenumber", "l_returnflag").select(r6("gini_gain").alias("gini_gain"))


@query(_CELLS + "SELECT round(sum(n * n * na / (nv * ny)) - max(na), 4) AS chi2 FROM t")
def chi2_score(spark, sf):
    return S.chi_square(table(spark, sf, "lineitem"), "l_linenumber", "l_returnflag").select(F.round("chi2", 4).alias("chi2"))


@query("""WITH g AS (SELECT event_type, count(value) AS n, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY 1), t AS (SELECT sum(n) AS nn, count(*) AS k, sum(n * m) / sum(n) AS mean FROM g)
SELECT round((sum(n * (m - mean) ** 2) / (max(k) - 1)) / (sum(n * v) / (max(nn) - max(k))), 6) AS f FROM g, t""")
def anova_f_class(spark, sf):
    return S.anova_f(table(spark, sf, "events"), "value", "event_type").select(r6("f").alias("f"))


_PEARSON = " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS r, count(*) AS n FROM lineitem" for c in ("l_discount", "l_quantity", "l_tax"))


@query(f"SELECT feature, round(r, 6) AS r FROM ({_PEARSON})")
def pearson_rank(spark, sf):
    return S.pearson(table(spark, sf, "lineitem"), ["l_discount", "l_quantity", "l_tax"], "l_extendedprice").withColumn("r", r6("r"))


@query(f"SELECT feature, round(r * r * (n - 2) / (1 - r * r), 4) AS f FROM ({_PEARSON})")
def f_regression(spark, sf):
    return S.regression_f(table(spark, sf, "lineitem"), ["l_discount", "l_quantity", "l_tax"], "l_extendedprice").withColumn("f", F.round("f", 4))


@query("SELECT o_orderkey, o_custkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_samp(o_totalprice) FROM orders), 6) AS z, round((o_totalprice - (SELECT min(o_totalprice) FROM orders)) / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders), 6) AS m, round(ln(1 + o_totalprice), 6) AS l, round(o_totalprice * o_totalprice, 2) AS sq FROM orders")
def standardize_minmax_log_poly(spark, sf):
    o = table(spark, sf, "orders")
    x = F.col("o_totalprice")
    s = o.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    return o.crossJoin(F.broadcast(s)).select("o_orderkey", "o_custkey", r6((x - F.col("mean")) / F.col("sd")).alias("z"), r6((x - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("m"), r6(F.log1p(x)).alias("l"), F.round(x * x, 2).alias("sq"))


@query("WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.75) AS b FROM customer) SELECT round(a - 1.5 * (b - a), 6) AS low, round(b + 1.5 * (b - a), 6) AS high, count(*) FILTER (WHERE c_acctbal < a - 1.5 * (b - a) OR c_acctbal > b + 1.5 * (b - a)) AS n_out FROM customer, q GROUP BY a, b")
def iqr_outliers(spark, sf):
    c = table(spark, sf, "customer")
    q = B.quantiles(c, "c_acctbal", [0.25, 0.75]).toDF("a", "b")
    low, high = F.col("a") - 1.5 * (F.col("b") - F.col("a")), F.col("b") + 1.5 * (F.col("b") - F.col("a"))
    return c.crossJoin(F.broadcast(q)).groupBy(r6(low).alias("low"), r6(high).alias("high")).agg(F.count_if((F.col("c_acctbal") < low) | (F.col("c_acctbal") > high)).alias("n_out"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'error') AS n_error, count(*) FILTER (WHERE event_type = 'view') AS n_view FROM events GROUP BY user_id")
def one_hot_event_type(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in ("click", "error", "view")])


@query("SELECT o_orderpriority AS value, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS idx FROM orders GROUP BY 1")
def index_encode_priority(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("value")).count()
    return n.select("value", (F.row_number().over(Window.orderBy(F.desc("count"), "value")) - 1).cast("long").alias("idx"))


@query("SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS med, min(value) AS lo, max(value) AS hi, round(stddev_samp(value), 6) AS sd, round(kurtosis_pop(value), 4) AS kurt FROM events GROUP BY user_id")
def user_event_stats(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(v)).alias("mean"), r6(F.percentile(v, 0.5)).alias("med"), F.min(v).alias("lo"), F.max(v).alias("hi"), r6(F.stddev_samp(v)).alias("sd"), F.round(F.kurtosis(v), 4).alias("kurt"))


@query("SELECT o_custkey, count(*) FILTER (WHERE o_totalprice > 200000) AS n_over, round(count(*) FILTER (WHERE o_totalprice > 200000) / count(*), 6) AS ratio FROM orders GROUP BY o_custkey")
def orders_over_threshold(spark, sf):
    over = F.count_if(F.col("o_totalprice") > 200000)
    return table(spark, sf, "orders").groupBy("o_custkey").agg(over.alias("n_over"), r6(over / F.count(F.lit(1))).alias("ratio"))


_H = "md5(concat(event_id::VARCHAR, '-42'))"


@query(f"SELECT event_id, row_number() OVER (ORDER BY {_H}) - 1 AS rank, (row_number() OVER (ORDER BY {_H}) - 1) % 5 AS fold FROM events")
def kfold_plain(spark, sf):
    e = R.hash_rank(table(spark, sf, "events").select("event_id"), F.col("event_id"))
    return e.withColumn("fold", F.col("rank") % 5)


@query(f"SELECT event_id, event_type, (row_number() OVER (PARTITION BY event_type ORDER BY {_H}) - 1) % 5 AS fold FROM events")
def kfold_stratified(spark, sf):
    e = R.hash_rank(table(spark, sf, "events").select("event_id", "event_type"), F.col("event_id"), by=["event_type"])
    return e.select("event_id", "event_type", (F.col("rank") % 5).alias("fold"))


@query(f"WITH r AS (SELECT event_id, row_number() OVER (ORDER BY {_H}) - 1 AS k, count(*) OVER () AS n FROM events) SELECT event_id, CASE WHEN k < floor(n * 0.7) THEN 'train' WHEN k < floor(n * 0.9) THEN 'valid' ELSE 'test' END AS part FROM r")
def split_plain(spark, sf):
    e = R.hash_rank(table(spark, sf, "events").select("event_id"), F.col("event_id"))
    n = e.count()
    return e.select("event_id", F.when(F.col("rank") < n * 7 // 10, "train").when(F.col("rank") < n * 9 // 10, "valid").otherwise("test").alias("part"))


@query(f"WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_H}) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_id, event_type FROM r WHERE k < n // 4")
def downsample_by_label(spark, sf):
    e = R.hash_rank(table(spark, sf, "events").select("event_id", "event_type"), F.col("event_id"), by=["event_type"])
    n = e.groupBy("event_type").count()
    return e.join(sent(n), "event_type").where(F.col("rank") < F.floor(F.col("count") / 4)).select("event_id", "event_type")


@query(f"SELECT event_id, (row_number() OVER (ORDER BY {_H}) - 1) // 64 AS batch_id FROM events")
def batch_assign(spark, sf):
    from sparkloom.operators.sequences import batches

    return batches(R.hash_rank(table(spark, sf, "events").select("event_id"), F.col("event_id")), "rank", 64).drop("rank")


@query(f"WITH r AS (SELECT event_id, row_number() OVER (ORDER BY {_H}) - 1 AS k, count(*) OVER () AS n FROM events) SELECT event_id, k // 64 AS batch_id FROM r WHERE k // 64 < n // 64")
def batch_drop_last(spark, sf):
    from sparkloom.operators.sequences import batches

    return batches(R.hash_rank(table(spark, sf, "events").select("event_id"), F.col("event_id")), "rank", 64, drop_last=True).drop("rank")


@query("SELECT a.v AS depth, b.v AS rate, (row_number() OVER (ORDER BY a.v, b.v) - 1)::BIGINT AS candidate FROM (VALUES (2), (4), (6)) a(v), (VALUES (0.1::DOUBLE), (0.5::DOUBLE)) b(v)")
def param_grid_expand(spark, sf):
    a, b = spark.createDataFrame([(2,), (4,), (6,)], "depth int"), spark.createDataFrame([(0.1,), (0.5,)], "rate double")
    return a.crossJoin(b).withColumn("candidate", (F.row_number().over(Window.orderBy("depth", "rate")) - 1).cast("long"))


_YP = "WITH d AS (SELECT l_extendedprice / l_quantity > 1500 AS y, l_extendedprice > 40000 AS p FROM lineitem), c AS (SELECT count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE NOT y AND p) AS fp, count(*) FILTER (WHERE y AND NOT p) AS fn, count(*) FILTER (WHERE NOT y AND NOT p) AS tn FROM d) "


def _cells(spark, sf):
    return S.confusion(table(spark, sf, "lineitem"), F.col("l_extendedprice") / F.col("l_quantity") > 1500, F.col("l_extendedprice") > 40000)


@query(_YP + "SELECT * FROM c")
def confusion_matrix(spark, sf):
    return _cells(spark, sf)


@query(_YP + "SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(5 * tp / (5 * tp + 4 * fn + fp), 6) AS f_beta FROM c")
def prf_beta(spark, sf):
    out = S.prf(_cells(spark, sf), 2.0)
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query("WITH d AS (SELECT (l_extendedprice / l_quantity > 1500)::INT AS y, l_extendedprice AS s FROM lineitem), g AS (SELECT s, sum(y) AS p, sum(1 - y) AS q FROM d GROUP BY s), w AS (SELECT p, q, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g) SELECT round(sum(p * (2 * b + q)) / (2 * sum(p) * sum(q)), 9) AS auc FROM w")
def auc_rank(spark, sf):
    d = table(spark, sf, "lineitem").select((F.col("l_extendedprice") / F.col("l_quantity") > 1500).cast("int").alias("y"), F.col("l_extendedprice").alias("s"))
    return S.auc(d, "s", "y").select(F.round("auc", 9).alias("auc"))


@query("WITH p AS (SELECT l_extendedprice AS y, 1500 * l_quantity AS f FROM lineitem), m AS (SELECT avg(y) AS mean FROM p) SELECT round(avg((y - f) ** 2), 2) AS mse, round(sqrt(avg((y - f) ** 2)), 4) AS rmse, round(avg(abs(y - f)), 4) AS mae, round(1 - sum((y - f) ** 2) / sum((y - mean) ** 2), 6) AS r2 FROM p, m")
def regression_metrics(spark, sf):
    y, f = F.col("l_extendedprice"), 1500 * F.col("l_quantity")
    e = (y - f) * (y - f)
    return table(spark, sf, "lineitem").agg(F.round(F.avg(e), 2).alias("mse"), F.round(F.sqrt(F.avg(e)), 4).alias("rmse"), F.round(F.avg(F.abs(y - f)), 4).alias("mae"), r6(1 - F.avg(e) / F.var_pop(y)).alias("r2"))


_MULTI = "WITH d AS (SELECT l_returnflag AS y, CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS p FROM lineitem), k AS (SELECT DISTINCT y AS c FROM d), s AS (SELECT c, count(*) FILTER (WHERE y = c AND p = c) AS tp, count(*) FILTER (WHERE y = c) AS ny, count(*) FILTER (WHERE p = c) AS np FROM d, k GROUP BY c) "


@query(_MULTI + "SELECT round(avg(2 * tp / (ny + np)), 6) AS macro, round(sum(ny * 2 * tp / (ny + np)) / sum(ny), 6) AS weighted, round(2 * sum(tp) / (sum(ny) + sum(np)), 6) AS micro FROM s")
def multi_avg_f1(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("y"), F.when(F.col("l_quantity") < 17, "A").when(F.col("l_quantity") < 34, "N").otherwise("R").alias("p"))
    sides = F.explode(F.array(F.struct(F.col("y").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("q"), (F.col("y") == F.col("p")).cast("int").alias("h")), F.struct(F.col("p").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("q"), F.lit(0).alias("h"))))
    s = d.select(sides.alias("x")).select("x.*").groupBy("c").agg(F.sum("h").alias("tp"), F.sum("t").alias("ny"), F.sum("q").alias("np"))
    f = 2 * F.col("tp") / (F.col("ny") + F.col("np"))
    return s.agg(r6(F.avg(f)).alias("macro"), r6(F.sum(F.col("ny") * f) / F.sum("ny")).alias("weighted"), r6(2 * F.sum("tp") / (F.sum("ny") + F.sum("np"))).alias("micro"))


_RANKED = "WITH r AS (SELECT user_id, (event_type = 'click')::INT AS rel, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) "


def _ranked(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, sf, "events").select("user_id", (F.col("event_type") == "click").cast("int").alias("rel"), F.row_number().over(w).alias("k"))


@query(_RANKED + ", h AS (SELECT *, sum(rel) OVER (PARTITION BY user_id ORDER BY k) AS hits FROM r WHERE k <= 10), u AS (SELECT user_id, coalesce(sum(rel * hits / k) / nullif(sum(rel), 0), 0) AS ap FROM h GROUP BY user_id) SELECT round(avg(ap), 6) AS map FROM u")
def map_at_k(spark, sf):
    h = _ranked(spark, sf).where("k <= 10").withColumn("hits", F.sum("rel").over(Window.partitionBy("user_id").orderBy("k")))
    u = h.groupBy("user_id").agg(F.coalesce(F.try_divide(F.sum(F.col("rel") * F.col("hits") / F.col("k")), F.sum("rel")), F.lit(0.0)).alias("ap"))
    return u.agg(r6(F.avg("ap")).alias("map"))


@query(_RANKED + ", g AS (SELECT user_id, sum(CASE WHEN k <= 10 THEN rel / log2(k + 1) ELSE 0 END) AS dcg, least(sum(rel), 10) AS m FROM r GROUP BY user_id), i AS (SELECT m, sum(1 / log2(j + 1)) AS ideal FROM (SELECT DISTINCT m FROM g WHERE m > 0), range(1, 11) t(j) WHERE j <= m GROUP BY m) SELECT round(avg(coalesce(dcg / ideal, 0)), 6) AS ndcg FROM g LEFT JOIN i USING (m)")
def ndcg_at_k(spark, sf):
    g = _ranked(spark, sf).groupBy("user_id").agg(F.sum(F.when(F.col("k") <= 10, F.col("rel") / F.log2(F.col("k") + 1)).otherwise(0.0)).alias("dcg"), F.least(F.sum("rel"), F.lit(10)).cast("int").alias("m"))
    ideal = F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(10)), lambda j: j <= F.col("m")), F.lit(0.0), lambda s, j: s + 1 / F.log2(j + 1))
    return g.agg(r6(F.avg(F.coalesce(F.try_divide("dcg", ideal), F.lit(0.0)))).alias("ndcg"))


@query("WITH d AS (SELECT doc_id, quality AS y, 1 / (1 + exp(-(n_chars / 1000.0 - 2))) AS p FROM documents LEFT JOIN labels USING (doc_id)) SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS loss, count(y) AS n FROM d WHERE y IS NOT NULL AND p < 1")
def masked_cross_entropy(spark, sf):
    y, p = F.col("quality"), 1 / (1 + F.exp(-(F.col("n_chars") / 1000.0 - 2)))
    return _joined(spark, sf).where(y.isNotNull() & (p < 1)).agg(r6(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p)))).alias("loss"), F.count(y).alias("n"))


def _trials(spark, sf):
    """Averages of decimals: sums of doubles depend on the order of rows, and with them the side to which a tie is rounded."""
    e = table(spark, sf, "events")
    mean = F.avg(F.col("value").cast("decimal(28,8)")).cast("double")
    return e.groupBy((F.col("user_id") + 1).alias("trial")).agg(F.round(mean, 1).alias("effect"), F.count(F.lit(1)).alias("seconds"))


@query("WITH t AS (SELECT user_id + 1 AS trial, round(avg(value), 1) AS effect, count(*) AS seconds FROM events GROUP BY 1) SELECT trial, effect, seconds FROM t ORDER BY effect DESC, seconds, trial LIMIT 1")
def best_trial_strict(spark, sf):
    return C.best_trial(_trials(spark, sf))


_TRIALS = "WITH RECURSIVE t AS (SELECT user_id + 1 AS trial, round(avg(value), 1) AS effect, count(*) AS seconds FROM events GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY trial) AS k FROM t), "


@query("SELECT user_id + 1 AS trial, round(avg(value), 1) AS effect, count(*) AS seconds FROM events GROUP BY 1")
def trial_scores(spark, sf):
    return _trials(spark, sf)


@query(_TRIALS + """b AS (SELECT k, trial, effect, seconds FROM o WHERE k = 1 UNION ALL
SELECT o.k, CASE WHEN w THEN o.trial ELSE b.trial END, CASE WHEN w THEN o.effect ELSE b.effect END, CASE WHEN w THEN o.seconds ELSE b.seconds END
FROM b JOIN o ON o.k = b.k + 1, LATERAL (SELECT o.effect > b.effect + 5 OR (abs(o.effect - b.effect) <= 5 AND o.seconds < b.seconds) AS w))
SELECT trial, effect, seconds FROM b ORDER BY k DESC LIMIT 1""")
def best_trial_with_err(spark, sf):
    return C.best_trial(_trials(spark, sf), 5.0)


@query("WITH t AS (SELECT user_id + 1 AS trial, round(avg(value), 1) AS effect FROM events GROUP BY 1), s AS (SELECT trial, 1 / (1 + exp(-effect / 100)) AS s FROM t) SELECT trial, round(s / sum(s) OVER (), 6) AS weight FROM s")
def importance_probability(spark, sf):
    return C.sigmoid_weights(_trials(spark, sf).select("trial", (F.col("effect") / 100).alias("e")), "e").select("trial", r6("weight").alias("weight"))


@query(_TRIALS + """c AS (SELECT k, trial AS step, effect AS best, 0 AS bad FROM o WHERE k = 1 UNION ALL
SELECT o.k, o.trial, greatest(o.effect, c.best), CASE WHEN o.effect > c.best THEN 0 ELSE c.bad + 1 END FROM c JOIN o ON o.k = c.k + 1 WHERE c.bad < 3)
SELECT max(step) FILTER (WHERE bad >= 3) AS stop_at, max(best) AS best FROM c""")
def early_stop_point(spark, sf):
    return C.early_stop(_trials(spark, sf).select(F.col("trial").alias("step"), F.col("effect").alias("metric")), 3)


_PHI = "WITH m AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem), p AS (SELECT rid, l_orderkey, l_partkey, l_suppkey, l_linenumber, unnest([{'feature': 'l_quantity', 'phi': round(1500 * (l_quantity - q), 6), 'value': l_quantity}, {'feature': 'l_discount', 'phi': round(90000 * (l_discount - d), 6), 'value': l_discount}, {'feature': 'l_tax', 'phi': round(-90000 * (l_tax - t), 6), 'value': l_tax}], recursive := true) FROM (SELECT *, row_number() OVER () AS rid FROM lineitem), m), "


def _parts(spark, sf):
    li = table(spark, sf, "lineitem")
    m = li.agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"))
    parts = [("l_quantity", 1500.0, "q"), ("l_discount", 90000.0, "d"), ("l_tax", -90000.0, "t")]
    phi = F.array(*[F.struct(F.lit(f).alias("feature"), r6(w * (F.col(f) - F.col(c))).alias("phi"), F.col(f).alias("value")) for f, w, c in parts])
    key = F.concat_ws("/", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row")
    return li.crossJoin(F.broadcast(m)).select(key, phi.alias("parts"))


def _phi(spark, sf):
    return _parts(spark, sf).select("row", F.explode("parts").alias("x")).select("row", "x.*")


def _top_sql(order):
    return _PHI + f"r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY {order}, feature) AS rank FROM p) SELECT concat_ws('/', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row, feature, rank::INT AS rank, round(phi, 4) AS phi FROM r WHERE rank <= 2"


def _top(spark, sf, strategy):
    top = _parts(spark, sf).select("row", F.posexplode(C.top_of_row(F.col("parts"), 2, strategy)).alias("rank", "x"))
    return top.select("row", "x.feature", (F.col("rank") + 1).alias("rank"), F.round("x.phi", 4).alias("phi"))


@query(_top_sql("phi DESC"))
def top_max(spark, sf):
    return _top(spark, sf, "max")


@query(_top_sql("phi"))
def top_min(spark, sf):
    return _top(spark, sf, "min")


@query(_top_sql("abs(phi) DESC"))
def top_abs(spark, sf):
    return _top(spark, sf, "abs")


_GROUPS = {"amount": ["l_quantity"], "terms": ["l_discount", "l_tax"]}
_GROUPED = _PHI + "g AS (SELECT concat_ws('/', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row, feature, phi, CASE WHEN feature = 'l_quantity' THEN 'amount' ELSE 'terms' END AS grp FROM p), s AS (SELECT *, sum(phi) OVER (PARTITION BY row, grp) AS gphi FROM g), r AS (SELECT *, dense_rank() OVER (PARTITION BY row ORDER BY gphi DESC, grp) AS gr, row_number() OVER (PARTITION BY row, grp ORDER BY phi DESC, feature) AS ir FROM s) "


@query(_GROUPED + "SELECT row, grp, round(gphi, 4) AS group_phi, gr::INT AS rank FROM r WHERE ir = 1")
def group_sorted(spark, sf):
    g = C.grouped(_phi(spark, sf), "row", _GROUPS).select("row", F.col("group").alias("grp"), "group_phi")
    g = g.groupBy("row", "grp").agg(F.first("group_phi").alias("group_phi"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("group_phi"), "grp"))).withColumn("group_phi", F.round("group_phi", 4))


@query(_GROUPED + "SELECT row, feature, grp, round(phi, 4) AS phi FROM r WHERE ir <= CASE WHEN gr = 1 THEN 2 ELSE 1 END")
def group_quota(spark, sf):
    return C.top_by_group(_phi(spark, sf), "row", 3, _GROUPS).select("row", "feature", F.col("group").alias("grp"), F.round("phi", 4).alias("phi"))


_BY_ROW = _GROUPED.replace("PARTITION BY row, grp", "PARTITION BY rid, grp").replace("PARTITION BY row ORDER", "PARTITION BY rid ORDER").replace("AS row, feature, phi, CASE", "AS row, rid, feature, phi, CASE")


def _sorted_groups():
    return C.groups_of_row(F.col("parts"), _GROUPS, ["l_quantity", "l_discount", "l_tax"])


@query(_BY_ROW + "SELECT row, grp, round(gphi, 4) AS group_phi, gr::INT AS rank FROM r WHERE ir = 1")
def row_groups(spark, sf):
    """Each row's groups of features by summed contribution, sorted inside the row."""
    g = _parts(spark, sf).select("row", F.posexplode(_sorted_groups()).alias("i", "g"))
    return g.select("row", F.col("g.group").alias("grp"), F.round("g.group_phi", 4).alias("group_phi"), (F.col("i") + 1).alias("rank"))


@query(_BY_ROW + "SELECT row, feature, grp, round(phi, 4) AS phi FROM r WHERE ir <= CASE WHEN gr = 1 THEN 2 ELSE 1 END")
def row_group_quota(spark, sf):
    """Three features of each row, dealt to its groups, inside the row."""
    x = _parts(spark, sf).select("row", F.explode(C.quota_of_row(_sorted_groups(), 3)).alias("x"))
    return x.select("row", "x.part.feature", F.col("x.group").alias("grp"), F.round("x.part.phi", 4).alias("phi"))


@query(_PHI + "r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY abs(phi) DESC, feature) AS k FROM p) SELECT concat_ws('/', any_value(l_orderkey), any_value(l_partkey), any_value(l_suppkey), any_value(l_linenumber)) AS row, string_agg(feature || ' value is ' || value::VARCHAR, ',' ORDER BY k) AS reason FROM r WHERE k <= 2 GROUP BY rid")
def reason_string(spark, sf):
    phrase = lambda x: F.concat(x["feature"], F.lit(" value is "), x["value"].cast("string"))
    return _parts(spark, sf).select("row", F.array_join(F.transform(C.top_of_row(F.col("parts"), 2, "abs"), phrase), ",").alias("reason"))


_L = "list_transform(embedding, lambda x: x::DOUBLE)"


@query(f"WITH v AS (SELECT vec_id, {_L} AS v FROM embeddings) SELECT vec_id, round(list_sum(v), 6) AS total, round(list_avg(v), 6) AS mean, round(list_var_pop(v), 6) AS var, round(list_max(v) - list_min(v), 6) AS ptp, list_position(v, list_max(v)) - 1 AS arg_max, list_position(v, list_min(v)) - 1 AS arg_min, len(list_filter(v, lambda x: x > 0)) AS n_pos, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM v")
def array_statistics(spark, sf):
    v = F.col("v")
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).select(
        "vec_id", r6(A.total(v)).alias("total"), r6(A.mean(v)).alias("mean"), r6(A.variance(v)).alias("var"), r6(F.array_max(v) - F.array_min(v)).alias("ptp"),
        (F.array_position(v, F.array_max(v)) - 1).alias("arg_max"), (F.array_position(v, F.array_min(v)) - 1).alias("arg_min"),
        F.size(F.filter(v, lambda x: x > 0)).cast("long").alias("n_pos"), r6(F.sqrt(A.dot(v, v))).alias("norm"),
    )


@query(f"WITH v AS (SELECT vec_id, {_L} AS v FROM embeddings) SELECT vec_id, round(list_sum(v[1:10]), 6) AS cum10, round(v[6] - v[5], 6) AS diff5, round(v[62], 6) AS roll0, round(list_sum(list_transform(v, lambda x: least(greatest(x, -0.1), 0.1))), 6) AS clipped, list_grade_up(v)[1] - 1 AS first_sorted, round(list_sort(v)[32], 6) AS mid FROM v")
def array_transforms(spark, sf):
    v = F.col("v")
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).select(
        "vec_id", r6(F.element_at(A.cumsum(v), 10)).alias("cum10"), r6(F.element_at(A.diff(v), 5)).alias("diff5"), r6(F.element_at(A.roll(v, 3), 1)).alias("roll0"),
        r6(A.total(A.clip(v, -0.1, 0.1))).alias("clipped"), F.element_at(A.argsort(v), 1).cast("long").alias("first_sorted"), r6(F.element_at(F.array_sort(v), 32)).alias("mid"),
    )


@query("SELECT bin::INT AS bin, count(*) AS n FROM (SELECT least(floor((l_quantity - 1) * 7 / 49), 6) AS bin FROM lineitem WHERE l_quantity BETWEEN 1 AND 50) GROUP BY 1")
def histogram_bins(spark, sf):
    return table(spark, sf, "lineitem").select(A.histogram_bin(F.col("l_quantity"), 1, 50, 7).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, (value >= 1)::BIGINT + (value >= 10)::BIGINT + (value >= 100)::BIGINT AS digit, (value > 1)::BIGINT + (value > 10)::BIGINT + (value > 100)::BIGINT AS place FROM events")
def digitize_searchsorted(spark, sf):
    b = [1.0, 10.0, 100.0]
    return table(spark, sf, "events").select("event_id", A.searchsorted(b, F.col("value"), True).cast("long").alias("digit"), A.searchsorted(b, F.col("value")).cast("long").alias("place"))


@query("SELECT c_custkey, round(c_acctbal - 7 * floor(c_acctbal / 7), 6) AS mod, round(sin(c_acctbal), 6) AS s, round(exp(c_acctbal / 10000), 6) AS e, round(log2(abs(c_acctbal) + 1), 6) AS l, floor(c_acctbal)::BIGINT AS fl, ceil(c_acctbal)::BIGINT AS ce, sign(c_acctbal)::INT AS sg, round(degrees(c_acctbal / 1000), 6) AS deg, round(tanh(c_acctbal / 5000), 6) AS th FROM customer")
def elementwise_math(spark, sf):
    x = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", r6(A.modulo(x, F.lit(7.0))).alias("mod"), r6(F.sin(x)).alias("s"), r6(F.exp(x / 10000)).alias("e"), r6(F.log2(F.abs(x) + 1)).alias("l"), F.floor(x).alias("fl"), F.ceil(x).alias("ce"), F.signum(x).cast("int").alias("sg"), r6(F.degrees(x / 1000)).alias("deg"), r6(F.tanh(x / 5000)).alias("th"))


@query("SELECT round(covar_samp(l_quantity, l_extendedprice), 2) AS cov, round(corr(l_quantity, l_extendedprice), 6) AS cor, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS wavg FROM lineitem")
def column_statistics(spark, sf):
    q, x = F.col("l_quantity"), F.col("l_extendedprice")
    li = table(spark, sf, "lineitem")
    one = li.agg(F.round(F.covar_samp(q, x), 2).alias("cov"), r6(F.corr(q, x)).alias("cor"), F.round(F.sum(q * x) / F.sum(q), 4).alias("wavg"))
    return one.crossJoin(B.quantiles(li, "l_extendedprice", [0.75]).select(F.round("q0", 4).alias("p75"))).select("cov", "cor", "p75", "wavg")


@query("WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier) SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'diff', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'xor', k FROM ((SELECT k FROM a EXCEPT SELECT k FROM b) UNION (SELECT k FROM b EXCEPT SELECT k FROM a))")
def set_operations(spark, sf):
    a = table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).distinct()
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "diff": a.subtract(b), "xor": a.subtract(b).union(b.subtract(a))}
    out = None
    for op, part in parts.items():
        part = part.select(F.lit(op).alias("op"), "k")
        out = part if out is None else out.union(part)
    return out
