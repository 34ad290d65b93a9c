"""Queries on samples, splits, bins, transforms and features of keys."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import bins as B
from sparkloom.operators import ranking as R
from sparkloom.operators import sampling as S
from sparkloom.operators import scoring
from sparkloom.operators.ranking import sent
from sparkloom.plans.base import query, table
from sparkloom.plans.tabular import r6

_H = "md5(concat(event_id::VARCHAR, '-42'))"
_TYPED = f"WITH r AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY {_H}) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) "


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type", "value")


@query(_TYPED + "SELECT event_id, event_type, ((k >= floor(n * 0.7))::INT + (k >= floor(n * 0.9))::INT) AS part FROM r")
def split_stratified(spark, sf):
    return S.split(_events(spark, sf).drop("value"), "event_id", [0.7, 0.2, 0.1], by=["event_type"])


@query(f"SELECT event_id, row_number() OVER (ORDER BY {_H}) <= 500 AS held FROM events")
def holdout_size(spark, sf):
    return R.hash_rank(_events(spark, sf).select("event_id"), F.col("event_id")).select("event_id", (F.col("rank") < 500).alias("held"))


@query(_TYPED + """, u AS (SELECT event_type, max(n) AS n, 3 * max(n) // 2 AS m FROM r WHERE event_type = 'click' GROUP BY 1),
j AS (SELECT event_type, n, unnest(range(m)) AS j FROM u), d AS (SELECT event_type, ('0x' || md5(concat_ws('-', j, event_type, 42))[1:12])::BIGINT % n AS k FROM j)
SELECT event_id, r.event_type, count(*) AS copies FROM r JOIN d USING (event_type, k) GROUP BY ALL
UNION ALL SELECT event_id, event_type, 1 FROM r WHERE event_type <> 'click' AND (event_type <> 'view' OR k < n // 2)""")
def upsample_by_label(spark, sf):
    return S.sample_by_label(_events(spark, sf).drop("value"), "event_id", "event_type", {"click": 1.5, "view": 0.5})


@query("""WITH d AS (SELECT event_id, event_type, -ln((('0x' || md5(concat_ws('-', event_id, 42))[1:12])::BIGINT + 0.5::DOUBLE) / 281474976710656) / exp(value / 100) AS e FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY e, event_id) AS k FROM d) SELECT event_id, event_type FROM r WHERE k <= 50""")
def sample_weighted(spark, sf):
    return S.weighted_sample(_events(spark, sf), "event_id", "event_type", F.col("value") / 100, 50).select("event_id", "event_type")


@query(f"SELECT event_id, (row_number() OVER (ORDER BY {_H}) - 1) % 8 AS part FROM events")
def round_robin_partition(spark, sf):
    return R.hash_rank(_events(spark, sf).select("event_id"), F.col("event_id")).select("event_id", (F.col("rank") % 8).alias("part"))


@query("""WITH g AS (SELECT d.v AS depth, r.v AS rate, s.v AS leaf, md5(concat_ws('-', d.v, r.v, s.v, 42)) AS h FROM range(1, 11) d(v), (VALUES (0.1), (0.2), (0.3), (0.4), (0.5)) r(v), range(1, 3) s(v))
SELECT depth, rate::DOUBLE AS rate, leaf, row_number() OVER (ORDER BY h) - 1 AS candidate FROM g ORDER BY h LIMIT 20""")
def param_grid_random(spark, sf):
    g = spark.range(1, 11).toDF("depth").crossJoin(spark.createDataFrame([(x / 10,) for x in range(1, 6)], "rate double")).crossJoin(spark.range(1, 3).toDF("leaf"))
    h = F.md5(F.concat_ws("-", F.col("depth").cast("string"), F.col("rate").cast("string"), F.col("leaf").cast("string"), F.lit("42")))
    return g.withColumn("candidate", (F.row_number().over(Window.orderBy(h)) - 1).cast("long")).where("candidate < 20")


_BELOW = "WITH d AS (SELECT o_orderkey, o_totalprice, rank() OVER (ORDER BY o_totalprice) - 1 AS below, count(*) OVER (PARTITION BY o_totalprice) AS same, count(*) OVER () AS n FROM orders) "


@query(_BELOW + "SELECT o_orderkey, o_totalprice, (below * 10 // n)::INT AS bin FROM d")
def equal_freq_bins(spark, sf):
    return B.equal_frequency_bins(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 10)


@query(_BELOW + "SELECT o_orderkey, round((below + (same - 1) / 2) / (n - 1), 6) AS u FROM d")
def quantile_uniform(spark, sf):
    return B.quantile_uniform(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", r6("u").alias("u"))


@query("SELECT o_orderkey, round(sign(o_totalprice - 100000) * sqrt(abs(o_totalprice - 100000)), 6) AS power FROM orders")
def power_transform(spark, sf):
    x = F.col("o_totalprice") - 100000
    return table(spark, sf, "orders").select("o_orderkey", r6(F.signum(x) * F.sqrt(F.abs(x))).alias("power"))


@query("""WITH d AS (SELECT floor(l_extendedprice / 10000) AS v, l_returnflag AS y FROM lineitem), c AS (SELECT v, y, count(*)::DOUBLE AS n FROM d GROUP BY v, y),
t AS (SELECT n, sum(n) OVER (PARTITION BY v) AS nv, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS na FROM c) SELECT round(sum(n / na * ln(n * na / (nv * ny))), 6) AS mi FROM t""")
def mutual_info_binned(spark, sf):
    d = table(spark, sf, "lineitem").select(F.floor(F.col("l_extendedprice") / 10000).alias("v"), "l_returnflag")
    return scoring.information_gain(d, "v", "l_returnflag").select(r6(F.col("info_gain") * F.log(F.lit(2.0))).alias("mi"))


@query("WITH m AS (SELECT max(ts) - INTERVAL 7 DAY AS t FROM events) SELECT user_id, count(*) FILTER (WHERE ts > t) AS n_recent, round(count(*) FILTER (WHERE ts > t) / count(*), 6) AS ratio FROM events, m GROUP BY user_id")
def user_recent_ratio(spark, sf):
    e = table(spark, sf, "events")
    recent = F.count_if(F.col("ts") > F.col("t"))
    last = e.agg((F.max("ts") - F.expr("INTERVAL 7 DAY")).alias("t"))
    return e.crossJoin(F.broadcast(last)).groupBy("user_id").agg(recent.alias("n_recent"), r6(recent / F.count(F.lit(1))).alias("ratio"))


@query("""WITH o AS (SELECT o_custkey AS k, count(*) AS n_orders, count(DISTINCT date_trunc('month', o_orderdate)) AS n_months, round(avg(o_totalprice), 6) AS mean_price FROM orders GROUP BY 1),
c AS (SELECT c_custkey, c_nationkey, coalesce(n_orders, 0) AS n_orders, coalesce(n_months, 0) AS n_months, mean_price FROM customer LEFT JOIN o ON k = c_custkey)
SELECT c_custkey, n_orders, n_months, mean_price, round(n_orders - avg(n_orders) OVER (PARTITION BY c_nationkey), 6) AS over_nation FROM c""")
def customer_space_time_features(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.countDistinct(F.date_trunc("month", "o_orderdate")).alias("n_months"), r6(F.avg("o_totalprice")).alias("mean_price"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(o, "c_custkey", "left").na.fill(0, ["n_orders", "n_months"])
    nation = c.groupBy("c_nationkey").agg(F.avg("n_orders").alias("_m"))  # joined back, so that no window holds a nation
    return c.join(sent(nation), "c_nationkey").select("c_custkey", "n_orders", "n_months", "mean_price", r6(F.col("n_orders") - F.col("_m")).alias("over_nation"))


@query("WITH d AS (SELECT (l_extendedprice / l_quantity > 1500)::INT AS y, floor(l_extendedprice / 1000) AS s FROM lineitem), g AS (SELECT s, sum(y) AS p, sum(1 - y) AS q FROM d GROUP BY s) SELECT round(sum(a.p * b.q * CASE WHEN a.s > b.s THEN 1 WHEN a.s = b.s THEN 0.5 ELSE 0 END) / ((SELECT sum(p) FROM g) * (SELECT sum(q) FROM g)), 9) AS auc FROM g a, g b")
def auc_pairs(spark, sf):
    d = table(spark, sf, "lineitem").select((F.col("l_extendedprice") / F.col("l_quantity") > 1500).cast("int").alias("y"), F.floor(F.col("l_extendedprice") / 1000).alias("s"))
    return scoring.auc(d, "s", "y").select(F.round("auc", 9).alias("auc"))


@query(f"WITH r AS (SELECT (row_number() OVER (ORDER BY {_H}) - 1) // 64 AS b, ((event_type = 'click') = (value > 50))::INT AS hit FROM events) SELECT round(avg(m), 6) AS batch_mean, round(sum(m * n) / sum(n), 6) AS whole FROM (SELECT b, avg(hit) AS m, count(*) AS n FROM r GROUP BY b)")
def batch_mean_metric(spark, sf):
    e = R.hash_rank(_events(spark, sf), F.col("event_id"))
    hit = ((F.col("event_type") == "click") == (F.col("value") > 50)).cast("int")
    b = e.groupBy(F.floor(F.col("rank") / 64).alias("b")).agg(F.avg(hit).alias("m"), F.count(F.lit(1)).alias("n"))
    return b.agg(r6(F.avg("m")).alias("batch_mean"), r6(F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("whole"))
