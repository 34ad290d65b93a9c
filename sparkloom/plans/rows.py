"""Queries on rows, scores, draws and streams of ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import bins as B
from sparkloom.operators import ranking as R
from sparkloom.operators import sampling as S
from sparkloom.operators import sequences as Q
from sparkloom.plans.base import query, table
from sparkloom.plans.tabular import r6

_V = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"


def _v(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


@query(f"WITH d AS ({_V}), n AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN abs(x) > 0.2 THEN 'NaN'::DOUBLE ELSE x END) AS v FROM d), k AS (SELECT vec_id, v, list_filter(v, lambda x: NOT isnan(x)) AS f FROM n) SELECT vec_id, round(list_max(f), 6) AS hi, list_position(v, list_max(f)) - 1 AS arg_hi, round(list_min(f), 6) AS lo, list_position(v, list_min(f)) - 1 AS arg_lo FROM k")
def array_nan_extremes(spark, sf):
    """Largest and least elements and their places, NaNs left out."""
    n = _v(spark, sf).withColumn("v", F.transform("v", lambda x: F.when(F.abs(x) > 0.2, float("nan")).otherwise(x))).withColumn("f", F.filter("v", lambda x: ~F.isnan(x)))
    at = lambda m: F.array_position("v", m) - 1
    return n.select("vec_id", r6(F.array_max("f")).alias("hi"), at(F.array_max("f")).alias("arg_hi"), r6(F.array_min("f")).alias("lo"), at(F.array_min("f")).alias("arg_lo"))


@query("WITH c AS (SELECT count(*) FILTER (WHERE event_type = 'click' AND value > 50) AS c, count(*) FILTER (WHERE event_type = 'click') AS t, count(*) FILTER (WHERE value > 50) AS p FROM events), r AS (SELECT c / t AS recall, c / p AS precision FROM c) SELECT round(recall, 6) AS recall, round(precision, 6) AS precision, round(2 * precision * recall / (precision + recall + 0.0001), 6) AS f1 FROM r")
def f1_with_epsilon(spark, sf):
    """F1 with a small constant in the denominator, so that it is 0 where nothing is right."""
    e = table(spark, sf, "events")
    truth, guess = F.col("event_type") == "click", F.col("value") > 50
    c = e.agg(F.count_if(truth & guess).alias("c"), F.count_if(truth).alias("t"), F.count_if(guess).alias("p"))
    r = c.select(F.try_divide("c", "t").alias("recall"), F.try_divide("c", "p").alias("precision"))
    p, q = F.col("precision"), F.col("recall")
    return r.select(r6(q).alias("recall"), r6(p).alias("precision"), r6(2 * p * q / (p + q + 0.0001)).alias("f1"))


@query("SELECT round(quantile_cont(abs(x), 0.999), 6) AS scale FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings) WHERE NOT isnan(x)")
def contribution_scale(spark, sf):
    """The 99.9th percentile of absolute values, NaNs left out."""
    x = _v(spark, sf).select(F.explode("v").alias("x")).where(~F.isnan("x")).select(F.abs("x").alias("x"))
    return B.quantiles(x, "x", [0.999]).select(r6("q0").alias("scale"))


_DRAW = "('0x' || md5(concat_ws('-', i, b, 42))[1:12])::BIGINT"
_DRAWS = f"WITH n AS (SELECT count(*) AS n FROM orders), d AS (SELECT b, {_DRAW} % n AS k FROM n, range(0, 3) x(b), range(0, n) y(i)) "


def _draws(spark, sf):
    """Three bootstraps of places: as many draws with replacement as there are rows, each by its own number."""
    n = table(spark, sf, "orders").count()
    rows = spark.range(n).select(F.col("id").alias("i"), F.explode(F.array(*[F.lit(b).cast("long") for b in range(3)])).alias("b"))
    return rows.select("b", (S.draw_number(F.concat_ws("-", F.col("i").cast("string"), F.col("b").cast("string"), F.lit("42"))) % n).alias("k"))


@query(_DRAWS + "SELECT b, round(count(DISTINCT k) / count(*), 6) AS effective FROM d GROUP BY b")
def bootstrap_ratio(spark, sf):
    """The share of rows that a bootstrap draws at least once."""
    return _draws(spark, sf).groupBy("b", "k").agg(F.count(F.lit(1)).alias("n")).groupBy("b").agg(r6(F.count(F.lit(1)) / F.sum("n")).alias("effective"))


@query(_DRAWS + "SELECT b, k, count(*) AS copies FROM d GROUP BY b, k")
def bootstrap_lists(spark, sf):
    return _draws(spark, sf).groupBy("b", "k").agg(F.count(F.lit(1)).alias("copies"))


@query("SELECT event_id, round(1 - 1 / (1 + exp(-value / 100)), 6) AS p0, round(1 / (1 + exp(-value / 100)), 6) AS p1, (1 / (1 + exp(-value / 100)) > 0.6)::INT AS label FROM events")
def probability_pair(spark, sf):
    p = 1 / (1 + F.exp(-F.col("value") / 100))
    pair = F.array(1 - p, p)
    return table(spark, sf, "events").select("event_id", r6(pair[0]).alias("p0"), r6(pair[1]).alias("p1"), (pair[1] > 0.6).cast("int").alias("label"))


_ROWS8 = f"WITH d AS ({_V}), p AS (SELECT vec_id, i AS pos, v[i * 8 + 1:i * 8 + 8] AS s FROM d, range(0, 8) r(i)), a AS (SELECT vec_id, pos, list_position(s, list_max(s)) - 1 AS tag FROM p) "


def _argmax(spark, sf):
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("v", i * 8 + 1, 8))
    return _v(spark, sf).select("vec_id", F.transform(rows, lambda s: F.array_position(s, F.array_max(s)) - 1).alias("tags"))


@query(_ROWS8 + "SELECT vec_id, string_agg(tag, '' ORDER BY pos) AS path FROM a GROUP BY vec_id")
def argmax_decode(spark, sf):
    """The tag of highest score at each of eight positions."""
    return _argmax(spark, sf).select("vec_id", F.array_join(F.col("tags").cast("array<string>"), "").alias("path"))


@query(_ROWS8 + "SELECT vec_id, pos, tag FROM a WHERE tag NOT IN (0, 3)")
def blank_suppression(spark, sf):
    """Positions whose best tag isn't a blank one."""
    tags = _argmax(spark, sf).select("vec_id", F.posexplode("tags").alias("pos", "tag"))
    return tags.where(~F.col("tag").isin(0, 3)).select("vec_id", F.col("pos").cast("long").alias("pos"), "tag")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def first_rows(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(1000)


@query("SELECT * EXCLUDE (c_acctbal, c_mktsegment) FROM customer")
def columns_kept(spark, sf):
    """All columns but some, in their order."""
    c = table(spark, sf, "customer")
    return c.select(*[n for n in c.columns if n not in {"c_acctbal", "c_mktsegment"}])


_H = "md5(concat(event_id::VARCHAR, '-7'))"


@query(f"WITH r AS (SELECT value, event_type, row_number() OVER (ORDER BY {_H}) - 1 AS k, count(*) OVER () AS n FROM events) SELECT count(*) AS n, round(avg(((event_type = 'click') = (value > 50))::INT), 6) AS accuracy FROM r WHERE k < floor(n * 0.3)")
def metric_subsample(spark, sf):
    """A metric on an exact share of the rows, drawn by hash."""
    e = table(spark, sf, "events")
    n = int(e.count() * 0.3)
    hit = ((F.col("event_type") == "click") == (F.col("value") > 50)).cast("int")
    return R.hash_rank(e, F.col("event_id"), 7).where(F.col("rank") < n).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(hit)).alias("accuracy"))


@query("WITH d AS (SELECT event_id, (('0x' || md5(concat(event_id::VARCHAR, '-42'))[1:12])::BIGINT + 0.5::DOUBLE) / 281474976710656 AS u FROM events), c AS (SELECT least(floor(exp(u * ln(10001))) - 1, 9999)::BIGINT AS candidate FROM d) SELECT candidate, count(*) AS n, round(ln((candidate + 2) / (candidate + 1)) / ln(10001), 9) AS p FROM c GROUP BY candidate")
def log_uniform_candidates(spark, sf):
    """Negative candidates of falling probability, and that probability."""
    u = (S.draw_number(F.concat(F.col("event_id").cast("string"), F.lit("-42"))) + 0.5) / float(1 << 48)
    c = table(spark, sf, "events").select(F.least(F.floor(F.exp(u * F.log(F.lit(10001.0)))) - 1, F.lit(9999)).alias("candidate"))
    p = F.log((F.col("candidate") + 2) / (F.col("candidate") + 1)) / F.log(F.lit(10001.0))
    return c.groupBy("candidate").agg(F.count(F.lit(1)).alias("n")).select("candidate", "n", F.round(p, 9).alias("p"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity + l_discount + l_tax, 6) AS inputs, l_returnflag AS label FROM lineitem")
def batch_slices(spark, sf):
    """The last part of each row is the label, the rest are inputs."""
    parts = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]
    *inputs, label = parts
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(sum((F.col(c) for c in inputs[1:]), F.col(inputs[0]))).alias("inputs"), F.col(label).alias("label"))


@query("SELECT c_custkey, c_name || '|' || c_nationkey AS joined, lpad(c_custkey::VARCHAR, 10, '0') AS code, printf('%05d-%s', c_custkey, c_mktsegment) AS label, length(c_name) AS n, strlen(c_name) AS n_bytes FROM customer")
def string_forms(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", F.concat_ws("|", "c_name", F.col("c_nationkey").cast("string")).alias("joined"), F.lpad(k.cast("string"), 10, "0").alias("code"), F.format_string("%05d-%s", k, F.col("c_mktsegment")).alias("label"), F.length("c_name").cast("long").alias("n"), F.octet_length("c_name").cast("long").alias("n_bytes"))


_IDS = "WITH t AS (SELECT conv_id, list(len(text) ORDER BY turn) AS x FROM conversations GROUP BY conv_id) "


def _ids(spark, sf):
    x = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("n")))).alias("x"))
    return x.select("conv_id", F.transform("x", lambda e: e["n"]).alias("x"))


@query(_IDS + "SELECT conv_id, i, array_to_string(x[greatest(i - 2, 0) + 1:least(i + 3, len(x) - 1)], ',') AS data, array_to_string(x[i + 2:least(i + 3, len(x) - 1) + 1], ',') AS target FROM t, range(0, 100, 3) r(i) WHERE i < len(x) - 1")
def lm_context_chunks(spark, sf):
    """Chunks of three ids with up to two ids before them, and the three targets."""
    c = _ids(spark, sf).select("conv_id", F.explode(Q.context_chunks(F.col("x"), 3, 2)).alias("c"))
    line = lambda n: F.array_join(F.col(f"c.{n}").cast("array<string>"), ",").alias(n)
    return c.select("conv_id", F.col("c.start").cast("long").alias("i"), line("data"), line("target"))


@query("""WITH RECURSIVE t AS (SELECT conv_id, list(len(text) ORDER BY turn) AS x FROM conversations GROUP BY conv_id),
c AS (SELECT conv_id, 0::BIGINT AS k, 0::BIGINT AS start, least(1 + ('0x' || md5(concat_ws('-', conv_id, 0, 42))[1:12])::BIGINT % 3, len(x) - 1) AS n, len(x) AS m FROM t WHERE len(x) > 1
UNION ALL SELECT conv_id, k + 1, start + n, least(1 + ('0x' || md5(concat_ws('-', conv_id, k + 1, 42))[1:12])::BIGINT % 3, m - 1 - start - n), m FROM c WHERE start + n < m - 1)
SELECT conv_id, k, start, n FROM c""")
def lm_variable_chunks(spark, sf):
    """Chunks whose lengths are drawn by conversation and number, one after another until the ids end."""
    drawn = lambda k: 1 + S.draw_number(F.concat_ws("-", F.col("conv_id").cast("string"), k.cast("string"), F.lit("42"))) % 3
    c = _ids(spark, sf).select("conv_id", F.posexplode(Q.variable_chunks(F.size("x"), drawn)).alias("k", "c"))
    return c.select("conv_id", F.col("k").cast("long").alias("k"), F.col("c.start").alias("start"), F.col("c.n").alias("n"))


@query("""WITH s AS (SELECT conv_id, turn, len(text) AS n, conv_id % 4 AS stream FROM conversations WHERE len(text) > 1), o AS (SELECT stream, conv_id, turn, n - 1 AS n, coalesce(sum(n - 1) OVER (PARTITION BY stream ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b0 FROM s),
p AS (SELECT stream, conv_id, turn, unnest(range(b0::BIGINT, (b0 + n)::BIGINT)) AS place FROM o) SELECT stream, place // 64 AS batch, conv_id, turn, count(*) AS tokens FROM p GROUP BY ALL""")
def multi_stream_filler(spark, sf):
    """Four streams of sentences fill batches of 64 ids each; a sentence goes on in the next batch where it is cut."""
    s = table(spark, sf, "conversations").where(F.length("text") > 1).select("conv_id", "turn", (F.length("text") - 1).cast("long").alias("n"), (F.col("conv_id") % 4).alias("stream"))
    return Q.filled_batches(s, "stream", ["conv_id", "turn"], "n", 64).select("stream", "batch", "conv_id", "turn", "tokens")
