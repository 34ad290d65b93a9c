"""Queries on sets of labels, horizons of time, neighbours, readers and corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import horizons as H
from sparkloom.operators import label_sets as S
from sparkloom.operators import neighbours as N
from sparkloom.plans.base import query, table
from sparkloom.sources import corpora as C
from sparkloom.sources import readers as R
from sparkloom.sources.files import scratch

#: True labels of an order: what its suppliers' numbers leave of 5; predicted ones: what its parts' numbers do.
_SETS = "WITH s AS (SELECT l_orderkey, list_distinct(list(l_suppkey % 5)) AS t, list_distinct(list(l_partkey % 5)) AS p FROM lineitem GROUP BY 1), h AS (SELECT len(list_intersect(t, p)) AS h, len(t) AS t, len(p) AS p FROM s) "


def _sets(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 5).alias("t"), F.collect_set(F.col("l_partkey") % 5).alias("p"))


@query(_SETS + "SELECT round(avg(h / p), 9) AS precision, round(avg(h / t), 9) AS recall, round(avg(2 * h / (t + p)), 9) AS f1, round(avg(h / (t + p - h)), 9) AS jaccard FROM h")
def sample_averages(spark, sf):
    """Scores of each order's set of labels, averaged over orders."""
    return S.by_sample(_sets(spark, sf), "t", "p").select(*[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "jaccard")])


@query(
    _SETS
    + """, x AS (SELECT unnest(t) AS label, 't' AS kind FROM s UNION ALL SELECT unnest(p), 'p' FROM s UNION ALL SELECT unnest(list_intersect(t, p)), 'h' FROM s),
    c AS (SELECT label, count(*) FILTER (kind = 'h') AS h, count(*) FILTER (kind = 't') AS t, count(*) FILTER (kind = 'p') AS p FROM x GROUP BY label),
    r AS (SELECT 'micro' AS average, sum(h) / sum(p) AS precision, sum(h) / sum(t) AS recall, 2 * sum(h) / (sum(t) + sum(p)) AS f1 FROM c
          UNION ALL SELECT 'macro', avg(h / p), avg(h / t), avg(2 * h / (t + p)) FROM c UNION ALL SELECT 'weighted', sum(h / p * t) / sum(t), sum(h) / sum(t), sum(2 * h / (t + p) * t) / sum(t) FROM c
          UNION ALL SELECT 'samples', avg(h / p), avg(h / t), avg(2 * h / (t + p)) FROM h)
    SELECT average, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM r"""
)
def label_set_averages(spark, sf):
    return S.averages(_sets(spark, sf), "t", "p").select("average", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


_DAYS = {"1d": 86400, "7d": 7 * 86400, "30d": 30 * 86400}
_OVER = "(PARTITION BY user_id ORDER BY t RANGE BETWEEN {} PRECEDING AND CURRENT ROW)"


@query(
    "WITH e AS (SELECT event_id, user_id, amount, floor(epoch(ts))::BIGINT AS t FROM (SELECT event_id, user_id, ts, event_id % 100 AS amount FROM events)) SELECT event_id, "
    + ", ".join(f"count(*) OVER {_OVER.format(s)} AS n_{h}, sum(amount) OVER {_OVER.format(s)}::BIGINT AS total_{h}" for h, s in _DAYS.items())
    + " FROM e"
)
def event_horizons(spark, sf):
    """Events of a user, and the sum of an amount, over the last day, week and month before each event, its own included."""
    e = table(spark, sf, "events").select("event_id", "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("t"), (F.col("event_id") % 100).alias("amount"))
    found = H.over_horizons(e, "user_id", F.col("t"), _DAYS, {"n": ("count", F.lit(1)), "total": ("sum", F.col("amount"))})
    return found.select("event_id", *[f"{v}_{h}" for h in _DAYS for v in ("n", "total")])


@query("""WITH d AS (SELECT c_custkey AS i, c_acctbal::DOUBLE AS x, c_mktsegment AS c FROM customer), s AS (SELECT c, count(*) AS n FROM d GROUP BY c HAVING count(*) > 1), e AS (SELECT d.*, n FROM d JOIN s USING (c)),
    k AS (SELECT a.i, a.x, a.n, least(3, a.n - 1) AS k, list_sort(list(abs(a.x - b.x)))[least(3, a.n - 1)] AS d FROM e a JOIN e b ON a.c = b.c AND a.i <> b.i GROUP BY a.i, a.x, a.n),
    m AS (SELECT k.i, any_value(k.n) AS n, any_value(k.k) AS k, count(*) AS m FROM k, e WHERE CASE WHEN k.d > 0 THEN e.x > k.x - k.d AND e.x < k.x + k.d ELSE e.x = k.x END GROUP BY k.i),
    h AS (SELECT *, count(*) OVER () AS total FROM m), p AS (SELECT total, list_transform([total, k, n, m], lambda q: list_sum(list_transform(range(1, q), lambda j: 1.0::DOUBLE / j))) AS s FROM h)
    SELECT any_value(total) AS n, round(greatest(avg(coalesce(s[1], 0) + coalesce(s[2], 0) - coalesce(s[3], 0) - coalesce(s[4], 0)), 0), 6) AS mutual_information FROM p""")
def neighbour_mutual_info(spark, sf):
    """What a customer's balance tells of the market segment, from distances to neighbours."""
    d = table(spark, sf, "customer")
    return N.mutual_information(d, "c_custkey", "c_acctbal", "c_mktsegment").select("n", F.round("mutual_information", 6).alias("mutual_information"))


@query("""WITH p AS (SELECT unnest([0, 1]) AS p), o AS (SELECT o_orderkey, p, count(*) OVER (PARTITION BY p) AS n, row_number() OVER (PARTITION BY p ORDER BY md5(o_orderkey || '-' || (42 + p))) - 1 AS r FROM orders, p)
    SELECT o_orderkey, (p * n + r) // (n // 3 + 1) AS batch, p AS pass FROM o WHERE (p * n + r) // (n // 3 + 1) < 4""")
def reader_restarted(spark, sf):
    """Four batches of a third of the orders and one, the last of them filled by the next pass; a new reader takes each."""
    orders, folder = table(spark, sf, "orders").select("o_orderkey"), scratch(spark)
    size, out = orders.count() // 3 + 1, None
    for _ in range(4):
        reader = R.Reader(orders, "o_orderkey", size, folder, last="carry")
        batch, after = reader.take()
        out = batch if out is None else out.unionByName(batch)
        reader.commit(after)
    return out.select("o_orderkey", "batch", "pass")


_SPLIT = "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'valid' ELSE 'test' END"


@query(f"""WITH d AS (SELECT CASE lang WHEN 'en' THEN 'wt103' WHEN 'de' THEN 'ptb' ELSE 'text8' END AS corpus, {_SPLIT} AS split, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
    t AS (SELECT corpus, unnest(CASE corpus WHEN 'text8' THEN w ELSE list_append(w, '<eos>') END) AS token FROM d WHERE corpus <> 'wt103' OR split = 'train')
    SELECT corpus, token, count(*) AS n FROM t GROUP BY ALL""")
def corpus_vocabularies(spark, sf):
    """Texts laid out as three corpora, read by their rules and counted."""
    corpus = F.when(F.col("lang") == "en", "wt103").when(F.col("lang") == "de", "ptb").otherwise("text8")
    place = F.col("doc_id") % 10
    split = F.when(place < 8, "train").when(place == 8, "valid").otherwise("test")
    lines = table(spark, sf, "documents").where("text is not null").select(corpus.alias("corpus"), split.alias("split"), F.regexp_replace("text", r"[\r\n\u0085  ]", " ").alias("value"))
    root = scratch(spark)
    for name in ("wt103", "ptb", "text8"):
        for part in C.SPLITS:
            lines.where((F.col("corpus") == name) & (F.col("split") == part)).select("value").write.text(f"{root}/{name}/{part}.txt")
    return C.vocabularies(C.read(spark, root, lower=True))
