"""Queries on tag sequences, batches and windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import decoding as D
from sparkloom.operators import sequences as Q
from sparkloom.operators import state as A
from sparkloom.plans.base import query, table


def _tags(spark, sf):
    """A tag for each word of a document: capitals begin an entity, endings in `n` go on with one."""
    words = F.split("text", " ")
    tag = lambda w: F.when(w.rlike("^[A-Z]"), "B-CAP").when(w.endswith("n"), F.when(F.length(w) > 5, "I-CAP").otherwise("I-LOW")).otherwise("O")
    return table(spark, sf, "documents").select("doc_id", F.transform(words, tag).alias("tags"))


_TAGS = """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents),
t AS (SELECT doc_id, pos, CASE WHEN regexp_matches(w, '^[A-Z]') THEN 'B-CAP' WHEN suffix(w, 'n') THEN CASE WHEN length(w) > 5 THEN 'I-CAP' ELSE 'I-LOW' END ELSE 'O' END AS t FROM w),
i AS (SELECT *, t[1] AS h, t[3:] AS k, sum((t[1] = 'B')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS isl FROM t),
b AS (SELECT *, first_value(k) OVER x AS own FROM i WHERE isl > 0 WINDOW x AS (PARTITION BY doc_id, isl ORDER BY pos)),
c AS (SELECT *, sum((NOT (h = 'B' OR (h = 'I' AND k = own)))::INT) OVER (PARTITION BY doc_id, isl ORDER BY pos) AS brk FROM b),
e AS (SELECT doc_id, own AS tag, min(pos)::INT AS "start", max(pos)::INT AS "end" FROM c WHERE brk = 0 GROUP BY doc_id, isl, own) """


@query(_TAGS + 'SELECT doc_id, tag, "start", "end" FROM e')
def bio_decode(spark, sf):
    return Q.bio_entities(_tags(spark, sf), "doc_id", "tags")


@query(_TAGS + ', p AS (SELECT doc_id, tag, "start", "end" FROM e WHERE "end" - "start" <> 1 UNION ALL SELECT doc_id, tag, "start", "end" + 1 FROM e WHERE "end" = "start"), n AS (SELECT (SELECT count(*) FROM e) AS t, (SELECT count(*) FROM (SELECT DISTINCT * FROM p)) AS q, (SELECT count(*) FROM (SELECT * FROM e INTERSECT SELECT * FROM p)) AS c) SELECT t AS n_true, q AS n_predicted, c AS n_correct, round(c / t, 6) AS recall, round(c / q, 6) AS precision, round(2 * c / (t + q), 6) AS f1 FROM n')
def entity_prf(spark, sf):
    truth = Q.bio_entities(_tags(spark, sf), "doc_id", "tags")
    guess = truth.where(F.col("end") - F.col("start") != 1).unionByName(truth.where(F.col("end") == F.col("start")).withColumn("end", F.col("end") + 1))
    out = Q.entity_scores(truth, guess, ["doc_id", "tag", "start", "end"])
    return out.select("n_true", "n_predicted", "n_correct", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


@query(_TAGS + """, x AS (SELECT doc_id, unnest(range(len(string_split(text, ' ')))) AS j FROM documents), y AS (SELECT doc_id, tag, "start", unnest(range("start", "end" + 1)) AS j FROM e)
SELECT doc_id, md5(string_agg(CASE WHEN tag IS NULL THEN 'O' WHEN "start" = j THEN 'B-' || tag ELSE 'I-' || tag END, ' ' ORDER BY j)) AS tags FROM x LEFT JOIN y USING (doc_id, j) GROUP BY doc_id""")
def bio_encode(spark, sf):
    tags = _tags(spark, sf)
    spans = Q.bio_entities(tags, "doc_id", "tags").groupBy("doc_id").agg(F.collect_list(F.struct("tag", "start", "end")).alias("spans"))
    rows = tags.select("doc_id", F.size("tags").alias("n")).join(spans, "doc_id", "left")
    return Q.bio_tags(rows, "doc_id", "n", "spans").select("doc_id", F.md5(F.array_join("tags", " ")).alias("tags"))


@query("WITH t AS (SELECT conv_id, list(len(text) ORDER BY turn) AS x FROM conversations GROUP BY conv_id) SELECT conv_id, unnest(x[1:len(x) - 1]) AS input, unnest(x[2:]) AS target FROM t")
def lm_targets(spark, sf):
    x = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("n")))).alias("x"))
    return x.select("conv_id", F.explode(Q.next_targets(F.transform("x", lambda e: e["n"]))).alias("p")).select("conv_id", "p.*")


@query("WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations) SELECT conv_id, k // 3 AS chunk, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS turns FROM t GROUP BY 1, 2")
def lm_chunks(spark, sf):
    x = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("x"))
    return x.select("conv_id", F.posexplode(Q.chunks(F.col("x"), 3)).alias("chunk", "c")).select("conv_id", F.col("chunk").cast("long").alias("chunk"), F.array_join(F.col("c").cast("array<string>"), ",").alias("turns"))


@query("SELECT i, j, (j <= i)::INT AS seen FROM range(0, 8) a(i), range(0, 8) b(j)")
def causal_mask(spark, sf):
    n = spark.range(8)
    return n.select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("j")).select("i", "j", (F.col("j") <= F.col("i")).cast("int").alias("seen"))


@query("WITH r AS (SELECT doc_id, len(text) AS n, (row_number() OVER (ORDER BY len(text) DESC, doc_id) - 1) // 32 AS batch_id FROM documents) SELECT doc_id, n, batch_id, max(n) OVER (PARTITION BY batch_id) AS longest FROM r")
def len_sorted_batches(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("n"))
    return Q.length_batches(d, "doc_id", "n", 32)


@query("WITH t AS (SELECT conv_id, list(turn ORDER BY turn) AS x FROM conversations GROUP BY conv_id) SELECT conv_id, k::INT AS stream, array_to_string(x[k * (len(x) // 2) + 1:(k + 1) * (len(x) // 2)], ',') AS turns FROM t, range(0, 2) r(k)")
def lm_streams(spark, sf):
    x = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("x"))
    return x.select("conv_id", F.posexplode(Q.streams(F.col("x"), 2)).alias("stream", "s")).select("conv_id", "stream", F.array_join(F.col("s").cast("array<string>"), ",").alias("turns"))


MOVES = np.array([[0.5, -0.2, 0.1], [-0.4, 0.6, 0.0], [0.2, 0.1, 0.3]])


def _scores():
    """Three tags' scores for each word, from its length and capitals."""
    words = F.split("text", " ")
    one = lambda w: F.array(F.length(w) / 10.0, F.when(w.rlike("^[A-Z]"), 1.0).otherwise(0.0), 1.0 - F.length(w) / 8.0)
    return F.flatten(F.transform(words, one))


@query()
def viterbi(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(D.viterbi(_scores(), MOVES).cast("array<string>"), "").alias("path"))


@query()
def crf_loss(spark, sf):
    gold = F.transform(F.split("text", " "), lambda w: F.length(w) % 3)
    return table(spark, sf, "documents").select("doc_id", F.round(D.crf_loss(_scores(), gold, MOVES), 6).alias("loss"))


@query("""WITH RECURSIVE g AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, len(text) / 97.0::DOUBLE - 1 AS g FROM conversations),
s AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, 0::DOUBLE AS m, 0::DOUBLE AS v, 1::DOUBLE AS p FROM conversations
UNION ALL SELECT conv_id, g.k, 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, p - 0.001 * ((0.9 * m + 0.1 * g) / (sqrt(0.999 * v + 0.001 * g * g) + 1e-6) + 0.01 * p) FROM s JOIN g USING (conv_id) WHERE g.k = s.k + 1)
SELECT conv_id, round(arg_max(m, k), 6) AS m, round(arg_max(v, k), 6) AS v, round(arg_max(p, k), 6) AS p FROM s GROUP BY conv_id""")
def adam_steps(spark, sf):
    x = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", (F.length("text") / 97.0 - 1).alias("g")))).alias("x"))
    out = x.select("conv_id", A.adam(F.transform("x", lambda e: e["g"]), 1.0, decay=0.01).alias("s"))
    return out.select("conv_id", *[F.round(f"s.{c}", 6).alias(c) for c in "mvp"])
