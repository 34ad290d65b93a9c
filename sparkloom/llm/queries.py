"""The queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import (
    byte_bpe, collocations, decontaminate, fill_middle, jaccard_join, language_id, licenses, quality, secrets, sharding, suffix_dedup, token_files, topk_join,
)
from sparkloom.llm.common import read


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), keep=["doc_id"]))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "quality")
    held_out = language_id.held_out("doc_id", 5, 0)
    model = quality.fit(docs, labels, ~held_out)
    return quality.score(docs.withColumn("held_out", held_out), model, keep=["doc_id", "held_out"])


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_join.topk(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN, with_ids=False, keep=["doc_id"])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), with_kept=False)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language_id.held_out()
    model = language_id.fit(docs, ~held_out)
    asked = docs.select("doc_id", "text", held_out.alias("held_out"))
    return language_id.predict(asked, model, keep=["doc_id", "held_out"])


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.token_files(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"), with_output=False, keep=["doc_id"])


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read(spark, sf_dir, "documents").select("text", "lang"))


def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.digest(licenses.scan(docs, licenses.fit(docs)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_secret_scans, op2_decontamination, op3_quality, op4_topk, op5_byte_bpe, op6_suffix_dedup, op7_sharding, op8_language_id, op9_token_files,
        op10_jaccard_join, op11_fill_middle, op12_collocations, op13_license_scans,
    )
}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES: dict[str, str] = {
    "op2_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
                FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT n FROM win),
        seen AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM d, sizes, unnest(range(1, len(w) - n + 2)) t(i)),
        hit AS (SELECT doc_id, i, n, item FROM seen JOIN win USING (n, s)),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit) h, unnest(range(i, i + n)) u(p) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
    "op6_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
        p AS (SELECT doc_id, i, substring(h, 2 * i + 1, 200) AS s FROM d, unnest(range(0, n - 99)) t(i)),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM p) WHERE k > 1),
        g AS (SELECT doc_id, i, coalesce((i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100)::INT, 1) AS new FROM r),
        u AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
        x AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM u GROUP BY doc_id, run),
        t AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS b FROM x GROUP BY doc_id),
        k AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi FROM x
              UNION ALL SELECT doc_id, coalesce(b, 0), n FROM d LEFT JOIN t USING (doc_id)),
        j AS (SELECT doc_id, unhex(string_agg(substring(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo)) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(kept) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id) JOIN j USING (doc_id)
    """,
    "op10_jaccard_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        r AS (SELECT doc_id, doc_id AS m FROM d UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id AND r.m < e.b)
        SELECT doc_id, coalesce(n.n, 0) AS n_shingles, min(m) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY ALL
    """,
    "op11_fill_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
        h AS (SELECT *, len(u) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
        f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
        c AS (SELECT *, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS x FROM f)
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
        FROM c
    """,
    "op12_collocations": rf"""
        WITH q AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM q),
        g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS s, w[i:i + k - 1] AS ws FROM w, unnest(range(1, 5)) a(k), unnest(range(1, len(w) - k + 2)) b(i)),
        f AS MATERIALIZED (SELECT lang, k, s, any_value(ws) AS ws, count(*) AS f FROM g GROUP BY lang, k, s),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT * FROM f WHERE k > 1 AND f >= 30),
        i AS (SELECT DISTINCT c.lang, array_to_string(ws[x:x + j - 1], ' ') AS s, j, f FROM c, unnest(range(2, k)) a(j), unnest(range(1, k - j + 2)) b(x)),
        o AS (SELECT lang, s, max(f) AS most FROM i GROUP BY lang, s),
        r AS (SELECT c.* FROM c LEFT JOIN o USING (lang, s) WHERE most IS NULL OR 100 * most < 80 * f),
        v AS MATERIALIZED (SELECT lang, s, f AS a, j, array_to_string(ws[1:j], ' ') AS p, array_to_string(ws[j + 1:], ' ') AS z FROM r, unnest(range(1, k)) t(j)),
        u AS (SELECT v.lang, v.s, a, j, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
              FROM v JOIN f x ON x.lang || ' ' || x.s = v.lang || ' ' || v.p JOIN f y ON y.lang || ' ' || y.s = v.lang || ' ' || v.z),
        b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, j) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, s) AS rank, s AS phrase, a, l, r, n, score FROM b JOIN n USING (lang)
        QUALIFY rank <= 2000
    """,
    "op4_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
