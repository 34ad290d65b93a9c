"""Queries that write files and read them back: delimited lines, word lists, JSON lines, vocabularies, label dictionaries, matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import vocabulary as V
from sparkloom.operators.ranking import numbered, sent
from sparkloom.plans.base import query, table
from sparkloom.sources import files as S

_TEXT = r"regexp_replace(text, '[\t\r\n]', ' ', 'g')"
_LINES = f"""WITH l AS (SELECT turn % 4 AS k, {_TEXT} AS t, role FROM conversations),
p AS (SELECT trim(CASE k WHEN 0 THEN t WHEN 1 THEN t || chr(9) || role WHEN 2 THEN t || chr(9) || role || chr(9) || 'more' ELSE '' END) AS line FROM l),
r AS (SELECT line, string_split(line, chr(9)) AS x FROM p), d AS (SELECT line, x, len(x) > 2 OR len(x[1]) = 0 AS bad FROM r) """


def _delimited(spark, sf):
    c = table(spark, sf, "conversations").select((F.col("turn") % 4).alias("k"), F.regexp_replace("text", r"[\t\r\n]", " ").alias("t"), "role")
    line = F.when(F.col("k") == 0, F.col("t")).when(F.col("k") == 1, F.concat_ws("\t", "t", "role")).when(F.col("k") == 2, F.concat_ws("\t", "t", "role", F.lit("more"))).otherwise("")
    return S.read_delimited(spark, S.text_table(c.select(line.alias("value"))))


@query(_LINES + "SELECT CASE WHEN NOT bad THEN x[1] END AS text, CASE WHEN NOT bad AND len(x) = 2 THEN x[2] END AS label, bad, count(*) AS n FROM d GROUP BY ALL")
def delimited_scan(spark, sf):
    return _delimited(spark, sf).groupBy("text", "label", "bad").agg(F.count(F.lit(1)).alias("n"))


@query(_LINES + ", b AS (SELECT *, bad OR coalesce(len(x) = 2 AND x[2] NOT IN ('user', 'assistant'), false) AS worse FROM d) SELECT count(*) FILTER (WHERE NOT worse) AS n_good, count(*) FILTER (WHERE worse) AS n_bad, count(DISTINCT line) FILTER (WHERE worse) AS n_lines FROM b")
def bad_line_report(spark, sf):
    code = F.when(F.col("label") == "user", 0).when(F.col("label") == "assistant", 1)
    good, bad = S.good_and_bad(_delimited(spark, sf), code)
    return good.agg(F.count(F.lit(1)).alias("n_good")).crossJoin(bad.agg(F.count(F.lit(1)).alias("n_bad"), F.count_distinct("line").alias("n_lines")))


@query(f"WITH w AS (SELECT conv_id, turn, unnest(string_split({_TEXT}, ' ')) AS word, generate_subscripts(string_split({_TEXT}, ' '), 1) AS p FROM conversations WHERE turn = 0), f AS (SELECT trim(word) AS token, min((conv_id, turn, p)) AS seen FROM w WHERE trim(word) <> '' GROUP BY 1) SELECT token, row_number() OVER (ORDER BY seen) AS id FROM f")
def vocab_word_file(spark, sf):
    """A file of one word a line, with repeats; ids by a word's first line."""
    c = table(spark, sf, "conversations").where("turn = 0").select("conv_id", "turn", F.posexplode(F.split(F.regexp_replace("text", r"[\t\r\n]", " "), " ")).alias("p", "value"))
    return S.read_word_list(spark, S.text_table(c.orderBy("conv_id", "turn", "p").select("value").coalesce(1)))


@query("WITH c AS (SELECT event_type AS token, count(*) AS n FROM events GROUP BY 1) SELECT token, row_number() OVER (ORDER BY n DESC, token) AS id FROM c")
def vocab_saved(spark, sf):
    vocab = V.capped(table(spark, sf, "events").groupBy(F.col("event_type").alias("token")).agg(F.count(F.lit(1)).alias("n")))
    path = S.scratch(spark)
    S.write_vocabulary(vocab, path)
    return S.read_vocabulary(spark, path)


@query("WITH c AS (SELECT event_type AS token, count(*) AS n FROM events GROUP BY 1) SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS id FROM c")
def vocab_lines_by_id(spark, sf):
    """A vocabulary saved as lines in the order of its ids, from 0, and read by line."""
    vocab = V.capped(table(spark, sf, "events").groupBy(F.col("event_type").alias("token")).agg(F.count(F.lit(1)).alias("n")))
    path = S.scratch(spark)
    S.write_word_list(vocab, path)
    return S.read_word_list(spark, path).select("token", (F.col("id") - 1).alias("id"))


@query("SELECT n_nationkey::VARCHAR AS code, n_name AS description, row_number() OVER (ORDER BY n_nationkey) - 1 AS label FROM nation")
def label_dictionary(spark, sf):
    return _labels(spark, sf)


def _labels(spark, sf):
    lines = table(spark, sf, "nation").orderBy("n_nationkey").select(F.to_json(F.struct(F.col("n_nationkey").cast("string").alias("label"), F.col("n_name").alias("label_desc"))).alias("value"))
    return S.read_labels(spark, S.text_table(lines.coalesce(1)))


@query("WITH l AS (SELECT n_nationkey AS code, n_name AS description, row_number() OVER (ORDER BY n_nationkey) - 1 AS label FROM nation) SELECT c_custkey, label, description FROM customer JOIN l ON code = c_nationkey")
def label_code_join(spark, sf):
    """Codes to dense indices and, from these, to descriptions."""
    labels = sent(_labels(spark, sf))  # a row for each label
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("code")).join(labels.select("code", "label"), "code")
    return c.join(labels.select("label", "description"), "label").select("c_custkey", "label", "description")


@query("SELECT n_name AS description, row_number() OVER (ORDER BY n_nationkey) - 1 AS label, n_nationkey::VARCHAR AS code FROM nation")
def label_inversion(spark, sf):
    """The dictionary as a map from index to code, and back to rows."""
    labels = _labels(spark, sf)
    forward = labels.agg(F.map_from_entries(F.collect_list(F.struct("code", "label"))).alias("m"))
    back = forward.select(F.explode(F.map_from_arrays(F.map_values("m"), F.map_keys("m"))).alias("label", "code"))
    return back.join(labels.select("label", "description"), "label").select("description", "label", "code")


@query(f"SELECT conv_id, turn, {_TEXT} AS sentence, (role = 'user')::INT AS label FROM conversations")
def delimited_sink(spark, sf):
    """keywords;sentence and a label, as delimited lines; the keywords hold the row's key."""
    c = table(spark, sf, "conversations")
    joined = F.concat(F.col("conv_id"), F.lit(","), F.col("turn"), F.lit(";"), F.regexp_replace("text", r"[\t\r\n]", " "))
    path = S.scratch(spark)
    S.write_delimited(c.select(joined.alias("text"), (F.col("role") == "user").cast("int").alias("label")), path, ["text", "label"])
    back = spark.read.text(path).select(F.split("value", "\t").alias("x"))
    key, rest = F.split(F.regexp_extract(F.col("x")[0], "^([^;]*);", 1), ","), F.regexp_extract(F.col("x")[0], "(?s)^[^;]*;(.*)$", 1)
    kinds = dict(c.dtypes)
    return back.select(key[0].cast(kinds["conv_id"]).alias("conv_id"), key[1].cast(kinds["turn"]).alias("turn"), rest.alias("sentence"), F.col("x")[1].cast("int").alias("label"))


@query("SELECT c_custkey AS id, c_nationkey::VARCHAR AS label, n_name AS label_desc FROM customer JOIN nation ON n_nationkey = c_nationkey")
def classes_as_json_lines(spark, sf):
    c = table(spark, sf, "customer").join(sent(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    path = S.scratch(spark)
    S.write_json_lines(c.select(F.col("c_custkey").cast("long").alias("id"), F.col("c_nationkey").cast("string").alias("label"), F.col("n_name").alias("label_desc")), path)
    back = S.read_json_lines(spark, path, "id long, label string, label_desc string").where("bad is null")
    return back.select(F.col("id").cast(dict(c.dtypes)["c_custkey"]).alias("id"), "label", "label_desc")


_CAPS = r"""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS k FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, k, w, coalesce(sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w) """


@query(_CAPS + "SELECT doc_id, CASE WHEN length(w) > 6 THEN 'LONG' ELSE 'SHORT' END AS tag, w AS surface, s::INT AS \"start\", (s + length(w) - 1)::INT AS \"end\" FROM p WHERE regexp_matches(w, '^[A-Z][a-z]+$')")
def spans_as_json_lines(spark, sf):
    """Spans of capitalised words as {tag: {surface: [[start, end]]}}, written and read back."""
    d = table(spark, sf, "documents").where("text is not null")
    by = S.pattern_spans(d, "doc_id", F.col("text"), r"(?<![^ ])[A-Z][a-z]+(?![^ ])", lambda w: "LONG" if len(w) > 6 else "SHORT")
    path = S.scratch(spark)
    S.write_json_lines(by, path)
    back = S.read_json_lines(spark, path, f"doc_id long, label {S.SPANS}").where("bad is null")
    flat = back.select("doc_id", F.explode("label").alias("tag", "m")).select("doc_id", "tag", F.explode("m").alias("surface", "at")).select("doc_id", "tag", "surface", F.explode("at").alias("p"))
    return flat.select("doc_id", "tag", "surface", F.col("p")[0].alias("start"), F.col("p")[1].alias("end"))


@query("SELECT vec_id, i::INT AS i, round(embedding[i + 1]::DOUBLE, 6) AS x FROM embeddings, range(0, 4) r(i)")
def matrix_staged_csv(spark, sf):
    """Columns of a matrix written without a header and read back with types inferred."""
    v = table(spark, sf, "embeddings").select("vec_id", *[F.round(F.col("embedding")[i].cast("double"), 6).alias(f"c{i}") for i in range(4)])
    back = S.read_matrix(spark, S.stage({"x": v, "nothing": None}, "csv")["x"], "csv")
    return back.select(F.col("_c0").cast(v.schema["vec_id"].dataType).alias("vec_id"), F.posexplode(F.array(*[F.col(f"_c{i + 1}").cast("double") for i in range(4)])).alias("i", "x"))


@query("SELECT vec_id, i, round(x, 6) AS x FROM (SELECT vec_id, unnest(range(len(embedding)))::INT AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) WHERE abs(x) > 0.2")
def matrix_staged_sparse(spark, sf):
    """The large entries of a matrix, as (row, column, value)."""
    v = table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")).where(F.abs("x") > 0.2)
    return S.read_matrix(spark, S.stage({"x": v}, "parquet")["x"], "parquet").select("vec_id", "i", F.round("x", 6).alias("x"))


@query(f"SELECT DISTINCT trim({_TEXT}) AS line FROM conversations")
def distinct_lines(spark, sf):
    return S.read_line_set(spark, S.text_table(table(spark, sf, "conversations").select(F.regexp_replace("text", r"[\t\r\n]", " ").alias("value"))))


@query(r"SELECT page_id, lower(regexp_extract(url, '(\.[^./?#]+)$', 1)) AS extension, sha256(url) AS cache_name FROM pages")
def url_names(spark, sf):
    """The extension of a URL's last part, and the name under which its contents are kept."""
    return table(spark, sf, "pages").select("page_id", F.lower(F.regexp_extract("url", r"(\.[^./?#]+)$", 1)).alias("extension"), F.sha2("url", 256).alias("cache_name"))


@query("""WITH w AS (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: len(x) > 1)) AS w FROM documents),
    p AS (SELECT w[i] AS l, w[i + 1] AS r, count(*) AS n FROM w, unnest(range(1, len(w))) t(i) GROUP BY ALL)
    SELECT row_number() OVER (ORDER BY n DESC, l, r) - 1 AS rank, l AS "left", r AS "right" FROM p""")
def merges_saved(spark, sf):
    """Pairs of letters by how often they stand together, saved as merges with the letters as vocabulary, and read back."""
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) > 1)
    word = table(spark, sf, "documents").select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    pair = lambda i: F.struct(F.substring("w", i, 1).alias("left"), F.substring("w", i + 1, 1).alias("right"))
    pairs = word.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), pair)).alias("p")).groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))
    merges = numbered(pairs, [-F.col("n"), F.col("left"), F.col("right")], "rank")
    letters = spark.range(26).select(F.char(F.col("id") + 97).alias("token"), F.col("id"))
    folder = S.scratch(spark)
    S.write_tokenizer(letters, merges, ["<|end|>"], folder)
    return S.read_tokenizer(spark, folder)[1]
