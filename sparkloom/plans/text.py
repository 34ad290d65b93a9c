"""Queries on texts and vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import pieces as P
from sparkloom.operators import selection as C
from sparkloom.operators import vocabulary as V
from sparkloom.plans.base import query, shared_out, table
from sparkloom.sources.files import parsed

_CHARS = "SELECT doc_id, unnest(list_filter(string_split(trim(coalesce(text, '')), ''), lambda c: c <> '')) AS token, generate_subscripts(list_filter(string_split(trim(coalesce(text, '')), ''), lambda c: c <> ''), 1) AS pos FROM documents"
_WORDS = r"SELECT doc_id, unnest(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda c: c <> '')) AS token FROM documents"
_FIRST = f"""WITH t AS ({_CHARS}), f AS (SELECT token, min((doc_id, pos)) AS seen, count(*) AS n FROM t GROUP BY token), i AS (SELECT token, row_number() OVER (ORDER BY seen) AS id, n FROM f),
v AS (SELECT token, id, n FROM i UNION ALL SELECT '[PAD]', 0, 0 UNION ALL SELECT '[UNK]', (SELECT max(id) + 1 FROM i), 0) """


def _docs(spark, sf):
    return shared_out(table(spark, sf, "documents"))


def _first(spark, sf):
    return V.first_chars(_docs(spark, sf), "doc_id", F.col("text"))


@query(_FIRST + "SELECT token, id, n FROM v")
def vocab_first_seen(spark, sf):
    return _first(spark, sf)


@query(f"WITH c AS (SELECT token, count(*) AS n FROM ({_WORDS}) GROUP BY token HAVING count(*) >= 3), t AS (SELECT * FROM c ORDER BY n DESC, token LIMIT 500) SELECT token, row_number() OVER (ORDER BY n DESC, token) AS id, n FROM t")
def vocab_capped(spark, sf):
    return V.capped(V.token_counts(_docs(spark, sf), V.words(F.col("text"))), 3, 500)


@query(f"WITH c AS (SELECT token, count(*) AS n FROM ({_WORDS}) GROUP BY token HAVING count(*) >= 50) SELECT token, row_number() OVER (ORDER BY n DESC, token) AS id, n FROM c")
def vocab_min_freq(spark, sf):
    return V.capped(V.token_counts(_docs(spark, sf), V.words(F.col("text"))), 50)


@query("""WITH e AS (SELECT event_type AS token, count(*) AS n FROM events GROUP BY 1), old AS (SELECT 'view' AS token, 1 AS id UNION ALL SELECT 'click', 2)
SELECT token, id::BIGINT AS id FROM old UNION ALL SELECT token, 2 + row_number() OVER (ORDER BY n DESC, token) FROM e WHERE token NOT IN (SELECT token FROM old)""")
def vocab_extend(spark, sf):
    old = spark.createDataFrame([("view", 1), ("click", 2)], "token string, id long")
    return V.extended(old, table(spark, sf, "events").groupBy(F.col("event_type").alias("token")).agg(F.count(F.lit(1)).alias("n")))


@query(_FIRST + ", m AS (SELECT map_from_entries(list((token, id))) AS m FROM v), d AS (SELECT doc_id, list_filter(string_split(trim(coalesce(text, '')), ''), lambda c: c <> '')[1:64] AS t FROM documents) SELECT d.doc_id, array_to_string(list_concat(list_transform(t, lambda c: m[c]), list_transform(range(64 - len(t)), lambda i: 0)), ',') AS ids, len(t) AS real_len, coalesce(quality, -1) AS quality FROM d CROSS JOIN m LEFT JOIN labels USING (doc_id)")
def content_to_id_char(spark, sf):
    ids = V.encode_chars(_docs(spark, sf), "doc_id", F.col("text"), _first(spark, sf), 64)
    return ids.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "real_len", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query(f"WITH w AS ({_WORDS}), c AS (SELECT token, count(*) AS n FROM w GROUP BY token HAVING count(*) >= 50), v AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) AS id FROM c), m AS (SELECT map_from_entries(list((token, id))) AS m, max(id) + 1 AS unk FROM v), d AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda c: c <> '')[1:32] AS t FROM documents) SELECT doc_id, array_to_string(list_concat(list_transform(t, lambda c: coalesce(m[c], unk)), list_transform(range(32 - len(t)), lambda i: 0)), ',') AS ids, len(t) AS real_len FROM d, m")
def content_to_id_word(spark, sf):
    vocab = V.with_specials(V.capped(V.token_counts(_docs(spark, sf), V.words(F.col("text"))), 50))
    ids = V.encode(_docs(spark, sf), "doc_id", V.words(F.col("text")), vocab, 32)
    return ids.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "real_len")


@query(r"SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def props_json_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages")
def html_title_extract(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '([!-/:-@\[-`{-~\p{P}])', ' \1 ', 'g'), '\s+', ' ', 'g'))) AS spaced FROM documents")
def punct_split(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(F.trim(F.regexp_replace(T.space_punctuation(F.col("text")), r"\s+", " "))).alias("spaced"))


@query(r"SELECT conv_id, turn, concat(role, ';', text) AS joined, len(text) AS n FROM conversations")
def json_concat(spark, sf):
    """Fields of JSON objects, joined."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", "text")).alias("json"))
    c = c.select("conv_id", "turn", F.from_json("json", "role string, text string").alias("x"))
    return c.select("conv_id", "turn", F.concat_ws(";", "x.role", "x.text").alias("joined"), F.length("x.text").cast("long").alias("n"))


@query(r"SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, len(list_filter(string_split(text, chr(10)), lambda s: len(string_split(trim(s, ' '), ',')) > 2 OR len(string_split(trim(s, ' '), ',')[1]) = 0)) AS n_bad FROM documents")
def bad_lines(spark, sf):
    lines = F.split("text", "\n")
    return _docs(spark, sf).select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(F.filter(lines, lambda s: parsed(s, ",")["bad"])).cast("long").alias("n_bad"))


@query(f"WITH c AS (SELECT token, count(*) AS n FROM ({_WORDS}) GROUP BY token HAVING count(*) >= 50), i AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 AS id FROM c) SELECT token, id FROM i UNION ALL SELECT '[UNK]', count(*) FROM i UNION ALL SELECT '[PAD]', count(*) + 1 FROM i")
def vocab_legacy_layout(spark, sf):
    return V.legacy(V.token_counts(_docs(spark, sf), V.words(F.col("text"))), 50)


@query(r"SELECT doc_id, least(len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda c: c <> '')), 256) AS real_len, repeat('1', least(len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda c: c <> '')), 256)::INT) || repeat('0', 256 - least(len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda c: c <> '')), 256)::INT) AS mask FROM documents")
def pad_mask(spark, sf):
    n = F.least(F.size(V.words(F.col("text"))), F.lit(256))
    return _docs(spark, sf).select("doc_id", n.cast("long").alias("real_len"), F.array_join(V.pad_mask(n, 256).cast("array<string>"), "").alias("mask"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '([\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}])', ' \1 ', 'g')) AS spaced FROM documents")
def cjk_spacing(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.space_ideographs(F.col("text"))).alias("spaced"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[\t\n\r\p{Zs}]', ' ', 'g'), '[\x{0}\x{FFFD}\p{C}]', '', 'g')) AS cleaned FROM documents")
def text_clean(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.clean(F.col("text"))).alias("cleaned"))


@query("SELECT doc_id, md5(strip_accents(lower(text))) AS plain FROM documents")
def lower_strip_accents(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.strip_accents(F.lower("text"))).alias("plain"))


@query(r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[\t\n\r\p{Zs}]', ' ', 'g'), '[\x{0}\x{FFFD}\p{C}]', '', 'g') AS t FROM documents),
b AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(strip_accents(lower(t)), '([!-/:-@\[-`{-~\p{P}])', ' \1 ', 'g'), '\s+'), lambda w: w <> '') AS w FROM a) SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS tokens FROM b""")
def basic_tokens(spark, sf):
    return _docs(spark, sf).select("doc_id", T.basic_tokens(F.col("text")).alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("tokens"))


@query()
def wordpiece(spark, sf):
    """Pieces are the characters, with and without the mark, and the frequent words of the corpus, at most 5000."""
    frequent = V.capped(V.token_counts(_docs(spark, sf), T.basic_tokens(F.col("text"))), 20, 5000)
    letters = [m + r["token"] for r in V.first_chars(_docs(spark, sf), "doc_id", F.lower("text")).where("n > 0").collect() for m in ("", "##")]  # Unicode bounds them
    vocab = letters + [r["token"] for r in frequent.collect()]
    out = P.word_pieces(_docs(spark, sf), "doc_id", T.basic_tokens(F.col("text")), vocab)
    return out.select("doc_id", F.size("pieces").cast("long").alias("n"), F.md5(F.array_join("pieces", " ")).alias("pieces"))


@query()
def gpt2_pretokens(spark, sf):
    return _docs(spark, sf).select("doc_id", F.explode(T.pre_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH a AS (SELECT doc_id, regexp_replace(translate(replace(text, '…', '...'), '—–―´', '---'''), '(-+|~+|!+|"+|;+|\?+|\++|,+|\)+|\(+|\\+|/+|\*+|\[+|\]+|\}+|\{+|\|+|_+)', ' \1 ', 'g') AS t FROM documents)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(t, '\s*\n\s*', e' \n ', 'g'), '[ \t\r\f\v]+', ' ', 'g'))) AS t FROM a""")
def text_standardize(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.standardise(F.col("text"))).alias("t"))


@query("SELECT conv_id, turn, array_to_string(list_append(string_split(text, ' '), '<eos>'), '|') AS one, array_to_string(list_append(list_prepend('<S>', string_split(text, ' ')), '<S>'), '|') AS two FROM conversations")
def eos_tokens(spark, sf):
    w = F.split("text", " ")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(T.with_ends(w), "|").alias("one"), F.array_join(T.with_ends(w, "<S>", "<S>"), "|").alias("two"))


@query("SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%H:%M:%S') AS clock FROM events")
def clock_text(spark, sf):
    return table(spark, sf, "events").select("event_id", T.clock(F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).alias("clock"))


@query(f"WITH c AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda c: c <> ''))) AS token FROM documents), p AS (SELECT doc_id, token, len(token) * (CASE WHEN token < 'm' THEN -1 ELSE 1 END) AS phi FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY phi DESC, token) AS rank FROM p) SELECT doc_id, token, rank::INT AS rank, phi::BIGINT AS phi FROM r WHERE rank <= 3")
def token_top_n(spark, sf):
    part = lambda w: F.struct(w.alias("feature"), (F.length(w) * F.when(w < "m", -1).otherwise(1)).cast("long").alias("phi"))
    parts = F.transform(F.array_distinct(V.words(F.col("text"))), part)
    top = _docs(spark, sf).select("doc_id", F.posexplode(C.top_of_row(parts, 3, "max")).alias("rank", "x"))
    return top.select("doc_id", F.col("x.feature").alias("token"), (F.col("rank") + 1).alias("rank"), "x.phi")


def _merges(name: str):
    import public_tokenizers

    return P.read_merges(public_tokenizers.path(name))


def _byte_ids(spark, sf):
    vocab, merges = _merges("byte_bpe_50k.json")
    return P.merged_ids(_docs(spark, sf), "doc_id", T.pre_tokens(F.col("text")), merges, vocab), vocab


@query()
def gpt2_ids(spark, sf):
    """Byte-level pieces of pre-tokens by merges, and their ids."""
    ids, _ = _byte_ids(spark, sf)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS text FROM documents")
def gpt2_round_trip(spark, sf):
    """Texts to ids and back."""
    ids, vocab = _byte_ids(spark, sf)
    return P.tokens_of(ids, "doc_id", "ids", vocab).select("doc_id", F.md5(P.decode_bytes(F.col("tokens"))).alias("text"))


@query(r"WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM conversations) SELECT concat_ws('/', conv_id, turn) AS row, array_to_string(w, ' ') AS text FROM w")
def gpt_pieces_joined(spark, sf):
    """Words cut by merges whose last piece carries an end mark, and joined again."""
    _, merges = _merges("word_bpe_49k.json")
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")
    c = table(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("row"), words.alias("w"))
    return P.merged_pieces(c, "row", F.col("w"), merges, end="</w>").select("row", T.joined_pieces(F.col("pieces"), tidy=False).alias("text"))


def _special_text():
    """A language's mark, the text and an end mark."""
    return F.concat(F.lit("<|"), F.coalesce("lang", F.lit("und")), F.lit("|>"), F.coalesce("text", F.lit("")), F.lit("<|endoftext|>"))


def _special_ids(spark, sf):
    vocab, merges = _merges("byte_bpe_50k.json")
    specials = ["<|endoftext|>", "<|en|>", "<|de|>"]
    whole = P.with_specials(vocab, specials)
    words = P.around_specials(_special_text(), specials, T.pre_tokens)
    return P.merged_ids(_docs(spark, sf).select("doc_id", "text", "lang"), "doc_id", words, merges, whole, specials=specials), whole


@query()
def gpt2_special_ids(spark, sf):
    """Ids of texts with special tokens, which stay whole; languages without a token of their own are ordinary text."""
    ids, _ = _special_ids(spark, sf)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids"))


@query("SELECT doc_id, md5(concat(CASE WHEN lang IN ('en', 'de') THEN '' ELSE '<|' || coalesce(lang, 'und') || '|>' END, coalesce(text, ''))) AS text FROM documents")
def gpt2_skip_specials(spark, sf):
    """Back to texts, special tokens left out."""
    ids, vocab = _special_ids(spark, sf)
    skip = tuple(vocab[s] for s in ("<|endoftext|>", "<|en|>", "<|de|>"))
    return P.tokens_of(ids, "doc_id", "ids", vocab, skip).select("doc_id", F.md5(P.decode_bytes(F.col("tokens"))).alias("text"))


@query()
def gpt_word_ids(spark, sf):
    """Ids of lower-cased words by merges of their bytes, the last of which carries an end mark."""
    vocab, merges = _merges("word_bpe_49k.json")
    words = T.cased_words(F.col("text"))
    ids = P.merged_ids(_docs(spark, sf), "doc_id", words, merges, vocab, None, end="</w>", in_bytes=True)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids"))


_TIDY = "text"
for _a, _b in T.TIDY:
    _TIDY = "replace({}, '{}', '{}')".format(_TIDY, _a.replace("'", "''"), _b.replace("'", "''"))


@query(f"WITH t AS (SELECT conv_id, turn, trim(replace(replace(replace(text, '.', ' .'), ',', ' ,'), ' ', '</w>'), ' ') AS x FROM conversations), u AS (SELECT conv_id, turn, trim(replace(x, '</w>', ' ')) AS text FROM t) SELECT conv_id, turn, {_TIDY} AS text FROM u")
def gpt_decode_tidy(spark, sf):
    spread = F.replace(F.replace(F.replace(F.col("text"), F.lit("."), F.lit(" .")), F.lit(","), F.lit(" ,")), F.lit(" "), F.lit("</w>"))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.joined_pieces(F.array(spread)).alias("text"))


@query(f"WITH w AS ({_WORDS}), c AS (SELECT token, count(*) AS n FROM w GROUP BY token HAVING count(*) >= 50), k AS (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda t: t <> '') AS t FROM conversations), u AS (SELECT conv_id, turn, unnest(t) AS token, generate_subscripts(t, 1) AS p FROM k) SELECT concat_ws('/', conv_id, turn) AS row, string_agg(token, ' ' ORDER BY p) AS text FROM u WHERE token IN (SELECT token FROM c) GROUP BY ALL")
def xl_lookup_decode(spark, sf):
    """Ids of a vocabulary's words, unknown ones with their own id, and back to words with that id left out."""
    counts = V.capped(V.token_counts(_docs(spark, sf), V.words(F.col("text"))), 50)
    vocab = {r["token"]: r["id"] for r in counts.collect()} | {"<unk>": 0}  # words of 50 occurrences
    c = table(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("row"), F.filter(F.split("text", " "), lambda t: t != "").alias("w"))
    ids = P.ids_of(c, "row", "w", vocab)
    return P.tokens_of(ids, "row", "ids", vocab, (0,)).where(F.size("tokens") > 0).select("row", F.array_join("tokens", " ").alias("text"))


@query(r"WITH d AS (SELECT doc_id, list_filter(string_split(trim(coalesce(text, '')), ''), lambda c: c <> '')[1:32] AS t FROM documents), v AS (SELECT chr(c::INT) AS token, c - 96 AS id FROM range(97, 123) r(c)), m AS (SELECT map_from_entries(list((token, id))) AS m FROM v) SELECT doc_id, array_to_string(list_transform(list_concat(t, list_transform(range(32 - len(t)), lambda i: '[PAD]')), lambda c: CASE WHEN c = '[PAD]' THEN 0 ELSE coalesce(m[c], 27) END), ',') AS ids FROM d, m")
def pad_then_lookup(spark, sf):
    """The older order: texts are padded with the pad's token first, and tokens are looked up then."""
    vocab = spark.createDataFrame([(chr(c), c - 96) for c in range(97, 123)] + [(V.PAD, 0), (V.UNK, 27)], "token string, id long")
    padded = F.slice(F.concat(V.chars(F.col("text")), F.array_repeat(F.lit(V.PAD), 32)), 1, 32)
    return V.encode(_docs(spark, sf), "doc_id", padded, vocab, 32).select("doc_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
