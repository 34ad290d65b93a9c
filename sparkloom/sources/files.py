"""Text, JSON and vocabulary files. Everything goes through Spark's readers and writers, so any file system will do."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkloom.operators.pieces import short_batches
from sparkloom.operators.ranking import numbered

SPANS = "map<string,map<string,array<array<int>>>>"


def parsed(line: Column, sep: str, content: int = 0) -> Column:
    """(text, label, bad) of a line of one or two parts; a line with more parts, or none in the place asked, is bad."""
    parts = F.split(F.trim(line), f"\\Q{sep}\\E")
    text, n = F.get(parts, F.lit(content)), F.size(parts)
    bad = (n > 2) | text.isNull() | (F.length(text) == 0)
    return F.struct(F.when(~bad, text).alias("text"), F.when(~bad & (n == 2), F.get(parts, F.lit(1 - content))).alias("label"), F.coalesce(bad, F.lit(True)).alias("bad"))


def read_delimited(spark: SparkSession, path: str, sep: str = "\t", *, content: int = 0, header: str | None = None) -> DataFrame:
    """file, line, text, label and bad. header: the line to leave out, as it stands.

    Spark splits files anywhere, so lines have no number; two equal lines give two equal rows.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
    if header is not None:
        lines = lines.where(F.col("line") != header)
    return lines.select("file", "line", parsed(F.col("line"), sep, content).alias("x")).select("file", "line", "x.*")


def good_and_bad(rows: DataFrame, convert: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with a text and, where convert (of `label`) is given, a label it can make something of; and the others."""
    bad = F.col("bad") if convert is None else F.col("bad") | (F.col("label").isNotNull() & convert.isNull())
    marked = rows.withColumn("_bad", bad)
    good = marked.where(~F.col("_bad")).drop("_bad", "bad")
    return (good if convert is None else good.withColumn("label", convert)), marked.where("_bad").drop("_bad", "bad")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Columns of the schema and bad, the line where it isn't JSON of this form, else null."""
    line = F.from_json("value", f"{schema}, bad string", {"columnNameOfCorruptRecord": "bad"})
    return spark.read.text(path).where("trim(value) <> ''").select(line.alias("x")).select("x.*")


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """text and spans (tag, start, end), ends included, of lines {"text": ..., "label": {tag: {surface: [[start, end]]}}}."""
    rows = read_json_lines(spark, path, f"text string, label {SPANS}").where("bad is null")
    kinds = F.transform(F.map_entries(F.coalesce("label", F.create_map().cast(SPANS))), lambda t: F.transform(F.flatten(F.map_values(t["value"])), lambda p: F.struct(t["key"].alias("tag"), F.get(p, F.lit(0)).alias("start"), F.get(p, F.lit(1)).alias("end"))))
    return rows.select("text", F.flatten(kinds).alias("spans"))


def scratch(spark: SparkSession) -> str:
    """A new place in the folder that driver and executors share; a local one only in a local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
    return f"{folder}/files-{uuid.uuid4().hex}"


def text_table(lines: DataFrame) -> str:
    """Writes a column `value` as lines; where they are."""
    path = scratch(lines.sparkSession)
    lines.write.text(path)
    return path


def _in_order(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place: file, block of the file and line in the block."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select(F.trim("value").alias("line"), at.alias("at"))


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """token and id, from 1 in the order of first lines, of files with one word a line; blank lines and repeats don't count."""
    first = _in_order(spark, path).where("line <> ''").groupBy(F.col("line").alias("token")).agg(F.min("at").alias("at"))
    return numbered(first, [F.col("at.file"), F.col("at.block"), F.col("at.line")], "id", 1).select("token", "id")


def write_word_list(vocab: DataFrame, path: str) -> None:
    """Tokens as lines in the order of their ids, in files whose names have that order."""
    vocab.orderBy("id").select(F.col("token").alias("value")).write.mode("overwrite").text(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """code, description and label, the index from 0 in the order of lines {"label": code, "label_desc": description}."""
    lines = _in_order(spark, path).where("line <> ''").select("at", F.from_json("line", "label string, label_desc string").alias("x"))
    rows = lines.select("at", F.col("x.label").alias("code"), F.col("x.label_desc").alias("description"))
    return numbered(rows, [F.col("at.file"), F.col("at.block"), F.col("at.line")], "label").select("code", "description", "label")


def read_line_set(spark: SparkSession, path: str) -> DataFrame:
    """The distinct lines, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("line")).distinct()


def stage(parts: dict[str, DataFrame | None], method: str = "parquet") -> dict[str, str | None]:
    """Writes the parts that there are, without header if as csv; where each is."""
    out: dict[str, str | None] = {}
    for name, df in parts.items():
        out[name] = None if df is None else f"{scratch(df.sparkSession)}-{name}"
        if df is not None:
            df.write.format(method).save(out[name])
    return out


def read_matrix(spark: SparkSession, path: str, method: str = "parquet") -> DataFrame:
    return spark.read.csv(path, header=False, inferSchema=True) if method == "csv" else spark.read.format(method).load(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """token and id of a saved vocabulary."""
    return spark.read.schema("token string, id long").parquet(path)


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.select("token", "id").write.mode("overwrite").parquet(path)


def write_merges(merges: DataFrame, path: str) -> None:
    """Pairs (left, right) as lines in the order of their rank, in files whose names have that order; parts hold no white space."""
    merges.orderBy("rank").select(F.concat_ws(" ", "left", "right").alias("value")).write.mode("overwrite").text(path)


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    """rank, from 0 in the order of lines, left and right; blank lines and comments (#) don't count."""
    lines = _in_order(spark, path).where("line <> '' AND NOT startswith(line, '#')").withColumn("parts", F.split("line", " "))
    rows = numbered(lines.where(F.size("parts") == 2), [F.col("at.file"), F.col("at.block"), F.col("at.line")], "rank")
    return rows.select("rank", F.get("parts", F.lit(0)).alias("left"), F.get("parts", F.lit(1)).alias("right"))


def write_tokenizer(vocab: DataFrame, merges: DataFrame, specials: list[str], folder: str) -> None:
    """A vocabulary (token, id), merges and special tokens, each in a place of its own below the folder."""
    write_vocabulary(vocab, f"{folder}/vocab")
    write_merges(merges, f"{folder}/merges")
    vocab.sparkSession.createDataFrame([(s,) for s in specials], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/specials")  # a line for each


def read_tokenizer(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """What write_tokenizer has saved; a vocabulary with a hole or a repeat in its ids is an error."""
    vocab = read_vocabulary(spark, f"{folder}/vocab")
    n, most, distinct = vocab.agg(F.count(F.lit(1)), F.max("id"), F.count_distinct("id")).first()
    if n and (most != n - 1 or distinct != n):
        raise ValueError("ids aren't the numbers from 0 on")
    return vocab, read_merges(spark, f"{folder}/merges"), [r["value"] for r in spark.read.text(f"{folder}/specials").collect()]


def write_delimited(df: DataFrame, path: str, columns: list[str], sep: str = "\t") -> None:
    """Columns joined by sep, null as nothing; separators and line ends inside a value become spaces."""
    plain = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), f"\\Q{sep}\\E|[\\r\\n]", " ") for c in columns]
    df.select(F.concat_ws(sep, *plain).alias("value")).write.mode("overwrite").text(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def surfaces(text: Column, spans: Column) -> Column:
    """{tag: {surface: [[start, end]]}} of spans (tag, start, end), as tagged results are handed in."""
    tags = F.array_distinct(F.transform(spans, lambda s: s["tag"]))
    word = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"] + 1)
    def words(tag: Column) -> Column:
        own = F.filter(spans, lambda s: s["tag"] == tag)
        places = lambda w: F.transform(F.filter(own, lambda s: word(s) == w), lambda s: F.array(s["start"], s["end"]))
        return F.map_from_entries(F.transform(F.array_distinct(F.transform(own, word)), lambda w: F.struct(w, places(w))))

    return F.map_from_entries(F.transform(tags, lambda t: F.struct(t, words(t))))


def pattern_spans(df: DataFrame, key: str, text: Column, pattern: str, tag: Callable[[str], str]) -> DataFrame:
    """key and label, {tag: {surface: [[start, end]]}} of the places of a pattern (of Python's re) in a text; tag names a surface's.
    A text is read once, in its row, without a shuffle. Texts without places are left out."""
    source = short_batches(df.select(F.col(key), text.alias("_text")))
    typed = source.select(key, F.create_map().cast(SPANS).alias("label")).schema
    kind = to_arrow_type(typed[1].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern).finditer
        for batch in batches:
            rows, labels = [], []
            for i, value in enumerate(batch.column(1)):
                places: dict[str, dict[str, list[list[int]]]] = {}
                for m in find(value.as_py() or ""):
                    places.setdefault(tag(m[0]), {}).setdefault(m[0], []).append([m.start(), m.end() - 1])
                if places:
                    rows.append(i)
                    labels.append([(t, list(words.items())) for t, words in places.items()])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(labels, kind)], names=[key, "label"])

    return source.mapInArrow(run, typed)
