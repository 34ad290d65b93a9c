"""Directories of language-model corpora: train, valid and test, with each corpus's own rules.

A corpus is told by the name of its directory. Its rules say which splits count for the vocabulary, which marks stand
around a line, whether the order of lines is kept, and where the training files lie.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import with_ends

SPLITS = ("train", "valid", "test")


@dataclass(frozen=True)
class Rules:
    """counted: the splits that the vocabulary is counted from, none if it is given. ends: marks around a line (0: none, 1: <eos>
    behind it, 2: <S> on both sides)."""

    counted: tuple[str, ...]
    ends: int = 1
    ordered: bool = True
    train: str = "train.txt"


# The corpora and where their files lie.
RULES = {
    "ptb": Rules(SPLITS),
    "wt2": Rules(SPLITS),
    "wt103": Rules(("train",)),
    "enwik8": Rules(SPLITS, ends=0),
    "text8": Rules(SPLITS, ends=0),
    "lm1b": Rules((), ends=2, ordered=False, train="1-billion-word-language-modeling-benchmark-r13output/training-monolingual.tokenized.shuffled/news.en-*"),
}


def found(spark: SparkSession, root: str) -> dict[str, str]:
    """The corpora with rules that lie below root, by name, and their paths."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    entries = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    names = {e.getPath().getName(): e.getPath().toString() for e in entries if e.isDirectory()}
    return {n: p for n, p in sorted(names.items()) if n in RULES}


def read(spark: SparkSession, root: str, *, lower: bool = False, corpora: list[str] | None = None) -> DataFrame:
    """corpus, split, file, line (its order in the file, as Spark splits it) and tokens of all lines of the corpora below root.

    One scan for each corpus and split. A line's white space is trimmed, and its tokens stand between white space; an empty line has
    its marks only.
    """
    out = None
    for name, path in found(spark, root).items():
        if corpora is not None and name not in corpora:
            continue
        rules = RULES[name]
        for split in SPLITS:
            lines = spark.read.text(f"{path}/{rules.train if split == 'train' else split + '.txt'}")
            text = F.trim(F.lower("value") if lower else F.col("value"), F.lit(" \t\r\n"))
            words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
            tokens = {0: words, 1: with_ends(words), 2: with_ends(words, "<S>", "<S>")}[rules.ends]
            order = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
            rows = lines.select(F.lit(name).alias("corpus"), F.lit(split).alias("split"), order.alias("at"), tokens.alias("tokens"))
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no corpus with rules lies there")
    return out


def vocabularies(rows: DataFrame) -> DataFrame:
    """corpus, token and n over the splits that a corpus's rules count. Counts are summed in tasks before they move."""
    counts = [(n, s) for n, r in RULES.items() for s in r.counted]
    wanted = F.concat_ws("/", "corpus", "split").isin([f"{n}/{s}" for n, s in counts])
    return rows.where(wanted).select("corpus", F.explode("tokens").alias("token")).groupBy("corpus", "token").agg(F.count(F.lit(1)).alias("n"))
