"""Steps whose work must grow no faster than their input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import decoding as D
from sparkloom.operators import pieces as P
from sparkloom.operators import selection, sparse_text, trees
from sparkloom.plans import registry
from sparkloom.sources import readers


def _documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    return f"file://{folder}"


def test_spans_of_a_long_text_and_at_line_ends(spark, tmp_path):
    """A text of 200,000 words, whose places before came from an array that was copied at each word; a line's end is part of a word."""
    n = 200_000
    sf = _documents(spark, tmp_path, [(1, " ".join(["a Bob"] * (n // 2)), "en"), (2, "Rome Foo\n", "en"), (3, "é😀 Alpinist", "de"), (4, "none", "en"), (5, None, "en")])
    got = registry.queries()["spans_as_json_lines"](spark, sf)
    assert sorted(map(tuple, got.where("doc_id > 1").collect())) == [(2, "SHORT", "Rome", 0, 3), (3, "LONG", "Alpinist", 3, 10)]
    bobs = got.where("doc_id = 1").agg(F.count("*"), F.min("start"), F.max("end"), F.sum(F.col("end") - F.col("start")), F.sum(F.col("start") % 6)).first()
    assert tuple(bobs) == (n // 2, 2, 3 * n - 2, n, n)


def test_words_are_explained_without_a_shuffle(spark, tmp_path):
    """Of texts whose tokens are all hot; before, each token of a text was a row that was shuffled twice. Nulls are no tokens."""
    df = spark.createDataFrame([(1, ["a", "b", None], 1.0), (2, ["a"], 0.0), (3, None, None)], "k long, t array<string>, y double")
    model = sparse_text.fit(df, "k", F.col("t"), "y", rounds=2, tolerance=0.0, out=f"file://{tmp_path}/w")
    out = sparse_text.explain(df, "k", F.col("t"), model)
    assert set(model.hot) == {"a", "b"} and not model.rare
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.k: [p.feature for p in r.parts] for r in out.collect()} == {1: ["a", "b"], 2: ["a"], 3: []}


def test_groups_of_a_row_are_made_once(spark):
    """A plan that sorted a row's parts anew for each group's rank was cubic in what it sorts."""
    parts = F.array(*[F.struct(F.lit(f).alias("feature"), (F.col("id") * w).cast("double").alias("phi")) for f, w in (("a", 3), ("b", -2), ("c", 1))])
    df = spark.range(3).select("id", parts.alias("parts"))
    made = selection.quota_of_row(selection.groups_of_row(F.col("parts"), {"x": ["a"], "y": ["b", "c"]}, ["a", "b", "c"]), 3)
    plan = df.select("id", made.alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("sort_array(") + plan.count("array_sort(") == 2
    assert [[p.part.feature for p in r.x] for r in df.select(made.alias("x")).collect()] == [["a", "b"], ["a", "c"], ["a", "c"]]  # of equal ones the first by name


def test_a_part_of_a_pass_is_bounded(spark, monkeypatch, tmp_path):
    """Before, a part held sixteen batches however large, and one task wrote it."""
    monkeypatch.setattr(readers, "PART_ROWS", 10)
    reader, seen = readers.Reader(spark.range(100), "id", 40, f"file://{tmp_path}/r", last="carry"), []
    for _ in range(3):
        batch, after = reader.take()
        seen.append([r.id for r in batch.orderBy("batch_place").collect()])
        reader.commit(after)
    assert [len(b) for b in seen] == [40, 40, 40] and sorted(sum(seen, [])[:100]) == list(range(100))
    sizes = [r["count"] for r in spark.read.parquet(f"file://{tmp_path}/r/pass-0-10").groupBy("part").count().collect()]
    assert sizes == [10] * 10


def test_ids_are_made_in_one_pass(spark, tmp_path):
    """Before, pieces went out of Python as strings and back again for their ids."""
    sf = _documents(spark, tmp_path, [(1, "hello  wörld 12", "en"), (2, None, "de")])
    for name in ("gpt2_ids", "gpt2_special_ids", "gpt_word_ids"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1
    words, merges, vocab = F.split("text", " "), [("h", "e"), ("he", "l")], {"hel": 5, "l": 6, "o": 7}
    df = spark.createDataFrame([(1, "hello xo"), (2, None)], "k long, text string")
    want = {r.k: r.ids for r in P.ids_of(P.merged_pieces(df, "k", words, merges), "k", "pieces", vocab, 9).collect()}
    assert {r.k: r.ids for r in P.merged_ids(df, "k", words, merges, vocab, 9).collect()} == want == {1: [5, 6, 7, 9, 7], 2: []}


def test_trees_are_boosted_on_cells_of_bins(spark, monkeypatch):
    """Passes read a row for each cell, not each row; trees are those of the rows. Nulls are in the lowest bin."""
    df = spark.range(3000).select((F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 11).alias("b"), ((F.col("id") * 37) % 10 < F.col("id") % 7).cast("int").alias("y"))
    rows = trees._rows(df, ["a", "b"], "y", None)
    cuts = [np.arange(7.0), np.arange(11.0)]
    cells = trees._cells(rows, cuts).toPandas()
    assert len(cells) <= 77 and cells["_key"].sum() == 3000 and (cells["_key"] * cells["_y"]).sum() == df.agg(F.sum("y")).first()[0]
    by_cell = trees.boost(df, ["a", "b"], "y", classify=True, trees=2, depth=2)
    monkeypatch.setattr(trees, "CELLS", 0)
    by_row = trees.boost(df, ["a", "b"], "y", classify=True, trees=2, depth=2)
    for s, t in zip(by_cell.trees, by_row.trees, strict=True):
        assert s.feature.tolist() == t.feature.tolist() and s.threshold.tolist() == t.threshold.tolist() and s.value == pytest.approx(t.value)


def test_partitions_of_all_rows_at_once(monkeypatch):
    rng, moves = np.random.default_rng(4), np.array([[0.5, -0.2, -np.inf], [-0.4, 0.6, 0.0], [0.2, 0.1, 0.3]])
    rows = [rng.normal(size=(n, 3)) * s for n, s in ((0, 1), (1, 1), (2, 900), (7, 1), (64, 5), (301, 900), (0, 1), (5, 1))]
    for positions in (100_000, 8):
        monkeypatch.setattr(D, "POSITIONS", positions)
        assert D.log_partitions(rows, moves) == pytest.approx(np.array([D.log_partition(s, moves) for s in rows]))
    assert len(D.log_partitions([], moves)) == 0
