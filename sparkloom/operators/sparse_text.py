"""Logistic learners over the words of texts, whose weights are a table, and what each word adds to a text's odds.

A text is a row with the numbers of its tokens. Tokens that make a large share of all are hot: their weights are sent to
all tasks, so a step reads the texts where they lie, and what moves is each task's sum of the gradient by token. There
are a bounded number of hot tokens, by their share. All others are kept as rows beside the texts, and their weights are
joined and their gradients added up by shuffles, so a vocabulary may be of any size. Texts never reach the driver.

A step divides a token's gradient by a bound of the curvature along it: the sum over its texts of count times the text's
length, over 4. The loss therefore falls at each step, whatever the data. Texts without tokens have the intercept alone.
Tokens that no training text has count nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.pieces import short_batches
from sparkloom.operators.tables import staged

#: A token is hot if it makes more than this share of all: there are fewer than the inverse of it.
HOT = 1 / 2_000_000
#: Tokens of a batch of gradients.
SLICE = 100_000


@dataclass
class Model:
    """weights (token, w) of all tokens but the hot ones, whose weights are by token in `hot`."""

    weights: DataFrame
    hot: dict[str, float]
    intercept: float
    rare: bool = False  # whether weights has any rows

    def table(self) -> DataFrame:
        spark = self.weights.sparkSession
        return self.weights.unionByName(spark.createDataFrame(list(self.hot.items()), "token string, w double")) if self.hot else self.weights


def _row_of(lists: pa.Array) -> np.ndarray:
    """The row of each item of a batch's arrays."""
    return np.repeat(np.arange(len(lists)), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))


def _lists(row: np.ndarray, rows: int, values: pa.Array) -> pa.Array:
    """An array for each of so many rows, of the values whose row, in order, it is."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), values)


def _coded(texts: DataFrame, hot: list[str]) -> DataFrame:
    """(_k, _y, _ids, _rest): the places in `hot` of a text's tokens, and its other tokens."""
    known = texts.sparkSession.sparkContext.broadcast(hot)
    typed = texts.select("_k", "_y", F.array().cast("array<int>").alias("_ids"), F.array().cast("array<string>").alias("_rest")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(known.value)}
        for batch in batches:
            row, flat = _row_of(batch.column(2)), batch.column(2).flatten()
            there = flat.is_valid().to_numpy(zero_copy_only=False)
            row, coded = row[there], flat.drop_null().dictionary_encode()
            ids = np.array([place.get(t, -1) for t in coded.dictionary.to_pylist()], np.int32)[coded.indices.to_numpy()]
            n, found = batch.num_rows, ids >= 0
            rest = coded.dictionary.take(coded.indices.filter(pa.array(~found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(row[found], n, pa.array(ids[found])), _lists(row[~found], n, rest)], names=typed.names)

    return short_batches(texts.select("_k", "_y", "_t")).mapInArrow(run, typed)


def _pass(docs: DataFrame, w: np.ndarray, intercept: float) -> DataFrame:
    """Rows (id, g) of each task's gradient by hot token, the intercept's under -1, from (_k, _y, _ids, _z, _mixed); and a
    row (_k, r) with the residual of each mixed text."""
    sent = docs.sparkSession.sparkContext.broadcast(w)
    typed = docs.select("_k", F.lit(0.0).cast("double").alias("r"), F.lit(0).alias("id"), F.lit(0.0).cast("double").alias("g")).schema
    for f in typed:
        f.nullable = True
    key = docs.select("_k", "_y", "_ids", "_z", "_mixed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, move = sent.value, 0.0
        total, kind = np.zeros(len(w)), None
        for batch in batches:
            row, ids = _row_of(batch.column(2)), batch.column(2).flatten().to_numpy(zero_copy_only=False)
            z = np.bincount(row, w[ids], batch.num_rows) + batch.column(3).to_numpy(zero_copy_only=False) + intercept
            r = 1 / (1 + np.exp(-z)) - batch.column(1).to_numpy(zero_copy_only=False)
            np.add.at(total, ids, r[row])
            move += float(r.sum())
            mixed, kind = batch.column(4), batch.column(0).type
            keys = batch.column(0).filter(mixed)
            if len(keys):
                none = [pa.nulls(len(keys), pa.int32()), pa.nulls(len(keys), pa.float64())]
                yield pa.RecordBatch.from_arrays([keys, pa.array(r).filter(mixed), *none], names=typed.names)
        if kind is not None:
            ids = np.concatenate([[-1], np.flatnonzero(total)]).astype(np.int32)
            g = np.concatenate([[move], total[ids[1:]]])
            for at in range(0, len(ids), SLICE):
                some = slice(at, at + SLICE)
                n = len(ids[some])
                yield pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.nulls(n, pa.float64()), pa.array(ids[some]), pa.array(g[some])], names=typed.names)

    return short_batches(key).mapInArrow(run, typed)


def fit(df: DataFrame, key: str, tokens: Column, target: str, *, alpha: float = 1.0, rounds: int = 30, tolerance: float = 1e-4, out: str) -> Model:
    """Weights from texts with a target of 0 or 1; others are left out. The table of weights is written to `out`, a folder.

    It stops when no weight has moved by more than tolerance. Each round's weights replace those of the round before.
    """
    spark = df.sparkSession
    texts = df.where(F.col(target).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(target).cast("double").alias("_y"), tokens.alias("_t"))
    share = (F.coalesce(F.size(F.filter("_t", lambda t: t.isNotNull())), F.lit(0)).cast("double") + 1) / 4
    # the share is written with the text: beside an explode it would be made again for each token
    with staged(texts.withColumn("_c", share)) as texts, staged(texts.select(F.col("_c").alias("c"), F.explode("_t").alias("token")).where("token is not null").groupBy("token").agg(F.sum("c").alias("curve"), F.count(F.lit(1)).alias("n"))) as curve:
        top = texts.agg(F.sum("_c").alias("curve"), F.count(F.lit(1)).alias("n")).first()
        if not top.n:
            raise ValueError("no texts to learn from")
        every = curve.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("tokens")).first()
        least = (every.n or 0) * HOT
        found = curve.where(F.col("n") > least).select("token", "curve").toPandas().sort_values("token")
        hot, bound = found["token"].tolist(), found["curve"].to_numpy(float)
        rare, any_rare = curve.where(F.col("n") <= least).select("token", "curve"), every.tokens > len(hot)
        w, b, weights = np.zeros(len(hot)), 0.0, None
        with staged(_coded(texts, hot)) as docs:
            loose = docs.select("_k", F.explode("_rest").alias("token"))
            for i in range(rounds):
                mixed = F.size("_rest") > 0
                plain = docs.withColumn("_z", F.lit(0.0)).withColumn("_mixed", mixed)
                if weights is not None:
                    z = loose.join(weights, "token").groupBy("_k").agg(F.sum("w").alias("_z"))
                    joined = docs.where(mixed).join(z, "_k", "left").withColumn("_z", F.coalesce("_z", F.lit(0.0))).withColumn("_mixed", F.lit(True))
                    plain = plain.where(~mixed).unionByName(joined)
                with staged(_pass(plain, w, b)) as made:
                    sums = made.where("id is not null").groupBy("id").agg(F.sum("g").alias("g")).toPandas()
                    g = np.zeros(len(hot) + 1)
                    g[sums["id"].to_numpy(int)] = sums["g"].to_numpy(float)  # the last one is the intercept's
                    move, step = g[-1] / top.curve, (g[:-1] + alpha * w) / (bound + alpha)
                    w, b, most = w - step, b - move, max([abs(move), *np.abs(step).max(initial=0.0, keepdims=True)])
                    if any_rare:
                        gradient = loose.join(made.where("id is null").select("_k", "r"), "_k").groupBy("token").agg(F.sum("r").alias("g"))
                        before = rare.withColumn("w", F.lit(0.0)) if weights is None else rare.join(weights, "token", "left")
                        by = (F.coalesce("g", F.lit(0.0)) + alpha * F.col("w")) / (F.col("curve") + alpha)
                        before.join(gradient, "token", "left").select("token", (F.col("w") - by).alias("w"), F.abs(by).alias("moved")).write.mode("overwrite").parquet(f"{out}/{i % 2}")
                        written = spark.read.schema("token string, w double, moved double").parquet(f"{out}/{i % 2}")
                        weights, most = written.select("token", "w"), max(most, written.agg(F.max("moved")).first()[0])
                if most <= tolerance:
                    break
    none = spark.createDataFrame([], "token string, w double")
    return Model(none if weights is None else weights, dict(zip(hot, w.tolist(), strict=True)), float(b), weights is not None)


def explain(df: DataFrame, key: str, tokens: Column, model: Model, *, padding: str | None = None) -> DataFrame:
    """key, parts (feature, phi, value) of each distinct token of a text, for selection.top_of_row, and odds: the intercept and
    all contributions. The token `padding` isn't shown, but counts. Texts without tokens have no parts.

    A text is explained in its row; only the weights of tokens that aren't hot, where there are any, are joined to it."""
    sent = df.sparkSession.sparkContext.broadcast(model.hot)
    few = "array<struct<token:string,w:double>>"
    source = df.select(F.col(key).alias("_k"), tokens.alias("_t"), F.array().cast(few).alias("_found"))
    if model.rare:
        coded = _coded(df.select(F.col(key).alias("_k"), F.lit(0.0).alias("_y"), tokens.alias("_t")).where("_k is not null"), list(model.hot))
        loose = coded.select("_k", F.explode(F.array_distinct("_rest")).alias("token"))
        found = loose.join(model.weights, "token").groupBy("_k").agg(F.collect_list(F.struct("token", "w")).alias("_found"))
        source = source.drop("_found").join(found, "_k", "left").select("_k", "_t", F.col("_found").cast(few).alias("_found"))
    parts = F.array().cast("array<struct<feature:string,phi:double,value:double>>")
    typed = source.select(F.col("_k").alias(key), parts.alias("parts"), F.lit(0.0).cast("double").alias("odds")).schema
    intercept = model.intercept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = sent.value
        for batch in batches:
            row, flat, n = _row_of(batch.column(1)), batch.column(1).flatten(), batch.num_rows
            there = flat.is_valid().to_numpy(zero_copy_only=False)
            row, coded, pairs = row[there], flat.drop_null().dictionary_encode(), batch.column(2).flatten()
            rare = dict(zip(pairs.field(0).to_pylist(), pairs.field(1).to_pylist(), strict=True))
            order = pc.sort_indices(coded.dictionary).to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            words = coded.dictionary.take(pa.array(order))
            w = np.array([hot[t] if t in hot else rare.get(t, 0.0) for t in words.to_pylist()], float)
            cell, count = np.unique(row * len(words) + place[coded.indices.to_numpy()], return_counts=True)
            at, word = np.divmod(cell, max(1, len(words)))
            value = count.astype(float)
            phi = value * w[word]
            odds = np.bincount(at, phi, n) + intercept
            feature = words.take(pa.array(word))
            if padding is not None:
                shown = pc.not_equal(feature, padding)
                kept = shown.to_numpy(zero_copy_only=False)
                at, phi, value, feature = at[kept], phi[kept], value[kept], feature.filter(shown)
            made = pa.StructArray.from_arrays([feature, pa.array(phi), pa.array(value)], names=["feature", "phi", "value"])
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(at, n, made), pa.array(odds)], names=typed.names)

    return short_batches(source).mapInArrow(run, typed)
