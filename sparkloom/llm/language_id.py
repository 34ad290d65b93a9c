"""Language identification by nearest centroids.

A text's vector holds TF-IDF weights of its byte n-grams of one to three letters, hashed to DIM places and of length 1.
Each language has several centroids, found by spherical k-means; the prediction is the language of the centroid with the
highest cosine, and the score is that cosine. A document is rejected if it has no letter, or lies farther from every
centroid than nearly all training texts by a wide margin.

Training reads a bounded sample: at most PER_LANGUAGE rows of each language, those of least hash of doc_id and text, so it
doesn't depend on how rows are laid out. Null texts and texts
without a letter are `und` with score 0 and rejected; so is everything if nothing can be learned. Rows with a null
language are predicted, not learned from. A column of docs with the name of a result column is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import map_texts

DIM = 2048
CENTROIDS = 4
PER_LANGUAGE = 1000
#: A text is rejected below this share of the cosine that one in QUANTILE training texts stays under.
REJECT_SHARE = 0.5
QUANTILE = 0.002
UNKNOWN = "und"
#: ASCII that is no letter becomes a space.
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def counts(text: str) -> np.ndarray:
    """How often each place's n-grams occur."""
    b = np.frombuffer(b" " + text.lower().encode().translate(_LETTERS) + b" ", np.uint8).astype(np.uint32)
    out = np.zeros(DIM, np.int64)
    codes = b
    for n in (1, 2, 3):
        if n > 1:
            codes = (codes[:-1] << np.uint32(8)) | b[n - 1 :]
        places = ((codes + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(21)
        out += np.bincount(places, minlength=DIM)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def weigh(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(rows) * idf
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def clusters(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means; starts with rows that lie far apart."""
    centres = [x.mean(0)]
    while len(centres) < min(k, len(x)):
        centres.append(x[(x @ np.array(centres).T).max(1).argmin()])
    c = np.array(centres)
    for _ in range(rounds):
        home = (x @ c.T).argmax(1)
        c = np.array([x[home == i].mean(0) if (home == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(docs: DataFrame, trains: Column, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, k: int = CENTROIDS) -> dict | None:
    """idf, centroids, their languages and the rejection threshold; None if there is nothing to learn from."""
    rows = docs.where(trains & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # a row for each language
    if not sizes:
        return None
    share = F.create_map(*[x for name, n in sizes.items() for x in (F.lit(name), F.lit((per_language + 8 * per_language**0.5) / n))])[F.col(lang)]
    place = F.pmod(F.xxhash64(doc_id), F.lit(1 << 20)) / float(1 << 20)
    drawn = rows.where(place <= share).select(F.col(lang).alias("lang"), place.alias("place"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))

    def make():
        def work(texts):
            good = [x.decode() if x else None for x in texts]
            return {"counts": [np.minimum(counts(t), 65535).astype("<u2").tobytes() if has_letter(t) else None for t in good]}

        return work

    counted = map_texts(drawn, make, [T.StructField("counts", T.BinaryType())], keep=["lang", "place", "tie"]).where("counts is not null")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place", "tie"))
    sample = counted.withColumn("_n", first).where(F.col("_n") <= per_language).orderBy("lang", "_n").toPandas()
    if not len(sample):
        return None
    raw = np.stack([np.frombuffer(x, "<u2") for x in sample["counts"]])
    idf = np.log((1 + len(raw)) / (1 + (raw > 0).sum(0))) + 1
    x = weigh(raw, idf)
    centres, names, near = [], [], []
    for name, at in sorted(sample.groupby("lang").indices.items()):
        c = clusters(x[at], k)
        centres.append(c)
        names += [name] * len(c)
        near.append((x[at] @ c.T).max(1))
    return {"idf": idf, "centres": np.concatenate(centres).T.copy(), "names": names, "least": REJECT_SHARE * float(np.quantile(np.concatenate(near), QUANTILE))}


def predict(docs: DataFrame, model: dict | None, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score and rejected. The model has a few vectors for each language and is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]

    def make():
        m = shared.value

        def work(texts):
            good = [x.decode() if x else None for x in texts]
            at = [i for i, t in enumerate(good) if m and has_letter(t)]
            names, scores, out = [UNKNOWN] * len(good), [0.0] * len(good), [True] * len(good)
            for k in range(0, len(at), 256):
                part = at[k : k + 256]
                cosine = weigh(np.stack([counts(good[i]) for i in part]), m["idf"]) @ m["centres"]
                for i, j, c in zip(part, cosine.argmax(1).tolist(), cosine.max(1).tolist(), strict=True):
                    names[i], scores[i], out[i] = m["names"][j], min(1.0, max(0.0, c)), c < m["least"]
            return {"lang_pred": names, "score": scores, "rejected": out}

        return work

    return map_texts(docs, make, fields, text, keep)


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


__all__ = ["fit", "held_out", "predict"]
