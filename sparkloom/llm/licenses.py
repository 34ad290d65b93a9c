"""Licence scans in DataFrame functions only, by an index of the rare words of licence texts.

A template is a licence's notice or, for the base labels, a phrase of its name. Postings say at which places a word
stands in which templates; each template is indexed by its words of the highest IDF, by how many documents of the whole
corpus have them (a notice by ANCHORS of them, a phrase by one). A document's words that the index has give starts: the
place of a word less its place in the template. At each start the template's other indexed words are looked for where they
should stand, SLACK words to either side for a notice, at the very place for a phrase. A notice's share is that of
the IDF of its indexed words that stand there; one of MIN_SHARE or more counts if all its mandatory key phrases stand in the
stretch of words that it would cover. A phrase counts if all its words stand there.

A start costs as much as a template is long, so a document costs as much as it is long. A null text counts as empty and has no words. A
document may have several labels and the same one at many places; n_base counts all places of the phrases. Repeated
rows are scanned each for itself. Over an empty table all IDFs are equal. A column with a result's name is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import without
from sparkloom.llm.secrets import bound

#: The pattern of words, and the phrases of the base labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Parts of well-known licences' notices, as words, and the phrases that each must have.
NOTICES = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        ("free of charge", "deal in the software without restriction"),
    ),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license", "in compliance with the license")),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        ("general public license", "free software foundation"),
    ),
    ("gpl", "licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "with or without modification")),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ("with or without fee", "this permission notice appear in all copies"),
    ),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "licensed under the creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
)
#: Words by which a notice is indexed, words to either side of their places, and the least share of a notice that counts.
ANCHORS, SLACK, MIN_SHARE = 6, 3, 0.75
RESULTS = ("n_words", "license_places", "labels", "score")


@dataclass(frozen=True)
class Template:
    """words, the places of the words by which it is indexed, with their IDFs, and its key phrases; exact for a phrase."""

    label: str
    words: tuple[str, ...]
    anchors: tuple[tuple[str, int, float], ...]
    keys: tuple[str, ...]
    exact: bool


def words_of(text: str) -> Column:
    lower = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def fit(docs: DataFrame, *, text: str = "text", notices: tuple = NOTICES, phrases: dict[str, str] = PHRASES, anchors: int = ANCHORS) -> list[Template]:
    """The templates, indexed by the words that fewest documents have; of equally rare ones the first in the template.

    What the driver gets is a number for each word of the templates.
    """
    texts = [(label, tuple(notice.split()), keys, False) for label, notice, keys in notices] + [(label, tuple(phrase.split()), (phrase,), True) for phrase, label in phrases.items()]
    vocabulary = sorted({w for _, words, _, _ in texts for w in words})
    has = F.array_distinct(F.filter(words_of(text), lambda w: w.isin(vocabulary)))
    number = {r.word: r.n for r in docs.select(F.explode(F.concat(has, F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    idf = {w: math.log((number.get("", 0) + 1) / (number.get(w, 0) + 1)) + 1e-9 for w in vocabulary}
    made = []
    for label, words, keys, exact in texts:
        first = {w: words.index(w) for w in words}
        rarest = sorted(first, key=lambda w: (-idf[w], first[w]))[: 1 if exact else anchors]  # noqa: B023
        made.append(Template(label, words, tuple((w, first[w], idf[w]) for w in rarest), keys, exact))
    return made


def _starts(hits: Column, t: Template) -> Column:
    """Where the template would start, by each of its indexed words."""
    offset = F.create_map(*[F.lit(x) for w, at, _ in t.anchors for x in (w, at)])
    own = F.filter(hits, lambda h: h["w"].isin([w for w, _, _ in t.anchors]))
    return F.array_distinct(F.transform(own, lambda h: h["i"] - F.element_at(offset, h["w"])))


def _window(words: Column, start: Column, size: Column) -> Column:
    """Words from start, which may lie before the first one, to start + size."""
    low = F.greatest(start, F.lit(0))
    return F.slice(words, low + 1, F.greatest(start + size - low, F.lit(0)))


def _places(words: Column, hits: Column, t: Template) -> Column:
    """(start, label, share, exact) of the template's places."""
    whole = F.array(*map(F.lit, t.words))
    found = lambda s, share: F.struct(s.alias("start"), F.lit(t.label).alias("label"), share.alias("share"), F.lit(t.exact).alias("exact"))
    if t.exact:
        return F.transform(F.filter(_starts(hits, t), lambda s: (s >= 0) & (_window(words, s, F.lit(len(t.words))) == whole)), lambda s: found(s, F.lit(1.0)))
    index = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(at).alias("at"), F.lit(idf).alias("idf")) for w, at, idf in t.anchors])
    total = math.fsum(idf for _, _, idf in t.anchors)

    def share(s: Column) -> Column:
        there = lambda a: F.array_contains(_window(words, s + a["at"] - SLACK, F.lit(2 * SLACK + 1)), a["w"])
        return F.aggregate(index, F.lit(0.0), lambda sum_, a: sum_ + F.when(there(a), a["idf"]).otherwise(0.0)) / total

    def verified(s: Column) -> Column:
        stretch = F.concat(F.lit(" "), F.array_join(_window(words, s - SLACK, F.lit(len(t.words) + 2 * SLACK)), " "), F.lit(" "))
        return bound(stretch, lambda x: F.forall(F.array(*[F.lit(f" {k} ") for k in t.keys]), lambda k: F.contains(x, k)))

    shares = F.transform(_starts(hits, t), lambda s: found(s, share(s)))
    return F.filter(shares, lambda x: (x["share"] >= MIN_SHARE) & verified(x["start"]))


def scan(docs: DataFrame, templates: list[Template], *, text: str = "text") -> DataFrame:
    """Adds n_words, license_places (start, label, share, exact) in order, labels (distinct, in order) and score, the largest share of a
    place (0 without one)."""
    vocabulary = sorted({w for t in templates for w, _, _ in t.anchors})
    words, hits = F.col("_words"), F.col("_hits")
    numbered = F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w")))
    places = F.when(F.size(hits) > 0, F.array_sort(F.concat(*[_places(words, hits, t) for t in templates])))
    none = F.array().cast("array<struct<start:int,label:string,share:double,exact:boolean>>")
    scanned = without(docs, *RESULTS).withColumn("_words", words_of(text)).withColumn("_hits", F.filter(numbered, lambda h: h["w"].isin(vocabulary)))
    return (
        scanned.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("license_places", F.coalesce(places, none))
        .withColumn("labels", F.array_sort(F.array_distinct(F.transform("license_places", lambda x: x["label"]))))
        .withColumn("score", F.coalesce(F.array_max(F.transform("license_places", lambda x: x["share"])), F.lit(0.0)))
        .drop("_words", "_hits")
    )


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns."""
    base = F.filter("license_places", lambda x: x["exact"])
    starts = F.transform(base, lambda x: x["start"].cast("long"))
    return df.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda x: x["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score",
    )
