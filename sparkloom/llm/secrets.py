"""Secret scans in DataFrame functions only.

Base patterns give spans of assigned, access-key and hexadecimal secrets. Beside them the entropy method looks at
candidate strings, which are long runs of the characters of a class: over each window of a candidate the Shannon
entropy of its characters is kept up by adding the entering character's count and taking off the leaving one's, and a
candidate whose highest window reaches its class's threshold is a secret, unless the allow-list names its form. All
steps are linear in the text, so that a candidate of any length may come.

A null text counts as empty and has no spans. Repeated spans of different kinds all stay. Positions count code points.
A document column with the name of a result column is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import without

#: The base patterns. A value of an assignment has 6 characters at least.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Characters in a window, and the entropy in bits from which a class's candidate is a secret.
WINDOW = 20
CLASSES = {"entropy_hex": (r"[0-9A-Fa-f]{20,}", 3.05), "entropy_base64": (r"[A-Za-z0-9+/_=-]{20,}", 3.65)}
#: Forms that are no secrets: no digit or no letter, identifiers, joined words, paths, placeholders.
ALLOW = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    # letters, or up to six digits, joined by marks: said by what it doesn't have, as Java repeats groups by recursion
    r"^(?!.*(?:[A-Za-z][0-9]|[0-9][A-Za-z]|[0-9]{7}|[^A-Za-z0-9_/=-]))(?=[A-Za-z0-9]).*[-_/=].*[A-Za-z0-9]$",
    r"(?i)example|sample|dummy|placeholder|xxxx|0123456789|abcdefgh",
)
KINDS = ("assign", "access", "hex", *CLASSES)
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
#: Items that are folded at once, and characters of the pieces that a text is cut into.
BLOCK, PIECE = 256, 512


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once: Spark evaluates an expression anew wherever a lambda names it."""
    return F.get(F.transform(F.array(value), then), 0)


def running(values: Column, start: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """What combine has made of all values before each place, and of all; combine is associative and start its neutral.

    An array that grows is copied at each step, so it grows within blocks, and their results are combined.
    """
    last = lambda a: F.element_at(a, -1)
    grow = lambda a, v: F.concat(a, F.array(combine(last(a), v)))
    n = F.floor((F.size(values) + BLOCK - 1) / BLOCK).cast("int")
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.aggregate(F.slice(values, k * BLOCK + 1, BLOCK), F.array(start), grow))).otherwise(F.array(F.array(start)))

    def together(made: Column) -> Column:
        heads = F.aggregate(made, F.array(start), lambda a, b: grow(a, last(b)))
        return bound(heads, lambda h: F.concat(F.flatten(F.transform(made, lambda b, k: F.transform(F.slice(b, 1, F.size(b) - 1), lambda x: combine(F.get(h, k), x)))), F.array(last(h))))

    return bound(blocks, together)


def spans_of(text: Column, pattern: str, kind: str, wanted: Callable[[Column], Column]) -> Column:
    """The spans of a pattern's matches that are wanted: pieces between matches and matches add up to positions."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def placed(z: Column) -> Column:
        sizes = F.transform(z, lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0)))
        ends = running(sizes, F.lit(0), lambda a, b: a + b)
        good = lambda x: F.coalesce(wanted(x["m"]), F.lit(False))
        span = lambda e, x, i: F.when(good(x), F.struct((F.get(e, i) + F.length(x["p"])).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.get(e, i + 1).alias("end"), F.lit(kind).alias("kind")))
        return bound(ends, lambda e: F.filter(F.transform(z, lambda x, i: span(e, x, i)), lambda s: s.isNotNull()))

    return F.when(text.rlike(pattern), bound(parts, placed)).otherwise(F.array().cast(SPAN))


def top_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The highest entropy in bits over all windows; 0 for a candidate shorter than one.

    The accumulator carries the window and the sum of c * log2(c) over its characters' counts c. A step changes two
    counts, that of the character which leaves and that of the one which enters, so it costs as much as the window is
    long, and a candidate as much as it is long.
    """
    term = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    start = F.struct(F.lit("").alias("w"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    count = lambda w, c: F.length(w) - F.length(F.replace(w, c, F.lit("")))

    def step(a: Column, c: Column) -> Column:
        full = F.length(a["w"]) >= window
        old = F.substring(a["w"], 1, 1)
        left = bound(count(a["w"], old), lambda n: F.get(term, n - 1) - F.get(term, n))
        rest = F.when(full, F.substring(a["w"], 2, window)).otherwise(a["w"])
        kept = F.when(full, a["sum"] + left).otherwise(a["sum"])
        return bound(
            F.struct(rest.alias("w"), kept.alias("sum"), count(rest, c).alias("n")),
            lambda k: bound(
                F.struct(F.concat(k["w"], c).alias("w"), (k["sum"] + F.get(term, k["n"] + 1) - F.get(term, k["n"])).alias("sum")),
                lambda now: F.struct(
                    now["w"].alias("w"),
                    now["sum"].alias("sum"),
                    F.greatest(a["best"], F.when(F.length(now["w"]) == window, math.log2(window) - now["sum"] / window).otherwise(0.0)).alias("best"),
                ),
            ),
        )

    return F.aggregate(F.split(candidate, ""), start, step, lambda a: a["best"])


def scan(docs: DataFrame, *, text: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Adds secret_spans: the base patterns' spans and the entropy method's, by start, then kind."""
    whole = F.coalesce(F.col(text), F.lit(""))
    allowed = lambda m: m.rlike("|".join(f"(?:{a})" for a in allow))
    hexes = CLASSES["entropy_hex"][0]
    named = without(docs, "secret_spans").withColumns({
        "_assign": spans_of(whole, ASSIGN, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
        "_access": spans_of(whole, ACCESS, "access", lambda m: m.isNotNull()),
        "_hex": spans_of(whole, HEX, "hex", lambda m: m.isNotNull()),
        "_entropy_hex": spans_of(whole, hexes, "entropy_hex", lambda m: F.when(~allowed(m), top_entropy(m) >= CLASSES["entropy_hex"][1])),
        # a run of hexadecimal digits alone belongs to that class
        "_entropy_base64": spans_of(whole, CLASSES["entropy_base64"][0], "entropy_base64", lambda m: F.when(~allowed(m) & ~m.rlike(f"^{hexes}$"), top_entropy(m) >= CLASSES["entropy_base64"][1])),
    })
    parts = ["_assign", "_access", "_hex", "_entropy_hex", "_entropy_base64"]
    return named.withColumn("secret_spans", F.array_sort(F.concat(*parts))).drop(*parts)


def merged(spans: Column) -> Column:
    """(start, end) of the stretches that spans, in order, cover: one begins where all spans before have ended."""

    def stretches(far: Column) -> Column:
        begins = F.filter(F.transform(spans, lambda s, i: F.when(s["start"] > F.get(far, i), i)), lambda i: i.isNotNull())
        end = lambda b, k: F.get(far, F.coalesce(F.get(b, k + 1), F.size(spans)))
        return bound(begins, lambda b: F.transform(b, lambda i, k: F.struct(F.get(spans, i)["start"].alias("start"), end(b, k).alias("end"))))

    return bound(running(F.transform(spans, lambda s: s["end"]), F.lit(-1), lambda a, b: F.greatest(a, b)), stretches)


def redact(docs: DataFrame, *, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Puts mark in place of every stretch that secret_spans covers; null texts stay null.

    The text is cut into pieces once, and what stands between the stretches is taken from the pieces.
    """
    t = F.col(f"`{text}`")
    pieces = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def gap(p: Column, low: Column, high: Column) -> Column:
        part = lambda j: F.get(p, j).substr(F.greatest(low - j * PIECE, F.lit(0)) + 1, F.least(high - j * PIECE, F.lit(PIECE)) - F.greatest(low - j * PIECE, F.lit(0)))
        return F.when(high > low, F.array_join(F.transform(F.sequence(F.floor(low / PIECE).cast("int"), F.floor((high - 1) / PIECE).cast("int")), part), "")).otherwise("")

    def clean(s: Column) -> Column:
        lows = F.concat(F.array(F.lit(0)), F.transform(s, lambda x: x["end"]))
        highs = F.concat(F.transform(s, lambda x: x["start"]), F.array(F.length(t)))
        gaps = bound(F.arrays_zip(lows.alias("a"), highs.alias("b")), lambda z: bound(pieces, lambda p: F.transform(z, lambda g: gap(p, g["a"], g["b"]))))
        return F.array_join(gaps, mark)

    return docs.withColumn(text, F.when(F.size("secret_spans") > 0, bound(merged(F.col("secret_spans")), clean)).otherwise(t))


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns."""
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    spans = F.col("secret_spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return df.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(line(F.filter(spans, lambda s: s["rank"] < 3)), 256).alias("base_sha256"), line(spans).alias("spans"),
    )
