"""Text functions as expressions: cleaning, spacing, accents, pre-tokens and standardisation."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code point ranges of ideographs, the pattern of pre-tokens, the runs of marks that stand apart in
# standardised text, and the marks that are made plain there.
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

RUNS = r"(-+|~+|!+|\"+|;+|\?+|\++|,+|\)+|\(+|\\+|/+|\*+|\[+|\]+|\}+|\{+|\|+|_+)"
PLAIN = {"—": "-", "–": "-", "―": "-", "…": "...", "´": "'"}


def clean(text: Column) -> Column:
    """Without NUL, U+FFFD and control characters; each white space becomes a space."""
    spaced = F.regexp_replace(text, r"[\t\n\r\p{Zs}]", " ")
    return F.regexp_replace(spaced, r"[\x{0}\x{FFFD}\p{C}]", "")


def _beyond(text: Column, first: str, changed: Callable[[Column], Column]) -> Column:
    """changed, for texts with a character from this one on; others have none that would change. One range is quick to look
    for. The text is bound, so that it isn't made anew at each place where it stands."""
    here = f"[\\x{{{ord(first):X}}}-\\x{{10FFFF}}]"
    return F.get(F.transform(F.array(text), lambda t: F.when(t.rlike(here), changed(t)).otherwise(t)), 0)


def space_ideographs(text: Column) -> Column:
    return _beyond(text, "\u3400", lambda t: F.regexp_replace(t, f"([{CJK}])", " $1 "))


#: Syllables of Hangul decompose by rule: their first one, and how many of their first, second and third parts there are.
HANGUL, LEADS, VOWELS, TAILS = 0xAC00, 19, 21, 28


@cache
def accents() -> tuple[str, str, str, dict[str, str]]:
    """Letters whose canonical decomposition, marks left out, is one letter; these letters; the marks; and characters, other
    than Hangul, that leave several."""
    pairs, marks, several = [], [], {}
    for c in map(chr, (i for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000 and not HANGUL <= i < HANGUL + LEADS * VOWELS * TAILS)):
        kept = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(kept) > 1:
            several[c] = kept
        elif not kept:
            marks.append(c)
        elif kept != c:
            pairs.append((c, kept))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs), "".join(marks), several


def _syllables(text: Column) -> Column:
    """Syllables of Hangul as their parts."""
    part = lambda first, n: F.array(*[F.lit(chr(first + i)) for i in range(n)])

    def parts(c: Column) -> Column:
        i = F.ascii(c) - HANGUL
        tail = F.when(i % TAILS > 0, F.get(part(0x11A7, TAILS), i % TAILS)).otherwise("")
        return F.concat(F.get(part(0x1100, LEADS), F.floor(i / (VOWELS * TAILS)).cast("int")), F.get(part(0x1161, VOWELS), F.floor(i % (VOWELS * TAILS) / TAILS).cast("int")), tail)

    known = f"[{chr(HANGUL)}-{chr(HANGUL + LEADS * VOWELS * TAILS - 1)}]"
    return _beyond(text, chr(HANGUL), lambda t: F.when(t.rlike(known), F.array_join(F.transform(F.split(t, ""), lambda c: F.when(c.rlike(known), parts(c)).otherwise(c)), "")).otherwise(t))


def strip_accents(text: Column) -> Column:
    """Canonically decomposed, without combining marks."""
    letters, bases, marks, several = accents()
    split = lambda t: F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in several.items() for x in p]), c), c)), "")
    whole = _beyond(text, min(several), lambda t: F.when(t.rlike("[" + "".join(several) + "]"), split(t)).otherwise(t))
    return _syllables(_beyond(whole, min(letters + marks), lambda t: F.translate(t, letters + marks, bases)))


def space_punctuation(text: Column) -> Column:
    """Spaces around ASCII symbols and all of Unicode's punctuation."""
    return F.regexp_replace(text, r"([!-/:-@\[-`{-~\p{P}])", " $1 ")


def basic_tokens(text: Column, lower: bool = True) -> Column:
    """Cleaned, spaced, lower-cased, stripped of accents, and split at white space and punctuation; null has no tokens."""
    out = space_ideographs(clean(F.coalesce(text, F.lit(""))))
    if lower:
        out = strip_accents(F.lower(out))
    return F.filter(F.split(space_punctuation(out), r"\s+"), lambda w: w != "")


def pre_tokens(text: Column) -> Column:
    """Contractions, words, numbers, runs of symbols and white space; joined they are the text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({PRE_TOKENS})"), F.lit(1))


# Contractions, words, digits and runs of symbols.
CASED_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cased_words(text: Column) -> Column:
    """Lower-cased words, single digits and runs of symbols, without white space."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({CASED_WORDS})"), F.lit(1))


def standardise(text: Column) -> Column:
    """Plain dashes, ellipses and quotes, spaces around runs of symbols and line ends, single spaces."""
    out = text
    for mark, plain in PLAIN.items():
        out = F.replace(out, F.lit(mark), F.lit(plain))
    out = F.regexp_replace(out, RUNS, " $1 ")
    out = F.regexp_replace(out, r"\s*\n\s*", " \n ")
    return F.trim(F.regexp_replace(out, r"[^\S\n]+", " "))


def with_ends(tokens: Column, end: str = "<eos>", start: str | None = None) -> Column:
    return F.concat(*([F.array(F.lit(start))] if start else []), tokens, F.array(F.lit(end)))


def clock(seconds: Column, offset_hours: int = 8) -> Column:
    """HH:MM:SS of an epoch in seconds at a fixed offset."""
    s = F.pmod(seconds.cast("long") + offset_hours * 3600, F.lit(86400))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


# What is tidied up, in this order, in text that was joined from pieces.
TIDY = (
    ("<unk>", ""), (" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"), (" 'm", "'m"), (" do not", " don't"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re"),
)


def joined_pieces(pieces: Column, end: str = "</w>", tidy: bool = True) -> Column:
    """The text of pieces whose last in a word carries an end mark."""
    out = F.trim(F.replace(F.array_join(pieces, ""), F.lit(end), F.lit(" ")))
    for a, b in TIDY if tidy else ():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
