"""Fill-in-middle texts from a scan for events.

A text's units are runs of ASCII letters and single other characters. One Aho-Corasick automaton looks for the events:
its patterns are the changes between a letter and another character and the sentinels. It works on classes of
characters: each character of a sentinel is a class of its own, and all that isn't ASCII is one with the other marks.
No pattern is longer than a sentinel, so a state follows from as many last characters, and numpy steps all places of a
text through the automaton's table at once.

Between two events a stretch is one unit, if of letters, or as many as it has characters. Sums over these stretches give
the number of units and, by binary search, the place after any number of them; a text without letters has one stretch.

The cuts and the form of a row come from the SHA-256 of a seed and the decimal doc_id, so they don't depend on how rows
are dealt; rows with the same doc_id draw the same numbers, and a null doc_id hashes as no digits. A null or empty text
is plain. Texts of any length go through the automaton a chunk at a time. A column with a result's name is replaced.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sparkloom.llm.common import short_batches, slices

#: Sentinels before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Characters that are scanned at once.
CHUNK = 1 << 20
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_CHANGE, _MARK = 1, 2


class Events:
    """The automaton: finds changes of class and sentinels."""

    def __init__(self, marks: tuple[str, ...] = MARKS):
        own = sorted({c for m in marks for c in m})
        if not all(marks) or any(ord(c) > 127 for c in own):
            raise ValueError("sentinels must be of ASCII characters")
        # classes: 0 other characters, 1 other letters, then each character of a sentinel
        self.kind = np.zeros(129, np.uint8)
        for c in _LETTERS:
            self.kind[ord(c)] = 1
        for i, c in enumerate(own):
            self.kind[ord(c)] = i + 2
        self.is_letter = np.array([False, True, *(c in _LETTERS for c in own)])
        kinds = range(len(self.is_letter))
        patterns = [([x, y], _CHANGE) for x in kinds for y in kinds if self.is_letter[x] != self.is_letter[y]]
        patterns += [([int(self.kind[ord(c)]) for c in m], _MARK) for m in marks]
        self.depth = max(len(p) for p, _ in patterns)
        self._build(patterns, len(kinds))

    def _build(self, patterns: list[tuple[list[int], int]], width: int) -> None:
        """Trie, links to the longest proper suffix, and the table of steps that follows them."""
        children: list[dict[int, int]] = [{}]
        found = [0]
        for pattern, what in patterns:
            state = 0
            for k in pattern:
                if k not in children[state]:
                    children[state][k] = len(children)
                    children.append({})
                    found.append(0)
                state = children[state][k]
            found[state] |= what
        self.step = np.zeros((len(children), width), np.int16)
        suffix, queue = [0] * len(children), deque([0])
        while queue:
            state = queue.popleft()
            found[state] |= found[suffix[state]]
            for k in range(width):
                after = int(self.step[suffix[state], k]) if state else 0
                if k in children[state]:
                    child = children[state][k]
                    suffix[child] = after
                    self.step[state, k] = child
                    queue.append(child)
                else:
                    self.step[state, k] = after
        self.found = np.array(found, np.uint8)

    def scan(self, text: str) -> tuple[np.ndarray, bool, bool]:
        """Where stretches start and the last one ends, whether the first is of letters, and whether a sentinel was seen."""
        bounds, marked = [np.zeros(1, np.int64)], False
        for start in range(0, len(text), CHUNK):
            back = min(self.depth - 1, start)
            points = np.frombuffer(text[start - back : start + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
            kinds = self.kind[np.minimum(points, 128)]
            state = np.zeros(len(kinds), np.int16)
            for lag in range(self.depth - 1, -1, -1):
                state[lag:] = self.step[state[lag:], kinds[: len(kinds) - lag]]
            found = self.found[state]
            marked = marked or bool((found & _MARK).any())
            at = np.flatnonzero(found & _CHANGE)
            bounds.append(at[at >= back] + (start - back))
        bounds.append(np.array([len(text)] if text else [], np.int64))
        return np.concatenate(bounds), bool(text) and text[0] in _LETTERS, marked


class Units:
    """Number and places of a text's units, from its events."""

    def __init__(self, bounds: np.ndarray, letters_first: bool):
        self.bounds = bounds
        sizes = np.diff(bounds)
        sizes[0 if letters_first else 1 :: 2] = 1
        self.sums = np.concatenate([[0], np.cumsum(sizes)])

    def __len__(self) -> int:
        return int(self.sums[-1])

    def end_of(self, n: int) -> int:
        """The place after the first n units."""
        i = int(np.searchsorted(self.sums, n, side="right")) - 1
        return int(self.bounds[i] + n - self.sums[i])


def draws(doc_id: int | None, seed: str) -> list[int]:
    """Four numbers of 32 bits."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def restore(output: str, form: str, marks: tuple[str, ...] = MARKS) -> str:
    """The text from which an output was made; its parts hold no sentinels, so the first of each is the one that was set."""
    p, s, m = marks
    if form == "plain":
        return output
    if form == "psm":
        prefix, _, rest = output.removeprefix(p).partition(s)
        suffix, _, middle = rest.partition(m)
    else:
        suffix, _, rest = output.removeprefix(s).partition(p)
        prefix, _, middle = rest.partition(m)
    return prefix + middle + suffix


def fill_in_middle(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    seed: str = "1",
    plain_percent: int = 10,
    spm_percent: int = 20,
    marks: tuple[str, str, str] = MARKS,
    with_output: bool = True,
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds n, form, prefix_chars, middle_chars, output (with_output), output_sha256 and restored_sha256.

    keep names the columns that stay beside them (all, by default). plain_percent of the rows stay plain, and of the
    others spm_percent have the suffix first.
    """
    fields = [
        T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType()), T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType()),
    ]
    fields = [f for f in fields if with_output or f.name != "output"]
    new = {f.name for f in fields}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{doc_id}`").cast("long").alias("_fim_id"), F.col(f"`{text}`").cast("binary").alias("_fim_text"))
    schema = T.StructType([source.schema[i] for i in range(len(kept))] + fields)
    types = [to_arrow_type(f.dataType) for f in fields]
    width = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events = Events(marks)
        digest = lambda t: hashlib.sha256(t.encode("utf-8", "surrogateescape")).hexdigest()
        for batch in batches:
            for part in slices(batch, "_fim_text"):
                made: dict[str, list] = {f.name: [] for f in fields}
                for i, data in zip(part.column(width).to_pylist(), part.column(width + 1).to_pylist(), strict=True):
                    whole = (data or b"").decode("utf-8", "surrogateescape")
                    bounds, letters_first, marked = events.scan(whole)
                    units = Units(bounds, letters_first)
                    n = len(units)
                    h1, h2, h3, h4 = draws(i, seed)
                    form, out, low, high = "plain", whole, None, None
                    if whole and not marked and h3 % 100 < 100 - plain_percent:
                        low, high = (units.end_of(h) for h in sorted((h1 % (n + 1), h2 % (n + 1))))
                        form = "spm" if h4 % 100 < spm_percent else "psm"
                        prefix, middle, suffix = whole[:low], whole[low:high], whole[high:]
                        p, s, m = marks
                        out = f"{s}{suffix}{p}{prefix}{m}{middle}" if form == "spm" else f"{p}{prefix}{s}{suffix}{m}{middle}"
                    row = {
                        "n": n, "form": form, "prefix_chars": low, "middle_chars": None if low is None else high - low, "output": out,
                        "output_sha256": digest(out), "restored_sha256": digest(restore(out, form, marks)),
                    }
                    for name, values in made.items():
                        values.append(row[name])
                if with_output:
                    made["output"] = [t.encode("utf-8", "surrogateescape") for t in made["output"]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(width)] + [pa.array(made[f.name], t) for f, t in zip(fields, types, strict=True)], names=[*kept, *made]
                )

    return short_batches(source).mapInArrow(run, schema)
