"""Plain versions of the operators, for comparison with small tables."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from math import log


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def secrets(text: str | None) -> dict:
    text, found = text or "", []
    for kind, (pattern, wanted) in enumerate((
        (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 6),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern.replace("(?i:", "(?ia:"), text) if wanted(m)]
    names = ("assign", "access", "hex")
    return {f"n_{k}": sum(f[1] == i for f in found) for i, k in enumerate(names)} | {
        "base_sha256": sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(found)))
    }


def all_secrets(text: str | None) -> list[tuple[int, str, int]]:
    """Base spans and those of the entropy method, by start, then kind: windows counted anew, the allow-list word by word."""
    from collections import Counter

    text = text or ""
    kinds = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
    level = lambda w: max(-sum(c / 20 * log(c / 20, 2) for c in Counter(w[i : i + 20]).values()) for i in range(len(w) - 19))

    def allowed(w: str) -> bool:
        words = re.split("[-_/=]+", w)
        joined = len(words) > 1 and all(re.fullmatch("[A-Za-z]+|[0-9]{1,6}", x) for x in words)
        uuid = re.fullmatch("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", w)
        named = any(x in w.lower() for x in ("example", "sample", "dummy", "placeholder", "xxxx", "0123456789", "abcdefgh"))
        return not any("0" <= c <= "9" for c in w) or not re.search("[A-Za-z]", w) or bool(joined or uuid or named)

    found = []
    for kind, (pattern, wanted) in enumerate((
        (r"(?ia:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 6),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
        (r"[0-9A-Fa-f]+", lambda m: len(m[0]) >= 20 and not allowed(m[0]) and level(m[0]) >= 3.05),
        (r"[A-Za-z0-9+/_=-]+", lambda m: len(m[0]) >= 20 and not re.fullmatch("[0-9A-Fa-f]+", m[0]) and not allowed(m[0]) and level(m[0]) >= 3.65),
    )):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if wanted(m)]
    return [(a, kinds[k], b) for a, k, b in sorted(found)]


def redacted(text: str | None, mark: str = "[SECRET]") -> str | None:
    if text is None:
        return None
    out, stretches = [], []
    for a, _, b in all_secrets(text):
        if stretches and a <= stretches[-1][1]:
            stretches[-1][1] = max(b, stretches[-1][1])
        else:
            stretches.append([a, b])
    at = 0
    for a, b in stretches:
        out.append(text[at:a])
        at = b
    return mark.join([*out, text[at:]])


def contamination(docs: dict[int, str | None], items: dict[int, str | None]) -> dict[int, tuple]:
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows: dict[tuple, set] = {}
    for i, t in items.items():
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes = {len(k) for k in windows}
    out = {}
    for d, t in docs.items():
        w, hit, got = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (who := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    got |= who
        out[d] = (len(w), len(hit), len(got), sha(",".join(sorted(got))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def byte_bpe(ranks_path: str, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def of(text: str | None) -> tuple:
        ids = enc.encode_ordinary(text or "")
        return len(ids), sha(",".join(map(str, ids))), sha((text or "").encode())

    return of


def word_ids(tokenizer_path: str, docs: dict[int, str | None]) -> dict[int, tuple]:
    from tokenizers import Tokenizer

    tok, start, out = Tokenizer.from_file(tokenizer_path), 0, {}
    for d in sorted(docs):
        ids = [*tok.encode(docs[d] or "", add_special_tokens=False).ids, 2]
        out[d] = (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    return out


def shard_of(key: int, tree: list, weights: dict[int, float] | None = None) -> int:
    """Down the tree, at each level into the option of least draw."""
    import xxhash

    def leaves(node) -> list[int]:
        return [node] if isinstance(node, int) else [s for x in node for s in leaves(x)]

    def draw(node, level: int) -> float:
        h = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        for p in (level, leaves(node)[0]):
            h = xxhash.xxh64_intdigest(struct.pack("<i", p), h)
        return -log(((h & ((1 << 52) - 1)) + 0.5) / (1 << 52)) / sum((weights or {}).get(s, 1.0) for s in leaves(node))

    for level in range(3):
        tree = min(tree, key=lambda node: draw(node, level))
    return tree


def quality_score(model: dict, text: str | None) -> float:
    """The model's score from features counted one by one; n-grams are placed as the operator places them."""
    import numpy as np

    from sparkloom.llm import quality

    raw = (text or "").encode()
    words, lines, n = raw.split(), raw.split(b"\n"), max(1, len(raw))
    m = max(1, len(words))
    is_in = lambda chars: sum(chr(c) in chars for c in raw)
    upper, lower, digit = sum(65 <= c <= 90 for c in raw), sum(97 <= c <= 122 for c in raw), sum(48 <= c <= 57 for c in raw)
    space, marks, high = is_in("\t\n\r "), is_in(".,;:'\"?-"), sum(c >= 128 for c in raw)
    other = len(raw) - upper - lower - digit - space - marks - high
    x = np.array([
        upper / max(1, upper + lower + high), lower / n, digit / n, space / n, marks / n, other / n, high / n, max((raw.count(c) for c in set(raw)), default=0) / n,
        min(40, (n - space) / m) / 10, log(1 + m) / 10, len(set(words)) / m, sum(a == b for a, b in zip(words, words[1:])) / m, 1 - len(set(lines)) / len(lines), log(1 + len(lines)) / 10,
        raw.count(b"!") / m, other / m,
    ], np.float32)
    row = np.concatenate([x, np.sqrt(np.abs(x)), x * x, quality.ngrams([raw])[0]])[None, :]
    return float(1 / (1 + np.exp(-np.clip(model["scale"](row) @ model["w"], -30, 30)))[0])


def nearest_language(model: dict, text: str | None) -> tuple[str, float, bool]:
    """Counts of n-grams in a dictionary, and a cosine with each centroid."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0, True
    letters = lambda b: bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in b)
    b, places = letters(b" " + text.lower().encode() + b" "), {}
    for n in (1, 2, 3):
        for i in range(len(b) - n + 1):
            code = int.from_bytes(b[i : i + n], "big")
            place = ((code + n) * 2654435761 & 0xFFFFFFFF) >> 21
            places[place] = places.get(place, 0) + 1
    x = {p: log(1 + c) * float(model["idf"][p]) for p, c in places.items()}
    length = sum(v * v for v in x.values()) ** 0.5
    cosines = [sum(v * float(model["centres"][p, j]) for p, v in x.items()) / length for j in range(len(model["names"]))]
    top = max(range(len(cosines)), key=cosines.__getitem__)
    return model["names"][top], min(1.0, max(0.0, cosines[top])), cosines[top] < model["least"]


def removed(docs: list[tuple[int, str | None]], size: int) -> dict[int, tuple]:
    """Bytes covered by strings of this size that also start earlier."""
    seen: set[bytes] = set()
    out = {}
    for d, t in sorted(docs):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - size + 1):
            if raw[i : i + size] in seen:
                gone[i : i + size] = b"\1" * size
            else:
                seen.add(raw[i : i + size])
        spans = len(re.findall(b"\1+", gone))
        out[d] = (len(raw), sum(gone), spans, sha(bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return out


def shingles(text: str | None, n: int = 5) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def jaccard_components(docs: dict[int, str | None]) -> dict[int, tuple]:
    sets = {d: shingles(t) for d, t in docs.items()}
    up = {d: d for d in docs}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    owners: dict[tuple, list] = {}
    for d in sorted(docs):
        shared: dict[int, int] = {}
        for s in sets[d]:
            for o in owners.setdefault(s, []):
                shared[o] = shared.get(o, 0) + 1
            owners[s].append(d)
        for o, n in shared.items():
            if 100 * n >= 75 * (len(sets[d]) + len(sets[o]) - n):
                a, b = top(d), top(o)
                up[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), top(d)) for d in docs}


def fill_in_middle(doc_id: int | None, text: str | None) -> dict:
    """Units cut by a pattern, joined again around two of their borders."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, h = len(units), sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    row = {"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None, "output_sha256": sha(text), "restored_sha256": sha(text)}
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return row
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return row | {"form": form, "prefix_chars": len(p), "middle_chars": len(m), "output_sha256": sha(out)}


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def collocations(rows: list[tuple[str | None, str | None]], least: int, percent: int, longest: int, top: int) -> set[tuple]:
    """rows of (text, lang): every phrase counted, all longer ones asked, all cuts scored."""
    from collections import Counter, defaultdict

    counts: dict[str, Counter] = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts["und" if lang is None else lang][tuple(words[i : i + k])] += 1
    out = set()
    for lang, f in counts.items():
        n = sum(c for w, c in f.items() if len(w) == 1)
        candidates = {w: c for w, c in f.items() if len(w) > 1 and c >= least}
        kept = []
        for w, a in candidates.items():
            inside = lambda v: any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))  # noqa: B023, E731
            if any(len(v) > len(w) and 100 * b >= percent * a and inside(v) for v, b in candidates.items()):
                continue
            score, _, l, r = min((2_000_000 * a // (f[w[:k]] + f[w[k:]]), k, f[w[:k]], f[w[k:]]) for k in range(1, len(w)))
            kept.append((-score, -a, " ".join(w).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return out


def license_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def licenses(texts: list[str | None], notices, phrases: dict[str, str], anchors: int, slack: int, least: float) -> list[dict]:
    """Every place of every template: IDFs counted anew, each start tried, shares and key phrases by lists of words."""
    words = [license_words(t) for t in texts]
    vocabulary = {w for _, t, _ in notices for w in t.split()} | {w for p in phrases for w in p.split()}
    df = {w: sum(w in set(ws) for ws in map(set, words)) for w in vocabulary}
    idf = {w: log((len(texts) + 1) / (df[w] + 1)) + 1e-9 for w in vocabulary}
    out = []
    for ws in words:
        places = []
        for phrase, label in phrases.items():
            p = phrase.split()
            places += [(i, label, 1.0, True) for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
        for label, notice, keys in notices:
            t = notice.split()
            first = {w: t.index(w) for w in t}
            index = sorted(first, key=lambda w: (-idf[w], first[w]))[:anchors]  # noqa: B023
            for start in {i - first[w] for i, w in enumerate(ws) if w in index}:
                near = lambda w: ws[max(start + first[w] - slack, 0) : max(start + first[w] + slack + 1, 0)]  # noqa: B023, E731
                share = sum(idf[w] for w in index if w in near(w)) / sum(idf[w] for w in index)
                stretch = " ".join(["", *ws[max(start - slack, 0) : max(start + len(t) + slack, 0)], ""])
                if share >= least and all(f" {k} " in stretch for k in keys):
                    places.append((start, label, share, False))
        base = sorted(i for i, _, _, exact in places if exact)
        out.append({
            "n_words": len(ws), "n_base": len(base), "first_word": base[0] if base else None, "last_word": base[-1] if base else None,
            "base_labels": ",".join(sorted({k for _, k, _, exact in places if exact})), "labels": ",".join(sorted({p[1] for p in places})), "score": max((p[2] for p in places), default=0.0),
        })
    return out
