"""Plain single-process versions of the corpus operators, to compare with."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in often for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def shingles(text, size):
    words = WORD.findall((text or "").translate(_FOLD))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def union_find(nodes, edges):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def near_components(rows, size, threshold):
    """doc_id -> (n_shingles, component) by comparing every pair that shares a shingle."""
    sets = {d: shingles(t, size) for d, t in rows}
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    shared = Counter()
    for ds in where.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                shared[a, b] += 1
    edges = [(a, b) for (a, b), n in shared.items() if 100 * n >= threshold * (len(sets[a]) + len(sets[b]) - n)]
    comp = union_find(list(sets), edges)
    return {d: (len(sets[d]), comp[d]) for d in sets}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    digits = lambda m: re.sub(r"[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, text) if ok(m.group())] for k, (p, ok) in kinds.items()}


def span_string(spans):
    return ",".join(f"{k}:{s}:{e}" for k in spans for s, e in spans[k])


def substring_dedup(rows, length):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256 of the rest)."""
    least: dict[bytes, int] = {}
    data = {d: (t or "").encode() for d, t in rows}
    for d, b in sorted(data.items()):
        for i in range(len(b) - length + 1):
            least.setdefault(b[i : i + length], d)
    out = {}
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeated_chunks(rows, cut, least_run):
    """doc_id -> [(start, end)]: runs of adjacent chunks (by ``cut``, ends of the chunks) that a smaller doc_id has."""
    first, parts = {}, {}
    for d, t in sorted(rows):
        data, low, parts[d] = (t or "").encode(), 0, []
        for end in cut(data):
            parts[d].append((low, end, data[low:end]))
            first.setdefault(data[low:end], d)
            low = end
    out = {}
    for d, chunks in parts.items():
        runs = []
        for low, end, body in chunks:
            if first[body] < d:
                if runs and runs[-1][1] == low:
                    runs[-1][1] = end
                else:
                    runs.append([low, end])
        if runs := [(a, b) for a, b in runs if b - a >= least_run]:
            out[d] = runs
    return out
