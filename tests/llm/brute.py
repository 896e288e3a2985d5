"""Plain Python versions of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACE = rb"[\x20\x09-\x0D]+"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def held(doc_id, fold: int) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == fold


def shingles(text: str | None, width: int) -> frozenset:
    w = words(text)
    if 0 < len(w) < width:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def near_components(docs: list[tuple], width: int, percent: int) -> list[int]:
    """Component number of every row of (doc_id, text), from all pairs."""
    sets = [shingles(t, width) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(docs))]


def digest(text: str | None) -> str:
    return hashlib.sha256(re.sub(SPACE, b" ", (text or "").encode())).hexdigest()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """The plain patterns of the contract."""
    text = text or ""

    def digits(m):
        return re.sub("[^0-9]", "", m.group())

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m)]


def base_scores(docs: list[tuple], fold: int) -> list[tuple]:
    """(n_tokens, n_known, train_tokens, base_score) of every row."""
    tokens = [[*words(t), b"\n"] for _, t in docs]
    counts: Counter = Counter()
    for (i, _), t in zip(docs, tokens, strict=True):
        if not held(i, fold):
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    return [
        (len(t), sum(counts[x] > 0 for x in t), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t))
        for t in tokens
    ]


def mix_targets(sizes: dict) -> dict:
    """Targets by sharing the excess again until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total >= 2.0 * sizes[s]]
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            open_.remove(s)
        left -= sum(target[s] for s in full)
    return target


def by_key(rows, key: str) -> dict:
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out
