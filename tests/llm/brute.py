"""Plain versions of the contracts, text by text, for the tests."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def lower_az(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def personal(text: str | None) -> tuple[list[int], list[str]]:
    """Counts and spans of the base kinds."""
    text = text or ""

    def digits(m):
        return re.sub("[^0-9]", "", m[0])

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0

    found = {
        "email": list(EMAIL.finditer(text)),
        "ip": [m for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15],
    }
    return [len(v) for v in found.values()], [f"{k}:{m.start()}:{m.end()}" for k, v in found.items() for m in v]


def shingles(text: str | None, n: int = 5) -> frozenset:
    w = WORD.findall(lower_az(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1)))


def similar_components(rows: list[tuple[int, str | None]], percent: int = 75) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest doc_id reachable)."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    holders: dict = {}
    for i in ids:
        meets = Counter(j for g in sets[i] for j in holders.get(g, ()))
        for j, k in meets.items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
        for g in sets[i]:
            holders.setdefault(g, []).append(i)
    return {i: (len(sets[i]), find(i)) for i in ids}


def without_repeats(rows: list[tuple[int, str | None]], size: int = 50) -> dict[int, tuple[int, int, str]]:
    """doc_id -> (words, removed words, sha256 of what is kept)."""
    words = {i: WORD.findall(t or "") for i, t in rows}
    first: dict = {}
    for i in sorted(words):
        for k in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][k:k + size]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k:k + size])] < i:
                gone[k:k + size] = [True] * size
        out[i] = (len(w), sum(gone), sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out
