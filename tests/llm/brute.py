"""Plain, slow versions of the operators, from their contracts alone."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text: str | None, n: int = 5) -> frozenset:
    words = WORD.findall(lower_ascii(text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def near_components(docs: list[tuple[int, str | None]], percent: int = 85) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, component), comparing every two sets that share a shingle."""
    sets = {d: shingles(x) for d, x in docs}
    distinct: dict[frozenset, int] = {}
    parent = {d: d for d in sets}

    def root(d: int) -> int:
        while parent[d] != d:
            parent[d] = d = parent[parent[d]]
        return d

    def join(a: int, b: int) -> None:
        a, b = sorted((root(a), root(b)))
        parent[b] = a

    for d in sorted(sets):
        if sets[d]:
            join(d, distinct.setdefault(sets[d], d))
    post = defaultdict(list)
    for s, d in distinct.items():
        shared = Counter(e for x in s for e in post[x])
        for e, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[e]) - both):
                join(d, e)
        for x in s:
            post[x].append(d)
    return {d: (len(sets[d]), root(d)) for d in sets}


def repeats_removed(docs: list[tuple[int, str | None]], n: int = 20) -> dict[int, tuple[int, int, str]]:
    """doc_id -> (words, removed words, digest of what is kept)."""
    seen, out = set(), {}
    for d, text in sorted(docs):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - n + 1):
            window = tuple(words[i : i + n])
            if window in seen:
                gone[i : i + n] = [True] * n
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[d] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out
