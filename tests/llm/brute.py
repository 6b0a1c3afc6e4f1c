"""Plain loops that say what the operators must find."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode().split()


class Union:
    def __init__(self, items) -> None:
        self.parent = {i: i for i in items}

    def root(self, i):
        while self.parent[i] != i:
            i = self.parent[i]
        return i

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def without_repeats(rows, window=20):
    """{doc_id: (n_words, n_removed, digest)} for rows (doc_id, text) with distinct ids."""
    first: dict = {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(text)
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s:s + window]), (doc, s))
    out = {}
    for doc, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[s:s + window])] < (doc, s):
                gone[s:s + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[doc] = len(w), sum(gone), hashlib.sha256(kept).hexdigest()
    return out


def near_duplicates(rows, size=5, percent=75):
    """{doc_id: (n_shingles, component_id, kept)}."""
    sets, where = {}, defaultdict(list)
    for doc, text in rows:
        w = [x.lower() for x in words(text)]
        sets[doc] = {tuple(w)} if 0 < len(w) < size else {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}
    union = Union(sets)
    for doc in sorted(sets):
        shared = Counter(other for s in sets[doc] for other in where[s])
        for other, n in shared.items():
            if 100 * n >= percent * (len(sets[doc]) + len(sets[other]) - n):
                union.join(doc, other)
        for s in sets[doc]:
            where[s].append(doc)
    return {d: (len(sets[d]), union.root(d), union.root(d) == d) for d in sets}
