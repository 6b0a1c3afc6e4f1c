"""One document chunk parsed by recompression: runs and pairs of names, level by level.

Every symbol carries the stretch of words that alone decides that it forms (its context). Two
equal stretches of words therefore hold the same symbols wherever a context lies inside.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from assayworks.llm.common import mix

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class Sums:
    """Names of word stretches from prefix sums, independent of where a stretch lies."""

    def __init__(self, names: np.ndarray) -> None:
        n = len(names)
        powers = np.ones(n + 1, np.uint64)
        powers[1:] = BASE
        np.cumprod(powers, out=powers)
        back = np.ones(n + 1, np.uint64)
        back[1:] = BASE_INVERSE
        self.back = np.cumprod(back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(names * powers[:n], out=self.sums[1:])

    def stretch(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mix((self.sums[last] - self.sums[first]) * self.back[first] + (last - first).astype(np.uint64))


class Anchors(NamedTuple):
    """Chosen symbols: their contexts, and the windows that chose each of their levels."""

    first: np.ndarray
    last: np.ndarray
    level: np.ndarray
    window_level: np.ndarray


def levels(names: np.ndarray, doc_of: np.ndarray, rounds: int):
    """Yield (context first, context last) of all symbols, level by level.

    Level 0 are the words, level 1 names runs of equal words, each later level names pairs: a
    name's parity in that round says left or right, and a left one merges with a right one after it.
    Contexts that would need a word outside the document reach over its edge, so no window holds them.
    """
    n = len(names)
    first, last = np.arange(n), np.arange(1, n + 1)
    doc, name = doc_of, names
    yield first, last
    # Runs: a new symbol starts where the name or the document changes.
    starts = np.empty(n, bool)
    starts[0] = True
    starts[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(starts)
    ends = np.append(at[1:], n)
    length = (ends - at).astype(np.uint64)
    doc = doc[at]
    name = np.where(length > 1, mix(name[at] * BASE + length), name[at])
    # The words before and after a run show that it is whole.
    first, last = at - 1, ends + 1
    yield first, last
    for level in range(2, rounds + 1):
        m = len(name)
        if m < 2:
            return
        left = (mix(name + np.uint64(level)) & np.uint64(1)).astype(bool)
        pairs = np.zeros(m, bool)
        pairs[:-1] = left[:-1] & ~left[1:] & (doc[:-1] == doc[1:])
        second = np.zeros(m, bool)
        second[1:] = pairs[:-1]
        # An unmerged symbol needs to see the neighbour that left it alone.
        new_first, new_last = first.copy(), last.copy()
        edge_after = np.ones(m, bool)
        edge_after[:-1] = doc[:-1] != doc[1:]
        edge_before = np.ones(m, bool)
        edge_before[1:] = edge_after[:-1]
        alone_left, alone_right = left & ~pairs, ~left & ~second
        see = np.flatnonzero(alone_left[:-1])
        new_last[see] = np.maximum(new_last[see], last[see + 1])
        see = np.flatnonzero(alone_right[1:]) + 1
        new_first[see] = np.minimum(new_first[see], first[see - 1])
        new_last[alone_left & edge_after] += np.int64(1 << 40)
        new_first[alone_right & edge_before] -= np.int64(1 << 40)
        both = np.flatnonzero(pairs)
        new_first[both] = np.minimum(first[both], first[both + 1])
        new_last[both] = np.maximum(last[both], last[both + 1])
        new_name = name.copy()
        new_name[both] = mix(name[both] * BASE + mix(name[both + 1]) + np.uint64(level))
        keep = ~second
        first, last, name, doc = new_first[keep], new_last[keep], new_name[keep], doc[keep]
        yield first, last


def anchors(names: np.ndarray, ends: np.ndarray, window: int, rounds: int) -> Anchors:
    """For each window the symbols of the highest level whose context it holds.

    ``ends`` are the documents' ends. Equal windows choose equal symbols, since the choice
    depends on nothing outside the window. Windows that no document holds have level -1.
    """
    n = len(names)
    doc_of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    doc_end = ends[doc_of]
    windows = np.arange(n) + window <= doc_end
    window_level = np.full(n, -1)
    todo = windows.copy()
    chosen = []
    doc_start = (ends - np.diff(ends, prepend=0))[doc_of]
    for level, (first, last) in reversed(list(enumerate(levels(names, doc_of, rounds)))):
        usable = np.flatnonzero((last - first <= window) & (first >= 0) & (last <= n))
        first, last = first[usable], last[usable]
        inside = (first >= doc_start[first]) & (last <= doc_end[first])
        # A run's context may reach into a neighbour document.
        first, last = first[inside], last[inside]
        low, high = np.maximum(last - window, doc_start[first]), first
        marks = np.zeros(n + 1, np.int64)
        np.add.at(marks, low, 1)
        np.add.at(marks, high + 1, -1)
        fresh = (np.cumsum(marks)[:n] > 0) & todo
        window_level[fresh] = level
        todo &= ~fresh
        counts = np.concatenate([[0], np.cumsum(fresh)])
        hit = counts[high + 1] > counts[low]
        chosen.append((first[hit], last[hit], np.full(int(hit.sum()), level)))
    parts = [np.concatenate(x) for x in zip(*chosen, strict=True)]
    return Anchors(*parts, window_level)
