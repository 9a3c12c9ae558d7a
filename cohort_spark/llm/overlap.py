"""T-occurrence search within one task: which sets share enough elements.

The sets are inverted to lists of set numbers per element. For a query with n elements, a partner
must appear on at least T of its n lists. Following DivideSkip, the longest lists are set apart (L of
them, fewer than T): the short ones are merged, sets that appear on T - L of them are candidates,
and each candidate is looked up in the long lists by binary search. The merge is one sort of all
short lists, which counts exactly as a heap of list heads does.
"""

from __future__ import annotations

import numpy as np

# A list is long when it has this many times the entries of the shortest lists together.
LONG = 8
PERCENT = 80


def required(n: np.ndarray | int, percent: int = PERCENT):
    """The least overlap that a set of ``n`` elements can have with a linked one."""
    return -(-percent * n // 100)


def linked(overlap: np.ndarray, n: int, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The link rule on whole numbers."""
    return 100 * overlap >= percent * (n + m - overlap)


class Lists:
    """Inverted lists of some sets. Sets are numbered by size, and lists hold numbers in order."""

    def __init__(self, elements: np.ndarray, sizes: np.ndarray) -> None:
        """``elements`` holds the sets one after the other, ``sizes`` (ascending) their lengths."""
        self.sizes, self.count = sizes, len(sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        self.known, code = np.unique(elements, return_inverse=True)
        order = np.argsort(code, kind="stable")
        self.members = owner[order]
        self.keys = code[order] * self.count + self.members
        self.first = np.searchsorted(code[order], np.arange(len(self.known) + 1))

    def partners(self, query: np.ndarray, lowest: int = 0, percent: int = PERCENT) -> np.ndarray:
        """Numbers from ``lowest`` on of the sets linked to ``query``."""
        n = len(query)
        need = int(required(n, percent))
        place = np.searchsorted(self.known, query)
        place = place[self.known[np.minimum(place, len(self.known) - 1)] == query]
        if len(place) < need:
            return np.zeros(0, np.int64)
        length = self.first[place + 1] - self.first[place]
        by_length = np.argsort(length, kind="stable")
        place, length = place[by_length], length[by_length]
        # A partner misses at most n - T lists, so it is on one of the first lists in this order.
        sure = len(place) - need + 1
        bound = min(self.count, int(length[:sure].sum()))
        short = max(sure, int(np.searchsorted(length, LONG * bound, side="right")))
        low, size = self.first[place[:short]], length[:short]
        take = np.arange(int(size.sum())) + np.repeat(low - (np.cumsum(size) - size), size)
        seen = np.bincount(self.members[take], minlength=self.count)
        seen[:lowest] = 0
        seen[(100 * self.sizes < percent * n) | (percent * self.sizes > 100 * n)] = 0
        found = np.flatnonzero(seen >= max(1, need - (len(place) - short)))
        overlap = seen[found]
        if short < len(place) and len(found):
            probes = (place[short:, None] * self.count + found[None, :]).ravel()
            at = np.minimum(np.searchsorted(self.keys, probes), len(self.keys) - 1)
            overlap = overlap + (self.keys[at] == probes).reshape(-1, len(found)).sum(axis=0)
        return found[linked(overlap, n, self.sizes[found], percent)]
