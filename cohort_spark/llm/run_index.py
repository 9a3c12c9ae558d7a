"""Run-length index of short byte strings: a run-compressed Burrows-Wheeler transform.

The strings are sorted by all their suffixes, each string closed by a mark of its own. Only the runs
of the transform are kept: where each begins and how far its rows move in one backward step. Rows
whose suffixes share ``length`` bytes form an interval; an interval keeps the smallest owner among
its suffixes, sampled at its ends. Streaming a string backwards through the runs yields the row, and
so the interval, of every window without the suffix array. Two directories name the run and the
interval of a row, so a step looks nothing up by search.
"""

from __future__ import annotations

import numpy as np

# Symbols, marks included, that one index can hold: three fields of 21 bits fit one sorting key.
FIELD = 21
LARGEST = 1 << FIELD
# Symbols that an index is best filled with: its arrays stay in a processor's cache.
GOOD = 1 << 17


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Sort keys that end in their place; places in order, rank per place, and whether all differ."""
    keys.sort()
    order = (keys & np.uint64(LARGEST - 1)).astype(np.int64)
    head = keys >> np.uint64(FIELD)
    new = np.empty(len(keys), bool)
    new[0] = False
    np.not_equal(head[1:], head[:-1], out=new[1:])
    rank = np.empty(len(keys), np.uint64)
    rank[order] = np.cumsum(new).astype(np.uint64)
    return order, rank, bool(new[1:].all())


class RunIndex:
    """Index over ``strings``, with an owner (document) for each."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, owners: np.ndarray, length: int) -> None:
        """``data`` holds the strings one after the other, ``sizes`` their lengths."""
        count, n = len(sizes), len(data) + len(sizes)
        if n > LARGEST:
            raise ValueError(f"{n} symbols in one index, {LARGEST} are possible")
        self.length, self.sizes = length, sizes
        self.ends = np.cumsum(sizes + 1) - 1
        text = np.empty(n, np.int64)
        inside = np.ones(n, bool)
        inside[self.ends] = False
        text[inside] = data.astype(np.int64) + count
        text[self.ends] = np.arange(count)
        order, kept = self._sort(text)
        self._compress(text, order, count)
        self._intervals(kept, order, owners)

    def _sort(self, text: np.ndarray) -> tuple[np.ndarray, tuple[int, np.ndarray]]:
        """Suffix order by doubling; ranks of the largest depth within ``length`` are kept."""
        n = len(text)
        place = np.arange(n, dtype=np.uint64)
        symbol = text.astype(np.uint64)
        bits = int(text.max()).bit_length()
        depth = max(1, min(self.length, (64 - FIELD) // bits))
        keys = symbol.copy()
        for step in range(1, depth):
            keys <<= np.uint64(bits)
            keys[: n - step] |= symbol[step:]
        order, rank, done = _ranked((keys << np.uint64(FIELD)) | place)
        kept = (depth, rank)
        while not done:
            after = np.zeros(n, np.uint64)
            after[: n - depth] = rank[depth:]
            keys = (((rank << np.uint64(FIELD)) | after) << np.uint64(FIELD)) | place
            order, rank, done = _ranked(keys)
            depth *= 2
            if depth <= self.length:
                kept = (depth, rank)
        return order, kept

    def _compress(self, text: np.ndarray, order: np.ndarray, count: int) -> None:
        before = text[order - 1]
        new = np.ones(len(before), bool)
        np.not_equal(before[1:], before[:-1], out=new[1:])
        self.starts = np.flatnonzero(new)
        heads = before[self.starts]
        lengths = np.diff(np.append(self.starts, len(before)))
        # Rows move to their symbol's block: all smaller symbols, then earlier runs of the same one.
        by_symbol = np.argsort(heads, kind="stable")
        target = np.empty(len(heads), np.int64)
        target[by_symbol] = np.cumsum(lengths[by_symbol]) - lengths[by_symbol]
        self.moves = target - self.starts
        self.run_of = np.repeat(np.arange(len(heads), dtype=np.int32), lengths)

    def _intervals(self, kept: tuple[int, np.ndarray], order: np.ndarray, owners: np.ndarray) -> None:
        """Neighbouring suffixes share ``length`` bytes when the kept depth agrees at both ends of them.

        A depth of less than half is the last one only when all suffixes differ at it.
        """
        depth, rank = kept
        same = np.zeros(len(order) - 1, bool)
        if 2 * depth >= self.length:
            last = np.minimum(order + (self.length - depth), len(order) - 1)
            same = (rank[order[1:]] == rank[order[:-1]]) & (rank[last[1:]] == rank[last[:-1]])
        head = np.concatenate([[True], ~same])
        whose = np.repeat(owners, self.sizes + 1)[order]
        self.smallest = np.minimum.reduceat(whose, np.flatnonzero(head))
        self.interval_of = np.cumsum(head, dtype=np.int32) - 1

    def stream(self) -> np.ndarray:
        """For each window of ``length`` bytes of each string, in order, the smallest owner of an equal one.

        All strings go backwards together, one byte a step.
        """
        windows = np.maximum(self.sizes - self.length + 1, 0)
        offset = np.cumsum(windows) - windows
        out = np.empty(int(windows.sum()), self.smallest.dtype)
        by_size = np.argsort(-self.sizes, kind="stable")
        sizes = self.sizes[by_size]
        last = (offset + self.sizes)[by_size]
        row = by_size.copy()
        for step in range(1, int(sizes[0]) + 1 if len(sizes) else 1):
            going = int(np.searchsorted(-sizes, -step, side="right"))
            row = row[:going]
            row = row + self.moves[self.run_of[row]]
            if step >= self.length:
                out[last[:going] - step] = self.smallest[self.interval_of[row]]
        return out
