"""Periodic runs of words, found by uniting suffixes in descending order of common prefix.

A run is a longest stretch of words with smallest period q and at least ``exponent`` periods. Words q
apart are equal in it, so the suffixes at its start s and at s + q share length - q words. Suffixes
that share at least L words form a class; going down from the largest L, a union-find joins classes
whose neighbours in the suffix order share L words, and each class keeps its positions in order.
Positions that become neighbours at distance d within L words seed a run of period d and length
d + L: no class member lies between them, so no smaller period fits, and L is exactly how far they
agree, so the run ends there. A seed whose preceding words agree as well is the inside of a run that
another seed starts, and is left out.

Suffix order and common prefixes come from prefix doubling over all texts of a piece at once; the words
of each text have numbers of their own, so no class spans two texts. Texts in which no five words (a
run's share at the least exponent of 4 and six words) return near enough are not sorted at all.

Each row is worked on by itself: no shuffle, and a task holds one piece of about 2 MB, or one longer
text (about 100 bytes a word, more by 4 bytes a word for each doubling of its longest repeat).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_spark.llm import bytes as B

EXPONENT = 4
LEAST_WORDS = 6

FOUND = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _near_repeats(word: np.ndarray, before: np.ndarray, shared: int, exponent: int) -> np.ndarray:
    """Texts in which some ``shared`` words return within 1 / ``exponent`` of the text."""
    n = np.diff(before)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(word) - shared + 1) if len(word) >= shared else np.zeros(0, np.int64)
    at = at[doc[at] == doc[at + shared - 1]]
    key = B.mix(B.grams(word, shared)[at] ^ B.mix(doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    near = exponent * (at[same + 1] - at[same]) <= n[doc[at[same]]]
    return np.unique(doc[at[same[near]]])


def suffix_order(code: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions in the order of their suffixes, and each doubling's ranks.

    Ranks of doubling k are equal where 2^k words are; the last ranks are all different.
    """
    size = len(code)
    order = np.argsort(code, kind="stable")
    ranks: list[np.ndarray] = []

    def numbered(active: np.ndarray, first: np.ndarray, begins: np.ndarray, rank: np.ndarray) -> np.ndarray:
        # Every group is numbered by its first place in the order, so groups that are single keep theirs.
        head = np.flatnonzero(begins)
        rank[active] = np.repeat(first[head], np.diff(np.append(head, len(active))))
        return rank

    place = np.arange(size)
    begins = np.ones(size, bool)
    begins[1:] = code[order[1:]] != code[order[:-1]]
    rank = numbered(order, place, begins, np.empty(size, np.int64))
    width = 1
    while True:
        ranks.append(rank.astype(np.int32 if size < 2**31 else np.int64))
        ends = np.append(begins[1:], True)
        open_places = np.flatnonzero(~(begins & ends))
        if not len(open_places):
            return order, ranks
        active = order[open_places]
        ahead = active + width
        second = np.where(ahead < size, rank[np.minimum(ahead, size - 1)] + 1, 0)
        by = np.argsort(rank[active] * (size + 1) + second, kind="stable")
        active, second = active[by], second[by]
        order[open_places] = active
        old = rank[active]
        now = np.ones(len(active), bool)
        now[1:] = (old[1:] != old[:-1]) | (second[1:] != second[:-1])
        begins[open_places] = now
        rank = numbered(active, open_places, now, rank.copy())
        width *= 2


def common_prefixes(left: np.ndarray, right: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """How many words the suffixes at ``left`` and ``right`` share."""
    size, shared = len(ranks[0]), np.zeros(len(left), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        a, b = left + shared, right + shared
        inside = np.maximum(a, b) < size
        a, b = np.minimum(a, size - 1), np.minimum(b, size - 1)
        shared += np.where(inside & (ranks[k][a] == ranks[k][b]), 1 << k, 0)
    return shared


def seeds(left: list[int], right: list[int], shared: list[int], exponent: int) -> list[tuple[int, int, int]]:
    """(position, distance, shared words) of positions that become neighbours within their shared words.

    The pairs come in descending order of shared words; a pair joins the classes of its two positions.
    """
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    found = []
    for i, j, words in zip(left, right, shared, strict=True):
        a, b = find(i), find(j)
        large, small = members.pop(a, None) or [a], members.pop(b, None) or [b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        reach = words // (exponent - 1)
        last = -1
        for at, x in enumerate(small, 1):
            k = bisect_left(large, x)
            # Two members of the smaller class were neighbours before, with more words in common.
            if k and (y := large[k - 1]) != last and x - y <= reach:
                found.append((y, x - y, words))
            if k < len(large) and (y := large[k]) - x <= reach and (at == len(small) or y < small[at]):
                found.append((x, y - x, words))
            large.insert(k, x)
            last = x
        parent[b] = a
        members[a] = large
    return found


def find_runs(word: np.ndarray, before: np.ndarray, *, exponent: int = EXPONENT, least: int = LEAST_WORDS) -> np.ndarray:
    """Rows of (text, start, length, period) of all runs, in this order.

    ``word`` has a hash of every word of all texts and ``before`` the n + 1 numbers of words before
    each text.
    """
    # A run of period 1 shares least - 1 words with itself one further on, a longer one more.
    shared = max(1, min(least - 1, 2 * (exponent - 1)))
    docs = _near_repeats(word, before, shared, exponent)
    none = np.zeros((0, 4), np.int64)
    if not len(docs):
        return none
    n = np.diff(before)[docs]
    base = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(docs)), n)
    picked = word[np.arange(len(owner)) - np.repeat(base - before[docs], n)]
    _, number = np.unique(picked, return_inverse=True)
    code = owner * (int(number.max()) + 1) + number
    order, ranks = suffix_order(code)
    left, right = order[:-1], order[1:]
    words = common_prefixes(left, right, ranks)
    keep = np.flatnonzero(words >= shared)
    keep = keep[np.argsort(-words[keep], kind="stable")]
    rows = seeds(left[keep].tolist(), right[keep].tolist(), words[keep].tolist(), exponent)
    if not rows:
        return none
    start, period, agree = np.array(rows, np.int64).T
    first = (start == 0) | (code[start - 1] != code[start + period - 1])
    good = first & (agree + period >= np.maximum(least, exponent * period))
    start, period, agree = start[good], period[good], agree[good]
    text = owner[start]
    out = np.stack([docs[text], start - base[text], agree + period, period], axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _collapse(data: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray, dropped: np.ndarray) -> pa.Array:
    """The texts without dropped words, joined by one space."""
    kept = np.flatnonzero(~dropped)
    doc = np.searchsorted(before, kept, side="right") - 1
    joined = kept[:-1][doc[1:] == doc[:-1]]
    edges = np.zeros(len(data) + 1, np.int8)
    edges[starts[kept]] += 1
    np.add.at(edges, ends[kept], -1)
    stays = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
    out = data.copy()
    # The byte after a word that another one follows is white space of the same text.
    stays[ends[joined]] = True
    out[ends[joined]] = 0x20
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(stays, out=sums[1:])
    offsets = sums[at]
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(offsets), pa.py_buffer(out[stays]))


def runs_of(texts: pa.Array, *, exponent: int = EXPONENT, least: int = LEAST_WORDS) -> list[pa.Array]:
    """Words, runs and collapsed text of every text."""
    data, at = B.raw(texts)
    starts, ends, before, mask = B.words(data, at, B.NOT_SPACE)
    found = find_runs(B.hashes(data, mask, starts, ends), before, exponent=exponent, least=least)
    edges = np.zeros(len(starts) + 1, np.int64)
    first = before[found[:, 0]] + found[:, 1]
    np.add.at(edges, first + found[:, 3], 1)
    np.add.at(edges, first + found[:, 2], -1)
    dropped = np.cumsum(edges[:-1]) > 0
    cut = np.searchsorted(found[:, 0], np.arange(len(at)))
    parts = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], fields=list(_RUN))
    runs = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), parts)
    return [pa.array(np.diff(before)), runs, _collapse(data, at, starts, ends, before, dropped).cast(pa.string())]


def periodic_runs(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", exponent: int = EXPONENT, least: int = LEAST_WORDS
) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: each row's runs by start and period, and its text without repeats.

    A word is dropped from the collapsed text if any run has it after the run's first period.
    ``exponent`` is 2 at least.

    Defined cases: a null or empty text has no words, no runs and an empty collapsed text; repeated
    rows, and rows without ``doc_id``, are each worked on by themselves; equal runs cannot occur twice,
    and overlapping runs are all returned; an empty table gives an empty one; further columns are not
    read.
    """
    if exponent < 2:
        raise ValueError("a run has at least two periods")
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in B.pieces(batch, "text"):
                out = runs_of(piece.column("text"), exponent=exponent, least=least)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *out], names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(work, f"doc_id {kind}, {FOUND}")
