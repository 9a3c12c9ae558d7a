"""Words and hashes of many texts at once, on the bytes of an Arrow column.

A text column arrives as one buffer of UTF-8 and one of offsets. Every rule used here (lower case of
A-Z, white space, ASCII letters and digits) is a rule on single bytes, so words are found with a
256-entry table over the whole buffer and nothing is decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that are worked on at once; one longer text is one piece.
PIECE_BYTES = 1 << 21

_SPACES = [0x20, *range(0x09, 0x0E)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[_SPACES] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on all bits."""
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


_POWERS = np.cumprod(np.full(1 << 12, _A, np.uint64), dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(1 << n.bit_length(), _A, np.uint64), dtype=np.uint64)
    return _POWERS


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, text: str, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``size`` bytes of text each."""
    _, at = raw(batch.column(text))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, side="right")) - 1)
        yield batch.slice(first, last - first)
        first = last
    # Workers live on between tasks: what Arrow keeps for later would add up over the stages of a job.
    pa.default_memory_pool().release_unused()


def words(
    data: np.ndarray, at: np.ndarray, inside: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts: starts, ends (exclusive), words before each text (n + 1), and the byte mask.

    ``inside`` is the 256-entry table of word bytes. A word never crosses two texts.
    """
    mask = inside[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64), mask
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    opens = mask.copy()
    opens[1:] &= ~mask[:-1] | edge[1:-1]
    closes = mask.copy()
    closes[:-1] &= ~mask[1:] | edge[1:-1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, at), mask


def hashes(data: np.ndarray, mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word; equal words have equal hashes wherever they stand.

    ``mask`` marks exactly the bytes of the words.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    first = np.zeros(len(length), np.int64)
    np.cumsum(length[:-1], out=first[1:])
    letters = data[mask].astype(np.uint64) + np.uint64(1)
    within = np.arange(len(letters), dtype=np.int64)
    within -= np.repeat(first, length)
    letters *= _powers(int(length.max()) + 1)[within]
    return mix(np.add.reduceat(letters, first) ^ length.astype(np.uint64))


def grams(word: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words, by its first word; n - 1 fewer than words."""
    if len(word) < n:
        return np.zeros(0, np.uint64)
    out = word[: len(word) - n + 1].copy()
    for k in range(1, n):
        out = out * _A + word[k : len(word) - n + 1 + k]
    return mix(out)
