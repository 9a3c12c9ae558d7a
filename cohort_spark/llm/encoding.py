"""Whole texts to token numbers with a given tokenizer, one distinct word at a time.

A byte-level BPE tokenizer first splits a text by a fixed pattern and then encodes each part for
itself, so equal parts have equal numbers. ``Encoder`` finds the parts of many texts at once on their
code points and lets the tokenizers library encode each distinct part once. The class of every code
point below ``TABLED`` is asked of the library; a text with another code point, or with the name of
a special token, goes to the library whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

from cohort_spark.llm import bytes as B

TABLED = 0x3000
# Distinct parts that a worker remembers; then it starts afresh.
REMEMBERED = 600_000
_LETTER, _NUMBER, _SPACE, _OTHER, _UNKNOWN = range(5)
# The endings that the byte-level pattern splits off after an apostrophe.
_SHORT_ENDINGS = "stmd"
_LONG_ENDINGS = ("re", "ve", "ll")


class Encoder:
    """Encodes batches of texts exactly as ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.special = [t["content"] for t in described.get("added_tokens", [])]
        splitter = described.get("pre_tokenizer") or {}
        self.by_parts = (
            splitter.get("type") == "ByteLevel"
            and not splitter.get("add_prefix_space")
            and splitter.get("use_regex", True)
            and described.get("normalizer") is None
            and described.get("truncation") is None
        )
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.classes = self._classes() if self.by_parts else np.full(TABLED + 1, _UNKNOWN, np.uint8)
        self._forget()

    def _classes(self) -> np.ndarray:
        """The pattern's class of each code point: what it stays in one part with."""
        parts = self.library.pre_tokenizer.pre_tokenize_str
        table = np.full(TABLED + 1, _UNKNOWN, np.uint8)
        for point in range(TABLED):
            c = chr(point)
            if len(parts(f"a{c}a")) == 1:
                table[point] = _LETTER
            elif len(parts(f"1{c}1")) == 1:
                table[point] = _NUMBER
            elif len(parts(f"!{c}!")) == 1:
                table[point] = _OTHER
            else:
                table[point] = _SPACE
        return table

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.first = np.zeros(1, np.int64)
        self.flat = np.zeros(0, self.dtype)

    def whole(self, texts: Sequence[str]) -> list[np.ndarray]:
        """By the library alone."""
        return [
            np.array(e.ids, self.dtype)
            for e in self.library.encode_batch(list(texts), add_special_tokens=False)
        ]

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Token numbers of every text."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=at[1:])
        kinds = self.classes[np.minimum(points, TABLED)]
        strange = np.zeros(len(points) + 1, np.int64)
        np.cumsum(kinds == _UNKNOWN, out=strange[1:])
        plain = strange[at[1:]] == strange[at[:-1]]
        if any(s in joined for s in self.special):
            plain &= np.array([not any(s in t for s in self.special) for t in texts])
        if not plain.all():
            out: list[np.ndarray] = [np.zeros(0, self.dtype)] * len(texts)
            rest = np.flatnonzero(~plain).tolist()
            for i, ids in zip(rest, self.whole([texts[i] for i in rest]), strict=True):
                out[i] = ids
            rest = np.flatnonzero(plain).tolist()
            for i, ids in zip(rest, self.encode([texts[i] for i in rest]) if rest else [], strict=True):
                out[i] = ids
            return out
        if not len(points):
            return [np.zeros(0, self.dtype)] * len(texts)
        return self._encode_parts(joined, points, kinds, at)

    @staticmethod
    def _parts(points: np.ndarray, kinds: np.ndarray, at: np.ndarray) -> np.ndarray:
        """First code point of every part of the pattern."""
        n = len(points)
        heads = at[:-1][at[:-1] < n]
        opens = np.ones(n, bool)
        opens[1:] = kinds[1:] != kinds[:-1]
        opens[heads] = True
        is_head = np.zeros(n, bool)
        is_head[heads] = True
        # White space before something else: its last character stands alone, or a blank joins what follows.
        after = np.flatnonzero((kinds[1:] != _SPACE) & (kinds[:-1] == _SPACE) & ~is_head[1:]) + 1
        opens[after - 1] = True
        opens[after[points[after - 1] == 0x20]] = False
        # An apostrophe that opens a part takes a known ending with it.
        marks = np.flatnonzero((points == ord("'")) & opens)
        if len(marks):
            text_end = np.append(at[1:], n)[np.searchsorted(at, marks, side="right") - 1]
            one = points[np.minimum(marks + 1, n - 1)]
            two = points[np.minimum(marks + 2, n - 1)]
            size = np.zeros(len(marks), np.int64)
            size[np.isin(one, [ord(c) for c in _SHORT_ENDINGS]) & (marks + 1 < text_end)] = 2
            for a, b in _LONG_ENDINGS:
                size[(one == ord(a)) & (two == ord(b)) & (marks + 2 < text_end)] = 3
            marks, size, text_end = marks[size > 0], size[size > 0], text_end[size > 0]
            opens[marks + 1] = False
            ends = marks + size
            opens[ends[ends < text_end]] = True
        return np.flatnonzero(opens)

    def _encode_parts(
        self, joined: str, points: np.ndarray, kinds: np.ndarray, at: np.ndarray
    ) -> list[np.ndarray]:
        starts = self._parts(points, kinds, at)
        ends = np.append(starts[1:], len(points))
        length = ends - starts
        within = np.arange(len(points), dtype=np.int64) - np.repeat(starts, length)
        letters = (points.astype(np.uint64) + np.uint64(1)) * B._powers(int(length.max()) + 1)[within]
        hashed = B.mix(np.add.reduceat(letters, starts) ^ length.astype(np.uint64))
        coded = pa.array(hashed).dictionary_encode()
        number = np.asarray(coded.indices)
        distinct = np.asarray(coded.dictionary)
        example = np.zeros(len(distinct), np.int64)
        example[number[::-1]] = np.arange(len(number) - 1, -1, -1)
        if len(self.known) + len(distinct) > REMEMBERED:
            self._forget()
        known = self.known
        place = np.array([known.get(h, -1) for h in distinct.tolist()], np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            parts = [joined[starts[e] : ends[e]] for e in example[new].tolist()]
            place[new] = len(self.first) - 1 + np.arange(len(new))
            known.update(zip(distinct[new].tolist(), place[new].tolist(), strict=True))
            # A list of parts is one encoding of the library, which says whose each number is.
            coded = self.library.encode(parts, is_pretokenized=True, add_special_tokens=False)
            sizes = np.bincount(np.array(coded.word_ids, np.int64), minlength=len(parts))
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, np.array(coded.ids, self.dtype)])
        low = self.first[place][number]
        count = self.first[place + 1][number] - low
        before = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=before[1:])
        take = np.arange(before[-1], dtype=np.int64) + np.repeat(low - before[:-1], count)
        tokens = self.flat[take]
        cut = before[np.searchsorted(starts, at)]
        return [tokens[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
