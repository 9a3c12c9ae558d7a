"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of words of every item. Documents are streamed through it: for each
word it keeps the longest run of words ending there that some item contains. A window (``window``
consecutive item words, or a whole shorter item) that occurs marks its words as hit. A match of m
words is m - 1 neighbouring pairs that occur in items, so the walk only visits stretches in which
every pair does; pairs are looked up for whole batches at once.

The automaton is built on the driver from at most ``block_tokens`` item words and broadcast, so its
size has a bound; more items become further automata through which the documents pass in turn.

Defined cases: a null or empty text has no words, no hits and is not contaminated; an item without
words has no windows; an item without identifier counts under the empty string; repeated items count
once; repeated documents are judged one by one; empty tables give empty results or no hits. Columns
pass through; the added ones start with ``_bench_``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort_spark.llm import bytes as B

WINDOW = 13
# A document is contaminated when this share (one part in so many) of its words is hit.
COVERAGE_PART = 20
BLOCK_TOKENS = 200_000
ADDED = [
    T.StructField("_bench_n_words", T.LongType()),
    T.StructField("_bench_runs", T.ArrayType(T.IntegerType())),
    T.StructField("_bench_items", T.ArrayType(T.StringType())),
]


def item_words(texts: Sequence[str | None]) -> list[np.ndarray]:
    """Word hashes of each item; A-Z lower-cased, words of digits, letters and non-ASCII."""
    data, at = B.raw(pa.array(texts, pa.string()))
    data = B.LOWER[data]
    starts, ends, first, mask = B.words(data, at, B.ALNUM)
    hashed = B.hashes(data, mask, starts, ends)
    return [hashed[first[i] : first[i + 1]] for i in range(len(texts))]


class Automaton:
    """Suffix automaton of several word sequences, with the windows that end in each state."""

    def __init__(self, items: Sequence[tuple[str, np.ndarray]], window: int = WINDOW) -> None:
        self.window = window
        present = [(key, w) for key, w in items if len(w)]
        every = np.concatenate([w for _, w in present]) if present else np.zeros(0, np.uint64)
        self.vocabulary = np.unique(every)
        self.least = min([window, *[len(w) for _, w in present]])
        self.length, self.link, self.next = [0], [-1], [{}]
        coded = [(key, np.searchsorted(self.vocabulary, w).tolist()) for key, w in present]
        for _, tokens in coded:
            self._extend(tokens)
        pairs = [np.array(t[:-1]) * len(self.vocabulary) + np.array(t[1:]) for _, t in coded if len(t) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.long: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for key, tokens in coded:
            self._register(key, tokens)
        self._shortcuts()

    def _new(self, length: int) -> int:
        self.length.append(length)
        self.link.append(0)
        self.next.append({})
        return len(self.length) - 1

    def _split(self, state: int, target: int, token: int) -> int:
        """Separate the shorter runs of ``target`` that end a step from ``state``."""
        clone = self._new(self.length[state] + 1)
        self.next[clone] = dict(self.next[target])
        self.link[clone] = self.link[target]
        self.link[target] = clone
        while state >= 0 and self.next[state].get(token) == target:
            self.next[state][token] = clone
            state = self.link[state]
        return clone

    def _extend(self, tokens: Sequence[int]) -> None:
        last = 0
        for token in tokens:
            known = self.next[last].get(token)
            if known is not None:
                exact = self.length[known] == self.length[last] + 1
                last = known if exact else self._split(last, known, token)
                continue
            made, state = self._new(self.length[last] + 1), last
            while state >= 0 and token not in self.next[state]:
                self.next[state][token] = made
                state = self.link[state]
            if state >= 0:
                target = self.next[state][token]
                exact = self.length[target] == self.length[state] + 1
                self.link[made] = target if exact else self._split(state, target, token)
            last = made

    def _register(self, key: str, tokens: Sequence[int]) -> None:
        state, n, whole = 0, min(self.window, len(tokens)), len(tokens) < self.window
        for i, token in enumerate(tokens, 1):
            state = self.next[state][token]
            if i < n:
                continue
            top = state
            while self.length[self.link[top]] >= n:
                top = self.link[top]
            if whole:
                self.short.setdefault(top, []).append((n, key))
            else:
                self.long.setdefault(top, set()).add(key)

    def _shortcuts(self) -> None:
        order = np.argsort(self.length, kind="stable").tolist()
        self.top, self.near = [-1] * len(order), [-1] * len(order)
        for v in order[1:]:
            up = self.link[v]
            if self.length[v] >= self.window:
                self.top[v] = self.top[up] if self.length[up] >= self.window else v
            self.near[v] = v if v in self.short else self.near[up]

    def tokens(self, hashed: np.ndarray) -> np.ndarray:
        """Item vocabulary numbers of words, -1 for words that no item has."""
        if not len(self.vocabulary):
            return np.full(len(hashed), -1, np.int64)
        at = np.searchsorted(self.vocabulary, hashed)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashed, at, -1)

    def stretches(self, tokens: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
        """Maximal runs of words that could hold a window; ``first`` has each text's first word."""
        known = tokens >= 0
        joined = known[:-1] & known[1:]
        joined[first[(first > 0) & (first < len(tokens))] - 1] = False
        at = np.flatnonzero(joined)
        if len(at):
            pair = tokens[at] * len(self.vocabulary) + tokens[at + 1]
            place = np.searchsorted(self.pairs, pair)
            place[place == len(self.pairs)] = 0
            joined[at[self.pairs[place] != pair] if len(self.pairs) else at] = False
        opens = known.copy()
        opens[1:] &= ~joined
        closes = known.copy()
        closes[:-1] &= ~joined
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        enough = ends - starts >= self.least
        yield from zip(starts[enough].tolist(), ends[enough].tolist(), strict=True)

    def walk(self, tokens: Sequence[int]) -> Iterator[tuple[int, int, object]]:
        """Start, end and items of every window in a stretch, from the longest match at each word."""
        state, matched = 0, 0
        for i, token in enumerate(tokens, 1):
            while state and token not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if token in self.next[state]:
                state, matched = self.next[state][token], matched + 1
            if matched >= self.window:
                yield i - self.window, i, self.long[self.top[state]]
            near = self.near[state] if state else -1
            while near > 0:
                for n, key in self.short[near]:
                    if n <= matched:
                        yield i - n, i, (key,)
                near = self.near[self.link[near]]


def _runs(flags: np.ndarray) -> np.ndarray:
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)], 1).ravel()


def _judge(batch: pa.RecordBatch, text: str, automaton: Automaton) -> list[pa.Array]:
    """The added columns for one piece, earlier findings included."""
    data, at = B.raw(batch.column(text))
    data = B.LOWER[data]
    starts, ends, first, mask = B.words(data, at, B.ALNUM)
    tokens = automaton.tokens(B.hashes(data, mask, starts, ends))
    steps = np.zeros(len(tokens) + 1, np.int64)
    items: dict[int, set[str]] = {}
    if len(tokens):
        for low, high in automaton.stretches(tokens, first[:-1]):
            found: set[str] | None = None
            for begin, end, keys in automaton.walk(tokens[low:high].tolist()):
                if found is None:
                    doc = int(np.searchsorted(first, low, side="right")) - 1
                    found = items.setdefault(doc, set())
                steps[low + begin] += 1
                steps[low + end] -= 1
                found.update(keys)
    hit = np.cumsum(steps[:-1]) > 0
    before = batch.column("_bench_runs").to_pylist() if "_bench_runs" in batch.schema.names else None
    listed = batch.column("_bench_items").to_pylist() if before else None
    runs, keys = [], []
    for i in range(batch.num_rows):
        if i not in items:
            runs.append(before[i] if before else [])
            keys.append(listed[i] if listed else [])
            continue
        flags = hit[first[i] : first[i + 1]].copy()
        if before:
            for low, high in zip(before[i][::2], before[i][1::2], strict=True):
                flags[low:high] = True
        runs.append(_runs(flags).tolist())
        keys.append(sorted(items[i] | set(listed[i] if listed else ())))
    return [
        pa.array(np.diff(first), pa.int64()),
        pa.array(runs, pa.list_(pa.int32())),
        pa.array(keys, pa.list_(pa.string())),
    ]


def _pass(rows: DataFrame, automaton: Automaton) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(automaton)
    kept = [f for f in rows.schema.fields if f not in ADDED]
    schema = T.StructType([*kept, *ADDED])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in B.pieces(batch, "text"):
                arrays = [piece.column(f.name) for f in kept]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, *_judge(piece, "text", shared.value)], names=schema.names
                )

    return rows.mapInArrow(judge, schema)


def automata(
    items: DataFrame, *, window: int = WINDOW, block_tokens: int = BLOCK_TOKENS
) -> Iterator[Automaton]:
    """Automata of bounded size over all items; at least one."""
    block: list[tuple[str, np.ndarray]] = []
    held, made = 0, False
    for row in items.select("item_id", "text").toLocalIterator():
        hashed = item_words([row["text"]])[0]
        if block and held + len(hashed) > block_tokens:
            yield Automaton(block, window)
            block, held, made = [], 0, True
        block.append(("" if row["item_id"] is None else str(row["item_id"]), hashed))
        held += len(hashed)
    if block or not made:
        yield Automaton(block, window)


def _scanned(docs: DataFrame, items: DataFrame, text: str, window: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``row`` (all columns of ``docs``, under any name), ``text`` and the added columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    for automaton in automata(items, window=window, block_tokens=block_tokens):
        rows = _pass(rows, automaton)
    return rows


def scan(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    window: int = WINDOW,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Documents with ``_bench_n_words``, hit word runs ``[from, to, ...]`` and the items that occur.

    Columns of ``docs`` with one of these names are replaced.
    """
    found = _scanned(docs, items, text, window, block_tokens)
    added = [f.name for f in ADDED]
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in added], *added)


def n_hit() -> Column:
    """Hit words of a scanned row."""
    runs = F.col("_bench_runs")
    ends = F.filter(runs, lambda _, i: i % 2 == 1)
    starts = F.filter(runs, lambda _, i: i % 2 == 0)
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return total(ends) - total(starts)


def contaminated(coverage_part: int = COVERAGE_PART) -> Column:
    """True where hit words reach one part in ``coverage_part`` of all words."""
    return (n_hit() > 0) & (n_hit() * coverage_part >= F.col("_bench_n_words"))


def decontaminate(
    docs: DataFrame, items: DataFrame, *, window: int = WINDOW, coverage_part: int = COVERAGE_PART
) -> DataFrame:
    """The documents below the coverage limit, unchanged."""
    return _scanned(docs, items, "text", window).where(~contaminated(coverage_part)).select("row.*")


def cut_spans(
    docs: DataFrame, items: DataFrame, *, text: str = "text", window: int = WINDOW, longer_than: int = 0
) -> DataFrame:
    """All documents, without hit runs of more than ``longer_than`` words; the rest of a text stays."""
    scanned = _scanned(docs, items, text, window).select("row", "text", "_bench_runs")
    schema = T.StructType([scanned.schema["row"], T.StructField("text", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in B.pieces(batch, "text"):
                data, at = B.raw(piece.column("text"))
                starts, ends, first, _ = B.words(B.LOWER[data], at, B.ALNUM)
                whole, texts = data.tobytes(), piece.column("text").to_pylist()
                for i, runs in enumerate(piece.column("_bench_runs").to_pylist()):
                    long = [(a, b) for a, b in zip(runs[::2], runs[1::2], strict=True) if b - a > longer_than]
                    if not long:
                        continue
                    kept, here = [], at[i]
                    for a, b in long:
                        kept.append(whole[here : starts[first[i] + a]])
                        here = ends[first[i] + b - 1]
                    texts[i] = b"".join([*kept, whole[here : at[i + 1]]]).decode()
                yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(texts, pa.string())], names=schema.names)

    done = scanned.mapInArrow(cut, schema)
    return done.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
