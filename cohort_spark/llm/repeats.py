"""Removal of long strings that an earlier document has, by run-length indexes.

Equal strings of ``LENGTH`` bytes must meet in one place, or they cannot be compared. Every window
of that length is named by the smallest hash among the ``GRAM``-byte strings in it, so equal windows
have equal names, and neighbouring windows mostly share theirs: a document becomes runs of windows
with one name each.

1. Names that only one document has are dropped (``shared_keys``).
2. For the others, each run's bytes go to the bucket of its name, once per chunk of documents and
   with the smallest ``doc_id`` that has them.
3. A bucket builds a run-length index (``run_index``) of the different strings of each name, streams
   the strings through it, and so finds the first document of every window.
4. The chunks get the answers, mark windows whose first document is smaller than their own, and drop
   every byte that a marked window covers.

A name with more runs than ``HOT`` is not kept together, however few documents have them: its windows
are named by themselves, which deals them to all buckets. So the strings of a name that is kept
together always fit one index.

Defined cases: a null or empty text has no bytes and hashes as empty; a null ``doc_id`` comes after
all others; rows with one ``doc_id`` are not earlier than each other, equal or not; texts shorter
than ``LENGTH`` lose nothing; an empty table gives an empty one. ``doc_id`` must be a whole number;
further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_spark.llm import bytes as B
from cohort_spark.llm import shared_keys as S
from cohort_spark.llm.run_index import GOOD, LARGEST, RunIndex

LENGTH = 50
GRAM = 16
# Windows of one run; a longer run is cut, so that a string has at most LENGTH - 1 + MOST_WINDOWS bytes.
MOST_WINDOWS = 60
SEGMENT = 1 << 21
HOT = 15_000
# A string and its mark have at most LENGTH + MOST_WINDOWS symbols; so many strings always fit one index.
MOST_RUNS = LARGEST // (LENGTH + MOST_WINDOWS)
LAST = np.iinfo(np.int64).max

_SENT = "bucket int, chunk int, shared binary, names binary, sizes binary, owners binary, strings binary"
_FOUND = "bucket int, chunk int, shared binary, firsts binary"
_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at every place as one number."""
    return np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,)).copy()


def _names(data: np.ndarray) -> np.ndarray:
    """The name of the window that begins at each byte."""
    eight = _eights(data)
    hashed = eight[:-8] * B._A ^ (eight[8:] + B._B) * B._C
    hashed ^= hashed >> np.uint64(29)
    hashed *= B._B
    hashed ^= hashed >> np.uint64(32)
    width, have = LENGTH - GRAM + 1, 1
    while have * 2 <= width:
        hashed = np.minimum(hashed[:-have], hashed[have:])
        have *= 2
    return np.minimum(hashed[: len(hashed) - (width - have)], hashed[width - have :]) if width > have else hashed


@dataclass
class Runs:
    """Runs of windows with one name: first window, one past the last, name, and document."""

    start: np.ndarray
    end: np.ndarray
    name: np.ndarray
    doc: np.ndarray


def runs(data: np.ndarray, at: np.ndarray) -> Runs:
    """All runs of all texts; a window never crosses two texts."""
    starts, ends, names = [], [], []
    fits = at[1:] - LENGTH + 1
    for low in range(0, len(data) - LENGTH + 1, SEGMENT):
        name = _names(data[low : low + SEGMENT + LENGTH - 1])
        high = low + len(name)
        changes = np.flatnonzero(name[1:] != name[:-1]) + (low + 1)
        inner = lambda a: a[(a > low) & (a < high)]
        cut = np.unique(np.concatenate([[low], changes, inner(at), inner(fits)]))
        starts.append(cut)
        ends.append(np.append(cut[1:], high))
        names.append(name[cut - low])
    if not starts:
        none = np.zeros(0, np.int64)
        return Runs(none, none, np.zeros(0, np.uint64), none)
    start, end, name = map(np.concatenate, (starts, ends, names))
    doc = np.searchsorted(at, start, side="right") - 1
    whole = start + LENGTH <= at[doc + 1]
    start, end, name, doc = start[whole], end[whole], name[whole], doc[whole]
    pieces = -(-(end - start) // MOST_WINDOWS)
    if len(pieces) and pieces.max() > 1:
        which = np.repeat(np.arange(len(start)), pieces)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, name, doc, end = start[which] + nth * MOST_WINDOWS, name[which], doc[which], end[which]
        end = np.minimum(end, start + MOST_WINDOWS)
    return Runs(start, end, name, doc)


class Chunk:
    """The documents of one chunk and their runs; the same rows give the same lists each time."""

    def __init__(self, table: pa.Table, buckets: int) -> None:
        table = table.select(["doc_id", "text"]).combine_chunks()
        self.ids = table["doc_id"]
        self.rank = self.ids.fill_null(LAST).to_numpy()
        self.data, self.at = B.raw(table["text"])
        # Chunks are read several times: order rows by content, whatever order they arrive in.
        content = [self.data[a:b].tobytes() for a, b in zip(self.at[:-1].tolist(), self.at[1:].tolist(), strict=True)]
        order = sorted(range(len(content)), key=lambda i: (self.rank[i], content[i]))
        self.ids = self.ids.take(pa.array(order, pa.int64()))
        self.rank = self.rank[order]
        self.texts = [content[i] for i in order]
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        self.at = np.zeros(len(order) + 1, np.int64)
        np.cumsum([len(t) for t in self.texts], out=self.at[1:])
        self.buckets = buckets
        self.runs = runs(self.data, self.at)
        self.keys = S.Keys(self.runs.name, self.runs.doc, buckets)

    def shared(self, flags: np.ndarray, hot: int) -> Strings:
        """The different strings of the runs whose name ``flags`` marks (1: kept together, 2: window by window)."""
        flag = flags[self.keys.inverse]
        start, end, doc = (a[flag == 1] for a in (self.runs.start, self.runs.end, self.runs.doc))
        name = self.runs.name[flag == 1]
        if (flag == 2).any():
            size = (self.runs.end - self.runs.start)[flag == 2]
            nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            single = np.repeat(self.runs.start[flag == 2], size) + nth
            eight = _eights(self.data)
            own = np.zeros(len(single), np.uint64)
            for step in (*range(0, LENGTH - 7, 8), LENGTH - 8):
                own = B.mix(own * B._A + eight[single + step])
            start = np.concatenate([start, single])
            end = np.concatenate([end, single + 1])
            doc = np.concatenate([doc, np.repeat(self.runs.doc[flag == 2], size)])
            name = np.concatenate([name, own])
        return Strings(self, start, end, name, doc)


class Strings:
    """Different strings of a chunk by bucket, and where each occurs."""

    def __init__(self, chunk: Chunk, start: np.ndarray, end: np.ndarray, name: np.ndarray, doc: np.ndarray) -> None:
        whole = chunk.data.tobytes()
        cuts = zip(start.tolist(), (end + LENGTH - 1).tolist(), strict=True)
        coded = pa.array([whole[a:b] for a, b in cuts], pa.binary()).dictionary_encode()
        self.start, self.end, self.doc = start, end, doc
        self.strings = coded.dictionary.to_pylist()
        which = np.asarray(coded.indices).astype(np.int64)
        n = len(self.strings)
        self.owner = np.full(n, LAST, np.int64)
        np.minimum.at(self.owner, which, chunk.rank[doc])
        self.name = np.zeros(n, np.uint64)
        self.name[which] = name
        bucket = (self.name % np.uint64(chunk.buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        self.which = self.place[which]
        self.cut = np.searchsorted(bucket[self.order], np.arange(chunk.buckets + 1))


def _flags(keys: S.Keys, bucket: list[int], levels: list[bytes], hot: int) -> np.ndarray:
    level = keys.spread(bucket, [S.unpack(x, "<u2") for x in levels], 0)
    return np.where(level < 2, 0, np.where(level > hot, 2, 1)).astype(np.uint8)


def _index(table: pa.Table) -> pa.Table:
    """First documents of all windows of the strings in one bucket."""
    rows = table.to_pylist()
    names = [np.frombuffer(r["names"], np.uint64) for r in rows]
    sizes = [np.frombuffer(r["sizes"], np.uint8).astype(np.int64) for r in rows]
    owners = np.concatenate([S.unpack(r["owners"], "<i8") for r in rows])
    data = np.concatenate([S.unpack(r["strings"], "u1") for r in rows])
    name, size = np.concatenate(names), np.concatenate(sizes)
    which, firsts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    windows = offset = which
    if len(name):
        ends = np.cumsum(size)
        strings = pa.Array.from_buffers(
            pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(data)]
        )
        coded = strings.dictionary_encode()
        which = np.asarray(coded.indices).astype(np.int64)
        different = coded.dictionary
        first = np.full(len(different), LAST, np.int64)
        np.minimum.at(first, which, owners)
        own_name = np.zeros(len(different), np.uint64)
        own_name[which] = name
        own_size = np.zeros(len(different), np.int64)
        own_size[which] = size
        firsts = _by_name(different, own_name, own_size, first)
        windows = own_size - LENGTH + 1
        offset = np.cumsum(windows) - windows
    out, at = [], 0
    for n in map(len, names):
        mine = which[at : at + n]
        at += n
        out.append(S.pack(firsts[_places(offset[mine], windows[mine])]))
    return pa.table(
        {"bucket": table["bucket"], "chunk": table["chunk"], "shared": table["shared"], "firsts": pa.array(out, pa.binary())}
    )


def _places(offset: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The places ``offset, offset + 1, ...`` of as many windows, string after string."""
    return np.repeat(offset - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())


def _by_name(strings: pa.Array, name: np.ndarray, size: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The first owner of each window of each string, in order, among the strings of its name."""
    windows = size - LENGTH + 1
    offset = np.cumsum(windows) - windows
    # A string that is alone under its name needs no index.
    out = np.repeat(owner, windows)
    order = np.argsort(name, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], name[order][1:] != name[order][:-1]]))
    forms = np.diff(np.append(heads, len(order)))
    several = np.flatnonzero(forms > 1)
    if not len(several):
        return out
    needs = np.add.reduceat(size[order] + 1, heads)[several].tolist()
    group = order[np.repeat(forms > 1, forms)]
    cuts, symbols, end = [0], 0, 0
    for n, need in zip(forms[several].tolist(), needs, strict=True):
        if symbols and symbols + need > GOOD:
            cuts.append(end)
            symbols = 0
        symbols += need
        end += n
    for low, high in zip(cuts, [*cuts[1:], end], strict=True):
        members = group[low:high]
        joined = b"".join(strings.take(pa.array(members)).to_pylist())
        index = RunIndex(np.frombuffer(joined, np.uint8), size[members], owner[members], LENGTH)
        out[_places(offset[members], windows[members])] = index.stream()
    return out


def _marked(chunk: Chunk, strings: Strings, firsts: np.ndarray) -> np.ndarray:
    """Which bytes a window covers whose first document is smaller than its own."""
    windows = strings.end - strings.start
    width = np.zeros(len(strings.strings), np.int64)
    width[strings.which] = windows
    offset = np.cumsum(width) - width
    nth = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    first = firsts[np.repeat(offset[strings.which], windows) + nth]
    earlier = first < np.repeat(chunk.rank[strings.doc], windows)
    begin = (np.repeat(strings.start, windows) + nth)[earlier]
    steps = np.zeros(len(chunk.data) + 1, np.int32)
    steps[: len(chunk.data)] += np.bincount(begin, minlength=len(chunk.data)).astype(np.int32)
    steps -= np.bincount(begin + LENGTH, minlength=len(steps)).astype(np.int32)
    return np.cumsum(steps[:-1]) > 0


def _cut(chunk: Chunk, gone: np.ndarray, digest: bool) -> Iterator[tuple[int, int, int, bytes]]:
    for i, text in enumerate(chunk.texts):
        mine = gone[chunk.at[i] : chunk.at[i + 1]]
        removed = int(np.count_nonzero(mine))
        if not removed:
            kept, spans = text, 0
        else:
            spans = int(mine[0]) + int(np.count_nonzero(mine[1:] & ~mine[:-1]))
            kept = np.frombuffer(text, np.uint8)[~mine].tobytes()
        yield len(text), removed, spans, hashlib.sha256(kept).digest() if digest else kept


def remove_repeats(
    docs: DataFrame, *, digest: bool = False, hot: int = HOT, plan: S.Layout | None = None
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` for every row of ``docs`` (``doc_id, text``).

    ``kept`` holds the bytes that stay, or their SHA-256 when ``digest`` is set. The same dealing of
    the documents to chunks is used three times in one plan, so the texts are shuffled once.
    """
    hot = min(hot, MOST_RUNS)
    plan = plan or S.layout(docs)
    dealt = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("chunk", S.chunk_of(plan))

    def name(key: tuple, table: pa.Table) -> pa.Table:
        return Chunk(table, plan.buckets).keys.sent(key[0].as_py(), times=True)

    def send(key: tuple, table: pa.Table, levels: pa.Table) -> pa.Table:
        number, chunk = key[0].as_py(), Chunk(table, plan.buckets)
        flags = _flags(chunk.keys, levels["bucket"].to_pylist(), levels["levels"].to_pylist(), hot)
        strings = chunk.shared(flags, hot)
        columns: dict[str, list] = {n: [] for n in ("bucket", "chunk", "shared", "names", "sizes", "owners", "strings")}
        for b in range(plan.buckets):
            mine = strings.order[strings.cut[b] : strings.cut[b + 1]]
            own = flags[chunk.keys.cut[b] : chunk.keys.cut[b + 1]]
            if not len(mine) and not own.any():
                continue
            parts = [strings.strings[m] for m in mine.tolist()]
            row = (
                b, number, S.pack(own), strings.name[mine].tobytes(), bytes(map(len, parts)),
                S.pack(strings.owner[mine]), S.pack(np.frombuffer(b"".join(parts), np.uint8)),
            )
            for values, value in zip(columns.values(), row, strict=True):
                values.append(value)
        types = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(columns.items(), types, strict=True)})

    def judge(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        chunk = Chunk(table, plan.buckets) if len(table) else None
        if chunk is None:
            rows: list[tuple] = []
        else:
            rows = found.sort_by("bucket").to_pylist()
            flags = chunk.keys.spread([r["bucket"] for r in rows], [S.unpack(r["shared"], "u1") for r in rows], 0)
            strings = chunk.shared(flags, hot)
            firsts = [S.unpack(r["firsts"], "<i8") for r in rows]
            gone = _marked(chunk, strings, np.concatenate(firsts) if firsts else np.zeros(0, np.int64))
            rows = list(_cut(chunk, gone, digest))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.table(
            {
                "doc_id": chunk.ids if chunk else pa.array([], pa.int64()),
                **{n: pa.array(columns[i], pa.int64()) for i, n in enumerate(("n_bytes", "n_removed", "n_spans"))},
                "kept": pa.array(columns[3], pa.binary()),
            }
        )

    by_chunk = dealt.groupBy("chunk")
    levels = S.levels(by_chunk.applyInArrow(name, S.SENT))
    sent = by_chunk.cogroup(levels.groupBy("chunk")).applyInArrow(send, _SENT)
    found = sent.groupBy("bucket").applyInArrow(_index, _FOUND)
    return by_chunk.cogroup(found.groupBy("chunk")).applyInArrow(judge, _RESULT)
