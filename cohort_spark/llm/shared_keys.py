"""Which hashed keys occur in several documents, over any number of documents.

Documents are dealt to chunks of a few MB. A chunk sends its distinct keys, packed and sorted, to
key buckets; a bucket adds up the chunks and sends back one number per key, in the order in which
the chunk can list its keys again. So a key costs a few bytes on the way there and one on the way
back, a common key costs at most one entry per chunk, and no key is ever gathered with its rows.

A chunk may send how often each key occurs as well; then a key of several documents comes back with
its occurrences, of which there are at least as many.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text per chunk, and text whose keys go to one bucket.
CHUNK_BYTES = 3 << 20
BUCKET_BYTES = 10 << 20
LEAST_BUCKETS = 32
MOST = 65_535

SENT = "bucket int, chunk int, keys binary, counts binary"
LEVELS = "bucket int, chunk int, levels binary"


def pack(array: np.ndarray) -> bytes:
    """Size and compressed bytes of an array."""
    raw = array.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(data: bytes, dtype: str) -> np.ndarray:
    """The array that ``pack`` was given."""
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], size, "zstd", asbytes=True), dtype)


@dataclass(frozen=True)
class Layout:
    """How many chunks and buckets a corpus is dealt to."""

    chunks: int
    buckets: int


def layout(
    docs: DataFrame, text: str = "text", *, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES
) -> Layout:
    """Chunks and buckets in proportion to the bytes of text."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return Layout(max(1, -(-size // chunk_bytes)), max(LEAST_BUCKETS, -(-size // bucket_bytes)))


def chunk_of(plan: Layout, doc_id: str = "doc_id", text: str = "text") -> Column:
    """The chunk of a document; copies of a text under other identifiers go to others."""
    return F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(plan.chunks)).cast("int")


class Keys:
    """The distinct keys of one chunk, listed by bucket and value, with documents per key."""

    def __init__(self, hashed: np.ndarray, doc: np.ndarray, buckets: int) -> None:
        bucket = hashed % np.uint64(buckets)
        code = (bucket << np.uint64(32)) | (hashed >> np.uint64(32))
        self.code, self.at, self.inverse = np.unique(code, return_index=True, return_inverse=True)
        self.bucket = (self.code >> np.uint64(32)).astype(np.int64)
        self.rest = self.code.astype(np.uint32)
        width = int(doc.max()) + 1 if len(doc) else 1
        pairs = np.unique(self.inverse * width + doc) // width
        self.documents = np.bincount(pairs, minlength=len(self.code))
        self.times = np.bincount(self.inverse, minlength=len(self.code))
        self.cut = np.searchsorted(self.bucket, np.arange(buckets + 1))

    def sent(self, chunk: int, *, times: bool = False) -> pa.Table:
        """Rows for the buckets; with ``times``, the occurrences follow the documents."""
        sums = [np.minimum(n, MOST).astype(np.uint16) for n in (self.documents, *([self.times] if times else []))]
        used = np.flatnonzero(np.diff(self.cut)).tolist()
        part = lambda a, b: a[self.cut[b] : self.cut[b + 1]]
        return pa.table(
            {
                "bucket": pa.array(used, pa.int32()),
                "chunk": pa.array([chunk] * len(used), pa.int32()),
                "keys": pa.array([part(self.rest, b).tobytes() for b in used], pa.binary()),
                "counts": pa.array([pack(np.concatenate([part(n, b) for n in sums])) for b in used], pa.binary()),
            }
        )

    def spread(self, bucket: list[int], values: list[np.ndarray], empty: object) -> np.ndarray:
        """Values that came back per bucket, for every key; ``empty`` for buckets that sent none."""
        out = np.full(len(self.code), empty, values[0].dtype if values else np.uint16)
        for b, v in zip(bucket, values, strict=True):
            out[self.cut[b] : self.cut[b + 1]] = v[: self.cut[b + 1] - self.cut[b]]
        return out


def _add_up(table: pa.Table) -> pa.Table:
    keys = [np.frombuffer(x, np.uint32) for x in table["keys"].to_pylist()]
    counts = [unpack(x, "<u2") for x in table["counts"].to_pylist()]
    every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    add = lambda parts: np.bincount(inverse, np.concatenate(parts), len(every))
    total = add([c[: len(k)] for c, k in zip(counts, keys, strict=True)])
    if any(len(c) > len(k) for c, k in zip(counts, keys, strict=True)):
        times = add([c[len(k) :] for c, k in zip(counts, keys, strict=True)])
        total = np.where(total < 2, total, np.maximum(total, times))
    total = np.minimum(total, MOST).astype(np.uint16)[inverse]
    ends = np.cumsum([len(k) for k in keys])
    levels = [pack(x) for x in np.split(total, ends[:-1])]
    return pa.table({"bucket": table["bucket"], "chunk": table["chunk"], "levels": pa.array(levels, pa.binary())})


def levels(sent: DataFrame) -> DataFrame:
    """``bucket, chunk, levels``: documents, or occurrences, per key (up to ``MOST``) for each chunk's keys."""
    return sent.groupBy("bucket").applyInArrow(_add_up, LEVELS)
