"""Flat token files with 64-bit document offsets.

Documents are dealt by ``doc_id`` ranges, one file per range, in ascending order. A file set holds

- ``tokens-NNNNN.bin``: the numbers of all documents of the range, unsigned little-endian, each
  document closed by the end number;
- ``offsets-NNNNN.bin``: one signed 64-bit offset per document and one at the end, within the file;
- ``ids-NNNNN.bin``: the signed 64-bit ``doc_id`` of each document.

A task writes under a name of its own attempt and renames at the end, so a repeated task leaves the
same files. Bases of the ranges are prefix sums of the per-file totals. Files are read by memory map
(or through the file system that the folder's scheme names).

Defined cases: a null or empty text is the end number alone; a null ``doc_id`` sorts first and is
stored as the smallest 64-bit number; rows with the same ``doc_id`` follow each other, ordered by a
hash of their text; an empty table writes no files and reads as no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_spark.core import checkpoint_root, durable
from cohort_spark.llm import bytes as B
from cohort_spark.llm.encoding import Encoder
from cohort_spark.skew import running_totals

END = 2
FILE_BYTES = 32 << 20
NULL_ID = np.iinfo(np.int64).min
ROWS_PER_BATCH = 20_000
_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _store(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


class _Writer:
    """The three files of one range, renamed into place when complete."""

    def __init__(self, root: str, part: int, attempt: int) -> None:
        self.files, folder = _store(root)
        self.names = {k: f"{folder}/{k}-{part:05d}.bin" for k in ("tokens", "offsets", "ids")}
        self.attempt = attempt
        self.open = {k: self.files.open_output_stream(f"{n}.{attempt}") for k, n in self.names.items()}
        self.documents = self.tokens = 0

    def add(self, ids: np.ndarray, tokens: list[np.ndarray]) -> None:
        sizes = np.array([len(t) for t in tokens], np.int64)
        starts = self.tokens + np.cumsum(sizes) - sizes
        self.open["tokens"].write(np.concatenate(tokens).tobytes())
        self.open["offsets"].write(starts.astype("<i8").tobytes())
        self.open["ids"].write(ids.astype("<i8").tobytes())
        self.documents += len(ids)
        self.tokens += int(sizes.sum())

    def close(self) -> None:
        self.open["offsets"].write(np.array([self.tokens], "<i8").tobytes())
        for kind, name in self.names.items():
            self.open[kind].close()
            self.files.move(f"{name}.{self.attempt}", name)


def write_tokens(
    docs: DataFrame, tokenizer: str, root: str | None = None, *, end: int = END, file_bytes: int = FILE_BYTES
) -> tuple[str, DataFrame]:
    """Encode all documents into ``root``; returns it with ``part, documents, tokens`` per file."""
    if root is None:
        root = f"{checkpoint_root(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    store, folder = _store(root)
    store.create_dir(folder, recursive=True)
    keyed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text"),
        F.xxhash64("text").alias("tie"),
        F.monotonically_increasing_id().alias("row"),
    )
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // file_bytes))
    ordered = keyed.repartitionByRange(ranges, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, part = _encoder(tokenizer), None, TaskContext.get().partitionId()
        close = np.array([end], encoder.dtype)
        for batch in batches:
            for piece in B.pieces(batch, "text"):
                if writer is None:
                    writer = _Writer(root, part, TaskContext.get().taskAttemptId())
                texts = piece.column("text").fill_null("").to_pylist()
                ids = piece.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                writer.add(ids, [np.concatenate([t, close]) for t in encoder.encode(texts)])
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "documents": [writer.documents], "tokens": [writer.tokens]},
                schema=pa.schema([("part", pa.int32()), ("documents", pa.int64()), ("tokens", pa.int64())]),
            )

    return root, durable(
        ordered.select("doc_id", "text").mapInArrow(write, "part int, documents bigint, tokens bigint")
    )


def bases(parts: DataFrame) -> DataFrame:
    """``part`` with the number of tokens in all earlier files."""
    return running_totals(parts, [], [F.col("part")], {"base": F.col("tokens")})


def _mapped(files: pafs.FileSystem, name: str, dtype: str | np.dtype) -> np.ndarray:
    if isinstance(files, pafs.LocalFileSystem):
        return np.memmap(name, dtype, "r")
    with files.open_input_file(name) as file:
        return np.frombuffer(file.read_buffer(), dtype)


def read_tokens(root: str, parts: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    files = max(1, parts.count())
    dealt = bases(parts).select("part", "base").repartition(files, "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(root)
        dtype = _encoder(tokenizer).dtype
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{row['part']:05d}.bin"
                tokens = _mapped(store, f"{folder}/tokens-{name}", dtype)
                offsets = _mapped(store, f"{folder}/offsets-{name}", "<i8")
                ids = _mapped(store, f"{folder}/ids-{name}", "<i8")
                for low in range(0, len(ids), ROWS_PER_BATCH):
                    high = min(low + ROWS_PER_BATCH, len(ids))
                    cut = offsets[low : high + 1].tolist()
                    sums = [
                        zlib.crc32(tokens[a:b].astype("<u4").tobytes())
                        for a, b in zip(cut[:-1], cut[1:], strict=True)
                    ]
                    here = np.array(ids[low:high])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(here, mask=here == NULL_ID),
                            pa.array(row["base"] + np.array(cut[:-1], np.int64)),
                            pa.array(np.diff(np.array(cut, np.int64))),
                            pa.array(sums, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return dealt.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
