"""Ordering tags of image files, from their leading bytes only, as a partitioned data source."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Tags, transfer syntaxes and value kinds of the file format.
INSTANCE_NUMBER, POSITION, ORIENTATION = 0x00200013, 0x00200032, 0x00200037
TRANSFER_SYNTAX = 0x00020010
IMPLICIT, DEFLATED, BIG_ENDIAN = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.2"
LONG_KINDS = frozenset((b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV"))
ITEM, ITEM_END, SEQUENCE_END, UNDEFINED = 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD, 0xFFFFFFFF

LEADING_BYTES = 16 << 10
FILES_PER_PARTITION = 2_000

SCHEMA = (
    "path string, size bigint, ImagePositionPatient array<double>, ImageOrientationPatient array<double>, InstanceNumber bigint, "
    "error_type string, error string"
)


class HeaderError(ValueError):
    """A file is no image file, or its header is damaged."""


class MoreBytes(Exception):
    """The header goes on beyond the bytes at hand."""


@dataclass
class _Cursor:
    """A place in the leading bytes of one file."""

    data: bytes
    at: int
    explicit: bool = True
    order: str = "<"

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise MoreBytes
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def element(self) -> tuple[int, int]:
        """Tag and length of the next element; the cursor stands at its value."""
        group, number = struct.unpack(self.order + "HH", self.take(4))
        tag = group << 16 | number
        if group == 0xFFFE or not self.explicit:
            return tag, struct.unpack(self.order + "I", self.take(4))[0]
        kind = self.take(2)
        if not kind.isalpha() or not kind.isupper():
            raise HeaderError(f"no value kind at byte {self.at - 2}")
        if kind in LONG_KINDS:
            self.take(2)
            return tag, struct.unpack(self.order + "I", self.take(4))[0]
        return tag, struct.unpack(self.order + "H", self.take(2))[0]

    def skip(self, length: int) -> None:
        """Pass over a value; one of undefined length ends at its delimiter, whatever it nests."""
        if length != UNDEFINED:
            self.take(length)
            return
        open_parts = 1
        while open_parts:
            tag, inner = self.element()
            if tag in (ITEM_END, SEQUENCE_END):
                open_parts -= 1
            elif inner == UNDEFINED:
                open_parts += 1
            elif tag != ITEM:
                self.take(inner)


def _numbers(value: bytes) -> list[float]:
    return [float(x) for x in value.decode("ascii").rstrip("\0 ").split("\\") if x.strip()]


def parse(data: bytes) -> dict[str, object]:
    """The three ordering tags in the leading bytes of a file; absent ones are null."""
    if len(data) < 132:
        raise MoreBytes
    if data[128:132] != b"DICM":
        raise HeaderError("no image file")
    cursor, syntax = _Cursor(data, 132), ""
    # The leading group is always written one way; what follows has the syntax it names.
    while cursor.take(2) == b"\2\0":
        cursor.at -= 2
        tag, length = cursor.element()
        value = cursor.take(length)
        if tag == TRANSFER_SYNTAX:
            syntax = value.decode("ascii").rstrip("\0 ")
    cursor.at -= 2
    if syntax == DEFLATED:
        raise HeaderError("deflated data sets are not read")
    cursor.explicit, cursor.order = syntax != IMPLICIT, ">" if syntax == BIG_ENDIAN else "<"
    out: dict[str, object] = {"ImagePositionPatient": None, "ImageOrientationPatient": None, "InstanceNumber": None}
    while True:
        before = cursor.at
        tag, length = cursor.element()
        if tag > ORIENTATION:
            return out
        if tag == POSITION or tag == ORIENTATION:
            name = "ImagePositionPatient" if tag == POSITION else "ImageOrientationPatient"
            out[name] = _numbers(cursor.take(length)) or None
        elif tag == INSTANCE_NUMBER:
            numbers = _numbers(cursor.take(length))
            out["InstanceNumber"] = int(numbers[0]) if numbers else None
        else:
            cursor.skip(length)
        if cursor.at <= before:
            raise HeaderError(f"no progress at byte {before}")


def _read(system, path: str, size: int, leading: int) -> dict[str, object]:
    """Parse more and more of a file until its tags are found."""
    with system.open_input_file(path) as file:
        while True:
            data = file.read_at(min(leading, size), 0)
            try:
                return parse(data)
            except MoreBytes:
                if len(data) >= size:
                    # A data set may end anywhere after its last element.
                    return parse(data + struct.pack("<HH2sH", 0xFFFF, 0xFFFF, b"ZZ", 0) + bytes(8)) if len(data) >= 132 else _short()
                leading *= 8


def _short() -> dict[str, object]:
    raise HeaderError("shorter than any image file")


@dataclass
class _Files(InputPartition):
    paths: list[tuple[str, int]]


class _HeaderReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.root = options["path"]
        self.leading = int(options.get("leadingBytes", LEADING_BYTES))
        self.files = int(options.get("filesPerPartition", FILES_PER_PARTITION))

    def partitions(self) -> list[_Files]:
        """Files under the root in parts; only names and sizes are listed here."""
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.root)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        paths = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File)
        return [_Files(paths[i : i + self.files]) for i in range(0, len(paths), self.files)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.root)
        prefix = root.rstrip("/") + "/"
        for path, size in partition.paths:
            tags, error = {}, None
            try:
                tags = _read(system, path, size, self.leading)
            except (HeaderError, MoreBytes, ValueError, OSError, struct.error) as e:
                error = e
            yield (
                path.removeprefix(prefix),
                size,
                tags.get("ImagePositionPatient"),
                tags.get("ImageOrientationPatient"),
                tags.get("InstanceNumber"),
                type(error).__name__ if error else None,
                (str(error) or "the header is cut off") if error else None,
            )


class OrderingHeaders(DataSource):
    """``spark.read.format("ordering_headers").load(uri)``."""

    @classmethod
    def name(cls) -> str:
        return "ordering_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return _HeaderReader(self.options)


def read_ordering_headers(spark: SparkSession, root: str, *, leading_bytes: int = LEADING_BYTES, files_per_partition: int = FILES_PER_PARTITION) -> DataFrame:
    """Path, size and the three ordering tags of every file under a URI; ``root`` may be in any store that Arrow reads.

    A file is read from its start in growing pieces until the tags are found. Files that cannot be read
    (empty, damaged, no image) keep a row with null tags, ``error_type`` and ``error``.
    """
    spark.dataSource.register(OrderingHeaders)
    uri = root if "://" in root else f"file://{root.removeprefix('file:')}"
    options = {"leadingBytes": str(leading_bytes), "filesPerPartition": str(files_per_partition)}
    return spark.read.format("ordering_headers").options(**options).load(uri)


def header_failures(headers: DataFrame) -> DataFrame:
    """Discovered, readable and failed files."""
    return headers.agg(
        F.count("*").alias("discovered"),
        F.count_if(F.col("error_type").isNull()).alias("readable"),
        F.count_if(F.col("error_type").isNotNull()).alias("failed"),
    )
