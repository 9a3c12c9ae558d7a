"""Small image files for tests and queries: a header with three ordering tags and what stands before them."""

from __future__ import annotations

import struct

_LONG = (b"SQ", b"OB", b"UN")


def _element(tag: int, kind: bytes, value: bytes, explicit: bool, order: str, undefined: bool = False) -> bytes:
    value += b" " if len(value) % 2 else b""
    size = 0xFFFFFFFF if undefined else len(value)
    head = struct.pack(order + "HH", tag >> 16, tag & 0xFFFF)
    if not explicit:
        return head + struct.pack(order + "I", size) + value
    if kind in _LONG:
        return head + kind + b"\0\0" + struct.pack(order + "I", size) + value
    return head + kind + struct.pack(order + "H", size) + value


def image_file(number: int | None, position: list[float] | None, orientation: list[float] | None, *, syntax: str = "1.2.840.10008.1.2.1", padding: int = 0) -> bytes:
    """A file with nested sequences and ``padding`` bytes before its ordering tags, and pixels after them."""
    explicit, order = syntax != "1.2.840.10008.1.2", ">" if syntax.endswith(".1.2.2") else "<"
    meta = _element(0x00020010, b"UI", syntax.encode(), True, "<")
    text = lambda values: "\\".join(f"{v:.12g}" for v in values).encode()
    part = lambda *a, **k: _element(*a, explicit, order, **k)
    item = lambda body, n=None: struct.pack(order + "HHI", 0xFFFE, 0xE000, len(body) if n is None else n) + body
    end = lambda low: struct.pack(order + "HHI", 0xFFFE, low, 0)
    inner = part(0x00081150, b"UI", b"1.2")
    nested = part(0x00081140, b"SQ", item(inner + end(0xE00D), 0xFFFFFFFF) + item(inner) + end(0xE0DD), undefined=True)
    body = part(0x00080016, b"UI", b"1.2.3") + nested + part(0x00091001, b"UN", bytes(padding))
    if number is not None:
        body += part(0x00200013, b"IS", str(number).encode())
    if position is not None:
        body += part(0x00200032, b"DS", text(position))
    if orientation is not None:
        body += part(0x00200037, b"DS", text(orientation))
    return bytes(128) + b"DICM" + meta + body + part(0x7FE00010, b"OB", bytes(4096))
