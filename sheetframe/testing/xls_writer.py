"""A small BIFF8 writer in an OLE2 container: enough of the format to test a reader with."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from typing import Any

from ..sources.ole import MAGIC


@dataclass
class XlsCell:
    value: Any = None
    style: int = 0
    tokens: bytes | None = None  # a formula's tokens; value is its cached result
    rk: int | None = None


@dataclass
class XlsSheetSpec:
    name: str = "Sheet1"
    rows: dict[int, list[Any]] = field(default_factory=dict)
    state: int = 0
    merges: list[tuple[int, int, int, int]] = field(default_factory=list)  # row1, row2, col1, col2 from 0
    extra: bytes = b""  # further records after the cells
    before: bytes = b""  # and before them


def record(kind: int, body: bytes = b"") -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


def _text(text: str, wide_length: bool = True) -> bytes:
    wide = any(ord(c) > 255 for c in text)
    data = text.encode("utf-16-le" if wide else "latin-1")
    n = len(data) // 2 if wide else len(data)
    return struct.pack("<H" if wide_length else "<B", n) + bytes([wide]) + data


def sst_records(strings: list[str], most: int = 8224) -> bytes:
    """An SST record and its continuations, strings cut at the boundary where they come to it."""
    blocks = [struct.pack("<II", len(strings), len(strings))]
    for s in strings:
        wide = any(ord(c) > 255 for c in s)
        data = s.encode("utf-16-le" if wide else "latin-1")
        step, n = (2, len(data) // 2) if wide else (1, len(data))
        if len(blocks[-1]) + 3 + step > most:
            blocks.append(b"")
        blocks[-1] += struct.pack("<HB", n, wide)
        while data:
            room = (most - len(blocks[-1])) // step * step
            if room <= 0:
                blocks.append(bytes([wide]))
                continue
            blocks[-1] += data[:room]
            data = data[room:]
    return record(0x00FC, blocks[0]) + b"".join(record(0x003C, b) for b in blocks[1:])


def _cells(spec: XlsSheetSpec, strings: dict[str, int]) -> bytes:
    out = bytearray()  # grows in place, where bytes would be copied for each cell
    for row in sorted(spec.rows):
        for col, item in enumerate(spec.rows[row]):
            if item is None:
                continue
            c = item if isinstance(item, XlsCell) else XlsCell(item)
            head = struct.pack("<HHH", row - 1, col, 15 + c.style)
            v = c.value
            if c.tokens is not None:
                follows = b""
                if isinstance(v, bool):
                    result = bytes([1, 0, v, 0, 0, 0, 0xFF, 0xFF])
                elif isinstance(v, str):
                    result, follows = bytes([0, 0, 0, 0, 0, 0, 0xFF, 0xFF]), record(0x0207, _text(v))
                else:
                    result = struct.pack("<d", float(v or 0))
                out += record(0x0006, head + result + struct.pack("<HIH", 0, 0, len(c.tokens)) + c.tokens) + follows
            elif c.rk is not None:
                out += record(0x027E, head + struct.pack("<I", c.rk))
            elif isinstance(v, bool):
                out += record(0x0205, head + bytes([v, 0]))
            elif isinstance(v, int | float):
                out += record(0x0203, head + struct.pack("<d", float(v)))
            elif isinstance(v, str) and v.startswith("#ERR:"):
                out += record(0x0205, head + bytes([int(v[5:], 16), 1]))
            elif isinstance(v, str):
                out += record(0x00FD, head + struct.pack("<I", strings.setdefault(v, len(strings))))
            else:
                out += record(0x0201, head)
    return bytes(out)


def _ole(stream: bytes) -> bytes:
    stream = stream.ljust(max(4096, -(-len(stream) // 512) * 512), b"\0")
    n = len(stream) // 512
    n_fat = 1
    while n_fat * 128 < n + 1 + n_fat:
        n_fat += 1
    end, fat_mark = 0xFFFFFFFE, 0xFFFFFFFD
    fat = [k + 1 for k in range(n - 1)] + [end, end] + [fat_mark] * n_fat
    fat += [0xFFFFFFFF] * (n_fat * 128 - len(fat))

    def entry(name: str, kind: int, start: int, size: int, child: int) -> bytes:
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + struct.pack("<III", 0xFFFFFFFF, 0xFFFFFFFF, child) + b"\0" * 36 + struct.pack("<III", start, size, 0)

    directory = (entry("Root Entry", 5, end, 0, 1) + entry("Workbook", 2, 0, len(stream), 0xFFFFFFFF)).ljust(512, b"\0")
    tables = [n + 1 + k for k in range(n_fat)][:109]
    if n_fat > 109:
        raise ValueError("too large for this writer")
    head = MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIIIIIII", n_fat, n, 0, 4096, end, 0, end, 0)
    head += struct.pack("<109I", *tables, *[0xFFFFFFFF] * (109 - len(tables)))
    return head + stream + directory + struct.pack(f"<{len(fat)}I", *fat)


def write_xls(sheets: list[XlsSheetSpec], formats: dict[int, str] | None = None, xf_formats: list[int] | None = None, date1904: bool = False, globals_extra: bytes = b"") -> bytes:
    """A workbook; style k of a cell has the number format xf_formats[k]."""
    strings: dict[str, int] = {}
    bodies = []
    for s in sheets:
        wide = max((len(r) for r in s.rows.values()), default=0)
        dimension = struct.pack("<IIHHH", min(s.rows, default=1) - 1, max(s.rows, default=0), 0, wide, 0)
        merged = record(0x00E5, struct.pack("<H", len(s.merges)) + b"".join(struct.pack("<HHHH", *m) for m in s.merges)) if s.merges else b""
        bodies.append(record(0x0809, struct.pack("<HHHHII", 0x0600, 0x0010, 0, 0, 0, 0)) + record(0x0200, dimension) + s.before + _cells(s, strings) + s.extra + merged + record(0x000A))
    font = record(0x0031, struct.pack("<HHHHHBBBB", 200, 0, 0x7FFF, 400, 0, 0, 0, 0, 0) + _text("Arial", False))
    xfs = b"".join(record(0x00E0, struct.pack("<HHHBB", 0, k, 0, 0x20, 0) + b"\0" * 2 + struct.pack("<IIH", 0, 0, 0x20C0)) for k in [0] * 15 + (xf_formats or [0]))
    head = record(0x0809, struct.pack("<HHHHII", 0x0600, 0x0005, 0, 0, 0, 0)) + record(0x0022, struct.pack("<H", date1904)) + font * 4
    head += b"".join(record(0x041E, struct.pack("<H", k) + _text(c)) for k, c in (formats or {}).items()) + xfs
    tail = sst_records(list(strings)) + globals_extra + record(0x000A)
    bounds = sum(len(record(0x0085, b"\0" * 6 + _text(s.name, False))) for s in sheets)
    at, places = len(head) + bounds + len(tail), b""
    for s, body in zip(sheets, bodies, strict=True):
        places += record(0x0085, struct.pack("<IBB", at, s.state, 0) + _text(s.name, False))
        at += len(body)
    return _ole(head + places + tail + b"".join(bodies))
