"""Office drawing records: the picture store of a workbook and the anchored pictures of a sheet."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

BSTORE, BSE, SP, OPT, ANCHOR = 0xF001, 0xF007, 0xF00A, 0xF00B, 0xF010
#: Picture records: id, extension, size of the part before the picture with one digest (fixed values).
BLIPS = {0xF01A: ("emf", 50), 0xF01B: ("wmf", 50), 0xF01C: ("pict", 50), 0xF01D: ("jpeg", 17), 0xF01E: ("png", 17), 0xF01F: ("dib", 17), 0xF029: ("tiff", 17), 0xF02A: ("jpeg", 17)}


def records(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(instance, type, body) of all records, containers opened."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        head, kind, size = struct.unpack_from("<HHI", data, at)
        body_end = min(at + 8 + size, end)
        if head & 15 == 15:
            yield head >> 4, kind, b""
            yield from records(data, at + 8, body_end)
        else:
            yield head >> 4, kind, data[at + 8 : body_end]
        at += 8 + size


def read_blip(data: bytes) -> tuple[str, bytes] | None:
    if len(data) < 8:
        return None
    head, kind, size = struct.unpack_from("<HHI", data)
    if kind not in BLIPS:
        return None
    extension, before = BLIPS[kind]
    if head >> 4 & 1:  # a second digest
        before += 16
    content = data[8 + before : 8 + size]
    if before >= 50 and data[8 + before - 2] == 0:  # a deflated metafile
        content = zlib.decompress(content)
    return extension, content


def blip_store(group: bytes) -> list[tuple[str, bytes]]:
    """(extension, content) of the pictures, by number from 1; an empty place has no content."""
    return [read_blip(body[36:]) or ("", b"") for _, kind, body in records(group) if kind == BSE]


def shapes(drawing: bytes) -> list[tuple[int, int, int, str | None]]:
    """(picture number, row, column from 0, name) of the anchored pictures."""
    out, picture, name = [], 0, None
    for count, kind, body in records(drawing):
        if kind == SP:
            picture, name = 0, None
        elif kind == OPT:
            extra = 6 * count
            for k in range(count):
                key, value = struct.unpack_from("<HI", body, 6 * k)
                if key & 0x3FFF == 0x0104:
                    picture = value
                if key & 0x8000:
                    if key & 0x3FFF == 0x0380:
                        name = body[extra : extra + value].decode("utf-16-le", "replace").rstrip("\0")
                    extra += value
        elif kind == ANCHOR and picture and len(body) >= 8:
            _, col, _, row = struct.unpack_from("<HHHH", body)
            out.append((picture, row, col, name))
    return out
