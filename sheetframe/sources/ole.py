"""OLE2 compound files: named streams out of sector chains."""

from __future__ import annotations

import struct

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_END, _FREE = 0xFFFFFFFE, 0xFFFFFFFF


class OleError(ValueError):
    """A broken compound file."""


class OleFile:
    def __init__(self, data: bytes):
        if not data.startswith(MAGIC):
            raise OleError("not a compound file")
        if len(data) < 512:
            raise OleError("the header is cut short")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or mini_shift > shift:
            raise OleError("unknown sector size")
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        (n_fat, first_dir, _, self.mini_limit, first_mini, n_mini, first_more, n_more) = struct.unpack_from("<I I I I I I I I", data, 44)
        tables = list(struct.unpack_from("<109I", data, 76))
        at = first_more
        for _ in range(n_more):
            more = self._numbers(at)
            tables += more[:-1]
            at = more[-1]
        self.fat: list[int] = []
        for t in [x for x in tables if x < 0xFFFFFFFA][:n_fat]:
            self.fat += self._numbers(t)
        self.mini_fat = [x for s in self._chain(first_mini, self.fat) for x in self._numbers(s)] if n_mini else []
        self.entries: dict[str, tuple[int, int, int]] = {}
        root = None
        directory = b"".join(self._sector(s) for s in self._chain(first_dir, self.fat))
        for k in range(0, len(directory) - 127, 128):
            size_name = struct.unpack_from("<H", directory, k + 64)[0]
            kind = directory[k + 66]
            name = directory[k : k + max(0, size_name - 2)].decode("utf-16-le", "replace")
            start, size = struct.unpack_from("<II", directory, k + 116)
            if kind == 5:
                root = (start, size)
            elif kind == 2:
                self.entries.setdefault(name, (kind, start, size))
        self.mini = b"".join(self._sector(s) for s in self._chain(root[0], self.fat))[: root[1]] if root and root[1] else b""

    def _sector(self, k: int) -> bytes:
        at = (k + 1) * self.size
        if at >= len(self.data):
            raise OleError(f"sector {k} lies beyond the file")
        return self.data[at : at + self.size]

    def _numbers(self, k: int) -> list[int]:
        sector = self._sector(k)
        return list(struct.unpack_from(f"<{len(sector) // 4}I", sector))

    def _chain(self, k: int, table: list[int]) -> list[int]:
        out: list[int] = []
        while k < 0xFFFFFFFA:
            if k >= len(table) or len(out) > len(table):
                raise OleError("a sector chain leads nowhere or in a circle")
            out.append(k)
            k = table[k]
        return out

    def has(self, name: str) -> bool:
        return any(n.lower() == name.lower() for n in self.entries)

    def stream(self, name: str) -> bytes:
        for n, (_, start, size) in self.entries.items():
            if n.lower() == name.lower():
                if size < self.mini_limit:
                    return b"".join(self.mini[s * self.mini_size : (s + 1) * self.mini_size] for s in self._chain(start, self.mini_fat))[:size]
                return b"".join(self._sector(s) for s in self._chain(start, self.fat))[:size]
        raise OleError(f"no stream {name}")
