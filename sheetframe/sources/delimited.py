"""Delimited text: options, a strict or tolerant record parser, and the engine's own row reader. No Spark here.

Records are numbered from 1; a field with line ends in it makes one record. An empty line is the record []. A chunk without
quotes and escapes is split at C speed; only records with either go through the state machine.
"""

from __future__ import annotations

import base64
import io
import quopri
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from typing import Any, BinaryIO

from ..functions.addressing import Area, col_letter
from .sniff import SAMPLE_BYTES, bom_size, codec_of, detect_bom, detect_delimiter, detect_encoding, looks_binary

ERR_UNEXPECTED_QUOTES, ERR_UNEXPECTED_CHAR, ERR_UNEXPECTED_EOF, ERR_OTHER = 1001, 1003, 1002, 1004

KEYS_FIRST_ROW, KEYS_ROW_ZERO, KEYS_COL_ZERO, KEYS_ROW_ONE, KEYS_COL_ONE, KEYS_COL_EXCEL = 1, 2, 4, 8, 16, 128


class DelimitedError(ValueError):
    def __init__(self, code: int, message: str, record: int, column: int):
        super().__init__(f"{message} in {record}:{column}")
        self.code, self.record, self.column = code, record, column


@dataclass(frozen=True)
class DelimitedOptions:
    """double_quotes is accepted and has no effect: a doubled enclosure within quotes always stands for one. stream_filter is
    what the bytes pass through before anything else: convert.iconv.FROM/TO, a name of STREAM_FILTERS, or a function of bytes."""

    strict: bool = True
    encoding: str | None = None
    delimiter: str | None = None
    enclosure: str = '"'
    double_quotes: bool = True
    escape: str = ""
    trim_fields: bool = True
    skip_empty_lines: bool = False
    comment_prefix: str = ""
    allow_binary: bool = False
    stream_filter: str | Callable[[bytes], bytes] | None = None

    @classmethod
    def of(cls, options: dict[str, Any] | None = None) -> DelimitedOptions:
        """From names in snake or camel case; mode is strict or tolerant; delimiter auto is a guess."""
        given: dict[str, Any] = {}
        for name, value in (options or {}).items():
            key = re.sub(r"([A-Z])", lambda m: "_" + m[1].lower(), name)
            if key == "mode":
                key, value = "strict", str(value).lower() in ("strict", "true", "1")
            if key in ("strict", "double_quotes", "trim_fields", "skip_empty_lines", "allow_binary") and isinstance(value, str):
                value = value.lower() in ("true", "1", "yes")
            if key == "delimiter" and value == "auto":
                value = None
            if key in cls.__dataclass_fields__:
                given[key] = value
        return cls(**given)


#: Filters of a stream by name.
STREAM_FILTERS: dict[str, Callable[[bytes], bytes]] = {
    "zlib.inflate": lambda data: zlib.decompress(data, -15),
    "gzip": lambda data: zlib.decompress(data, 31),
    "convert.base64-decode": base64.b64decode,
    "convert.quoted-printable-decode": quopri.decodestring,
}


def filtered(stream: BinaryIO, options: DelimitedOptions) -> tuple[BinaryIO, DelimitedOptions]:
    """The stream behind the options' filter, and the options with the encoding that it leaves."""
    wanted = options.stream_filter
    if wanted is None:
        return stream, options
    if isinstance(wanted, str) and (m := re.fullmatch(r"convert\.iconv\.([^/]+?)[/.]([A-Za-z0-9_-]+)", wanted)):
        if codec_of(m[1]) is None or codec_of(m[2]) is None:
            raise DelimitedError(ERR_OTHER, f"Filter {wanted} is not supported", 0, 0)
        return stream, replace(options, encoding=m[1])
    give = STREAM_FILTERS.get(wanted) if isinstance(wanted, str) else wanted
    if give is None:
        raise DelimitedError(ERR_OTHER, f"Filter {wanted} is not supported", 0, 0)
    return io.BytesIO(give(stream.read())), options


def resolve(sample: bytes, options: DelimitedOptions) -> DelimitedOptions:
    """The options with encoding and delimiter settled by a sample of the file's start."""
    encoding = options.encoding
    if encoding and codec_of(encoding) is None:
        raise DelimitedError(ERR_OTHER, f"Encoding {encoding} is not supported", 0, 0)
    encoding = encoding or detect_encoding(sample)
    wide = encoding.upper().startswith(("UTF-16", "UTF-32"))
    if not options.allow_binary and not wide and looks_binary(sample):
        raise DelimitedError(ERR_OTHER, "The file appears to be binary, not delimited text", 0, 0)
    delimiter = options.delimiter
    if delimiter is None:
        text = sample[bom_size(sample) :].decode(codec_of(encoding), "replace")
        if len(sample) >= SAMPLE_BYTES:  # the last record is cut
            text = text[: max(text.rfind("\n"), text.rfind("\r")) + 1] or text
        best, confidence = detect_delimiter(text)
        delimiter = best if confidence >= 0.6 else ","
    return replace(options, encoding=encoding, delimiter=delimiter)


class RecordParser:
    """Characters to records, by the options' enclosure, escape and delimiter. on_error takes a DelimitedError; without one,
    the first error of a record is raised once the record has ended."""

    def __init__(self, options: DelimitedOptions, on_error: Callable[[DelimitedError], None] | None = None):
        self.o, self.on_error = options, on_error
        special = re.escape(options.enclosure) + (re.escape(options.escape) if options.escape else "")
        self._special = re.compile(f"[{special}]") if special else None
        self._piece = None
        if options.enclosure and not options.escape and len(options.delimiter or "") == 1:
            q, d = re.escape(options.enclosure), re.escape(options.delimiter)
            blanks = "[ \\t]*" if options.trim_fields else ""
            self._piece = re.compile(rf"{q}((?:[^{q}]++|{q}{q})*+){q}{blanks}({d}|\Z)|([^{q}{d}]*+)({d}|\Z)")
        self.record, self.errors = 0, []

    def records(self, chunks: Iterable[str]) -> Iterator[tuple[int, str, list[str]]]:
        """(number, the record's text, fields)."""
        for line in self._record_texts(chunks):
            self.record += 1
            yield self.record, line, self.fields(line)

    def _record_texts(self, chunks: Iterable[str]) -> Iterator[str]:
        """Cuts text into records with their line ends. Within an open quoted field line ends don't cut."""
        held, cut = "", re.compile(r"\r\n|\n|\r")
        source = iter(chunks)
        ended = False
        while not ended:
            block = next(source, None)
            if block is None:
                ended = True
            else:
                held += block
            at = begin = 0
            state = "start"
            while m := cut.search(held, at):
                if m[0] == "\r" and m.end() == len(held) and not ended:
                    break  # a line feed may follow
                state = self._advance(state, held, at, m.start())
                if state == "quoted":
                    at = m.end()
                    continue
                yield held[begin : m.end()]
                at = begin = m.end()
                state = "start"
            held = held[begin:]
        if held:
            yield held

    def _advance(self, state: str, text: str, at: int, end: int) -> str:
        """The state (start of a field, plain, quoted, or after closing quotes) at end, given that at `at`."""
        o = self.o
        if self._special is None or state != "quoted" and not self._special.search(text, at, end):
            return state
        while at < end:
            if state == "quoted":
                m = self._special.search(text, at, end)
                if not m:
                    return state
                at = m.end()
                if m[0] == o.enclosure:
                    if at < end and text[at] == o.enclosure:
                        at += 1
                    else:
                        state = "after"
                else:
                    at += 1
            elif state == "start" and text[at] == o.enclosure:
                state, at = "quoted", at + 1
            else:
                stop = text.find(o.delimiter, at, end)
                escaped = text.find(o.escape, at, end) if o.escape and state != "after" else -1
                if 0 <= escaped < (stop if stop >= 0 else end):
                    state, at = "plain", escaped + 2
                elif stop < 0:
                    return "after" if state == "after" else "plain"
                else:
                    state, at = "start", stop + 1
        return state

    def _open(self, text: str) -> bool:
        """Whether a record's text ends within quotes."""
        return self._advance("start", text, 0, len(text)) == "quoted"

    def fields(self, line: str) -> list[str]:
        body = line[:-2] if line.endswith("\r\n") else line[:-1] if line.endswith(("\n", "\r")) else line
        if not body:
            return []
        if self._special is None or not self._special.search(body):
            fields = body.split(self.o.delimiter)
            if self.o.trim_fields:
                last = fields[-1]
                fields = [f.strip(" \t\n\r\0\x0b") for f in fields]
                if len(line) == len(body):
                    fields[-1] = last  # cut by the end of the file, not by a line end
            return fields
        if self._piece and (found := self._well_formed(body, len(line) == len(body))) is not None:
            return found
        self.errors = []
        fields, unclosed = self._scan(line if self._open(body) else body, True, len(line) == len(body))
        if unclosed:
            self._error(ERR_UNEXPECTED_EOF, "Unexpected end within a quoted field", len(line))
        if self.o.strict and self.errors:
            if self.on_error is None:
                raise self.errors[0]
            for e in self.errors:
                self.on_error(e)
        return fields

    def _well_formed(self, body: str, at_end: bool) -> list[str] | None:
        """The fields of a record whose quotes are all in their place, None for another, which is for _scan."""
        out, at, n, q = [], 0, len(body), self.o.enclosure
        while m := self._piece.match(body, at):
            quoted, last = m[1] is not None, not (m[2] or m[4])
            value = m[1].replace(q + q, q) if quoted else m[3]
            if self.o.trim_fields and not quoted and not (last and at_end):
                value = value.strip(" \t\n\r\0\x0b")
            out.append(value)
            at = m.end()
            if last:
                return out
            if at == n:
                return [*out, ""]
        return None

    def _error(self, code: int, message: str, column: int) -> None:
        self.errors.append(DelimitedError(code, message, self.record, column))

    def _scan(self, text: str, report: bool, at_end: bool = False) -> tuple[list[str], bool]:
        """The fields of a record, and whether it ends within quotes."""
        o, n, at, out = self.o, len(text), 0, []
        while True:
            field: list[str] = []
            quoted = at < n and text[at] == o.enclosure
            within = closed = skipping = False
            if quoted:
                at, within = at + 1, True
            while at < n:
                c = text[at]
                if within:
                    if c == o.enclosure:
                        if at + 1 < n and text[at + 1] == o.enclosure:
                            field.append(c)
                            at += 2
                        else:
                            within, closed = False, True
                            at += 1
                    elif o.escape and c == o.escape and at + 1 < n:
                        field.append(text[at + 1])
                        at += 2
                    else:
                        field.append(c)
                        at += 1
                    continue
                if c == o.delimiter:
                    break
                at += 1
                if skipping:
                    continue
                if closed:
                    if o.trim_fields and c in " \t":
                        continue
                    if o.strict:
                        if report:
                            self._error(ERR_UNEXPECTED_CHAR, f"Unexpected character {c!r} after a quoted field", at)
                        skipping = True
                        continue
                    field.append(c)
                elif c == o.enclosure:
                    if o.strict:
                        if report:
                            self._error(ERR_UNEXPECTED_QUOTES, "Unexpected quotes", at)
                        skipping = True
                    else:
                        field.append(c)
                elif o.escape and c == o.escape and at < n:
                    field.append(text[at])
                    at += 1
                else:
                    field.append(c)
            value = "".join(field)
            last = at >= n
            if o.trim_fields and not quoted and not (last and at_end):
                value = value.strip(" \t\n\r\0\x0b")
            out.append(value)
            if last:
                return out, within
            at += 1  # past the delimiter
            if at >= n:
                out.append("")
                return out, False


def decoded(stream: BinaryIO, options: DelimitedOptions, block: int = 1 << 17) -> Iterator[str]:
    """The text of a stream without its byte order mark."""
    import codecs

    decoder = codecs.getincrementaldecoder(codec_of(options.encoding or "UTF-8"))("replace")
    head = stream.read(4)
    yield decoder.decode(head[bom_size(head) if detect_bom(head) else 0 :])
    while data := stream.read(block):
        yield decoder.decode(data)
    yield decoder.decode(b"", True)


class DelimitedReader:
    """A file's records, and rows the way the low-level engine gives them: columns from 0, rows by record number."""

    def __init__(self, source: bytes | BinaryIO, options: DelimitedOptions | dict | None = None, on_error: Callable[[DelimitedError], None] | None = None):
        asked = options if isinstance(options, DelimitedOptions) else DelimitedOptions.of(options)
        self.stream, asked = filtered(io.BytesIO(source) if isinstance(source, bytes) else source, asked)
        self.line_no = 0
        self._raw: Iterator[tuple[int, list[str]]] | None = None
        self.options, self.on_error = resolve(self.stream.read(SAMPLE_BYTES), asked), on_error
        self.header: bool = False
        self.names: list[str] = []
        self.start_row, self.start_col = 1, 1

    def from_row(self, row: int) -> DelimitedReader:
        self.start_row = row
        return self

    def from_col(self, col: int) -> DelimitedReader:
        self.start_col = col
        return self

    def with_header(self, names: list[str] | None = None) -> DelimitedReader:
        self.header, self.names = True, list(names or [])
        return self

    def records(self) -> Iterator[tuple[int, list[str]]]:
        """(record number, fields), comments left out, and empty lines where they are to be skipped."""
        self.stream.seek(0)
        parser = RecordParser(self.options, self.on_error)
        for number, line, fields in parser.records(decoded(self.stream, self.options)):
            if not fields and self.options.skip_empty_lines:
                continue
            if self.options.comment_prefix and line.startswith(self.options.comment_prefix):
                continue
            self.line_no = number
            yield number, fields

    def next_raw_row(self) -> list[str] | None:
        """The fields of the next record, comments left out, None at the end; line_no is its number, which counts empty and
        comment lines too."""
        if self._raw is None:
            self._raw = self.records()
        found = next(self._raw, None)
        if found is None:
            self._raw = None
            return None
        return found[1]

    def rows(self, keys: dict | list | bool | None = None, mode: int = 0, limit: int = 0) -> Iterator[tuple[int, dict[Any, str]]]:
        """(row key, column key to value). The header is a header only as record 1; longer rows get further keys; a one-based
        row key is the record number plus 1."""
        header = self.header or keys is True or bool(mode & KEYS_FIRST_ROW)
        names: dict[int, Any] = dict(enumerate(keys)) if isinstance(keys, list) else dict(keys) if isinstance(keys, dict) else {}
        columns: list[Any] = []
        given = 0

        def key(k: int) -> Any:
            return col_letter(k + 1) if mode & KEYS_COL_EXCEL else k + 1 if mode & KEYS_COL_ONE else k

        for number, fields in self.records():
            if number < self.start_row:
                continue
            if number == 1 and header:
                names = dict(enumerate(fields)) | names
                for k, name in zip(list(names), self.names, strict=False):
                    names[k] = name
                continue
            given += 1
            if limit and given > limit:
                return
            fields = fields[self.start_col - 1 :]
            if not columns:
                columns = [names.get(k) or key(k) for k in range(max(len(fields), len(names)) if names else len(fields))]
            columns += [key(k) for k in range(len(columns), len(fields))]
            row_key = number + 1 if mode & KEYS_ROW_ONE else number - 1 if mode & KEYS_ROW_ZERO else number
            yield row_key, dict(zip(columns, fields, strict=False))


class DelimitedSheet:
    """Delimited text as the one sheet of a book: id 1, name CSV, every cell a string without style."""

    kind = "csv"
    id, name, state, path = 1, "CSV", "visible", ""

    def __init__(self, reader: DelimitedReader):
        self.reader = reader

    def rows(self, area: Area = Area(), row_limit: int = 0, row_mode: bool = False) -> Iterator[tuple[int, dict[str, str], list[dict[str, Any]]]]:
        given = 0
        for number, fields in self.reader.records():
            if number > area.row_max:
                return
            if number < area.row_min:
                continue
            part = fields[area.col_min - 1 : area.col_max]
            if not part and not row_mode:
                continue
            yield number, {}, [{"col": area.col_min + k, "t": "s", "s": None, "raw": v, "f": None, "text": None, "fmt": "", "code": "", "base1904": False} for k, v in enumerate(part)]
            given += 1
            if row_limit and given >= row_limit:
                return


class DelimitedBook:
    kind = "csv"

    def __init__(self, source: bytes | BinaryIO, options: DelimitedOptions | dict | None = None):
        self.reader = DelimitedReader(source, options)
        self.sheets = [DelimitedSheet(self.reader)]
        self.defined_names: dict[str, str] = {}
        self.date1904 = False
