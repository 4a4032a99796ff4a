"""Delimited text of any size: a file is cut into splits as Spark's text source cuts it, and records are put together again.

At the start of a line a reader is at the start of a record or within a quoted field, nothing else. So a first pass works out,
for each split and either of the two, how the split ends and how many records begin in it; from a row for each split follow the
true state and the record number at its start. A second pass parses the records that lie within a split. What a split's ends cut
comes as fragments, at most two for a split, that are joined by record number. Memory is that of one record.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addressing import Area
from ..functions.typing_rules import RAW_CELL
from .delimited import ERR_OTHER, DelimitedError, DelimitedOptions, RecordParser, resolve
from .sniff import SAMPLE_BYTES, bom_size, codec_of

_PIECE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r)")
RECORDS = "book string, row bigint, fields array<string>"


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(book, at, line binary without its line feed), in order within a split."""
    text = spark.read.format("text").option("lineSep", "\n").load(paths)
    return text.select(F.col("_metadata.file_path").alias("book"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("line"))


def _settled(lines: DataFrame, csv: dict[str, Any] | None) -> DelimitedOptions:
    """The options, with what isn't named told from the first lines of the files, which are taken to be alike."""
    asked = DelimitedOptions.of(csv)
    if asked.stream_filter is not None:
        raise DelimitedError(ERR_OTHER, "A filtered stream can't be split", 0, 0)
    sample = b""
    if not (asked.encoding and asked.delimiter):
        for r in lines.where("at = 0").limit(2000).select("line").collect():
            sample += bytes(r["line"][:SAMPLE_BYTES]) + b"\n"
            if len(sample) >= SAMPLE_BYTES:
                break
    found = resolve(sample[:SAMPLE_BYTES], asked)
    if found.encoding.upper().startswith(("UTF-16", "UTF-32")):
        raise DelimitedError(ERR_OTHER, f"Text in {found.encoding} can't be split", 0, 0)
    return found


class _Split:
    """The lines of one split, piece by piece: a line may hold carriage returns that end records too."""

    def __init__(self, options: DelimitedOptions):
        self.parser, self.codec = RecordParser(options), codec_of(options.encoding or "UTF-8")

    def pieces(self, line: bytes, first: bool) -> list[str]:
        text = (line[bom_size(line) :] if first else line).decode(self.codec, "replace") + "\n"
        return [text] if "\r" not in text else _PIECE.findall(text)

    def after(self, quoted: bool, piece: str) -> bool:
        """Whether a quoted field is open at the end of a piece."""
        body = len(piece) - (2 if piece.endswith("\r\n") else 1)
        return self.parser._advance("quoted" if quoted else "start", piece, 0, body) == "quoted"


def _by_split(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    """(whether a new split begins, the row) of rows that begin with book and at."""
    key = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield row[:2] != key, row
            key = row[:2]


def _starts(lines: DataFrame, options: DelimitedOptions) -> DataFrame:
    """(book, at, quoted, number) of each split: whether it begins within a quoted field, and the number of the first record
    that begins in it."""

    def transitions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, here, ends, begun = _Split(options), None, [], []

        def give() -> pa.RecordBatch:
            columns = ([here[0]], [here[1]], [ends[0]], [begun[0]], [ends[1]], [begun[1]])
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["book", "at", "end0", "begun0", "end1", "begun1"])

        for new, (book, at, line) in _by_split(batches):
            if new:
                if here is not None:
                    yield give()
                here, ends, begun, first = (book, at), [False, True], [0, 0], at == 0
            for piece in split.pieces(line, first):
                for k in (0, 1):
                    begun[k] += not ends[k]
                    ends[k] = split.after(ends[k], piece)
            first = False
        if here is not None:
            yield give()

    def chained(table: pa.Table) -> pa.Table:
        quoted, number, out = False, 1, []
        for row in sorted(table.to_pylist(), key=lambda r: r["at"]):
            out.append((row["book"], row["at"], quoted, number))
            number += row["begun1"] if quoted else row["begun0"]
            quoted = row["end1"] if quoted else row["end0"]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.bool_(), pa.int64()), strict=True)], names=["book", "at", "quoted", "number"])

    found = lines.mapInArrow(transitions, "book string, at bigint, end0 boolean, begun0 bigint, end1 boolean, begun1 bigint")
    return found.groupBy("book").applyInArrow(chained, "book string, at bigint, quoted boolean, number bigint")


def split_records(spark: SparkSession, paths: str | list[str], csv: dict[str, Any] | None = None) -> DataFrame:
    """RECORDS of delimited files of any size, numbered in each file as DelimitedReader numbers them, comments and, where asked
    for, empty lines left out. An error within a record is raised. Encodings of two or four bytes a character, and filtered
    streams, can't be split; the last field of a file without a line end at its end is trimmed like any other."""
    lines = _lines(spark, paths)
    options = _settled(lines, csv)
    starts = _starts(lines, options)
    # A row for each split: its number is the input's size over the size of a split.
    placed = lines.join(F.broadcast(starts), ["book", "at"]).select("book", "at", "line", "quoted", "number")

    def wanted(text: str, fields: list[str]) -> bool:
        return not (options.skip_empty_lines and not fields or options.comment_prefix and text.startswith(options.comment_prefix))

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, out, weight = _Split(options), [], 0
        held, quoted, number, whole, first = [], False, 0, True, False
        here: tuple[str, int] = ("", 0)

        def give() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["book", "at", "row", "fields", "fragment"])

        def end_of_split() -> None:
            if held:
                out.append((*here, number - 1, None, "".join(held)))
                held.clear()

        for new, (book, at, line, was_quoted, from_number) in _by_split(batches):
            if new:
                end_of_split()
                here, quoted, number, whole, first = (book, at), was_quoted, from_number, not was_quoted, at == 0
            for piece in split.pieces(line, first):
                if not quoted:  # a record begins
                    number, whole = number + 1, True
                held.append(piece)
                quoted = split.after(quoted, piece)
                if not quoted:
                    text = "".join(held)
                    held.clear()
                    if whole:
                        split.parser.record = number - 1
                        fields = split.parser.fields(text)
                        if wanted(text, fields):
                            out.append((*here, number - 1, fields, None))
                    else:
                        out.append((*here, number - 1, None, text))
                    weight += len(text) + 50
            first = False
            if weight > 4 << 20:
                yield give()
                out, weight = [], 0
        end_of_split()
        if out:
            yield give()

    def joined(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["at"])
        text, parser = "".join(r["fragment"] for r in rows), RecordParser(options)
        parser.record = rows[0]["row"]
        fields = parser.fields(text)
        return pa.table([pa.array([rows[0]["book"]]), pa.array([rows[0]["row"]], pa.int64()), pa.array([fields], pa.list_(pa.string()))], names=["book", "row", "fields"]).slice(0, int(wanted(text, fields)))

    found = placed.mapInArrow(parse, "book string, at bigint, row bigint, fields array<string>, fragment string")
    whole = found.where("fragment is null").select("book", "row", "fields")
    return whole.union(found.where("fragment is not null").groupBy("book", "row").applyInArrow(joined, RECORDS))


def records_scan(records: DataFrame):
    """RECORDS as the scan of a Grid; first rows are looked up by file."""
    cell = lambda v, k: F.struct(k.cast("int").alias("col"), F.lit("s").alias("t"), F.lit(None).cast("int").alias("s"), v.alias("raw"), *(F.lit(None).cast("string").alias(n) for n in ("f", "text")), F.lit("").alias("fmt"), F.lit("").alias("code"), F.lit(False).alias("base1904"))

    def scan(area: Area, row_limit: int, row_mode: bool) -> DataFrame:
        part = F.slice("fields", F.lit(area.col_min), F.lit(area.col_max - area.col_min + 1))
        cells = F.transform(part, lambda v, k: cell(v, k + area.col_min)).cast(f"array<{RAW_CELL}>")
        rows = records.where(F.col("row").between(area.row_min, area.row_max)).select("book", F.col("row").cast("int").alias("row"), cells.alias("cells"))
        if not row_mode:
            rows = rows.where(F.size("cells") > 0)
        firsts = rows.groupBy(F.col("book").alias("_book")).agg(F.min("row").alias("first_row"), F.min_by("cells", "row").alias("_first"))
        known = firsts.select("_book", "first_row", F.array_min("_first.col").alias("first_col"), F.xxhash64("_first").alias("head"))
        out = rows.join(known, F.col("book") == F.col("_book")).select("book", "row", "first_row", "first_col", "head", F.create_map().cast("map<string,string>").alias("attrs"), "cells")
        if not row_limit:
            return out
        from pyspark.sql import Window

        return out.withColumn("_k", F.row_number().over(Window.partitionBy("book").orderBy("row"))).where(F.col("_k") <= row_limit).drop("_k")

    return scan
