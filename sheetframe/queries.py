"""Driver queries over the reference's operators, and the SQL that says the same.

Two families: tables that go through real files (written as XLSX, XLS or delimited bytes by the executors, a workbook per
range of the key, and read back by the scanners), and the grid algebra on a table seen as a sheet. What goes by row number or
address goes by workbook too, so the queries hold at any size. More queries over files are in file_queries.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.addressing import col_letter_expr, col_number_expr
from .functions.dates import EPOCH_SERIAL, format_seconds, serial_seconds, spark_pattern
from .functions.typing_rules import DateMode
from .operators import grid as g
from .operators.extents import actual_dimension, book_stat, stat
from .operators.grid import Grid, table_scan
from .operators.merged import merged_lookup
from .plans.book import Book, file_kinds
from .sources.formula import decompile
from .sources.ooxml import shift_formula
from .sources.workbook import ScanOptions, engine_rows
from .testing.xls_writer import XlsCell, XlsSheetSpec, write_xls
from .testing.xlsx_writer import BookSpec, Cell, SheetSpec, style_sheet, write_xlsx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Keys of a workbook, far under the 65,536 rows of an XLS sheet.
BOOK_ROWS = 4000


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_files(df: DataFrame, key: str, build: Callable[[list[tuple]], bytes], rows: int = BOOK_ROWS) -> DataFrame:
    """(path, content): a workbook for each `rows` values of a whole-number key, bucket-<key // rows>, its rows in order of the
    key, made once on the executors. Workbooks are dealt out to a given number of tasks: by the bytes of the table, which are few,
    Spark would leave a handful of tasks with all the writing and reading."""
    names = df.columns

    def make(table: pa.Table) -> pa.Table:
        table = table.sort_by(key)
        bucket = table.column("_bucket")[0].as_py()
        return pa.table({"path": [f"bucket-{bucket}"], "content": pa.array([build(list(zip(*(table.column(n).to_pylist() for n in names), strict=True)))], pa.binary())})

    tasks = 8 * df.sparkSession.sparkContext.defaultParallelism
    return df.withColumn("_bucket", F.floor(F.col(key) / rows)).repartition(tasks, "_bucket").groupBy("_bucket").applyInArrow(make, "path string, content binary").persist()


def _xlsx(header: list[str] | None, start_row: int = 1, start_col: int = 1, **kw: Any) -> Callable[[list[tuple]], bytes]:
    def build(rows: list[tuple]) -> bytes:
        lines = ([tuple(header)] if header else []) + rows
        sheet = SheetSpec("Data", {start_row + k: [None] * (start_col - 1) + list(line) for k, line in enumerate(lines)})
        return write_xlsx(BookSpec([sheet], **kw))

    return build


def _csv(header: list[str], delimiter: str = ",", encoding: str = "utf-8", end: str = "\n", before: str = "") -> Callable[[list[tuple]], bytes]:
    def cell(value: Any) -> str:
        text = "" if value is None else str(value)
        return '"' + text.replace('"', '""') + '"' if any(c in text for c in f'"\r\n{delimiter}') or text != text.strip() else text

    def build(rows: list[tuple]) -> bytes:
        return (before + "".join(delimiter.join(map(cell, row)) + end for row in [tuple(header), *rows])).encode(encoding)

    return build


def _book(files: DataFrame, **options: Any) -> Book:
    return Book(files.sparkSession, files, ScanOptions(**options))


def _sheet_of(df: DataFrame, order_by: list[str], columns: list[str] | None = None) -> Grid:
    """A table as a sheet without header, columns from A on."""
    return Grid(table_scan(df, order_by, columns))


def _serial(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(86_400_000_000.0) + EPOCH_SERIAL


# Through files


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def xlsx_rows_header(spark, sf_dir):
    df = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    rows = _book(as_files(df, "n_nationkey", _xlsx(df.columns, shared=True))).first_sheet().set_read_area("A1:C1048576", True).rows(types={"n_nationkey": "long", "n_regionkey": "long"})
    return rows.drop("row")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def xlsx_typed_inference(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return _book(as_files(df, "o_orderkey", _xlsx(df.columns))).first_sheet().with_header().rows(types="infer").drop("row")


@query("SELECT 'bucket-' || (c_custkey // 4000) AS book, (row_number() OVER (PARTITION BY c_custkey // 4000 ORDER BY c_custkey) + 1)::BIGINT AS r, c_name AS \"B\", c_acctbal AS \"C\" FROM customer QUALIFY r BETWEEN 3 AND 8")
def xlsx_area(spark, sf_dir):
    """An area, of every workbook."""
    df = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    rows = _book(as_files(df, "c_custkey", _xlsx(df.columns))).first_sheet().set_read_area("B3:C8").rows(types={"C": "double"}, book_name="book")
    return rows.select("book", F.col("row").cast("bigint").alias("r"), "B", "C")


@query("SELECT p_name AS \"B\", p_brand AS \"C\", p_type AS \"D\" FROM part")
def xlsx_columns_area(spark, sf_dir):
    df = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return _book(as_files(df, "p_partkey", _xlsx(None, shared=True))).first_sheet().set_read_area_columns("B:D").rows().drop("row")


@query("SELECT s_name AS supplier, s_nationkey::BIGINT AS s_nationkey FROM supplier")
def xlsx_header_offset(spark, sf_dir):
    """A table that begins at C5, with the header there and one name replaced."""
    df = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    grid = _book(as_files(df, "s_suppkey", _xlsx(df.columns, 5, 3))).first_sheet().from_cell("C5").with_header(["key", "supplier"])
    return grid.rows(types={"s_nationkey": "long"}).select("supplier", "s_nationkey")


@query("SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS seconds, strftime(o_orderdate, '%d.%m.%Y') AS shown FROM orders")
def xlsx_dates(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").select("o_orderkey", _serial(F.col("o_orderdate")).alias("at"))

    def build(rows: list[tuple]) -> bytes:
        sheet = SheetSpec("Data", {k: [key, Cell(at, style=1)] for k, (key, at) in enumerate(rows, 1)})
        return write_xlsx(BookSpec([sheet], styles=style_sheet(["dd\\.mm\\.yyyy"])))

    files = as_files(df, "o_orderkey", build)
    plain = _book(files).first_sheet().set_read_area("A:B").rows(types="long").select(F.col("A").alias("o_orderkey"), F.col("B").alias("seconds"))
    own = _book(files).date_formatter(True).first_sheet().set_read_area("A:B").rows(types={"A": "long"}).select(F.col("A").alias("key"), F.col("B").alias("shown"))
    return plain.join(own, plain["o_orderkey"] == own["key"]).drop("key")


@query("SELECT doc_id, text FROM documents")
def xlsx_unescape(spark, sf_dir):
    """Texts with line ends written as _xHHHH_ sequences."""
    df = _table(spark, sf_dir, "documents").select("doc_id", "text")

    def build(rows: list[tuple]) -> bytes:
        hide = lambda t: (t or "").replace("_x", "_x005F_x").replace("\n", "_x000A_").replace("\r", "_x000D_")
        return write_xlsx(BookSpec([SheetSpec("Data", {k: [key, hide(t)] for k, (key, t) in enumerate(rows, 1)})], shared=True))

    rows = _book(as_files(df, "doc_id", build, 500)).first_sheet().grid().rows(types={"A": "long"})
    return rows.select(F.col("A").alias("doc_id"), F.col("B").alias("text"))


@query("SELECT r_name AS name, CASE r_regionkey % 3 WHEN 0 THEN 'visible' WHEN 1 THEN 'hidden' ELSE 'veryHidden' END AS state, r_regionkey::BIGINT AS key FROM region")
def sheets_select(spark, sf_dir):
    """A sheet per region; every sheet read by itself."""
    rows = _table(spark, sf_dir, "region").select("r_regionkey", "r_name")

    def build(found: list[tuple]) -> bytes:
        return write_xlsx([SheetSpec(name, {1: [key]}, state=("visible", "hidden", "veryHidden")[key % 3]) for key, name in found])

    book = _book(as_files(rows, "r_regionkey", build))
    cells = book.cells().select("sheet", F.col("i").alias("key"))
    sheets = book.part("sheets").select(F.col("sheet").alias("name"), "state")
    return sheets.join(cells, sheets["name"] == cells["sheet"]).select("name", "state", "key")


@query("SELECT page_id, url FROM pages")
def hyperlinks_join(spark, sf_dir):
    """Links of cells, by a join of hyperlinks and cells on the address."""
    df = _table(spark, sf_dir, "pages").select("page_id", "url")

    def build(rows: list[tuple]) -> bytes:
        return write_xlsx([SheetSpec("Data", {k: [key] for k, (key, _) in enumerate(rows, 1)}, links=[(f"A{k}", url, None) for k, (_, url) in enumerate(rows, 1)])])

    book = _book(as_files(df, "page_id", build))
    cells = book.first_sheet().grid().cells(book_name="book").select("book", F.col("address").alias("ref"), F.col("i").alias("page_id"))
    return cells.join(book.first_sheet().hyperlinks(), ["book", "ref"]).select("page_id", F.col("link").alias("url"))


@query("SELECT o_orderkey, CASE WHEN r = 2 THEN '=A2*2+LOG10($A$1)' ELSE '=A' || r || '*2+LOG10($A$1)' END AS formula FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey // 4000 ORDER BY o_orderkey) + 1 AS r FROM orders)")
def formula_shift(spark, sf_dir):
    """A shared formula over all rows: the first has its text, the others only its number."""
    df = _table(spark, sf_dir, "orders").select("o_orderkey")

    def build(rows: list[tuple]) -> bytes:
        last = len(rows) + 1
        lines: dict[int, list[Any]] = {1: [10, None]}
        for k, (key,) in enumerate(rows, 2):
            lines[k] = [key, Cell(formula="A2*2+LOG10($A$1)" if k == 2 else "", formula_attrs=f' t="shared" si="0" ref="B2:B{last}"' if k == 2 else ' t="shared" si="0"', raw="1")]
        return write_xlsx([SheetSpec("Data", lines)])

    rows = _book(as_files(df, "o_orderkey", build)).first_sheet().set_read_area("A2").typed_rows()
    at = lambda k: F.get(F.filter("cells", lambda c: c["col"] == k), 0)
    return rows.select(at(1)["i"].alias("o_orderkey"), at(2)["f"].alias("formula"))


@query("SELECT p_partkey, p_name, p_retailprice, p_size::BIGINT AS p_size FROM part")
def xls_rows(spark, sf_dir):
    df = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice", "p_size")

    def build(rows: list[tuple]) -> bytes:
        return write_xls([XlsSheetSpec("Data", {1: list(df_names), **{k: list(r) for k, r in enumerate(rows, 2)}})])

    df_names = df.columns
    rows = _book(as_files(df, "p_partkey", build)).first_sheet().with_header().rows(types={"p_partkey": "long", "p_retailprice": "double", "p_size": "long"})
    return rows.drop("row")


@query("SELECT o_orderkey, (o_orderkey % 1000) / 100.0 AS hundredth, (o_orderkey % 1000)::BIGINT AS whole, CASE WHEN o_orderkey % 2 = 0 THEN '2*3' ELSE NULL END AS formula FROM orders")
def xls_rk_and_formulas(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").select("o_orderkey")

    def build(rows: list[tuple]) -> bytes:
        lines = {}
        for k, (key,) in enumerate(rows, 1):
            n = key % 1000
            lines[k] = [float(key), XlsCell(rk=n << 2 | 3), XlsCell(rk=n << 2 | 2), XlsCell(6, tokens=bytes.fromhex("1E02001E030005")) if key % 2 == 0 else None]
        return write_xls([XlsSheetSpec("Data", lines)])

    grid = _book(as_files(df, "o_orderkey", build)).first_sheet().set_read_area("A:D")
    typed = grid.typed_rows()
    at = lambda k: F.get(F.filter("cells", lambda c: c["col"] == k), 0)
    return typed.select(at(1)["i"].alias("o_orderkey"), F.coalesce(at(2)["d"], at(2)["i"].cast("double")).alias("hundredth"), at(3)["i"].alias("whole"), F.substring(at(4)["f"], 2, 100).alias("formula"))


@query("SELECT doc_id, text FROM documents")
def xls_sst_continue(spark, sf_dir):
    """Long texts in a shared string table that spreads over continuation records. A string holds 65,535 characters at most and
    a row 256 cells, so a text takes as many cells and rows as it needs."""
    df = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def build(rows: list[tuple]) -> bytes:
        lines: dict[int, list[Any]] = {}
        for key, text in rows:
            parts = [text[i : i + 30_000] for i in range(0, len(text), 30_000)] or [""]
            for at in range(0, len(parts), 200):
                lines[len(lines) + 1] = [float(key), float(at), *parts[at : at + 200]]
        return write_xls([XlsSheetSpec("Data", lines)])

    rows = _book(as_files(df, "doc_id", build, 200)).first_sheet().grid().typed_rows()
    parts = F.concat_ws("", F.transform(F.slice("cells", F.lit(3), F.size("cells")), lambda c: c["x"]))
    lines = rows.select(F.col("cells")[0]["i"].alias("doc_id"), F.struct(F.col("cells")[1]["i"].alias("at"), parts.alias("text")).alias("line"))
    whole = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return whole.select("doc_id", F.concat_ws("", "lines.text").alias("text"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def csv_roundtrip(spark, sf_dir):
    df = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return _book(as_files(df, "c_custkey", _csv(df.columns, end="\r\n"))).first_sheet().with_header().rows(types={"c_custkey": "long"}).drop("row")


@query("SELECT doc_id, text FROM documents")
def csv_quoted_multiline(spark, sf_dir):
    df = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return _book(as_files(df, "doc_id", _csv(df.columns), 500), kind="csv", csv={"delimiter": ","}).first_sheet().with_header().rows(types={"doc_id": "long"}).drop("row")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def csv_tsv_sniff(spark, sf_dir):
    df = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return _book(as_files(df, "s_suppkey", _csv(df.columns, "\t"))).first_sheet().with_header().rows(types={"s_suppkey": "long", "s_acctbal": "double"}).drop("row")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, 'Страна ' || lower(n_name) || ', столица и города' AS name FROM nation")
def csv_cp1251(spark, sf_dir):
    df = _table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("Страна "), F.lower("n_name"), F.lit(", столица и города")).alias("name"))
    return _book(as_files(df, "n_nationkey", _csv(df.columns, ";", "cp1251")), csv={"delimiter": ";"}).first_sheet().with_header().rows(types={"n_nationkey": "long"}).drop("row")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation WHERE n_nationkey % 5 <> 0")
def csv_comment_skip(spark, sf_dir):
    df = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    build = lambda rows: "".join(["n_nationkey,n_name\n", *(f"{'#' * (key % 5 == 0)}{key},{name}\n" for key, name in rows)]).encode()
    return _book(as_files(df, "n_nationkey", build), csv={"comment_prefix": "#", "delimiter": ","}).first_sheet().with_header().rows(types={"n_nationkey": "long"}).drop("row")


@query("SELECT (row_number() OVER (ORDER BY n_nationkey) + 1)::BIGINT AS r, n_name AS \"B\" FROM nation QUALIFY r >= 4")
def csv_from_row_col(spark, sf_dir):
    df = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = _book(as_files(df, "n_nationkey", _csv(df.columns)), csv={"delimiter": ","}).first_sheet().from_cell("B4").rows()
    return rows.select(F.col("row").cast("bigint").alias("r"), "B")


@query("SELECT doc_id::BIGINT AS doc_id, doc_id % 3 = 0 AS is_xls, doc_id % 3 = 1 AS is_xlsx FROM documents")
def file_signatures(spark, sf_dir):
    head = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("D0CF11E0A1B11AE100"))).when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("504B0304"))).otherwise(F.lit("a,b").cast("binary"))
    files = _table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), head.alias("content"))
    return file_kinds(files).select("doc_id", "is_xls", "is_xlsx")


@query("SELECT row_number() OVER (ORDER BY n_nationkey)::BIGINT + 1 AS r, n_nationkey::VARCHAR AS a, n_name AS b FROM nation")
def csv_keys_excel(spark, sf_dir):
    """The engine's own keys: letters for columns."""
    df = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = engine_rows(as_files(df, "n_nationkey", _csv(df.columns)), {"delimiter": ","}, None, 128, from_row=2)
    return rows.select(F.col("row").cast("bigint").alias("r"), F.element_at("cells", "A").alias("a"), F.element_at("cells", "B").alias("b"))


@query("SELECT row_number() OVER (ORDER BY n_nationkey)::BIGINT + 2 AS r, n_nationkey::VARCHAR AS a, n_name AS b FROM nation")
def csv_keys_one_based(spark, sf_dir):
    """The engine's one-based row key is the record number plus one."""
    df = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = engine_rows(as_files(df, "n_nationkey", _csv(df.columns)), {"delimiter": ","}, None, 8 | 16, from_row=2)
    return rows.select(F.col("row").cast("bigint").alias("r"), F.element_at("cells", "1").alias("a"), F.element_at("cells", "2").alias("b"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 1001 END AS code, CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE c_name END AS name FROM customer")
def csv_errors(spark, sf_dir):
    """Broken records come with their errors."""
    name = F.when(F.col("c_custkey") % 7 == 0, F.lit('x"y')).otherwise(F.col("c_name"))
    df = _table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"))
    build = lambda rows: "".join(f"{key},{name}\n" for key, name in rows).encode()
    found = _book(as_files(df, "c_custkey", build), csv={"delimiter": ","}).part("records")
    return found.select(F.col("fields")[0].cast("bigint").alias("c_custkey"), F.get("errors", 0)["code"].alias("code"), F.col("fields")[1].alias("name"))


@query("SELECT r_regionkey::BIGINT AS key, 'image' || r_regionkey || '.png' AS file_name, 'image/png' AS mime, (r_regionkey + 2)::BIGINT AS r FROM region")
def images_by_cell(spark, sf_dir):
    df = _table(spark, sf_dir, "region").select("r_regionkey")

    def build(rows: list[tuple]) -> bytes:
        return write_xlsx([SheetSpec("Data", {key + 2: [key] for (key,) in rows}, images=[(key + 2, 1, f"image{key}.png", b"\x89PNG" + bytes([key])) for (key,) in rows])])

    book = _book(as_files(df, "r_regionkey", build))
    cells = book.first_sheet().grid().cells(book_name="book").select("book", "row", F.col("i").alias("key"))
    return book.images().join(cells, ["book", "row"]).select("key", "file_name", "mime", F.col("row").cast("bigint").alias("r"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%m-%d-%y') AS shown, (epoch(o_orderdate)::BIGINT // 86400 + 25569)::VARCHAR AS original FROM orders")
def builtin_date_pattern(spark, sf_dir):
    """Builtin format 14 by the cell's own code, and the serial text."""
    df = _table(spark, sf_dir, "orders").select("o_orderkey", F.floor(_serial(F.col("o_orderdate"))).alias("at"))

    def build(rows: list[tuple]) -> bytes:
        return write_xlsx(BookSpec([SheetSpec("Data", {k: [key, Cell(at, style=1)] for k, (key, at) in enumerate(rows, 1)})], styles=style_sheet([14])))

    grid = _book(as_files(df, "o_orderkey", build)).date_formatter(True).first_sheet().set_read_area("A:B")
    at = lambda k: F.get(F.filter("cells", lambda c: c["col"] == k), 0)
    return grid.typed_rows().select(at(1)["i"].alias("o_orderkey"), at(2)["x"].alias("shown"), at(2)["o"].alias("original"))


# The grid algebra on a table


@query("SELECT o_orderkey::VARCHAR AS \"A\", o_orderstatus AS \"B\", (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS r FROM orders")
def key_row_zero(spark, sf_dir):
    return _orders(spark, sf_dir).rows(mode=g.KEYS_ROW_ZERO_BASED).select("A", "B", F.col("row").cast("bigint").alias("r"))


@query("SELECT o_orderkey::VARCHAR AS \"A\", o_orderstatus AS \"B\", (row_number() OVER (ORDER BY o_orderkey) - 4)::BIGINT AS r FROM orders QUALIFY r >= 1")
def key_row_one(spark, sf_dir):
    return _orders(spark, sf_dir).from_cell("A5").rows(mode=g.KEYS_ROW_ONE_BASED).select("A", "B", F.col("row").cast("bigint").alias("r"))


@query("SELECT o_orderstatus AS \"0\", o_totalprice AS \"1\", row_number() OVER (ORDER BY o_orderkey)::BIGINT AS r FROM orders")
def key_col_zero(spark, sf_dir):
    return _orders(spark, sf_dir).set_read_area_columns("B:C").rows(mode=g.KEYS_COL_ZERO_BASED, types={"1": "double"}).select("0", "1", F.col("row").cast("bigint").alias("r"))


@query("SELECT o_orderkey::VARCHAR AS \"1\", o_orderstatus AS \"2\", o_totalprice AS \"3\", row_number() OVER (ORDER BY o_orderkey)::BIGINT AS r FROM orders")
def key_one_based(spark, sf_dir):
    return _orders(spark, sf_dir).rows(mode=g.KEYS_ONE_BASED, types={"3": "double"}).select("1", "2", "3", F.col("row").cast("bigint").alias("r"))


def _orders(spark: SparkSession, sf_dir: str) -> Grid:
    return _sheet_of(_table(spark, sf_dir, "orders"), ["o_orderkey"], ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query("SELECT s_name AS name, s_acctbal AS balance, s_suppkey::VARCHAR AS \"A\" FROM supplier")
def explicit_rename(spark, sf_dir):
    grid = _sheet_of(_table(spark, sf_dir, "supplier"), ["s_suppkey"], ["s_suppkey", "s_name", "s_acctbal"])
    return grid.rows({"B": "name", "c": "balance"}, types={"balance": "double"}).select("name", "balance", "A")


@query("SELECT 'B' || r AS address, c_name AS value FROM (SELECT c_name, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) UNION ALL SELECT 'C' || r, c_mktsegment FROM (SELECT c_mktsegment, row_number() OVER (ORDER BY c_custkey) AS r FROM customer)")
def read_cells(spark, sf_dir):
    grid = _sheet_of(_table(spark, sf_dir, "customer"), ["c_custkey"], ["c_custkey", "c_name", "c_mktsegment"])
    return grid.set_read_area_columns("B:C").cells().select("address", "value")


@query("SELECT 'A' AS col, row_number() OVER (ORDER BY c_custkey)::BIGINT AS r, c_mktsegment AS value FROM customer")
def read_columns(spark, sf_dir):
    """Columns in the long form, which has no bound."""
    turned = _sheet_of(_table(spark, sf_dir, "customer"), ["c_custkey"], ["c_mktsegment"]).long_rows()
    return turned.select("col", F.col("row").cast("bigint").alias("r"), "value")


@query("SELECT r_name AS name, (r_regionkey + 1)::BIGINT AS r FROM region")
def key_first_row(spark, sf_dir):
    """The first row names the columns by mode, and rows count from 1 after it."""
    df = _table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    grid = _book(as_files(df, "r_regionkey", _xlsx(df.columns))).first_sheet().grid()
    return grid.rows(mode=g.KEYS_FIRST_ROW | g.KEYS_ROW_ONE_BASED).select(F.col("r_name").alias("name"), F.col("row").cast("bigint").alias("r"))


@query("SELECT n_nationkey::VARCHAR AS key, n_name FROM nation")
def header_names_short(spark, sf_dir):
    df = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return _book(as_files(df, "n_nationkey", _xlsx(df.columns))).first_sheet().with_header(["key"]).rows().select("key", "n_name")


@query("SELECT 'A' || 3 AS address, o_orderkey::VARCHAR AS value FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 2) UNION ALL SELECT 'B' || 3, o_orderstatus FROM (SELECT o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 2)")
def first_row_cells(spark, sf_dir):
    return _orders(spark, sf_dir).set_read_area("A3:B20").first_row_cells().select("address", "value")


@query("SELECT n_name AS name, (n_nationkey + 10.5)::DOUBLE AS height FROM nation")
def result_mode_row(spark, sf_dir):
    """Rows with their attributes."""
    df = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    def build(rows: list[tuple]) -> bytes:
        return write_xlsx([SheetSpec("Data", {k: [name] for k, (_, name) in enumerate(rows, 1)}, row_attrs={k: f'ht="{key + 10.5}"' for k, (key, _) in enumerate(rows, 1)})])

    rows = _book(as_files(df, "n_nationkey", build)).first_sheet().grid().rows(mode=g.RESULT_MODE_ROW)
    return rows.select(F.col("A").alias("name"), F.element_at("__row", "ht").cast("double").alias("height"))


@query("SELECT o_orderkey AS \"A\", o_orderstatus AS \"B\" FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 6")
def first_row(spark, sf_dir):
    grid = _sheet_of(_table(spark, sf_dir, "orders"), ["o_orderkey"], ["o_orderkey", "o_orderstatus"])
    return grid.from_cell("A7").first_row().select(F.col("A").cast("bigint").alias("A"), "B")


@query("SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 100")
def row_limit(spark, sf_dir):
    rows = _sheet_of(_table(spark, sf_dir, "events"), ["event_id"], ["event_id", "event_type"]).limit(100).rows(types={"A": "long"})
    return rows.select(F.col("A").alias("event_id"), F.col("B").alias("event_type"))


@query(r"SELECT doc_id, nullif(trim(lang || '', ' '), '') AS lang, nullif(trim(CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN chr(9) || ' x' || chr(10) ELSE source END, E' \t\n'), '') AS source FROM documents")
def trim_empty(spark, sf_dir):
    source = F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 == 1, "\t x\n").otherwise(F.col("source"))
    df = _table(spark, sf_dir, "documents").select("doc_id", "lang", source.alias("source"))
    rows = _sheet_of(df, ["doc_id"]).rows(mode=g.TRIM_STRINGS | g.TREAT_EMPTY_STRING_AS_EMPTY_CELL, types={"A": "long"})
    return rows.select(F.col("A").alias("doc_id"), F.col("B").alias("lang"), F.col("C").alias("source"))


@query("SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS seconds, (epoch(o_orderdate) + 1462 * 86400)::BIGINT AS seconds_1904 FROM orders")
def serial_to_seconds(spark, sf_dir):
    serial = _serial(F.col("o_orderdate"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", serial_seconds(serial).alias("seconds"), serial_seconds(serial, True).alias("seconds_1904"))


@query("SELECT c_custkey, ((CASE WHEN c_custkey <= 59 THEN c_custkey + 1 ELSE c_custkey END - 25569) * 86400)::BIGINT AS seconds FROM customer")
def serial_leap_bug(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", serial_seconds(F.col("c_custkey").cast("double")).alias("seconds"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%m-%d-%y') AS short, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS long, strftime(o_orderdate, '%d-%b-%y') AS named FROM orders")
def date_patterns(spark, sf_dir):
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    shown = {name: format_seconds(seconds, spark_pattern(code)).alias(name) for name, code in (("short", "mm-dd-yy"), ("long", "yyyy-mm-dd hh:mm:ss"), ("named", "dd-mmm-yy"))}
    return _table(spark, sf_dir, "orders").select("o_orderkey", *shown.values())


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS day FROM orders")
def date_formatter_fixed(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").select("o_orderkey", _serial(F.col("o_orderdate")).alias("at"))
    scan = table_scan(df, ["o_orderkey"])
    dated = lambda area, limit, mode: scan(area, limit, mode).withColumn("cells", F.transform("cells", lambda c: F.when(c["col"] == 2, c.withField("fmt", F.lit("date")).withField("s", F.lit(1))).otherwise(c)))
    dated.columns = scan.columns
    rows = Grid(dated).with_dates(DateMode("pattern", "yyyy/MM/dd")).rows(types={"A": "long"})
    return rows.select(F.col("A").alias("o_orderkey"), F.col("B").alias("day"))


@query("SELECT n::BIGINT AS n, CASE WHEN n > 702 THEN chr((65 + (n - 703) // 676)::INTEGER) ELSE '' END || CASE WHEN n > 26 THEN chr((65 + ((n - 27) // 26) % 26)::INTEGER) ELSE '' END || chr((65 + (n - 1) % 26)::INTEGER) AS letters, n::BIGINT AS back FROM range(1, 16385) t(n)")
def col_letters(spark, sf_dir):
    letters = spark.range(1, 16385).select(F.col("id").alias("n"), col_letter_expr(F.col("id")).alias("letters"))
    return letters.withColumn("back", col_number_expr(F.col("letters")).cast("bigint"))


@query("SELECT 1::BIGINT AS min_row, count(*)::BIGINT AS max_row, 1::BIGINT AS min_col, 3::BIGINT AS max_col, (3 * count(*))::BIGINT AS cells_total, (3 * count(*) - count(CASE WHEN event_id % 5 = 0 THEN 1 END))::BIGINT AS cells_filled FROM events")
def stat_sheet(spark, sf_dir):
    df = _table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))
    found = stat(_sheet_of(df, ["event_id"]).cell_relation())
    return found.select(*(F.col(c).cast("bigint").alias(c) for c in ("min_row", "max_row", "min_col", "max_col", "cells_total", "cells_filled")))


@query("SELECT 'A1:B' || count(*) AS dimension FROM customer")
def dimension(spark, sf_dir):
    cells = _sheet_of(_table(spark, sf_dir, "customer"), ["c_custkey"], ["c_custkey", "c_name"]).cell_relation()
    return actual_dimension(cells).select("dimension")


@query("SELECT o_orderpriority AS sheet, count(*)::BIGINT AS cells_total FROM orders GROUP BY ROLLUP (o_orderpriority)")
def stat_book(spark, sf_dir):
    """A sheet per priority, and all of them together."""
    null = F.lit(None)
    cells = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("sheet"), F.col("o_orderkey").cast("int").alias("row"), F.lit(1).alias("col"), F.col("o_orderkey").alias("i"), null.cast("double").alias("d"), null.cast("boolean").alias("b"), null.cast("string").alias("x"))
    return book_stat(cells).select("sheet", "cells_total")


@query("SELECT o_orderkey, CASE WHEN r % 10 BETWEEN 2 AND 5 THEN 'A' || (r - r % 10 + 2) || ':B' || (r - r % 10 + 5) END AS range FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders)")
def merged_ranges(spark, sf_dir):
    """Rows 2 to 5 of every ten are merged."""
    cells = _sheet_of(_table(spark, sf_dir, "orders"), ["o_orderkey"], ["o_orderkey"]).cell_relation().select("row", "col", F.col("i").alias("o_orderkey"))
    first = F.col("row")
    ranges = cells.where("row % 10 = 2").select(first.alias("row1"), F.lit(1).alias("col1"), (first + 3).alias("row2"), F.lit(2).alias("col2"), F.concat(F.lit("A"), first, F.lit(":B"), first + 3).alias("ref"), first.alias("position"))
    return merged_lookup(cells, ranges).select("o_orderkey", "range")


@query("SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem")
def typing_numbers(spark, sf_dir):
    """Numbers as text through the typing rules, without a file."""
    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    none = F.lit(None).cast("string")
    cell = lambda k, c: F.struct(F.lit(k).alias("col"), F.lit("").alias("t"), F.lit(0).alias("s"), c.cast("string").alias("raw"), none.alias("f"), none.alias("text"), F.lit("").alias("fmt"), F.lit("").alias("code"), F.lit(False).alias("base1904"))
    one = F.lit(1)
    rows = df.select(F.lit("").alias("book"), one.alias("row"), one.alias("first_row"), one.alias("first_col"), F.lit(0).cast("long").alias("head"), F.create_map().cast("map<string,string>").alias("attrs"), F.array(*(cell(k, df[c]) for k, c in enumerate(df.columns, 1))).alias("cells"))
    grid = Grid(lambda area, limit, mode: rows).set_read_area("A:C")
    return grid.rows(types={"A": "long", "B": "double", "C": "double"}).toDF("row", *df.columns).drop("row")


@query("SELECT doc_id, quality = 1 AS good, CASE WHEN toxic = 1 THEN '#N/A' ELSE '#DIV/0!' END AS mark FROM labels")
def typing_bool_err(spark, sf_dir):
    df = _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")

    def build(rows: list[tuple]) -> bytes:
        return write_xlsx([SheetSpec("Data", {k: [key, bool(q), Cell(kind="e", raw="#N/A" if t else "#DIV/0!")] for k, (key, q, t) in enumerate(rows, 1)})])

    rows = _book(as_files(df, "doc_id", build)).first_sheet().grid().rows(types={"A": "long", "B": "boolean"})
    return rows.select(F.col("A").alias("doc_id"), F.col("B").alias("good"), F.col("C").alias("mark"))


@query("SELECT r_regionkey::BIGINT AS key, CASE WHEN r_regionkey % 2 = 1 THEN '#FF0000' END AS fill, CASE WHEN r_regionkey % 2 = 1 THEN '0.00' ELSE 'General' END AS pattern FROM region")
def style_compose(spark, sf_dir):
    """Complete styles of cells, by joins of the style tables."""
    df = _table(spark, sf_dir, "region").select("r_regionkey")
    styles = (
        '<fonts><font><sz val="11"/></font></fonts><fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFFF0000"/></patternFill></fill></fills><borders><border/></borders>'
        '<cellStyleXfs><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs><cellXfs><xf numFmtId="0" fontId="0" fillId="0" borderId="0" xfId="0"/><xf numFmtId="2" fontId="0" fillId="1" borderId="0" xfId="0"/></cellXfs>'
    )

    def build(rows: list[tuple]) -> bytes:
        return write_xlsx(BookSpec([SheetSpec("Data", {k: [Cell(key, style=key % 2)] for k, (key,) in enumerate(rows, 1)})], styles=styles))

    cells = _book(as_files(df, "r_regionkey", build)).first_sheet().read_cells_with_styles()
    return cells.select(F.col("i").alias("key"), F.element_at("fill", "fill-color").alias("fill"), F.element_at("format", "format-pattern").alias("pattern"))


@query("SELECT o_orderkey, '=A' || (o_orderkey % 1000 + 1) || '+$B$2' AS shifted, CASE WHEN o_orderkey % 2 = 0 THEN '2*3' END AS tokens FROM orders")
def formula_columns(spark, sf_dir):
    """Formula shifting and token decompiling over columns."""
    df = _table(spark, sf_dir, "orders").select("o_orderkey")

    def both(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            shifted = [shift_formula("=A1+$B$2", k % 1000, 0) for k in keys]
            tokens = [decompile(bytes.fromhex("1E02001E030005" if k % 2 == 0 else "FF")) for k in keys]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shifted, pa.string()), pa.array(tokens, pa.string())], names=["o_orderkey", "shifted", "tokens"])

    return df.mapInArrow(both, "o_orderkey long, shifted string, tokens string")

from . import file_queries  # noqa: E402, F401  (registers its queries)
