"""More driver queries: metadata, styles, dates, formulas, pictures and text encodings, each through real files."""

from __future__ import annotations

import struct
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.addressing import range_stats_expr
from .functions.dates import serial_seconds, text_seconds
from .operators import grid as g
from .plans.book import open_bytes, open_stream
from .queries import _book, _csv, _orders, _serial, _sheet_of, _table, _xlsx, as_files, query
from .sources.formula import _ARGUMENTS, FUNCTIONS, decompile
from .sources.sniff import codec_of, detect_bom, detect_delimiter, detect_encoding, is_utf8, looks_binary
from .sources.workbook import engine_rows
from .testing.xls_writer import XlsCell, XlsSheetSpec, record, write_xls
from .testing.xlsx_writer import BookSpec, Cell, SheetSpec, style_sheet, write_xlsx

# Opening


@query("SELECT r_regionkey::BIGINT AS key, r_name AS name FROM region")
def open_string(spark, sf_dir):
    """A workbook that is at hand as bytes: the five regions."""
    rows = _table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").collect()
    book = open_bytes(spark, write_xlsx([SheetSpec("Data", {k: list(r) for k, r in enumerate(rows, 1)})]))
    return book.read_rows(types={"A": "long"}).select(F.col("A").alias("key"), F.col("B").alias("name"))


@query("SELECT r_regionkey::BIGINT AS key, r_name AS name FROM region")
def open_stream_rows(spark, sf_dir):
    import io

    rows = _table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").collect()
    book = open_stream(spark, io.BytesIO("".join(f"{a},{b}\n" for a, b in rows).encode()), csv={"delimiter": ","})
    return book.read_rows(types={"A": "long"}).select(F.col("A").alias("key"), F.col("B").alias("name"))


@query("SELECT n_nationkey::BIGINT AS key, n_name AS name FROM nation")
def open_xls_only(spark, sf_dir):
    """The kind named beforehand instead of told by the first bytes."""
    df = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    build = lambda rows: write_xls([XlsSheetSpec("S", {k: list(r) for k, r in enumerate(rows, 1)})])
    rows = _book(as_files(df, "n_nationkey", build), kind="xls").first_sheet().grid().rows(types={"A": "long"})
    return rows.select(F.col("A").alias("key"), F.col("B").alias("name"))


@query("SELECT 'bucket-' || r_regionkey AS book, e.entry FROM region, (VALUES ('xl/workbook.xml'), ('xl/worksheets/sheet1.xml'), ('xl/_rels/workbook.xml.rels'), ('_rels/.rels'), ('[Content_Types].xml')) e(entry)")
def package_entries(spark, sf_dir):
    df = _table(spark, sf_dir, "region").select("r_regionkey")
    return _book(as_files(df, "r_regionkey", _xlsx(None), 1)).entries().select("book", "entry")


@query("SELECT 'bucket-' || r_regionkey AS book, 'S' || r_regionkey AS sheet FROM region")
def package_contents(spark, sf_dir):
    """A file within the package, read as it is."""
    df = _table(spark, sf_dir, "region").select("r_regionkey")
    book = _book(as_files(df, "r_regionkey", lambda rows: write_xlsx([SheetSpec(f"S{rows[0][0]}", {1: [1]})]), 1))
    return book.contents("xl/workbook.xml").select("book", F.regexp_extract(F.col("content").cast("string"), '<sheet name="([^"]*)"', 1).alias("sheet"))


@query("SELECT 'bucket-' || r_regionkey AS book, r_regionkey % 2 = 0 AS ok FROM region")
def package_validate(spark, sf_dir):
    """Every other package has a part that isn't well formed."""
    df = _table(spark, sf_dir, "region").select("r_regionkey")
    build = lambda rows: write_xlsx(BookSpec([SheetSpec("S", {1: [1]})], parts={"xl/extra.xml": b"<a>" if rows[0][0] % 2 else b"<a/>"}))
    return _book(as_files(df, "r_regionkey", build, 1)).validate().groupBy("book").agg(F.every("ok").alias("ok"))


@query("SELECT CASE WHEN k = 3 THEN 'e' ELSE n_name END AS name, k::BIGINT AS k, n_nationkey::BIGINT AS key FROM (SELECT *, n_nationkey % 3 + 1 AS k FROM nation) WHERE k < 3")
def book_of_files(spark, sf_dir):
    """Workbooks whose columns are in another order, whose header is in another row, and which lack the sheet."""
    df = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    def build(rows: list[tuple]) -> bytes:
        ((key, name),) = rows
        kind = key % 3
        lines = {1: ["key", "name"], 2: [key, name]} if kind == 0 else {5: ["name", None, "key"], 6: [name, None, key]}
        other = SheetSpec("Other", {1: ["key"], 2: [99]}, sheet_id=7)
        return write_xlsx([other, SheetSpec("Data", lines, sheet_id=9)] if kind == 1 else [SheetSpec("data" if kind == 0 else "None", lines)])

    rows = _book(as_files(df, "n_nationkey", build, 1)).get_sheet("DATA").with_header().rows(types={"key": "long"}, mode=g.KEYS_ROW_ONE_BASED)
    return rows.select("name", (F.col("row") + F.col("key") % 3).cast("bigint").alias("k"), "key")


# Selection, keys and verbs


@query("SELECT n_name AS name, n_regionkey::BIGINT AS region FROM nation WHERE n_nationkey BETWEEN 2 AND 5")
def named_area(spark, sf_dir):
    """A defined name that lies on the second sheet, asked of the book."""
    df = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    build = lambda rows: write_xlsx(BookSpec([SheetSpec("First", {1: ["x"]}), SheetSpec("It's here", {k: list(r) for k, r in enumerate(rows, 1)})], names={"Part": "'It''s here'!$B$3:$C$6"}))
    return _book(as_files(df, "n_nationkey", build)).set_read_area("PART").rows(types={"C": "long"}).select(F.col("B").alias("name"), F.col("C").alias("region"))


@query("SELECT o_orderkey::VARCHAR AS \"0\", o_orderstatus AS \"1\", (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS r FROM orders")
def key_zero_based(spark, sf_dir):
    return _orders(spark, sf_dir).rows(mode=g.KEYS_ZERO_BASED).select("0", "1", F.col("row").cast("bigint").alias("r"))


@query("SELECT o_orderkey::VARCHAR AS \"A\", row_number() OVER (ORDER BY o_orderkey)::BIGINT AS r FROM orders")
def key_relative(spark, sf_dir):
    """A flag without effect."""
    return _orders(spark, sf_dir).rows(mode=g.KEYS_RELATIVE).select("A", F.col("row").cast("bigint").alias("r"))


@query("SELECT book, col, string_agg(r || ':' || value, '|' ORDER BY r) AS cells FROM (SELECT 'bucket-' || (s_suppkey // 4000) AS book, row_number() OVER (PARTITION BY s_suppkey // 4000 ORDER BY s_suppkey) AS r, s_suppkey::VARCHAR AS a, s_name AS b FROM supplier) UNPIVOT (value FOR col IN (a AS 's_suppkey', b AS 's_name')) GROUP BY book, col")
def rows_swapped(spark, sf_dir):
    """Rows turned to columns, in each workbook, with the first row as header."""
    df = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    turned = _book(as_files(df, "s_suppkey", _xlsx(df.columns))).first_sheet().grid().rows(mode=g.KEYS_SWAP | g.KEYS_FIRST_ROW | g.KEYS_ROW_ONE_BASED, book_name="book")
    return turned.select("book", "col", F.array_join(F.transform("values", lambda x: F.concat(x["row"].cast("string"), F.lit(":"), x["value"])), "|").alias("cells"))


@query("SELECT * FROM (VALUES ('empty', false, 25), ('empty and flag', true, 25), ('true', true, 25), ('false', false, 26), ('null', false, 26), ('map', false, 26), ('map and flag', true, 25)) t(asked, named, n)")
def header_precedence(spark, sf_dir):
    """What makes the first row a header, of an area that says so: rows counted, and whether names come from it."""
    df = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    grid = _book(as_files(df, "n_nationkey", _xlsx(df.columns))).first_sheet().set_read_area("A1:B100", True)
    plain = g.replace(grid, first_row_keys=False)
    cases = (
        ("empty", grid, (), 0, True),
        ("empty and flag", plain, (), g.KEYS_FIRST_ROW, False),
        ("true", plain, True, 0, False),
        ("false", grid, False, 0, False),
        ("null", grid, None, 0, False),
        ("map", grid, {"A": "key"}, 0, False),
        ("map and flag", plain, {"A": "key"}, g.KEYS_FIRST_ROW, False),
    )
    out = None
    for asked, own, keys, mode, _ in cases:
        rows = own.rows(keys, mode)
        one = rows.agg(F.lit(asked).alias("asked"), F.lit("n_name" in rows.columns and asked != "empty").alias("named"), F.count("*").cast("int").alias("n"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT n_name AS name, n_nationkey::BIGINT AS key FROM nation WHERE n_nationkey >= 3")
def rows_from_cell(spark, sf_dir):
    df = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = _book(as_files(df, "n_nationkey", _xlsx(None))).first_sheet().read_rows_from("A4", types={"A": "long"})
    return rows.select(F.col("B").alias("name"), F.col("A").alias("key"))


@query("SELECT 'bucket-' || n_nationkey AS book, (n_nationkey % 7 + 1)::BIGINT AS first_row, CASE WHEN n_nationkey % 2 = 0 THEN 'A' ELSE 'C' END AS first_col FROM nation")
def first_row_and_column(spark, sf_dir):
    df = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    build = lambda rows: write_xlsx([SheetSpec("S", {rows[0][0] % 7 + 1: [None] * (rows[0][0] % 2 * 2) + [rows[0][1]], 30: ["end"]})])
    found = _book(as_files(df, "n_nationkey", build, 1)).first_sheet().grid().first_row_number(book_name="book")
    return found.select("book", F.col("first_row").cast("bigint").alias("first_row"), "first_col")


# Cell values


@query("SELECT c_custkey, lpad(c_custkey::VARCHAR, 9, '0') AS code, c_custkey % 2 = 0 AS inline FROM customer")
def strings_stay_strings(spark, sf_dir):
    """Shared and inline texts that look like numbers."""
    df = _table(spark, sf_dir, "customer").select("c_custkey")

    def build(rows: list[tuple]) -> bytes:
        inline = rows[0][0] // 1000 % 2 == 0
        return write_xlsx(BookSpec([SheetSpec("S", {k: [key, f"{key:09}", key % 2 == 0] for k, (key,) in enumerate(rows, 1)})], shared=not inline))

    rows = _book(as_files(df, "c_custkey", build, 1000)).first_sheet().set_read_area("A:C").typed_rows()
    at = lambda k: F.get(F.filter("cells", lambda c: c["col"] == k), 0)
    return rows.select(at(1)["i"].alias("c_custkey"), at(2)["x"].alias("code"), at(3)["b"].alias("inline"))


@query("SELECT o_orderkey, epoch(o_orderdate)::BIGINT + 19263 AS seconds FROM orders")
def text_dates(spark, sf_dir):
    """Dates as text under a date style, in five forms, with a time."""
    forms = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy", "dd-MM-yyyy")
    day = F.col("o_orderdate").cast("timestamp")
    written = F.coalesce(*(F.when(F.col("o_orderkey") % 5 == k, F.date_format(day, f"{form} '05:21:03'")) for k, form in enumerate(forms)))
    df = _table(spark, sf_dir, "orders").select("o_orderkey", written.alias("day"))
    build = lambda rows: write_xlsx(BookSpec([SheetSpec("S", {k: [key, Cell(text, style=1)] for k, (key, text) in enumerate(rows, 1)})], styles=style_sheet(["yyyy-mm-dd"]), shared=True))
    return _book(as_files(df, "o_orderkey", build)).first_sheet().set_read_area("A:B").rows(types="long").select(F.col("A").alias("o_orderkey"), F.col("B").alias("seconds"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '25569' END AS shown FROM customer")
def zero_dates_show_the_original(spark, sf_dir):
    """A text that is no date, and the serial of second 0, under a date style."""
    df = _table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    build = lambda rows: write_xlsx(BookSpec([SheetSpec("S", {k: [key, Cell(name, style=1) if key % 2 == 0 else Cell(25569, style=1)] for k, (key, name) in enumerate(rows, 1)})], styles=style_sheet(["yyyy-mm-dd"]), shared=True))
    return _book(as_files(df, "c_custkey", build)).first_sheet().set_read_area("A:B").rows(types={"A": "long"}).select(F.col("A").alias("c_custkey"), F.col("B").alias("shown"))


@query("SELECT id::INTEGER AS s, category, code FROM (VALUES (0, '', 'General'), (1, 'number', '0.00'), (2, 'number', '000'), (3, '', '#,##0'), (4, '', '@'), (5, 'date', 'dd.mm.yyyy'), (6, 'date', '[h]:mm'), (7, 'date', 'mm-dd-yy'), (8, 'string', '@'), (9, 'number', '0%')) t(id, category, code)")
def style_categories(spark, sf_dir):
    """Categories and codes of styles: declared codes by their text, builtin ones by their id."""
    files = as_files(_table(spark, sf_dir, "region").where("r_regionkey = 0").select("r_regionkey"), "r_regionkey", lambda rows: write_xlsx(BookSpec([SheetSpec("S", {1: [1]})], styles=style_sheet(["0.00", "000", "#,##0", "@", "dd.mm.yyyy", "[h]:mm", 14, 49, 9]))))
    return _book(files).style_types().select("s", "category", "code")


@query("SELECT id::INTEGER AS s, category, code FROM (VALUES (15, '', 'General'), (16, 'date', 'dd.mm.yyyy'), (17, '', '#,##0.00\" pcs\"'), (18, 'number', '000'), (19, 'string', '@'), (20, 'date', 'h:mm')) t(id, category, code)")
def xls_style_categories(spark, sf_dir):
    files = as_files(_table(spark, sf_dir, "region").where("r_regionkey = 0").select("r_regionkey"), "r_regionkey", lambda rows: write_xls([XlsSheetSpec("S", {1: [1]})], {52: "dd.mm.yyyy", 57: '#,##0.00" pcs"', 58: "000", 165: "@"}, [0, 52, 57, 58, 165, 20]))
    return _book(files).style_types().where("s >= 15").select("s", "category", "code")


def _dated(spark, sf_dir) -> DataFrame:
    """Workbooks of (o_orderkey, date), the dates with the builtin code 14."""
    df = _table(spark, sf_dir, "orders").select("o_orderkey", F.floor(_serial(F.col("o_orderdate"))).alias("at"))
    return as_files(df, "o_orderkey", lambda rows: write_xlsx(BookSpec([SheetSpec("S", {k: [key, Cell(at, style=1)] for k, (key, at) in enumerate(rows, 1)})], styles=style_sheet([14]))))


def _shown(book) -> DataFrame:
    return book.first_sheet().set_read_area("A:B").rows(types={"A": "long"}).select(F.col("A").alias("o_orderkey"), F.col("B").alias("shown"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS shown FROM orders")
def date_format_set(spark, sf_dir):
    return _shown(_book(_dated(spark, sf_dir)).set_date_format("d.m.Y"))


@query("SELECT o_orderkey, (epoch(o_orderdate)::BIGINT // 86400 + 25569)::VARCHAR AS shown FROM orders")
def date_formatter_none(spark, sf_dir):
    return _shown(_book(_dated(spark, sf_dir)).date_formatter(None))


@query("SELECT o_orderkey, epoch(o_orderdate)::BIGINT::VARCHAR AS shown FROM orders")
def date_formatter_false(spark, sf_dir):
    return _shown(_book(_dated(spark, sf_dir)).date_formatter(False))


@query("SELECT o_orderkey, 'mm-dd-yy/' || (epoch(o_orderdate)::BIGINT // 86400) AS shown FROM orders")
def date_formatter_function(spark, sf_dir):
    return _shown(_book(_dated(spark, sf_dir)).date_formatter(lambda seconds, code, style: F.concat(code, F.lit("/"), F.floor(seconds / 86400).cast("string"))))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%y') AS shown FROM orders")
def locale_formats(spark, sf_dir):
    return _shown(_book(_dated(spark, sf_dir)).use_locale_formats("de_DE"))


# Styles


@query("SELECT r_regionkey::BIGINT AS key, CASE WHEN r_regionkey % 2 = 1 THEN 'center' END AS horizontal, CASE WHEN r_regionkey % 2 = 1 THEN 'top' END AS vertical, CASE WHEN r_regionkey % 2 = 1 THEN '1' END AS wrap, CASE WHEN r_regionkey % 2 = 1 THEN 'date' ELSE 'general' END AS category FROM region")
def style_alignment(spark, sf_dir):
    styles = style_sheet(["yyyy"]).replace('xfId="0"/></cellXfs>', 'xfId="0"><alignment horizontal="center" vertical="top" wrapText="true"/></xf></cellXfs>')
    df = _table(spark, sf_dir, "region").select("r_regionkey")
    build = lambda rows: write_xlsx(BookSpec([SheetSpec("S", {k: [Cell(key + 30000 * (key % 2), style=key % 2)] for k, (key,) in enumerate(rows, 1)})], styles=styles))
    cells = _book(as_files(df, "r_regionkey", build)).date_formatter(None).first_sheet().read_cells_with_styles()
    of = lambda k: F.element_at("format", f"format-{k}")
    return cells.select((F.col("o").cast("bigint") % 30000).alias("key"), of("align-horizontal").alias("horizontal"), of("align-vertical").alias("vertical"), of("wrap-text").alias("wrap"), of("category").alias("category"))


def _xls_styled(rows: list[tuple]) -> bytes:
    """Keys in a bold red Verdana of 14 points, centred on a yellow fill of the file's own palette, with thick left borders."""
    font = struct.pack("<HHHHHBBBB", 280, 2, 10, 700, 0, 1, 0, 0, 0) + struct.pack("<BB", 7, 0) + b"Verdana"
    xf = struct.pack("<HHHBB", 5, 2, 0, 0x02 | 0x08 | 0x10, 0) + b"\0\0" + struct.pack("<IIH", 5 | 10 << 16, 1 << 26, 9)
    palette = record(0x0092, struct.pack("<H", 3) + bytes.fromhex("11111100") + bytes.fromhex("FFEE0000") + bytes.fromhex("AA000000"))
    return write_xls([XlsSheetSpec("S", {k: [XlsCell(key, style=key % 2)] for k, (key,) in enumerate(rows, 1)})], globals_extra=record(0x0031, font) + palette + record(0x00E0, xf))


@query("SELECT r_regionkey::BIGINT AS key, CASE WHEN odd THEN 'Verdana' ELSE 'Arial' END AS font, CASE WHEN odd THEN '14' ELSE '10' END AS size, CASE WHEN odd THEN '1' END AS bold, CASE WHEN odd THEN '#AA0000' END AS color, CASE WHEN odd THEN '#FFEE00' END AS fill, CASE WHEN odd THEN 'thick' END AS border, CASE WHEN odd THEN 'center' END AS horizontal, CASE WHEN odd THEN '1' END AS wrap, CASE WHEN odd THEN 'number' ELSE 'general' END AS category FROM (SELECT *, r_regionkey % 2 = 1 AS odd FROM region)")
def xls_styles(spark, sf_dir):
    """Fonts, fills, borders, alignment and palette of a legacy workbook."""
    cells = _book(as_files(_table(spark, sf_dir, "region").select("r_regionkey"), "r_regionkey", _xls_styled)).first_sheet().read_cells_with_styles()
    of = lambda group, key: F.element_at(group, f"{group}-{key}")
    parts = {"font": of("font", "name"), "size": of("font", "size"), "bold": of("font", "style-bold"), "color": of("font", "color"), "fill": of("fill", "color"), "border": of("border", "left-style"), "horizontal": of("format", "align-horizontal"), "wrap": of("format", "wrap-text"), "category": of("format", "category")}
    return cells.select(F.col("i").alias("key"), *(c.alias(n) for n, c in parts.items()))


_THEME = '<a:theme xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:themeElements><a:clrScheme name="x"><a:lt1><a:srgbClr val="000000"/></a:lt1><a:dk1><a:srgbClr val="FFFFFF"/></a:dk1></a:clrScheme></a:themeElements></a:theme>'


@query("SELECT * FROM (VALUES (1::BIGINT, '#112233'), (2, '#000000'), (3, '#808080'), (4, '#808080'), (5, '#FF0000'), (6, '#0000FF')) t(key, color)")
def colors_of_cells(spark, sf_dir):
    """Colours as they are written, by theme with and without tint, and by index."""
    colors = ['rgb="FF112233"', 'theme="0"', 'theme="0" tint="0.5"', 'theme="1" tint="-0.5"', 'indexed="10"', 'indexed="4"']
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor {c}/></patternFill></fill>' for c in colors)
    xfs = "".join(f'<xf numFmtId="0" fontId="0" fillId="{k}" borderId="0" xfId="0"/>' for k in range(len(colors) + 1))
    styles = f'<fonts><font/></fonts><fills><fill><patternFill patternType="none"/></fill>{fills}</fills><borders><border/></borders><cellStyleXfs><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs><cellXfs>{xfs}</cellXfs>'
    build = lambda rows: write_xlsx(BookSpec([SheetSpec("S", {1: [Cell(k, style=k) for k in range(1, 7)]})], styles=styles, theme=_THEME))
    cells = _book(as_files(_table(spark, sf_dir, "region").where("r_regionkey = 0").select("r_regionkey"), "r_regionkey", build)).first_sheet().read_cells_with_styles("fill-color")
    return cells.select(F.col("i").alias("key"), F.col("style").alias("color"))


def _styled(spark, sf_dir):
    """Nations, odd keys in bold; the header in plain."""
    styles = (
        '<fonts><font><sz val="11"/><name val="Calibri"/></font><font><b/></font></fonts><fills><fill><patternFill patternType="none"/></fill></fills><borders><border/></borders><cellStyleXfs><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs>'
        '<cellXfs><xf numFmtId="0" fontId="0" fillId="0" borderId="0" xfId="0"/><xf numFmtId="2" fontId="1" fillId="0" borderId="0" xfId="0"/></cellXfs>'
    )
    df = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    build = lambda rows: write_xlsx(BookSpec([SheetSpec("S", {1: ["key", "name"], **{k: [Cell(key, style=key % 2), name] for k, (key, name) in enumerate(rows, 2)}})], styles=styles))
    return _book(as_files(df, "n_nationkey", build))


@query("SELECT 'A' || (n_nationkey + 2) AS address, CASE WHEN n_nationkey % 2 = 1 THEN '0.00' ELSE 'General' END AS style FROM nation")
def cells_with_style_key(spark, sf_dir):
    cells = _styled(spark, sf_dir).read_cells_with_styles("format-pattern", area="A2:A100")
    return cells.select("address", "style")


@query("SELECT 'A' || (n_nationkey + 2) AS address, CASE WHEN n_nationkey % 2 = 1 THEN '1' END AS bold, '11' AS size FROM nation")
def cell_styles_of_a_group(spark, sf_dir):
    cells = _styled(spark, sf_dir).read_cell_styles(part="font").where("col = 1 and row > 1")
    return cells.select("address", F.element_at("style", "font-style-bold").alias("bold"), F.element_at("style", "font-size").alias("size"))


@query("SELECT 'A' || (n_nationkey + 2) AS address, CASE WHEN n_nationkey % 2 = 1 THEN '2' ELSE '0' END AS format, 'none' AS pattern FROM nation")
def cell_styles_flat(spark, sf_dir):
    cells = _styled(spark, sf_dir).read_cell_styles(True).where("col = 1 and row > 1")
    return cells.select("address", F.element_at("style", "format-num-id").alias("format"), F.element_at("style", "fill-pattern").alias("pattern"))


@query("SELECT (n_nationkey + 2)::BIGINT AS r, CASE WHEN n_nationkey % 2 = 1 THEN '1' END AS bold, n_nationkey::VARCHAR AS value FROM nation")
def rows_with_styles(spark, sf_dir):
    rows = _styled(spark, sf_dir).read_rows_with_styles(True).where("key = 'key'")
    return rows.select(F.col("row").cast("bigint").alias("r"), F.element_at("font", "font-style-bold").alias("bold"), "value")


@query("SELECT n_name AS value, (n_nationkey + 2)::BIGINT AS r, '0' AS format FROM nation")
def columns_with_styles(spark, sf_dir):
    rows = _styled(spark, sf_dir).read_columns_with_styles("A1", first_row_keys=True).where("key = 'name'")
    return rows.select("value", F.col("row").cast("bigint").alias("r"), F.element_at("format", "format-num-id").alias("format"))


@query("SELECT * FROM (VALUES ('A3', '1', 'number'), ('B3', NULL, 'general')) t(address, bold, category)")
def first_row_with_styles(spark, sf_dir):
    cells = _styled(spark, sf_dir).first_sheet().read_first_row_with_styles("A3")
    return cells.select("address", F.element_at("font", "font-style-bold").alias("bold"), F.element_at("format", "format-category").alias("category"))


# Extents, merged ranges


@query("SELECT 'bucket-' || n_nationkey AS book, 'B2:' || chr((67 + n_nationkey % 3)::INTEGER) || (n_nationkey + 3) AS declared, 'A1' AS dimension FROM nation")
def dimension_declared(spark, sf_dir):
    """What files declare, right or wrong, beside what they have."""
    df = _table(spark, sf_dir, "nation").select("n_nationkey")
    build = lambda rows: write_xlsx([SheetSpec("S", {1: [1]}, dimension=f"B2:{'CDE'[rows[0][0] % 3]}{rows[0][0] + 3}")])
    book = _book(as_files(df, "n_nationkey", build, 1))
    declared = book.part("sheets").select("book", F.col("dimension").alias("declared"))
    return declared.join(book.first_sheet().actual_dimension(("book",)).select("book", "dimension"), "book")


@query("SELECT 'bucket-' || n_nationkey AS book, (n_nationkey + 2)::INTEGER AS count_rows, (n_nationkey % 3 + 2)::INTEGER AS count_columns, 2::INTEGER AS min_row, (n_nationkey + 3)::INTEGER AS max_row, 2::INTEGER AS min_column, (n_nationkey % 3 + 3)::INTEGER AS max_column FROM nation")
def range_counts(spark, sf_dir):
    """Counts and bounds of declared dimensions."""
    df = _table(spark, sf_dir, "nation").select("n_nationkey")
    build = lambda rows: write_xlsx([SheetSpec("S", {1: [1]}, dimension=f"B2:{'CDE'[rows[0][0] % 3]}{rows[0][0] + 3}")])
    return _book(as_files(df, "n_nationkey", build, 1)).part("sheets").select("book", range_stats_expr(F.col("dimension")).alias("s")).select("book", "s.*")


@query("SELECT 'bucket-' || (c_custkey // 500) AS book, count(*)::BIGINT AS rows, 3::BIGINT AS columns, 'A1:C' || count(*) AS dimension FROM customer GROUP BY c_custkey // 500")
def csv_extents(spark, sf_dir):
    df = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    build = lambda rows: "".join(f"{a},{b},{c}\n" for a, b, c in rows).encode()
    found = _book(as_files(df, "c_custkey", build, 500), csv={"delimiter": ","}).first_sheet().actual_dimension(("book",))
    return found.select("book", F.col("count_rows").cast("bigint").alias("rows"), F.col("count_columns").cast("bigint").alias("columns"), "dimension")


@query("SELECT CASE WHEN n_regionkey IS NULL THEN NULL ELSE 'r' || n_regionkey END AS sheet, (2 * count(*))::BIGINT AS cells_total, (2 * count(*) - count(CASE WHEN n_nationkey % 3 = 0 THEN 1 END))::BIGINT AS cells_filled FROM nation GROUP BY ROLLUP (n_regionkey)")
def stat_of_a_book(spark, sf_dir):
    """Counts of each sheet and of all, with cells that hold a style and nothing else."""
    df = _table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")

    def build(rows: list[tuple]) -> bytes:
        own = lambda r: {k: [key, Cell(style=1) if key % 3 == 0 else "x"] for k, key in enumerate((key for key, region in rows if region == r), 1)}
        return write_xlsx(BookSpec([SheetSpec(f"r{r}", own(r)) for r in sorted({r for _, r in rows})], styles=style_sheet([14])))

    return _book(as_files(df, "n_nationkey", build)).stat().select("sheet", "cells_total", "cells_filled")


@query("SELECT 'bucket-' || r_regionkey AS book, (r_regionkey + 1)::BIGINT AS sheets, r_regionkey::BIGINT AS images FROM region")
def sheets_and_images_counted(spark, sf_dir):
    df = _table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("r_regionkey"))
    build = lambda rows: write_xlsx([SheetSpec(f"s{k}", {1: [k]}, images=[(1, 1, f"i{k}.png", b"\x89PNG" + bytes([k]))] * (k > 0)) for k in range(rows[0][0] + 1)])
    book = _book(as_files(df, "r_regionkey", build, 1))
    images = book.images().groupBy("book").agg(F.count("*").alias("images"))
    sheets = book.part("sheets").groupBy("book").agg(F.count("*").cast("bigint").alias("sheets"))
    return sheets.join(images, "book", "left").select("book", "sheets", F.coalesce("images", F.lit(0)).cast("bigint").alias("images"))


@query("SELECT 'bucket-' || (s_suppkey // 4000) AS book, 'A' || r || ':B' || (r + 1) AS ref FROM (SELECT s_suppkey, row_number() OVER (PARTITION BY s_suppkey // 4000 ORDER BY s_suppkey) AS r FROM supplier) WHERE r % 3 = 1")
def merged_cells_declared(spark, sf_dir):
    return _merged(spark, sf_dir).merged_cells().select("book", "ref")


@query("SELECT s_suppkey, (r % 3 <> 0) AS merged, r % 3 = 1 AS anchor FROM (SELECT s_suppkey, row_number() OVER (PARTITION BY s_suppkey // 4000 ORDER BY s_suppkey) AS r FROM supplier)")
def merged_anchor_has_the_value(spark, sf_dir):
    """Of a merged range only the first cell has a value."""
    sheet = _merged(spark, sf_dir)
    cells = sheet.grid().cells(book_name="book").select("book", "row", "col", F.col("i").alias("s_suppkey"), F.col("x").alias("x"))
    keys = cells.where("col = 3").select("book", "row", "s_suppkey")
    values = sheet.merged_lookup(cells.where("col = 1").select("book", "row", "col", "x"))
    return keys.join(values.select("book", "row", "merged", "x"), ["book", "row"]).select("s_suppkey", "merged", F.coalesce(F.col("x") == "anchor", F.lit(False)).alias("anchor"))


def _merged(spark, sf_dir):
    df = _table(spark, sf_dir, "supplier").select("s_suppkey")

    def build(rows: list[tuple]) -> bytes:
        lines = {k: [Cell("anchor") if k % 3 == 1 else Cell(style=0, raw=None, kind="n"), None, key] for k, (key,) in enumerate(rows, 1)}
        return write_xlsx([SheetSpec("S", lines, merges=[f"A{k}:B{k + 1}" for k in lines if k % 3 == 1])])

    return _book(as_files(df, "s_suppkey", build)).first_sheet()


# Metadata


@query("SELECT 'bucket-' || r_regionkey AS book, (r_regionkey + 10)::INTEGER AS sheet_id, 'S' || r_regionkey AS sheet, 'xl/worksheets/sheet1.xml' AS path, r_regionkey % 2 = 0 AS active FROM region")
def sheet_catalogue(spark, sf_dir):
    df = _table(spark, sf_dir, "region").select("r_regionkey")
    build = lambda rows: write_xlsx([SheetSpec(f"S{key}", {1: [1]}, sheet_id=key + 10, before="<sheetViews><sheetView tabSelected=\"1\"/></sheetViews>" * (key % 2 == 0)) for (key,) in rows])
    return _book(as_files(df, "r_regionkey", build, 1)).part("sheets").select("book", "sheet_id", "sheet", "path", "active")


@query("SELECT 'bucket-' || r_regionkey AS book, 'n' || k AS name, 'S!$A$' || k AS ref FROM region, range(1, 4) t(k)")
def defined_names(spark, sf_dir):
    df = _table(spark, sf_dir, "region").select("r_regionkey")
    build = lambda rows: write_xlsx(BookSpec([SheetSpec("S", {1: [1]})], names={f"n{k}": f"S!$A${k}" for k in range(1, 4)}))
    return _book(as_files(df, "r_regionkey", build, 1)).part("defined_names").select("book", "name", "ref")


@query("SELECT 'bucket-' || r_regionkey AS book, key, CASE key WHEN 'company' THEN r_name ELSE 'Writer' END AS value FROM region, (VALUES ('application'), ('company')) t(key)")
def document_properties(spark, sf_dir):
    df = _table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    build = lambda rows: write_xlsx(BookSpec([SheetSpec("S", {1: [1]})], properties=f"<Application>Writer</Application><Company>{rows[0][1]}</Company><Other>x</Other>"))
    return _book(as_files(df, "r_regionkey", build, 1)).part("properties").select("book", "key", "value")


@query("SELECT 'A' || (n_nationkey + 1) AS sqref, CASE WHEN n_nationkey % 2 = 0 THEN 'list' ELSE 'decimal' END AS type, n_nationkey::VARCHAR AS formula1, CASE WHEN n_nationkey % 2 = 1 THEN '99' END AS formula2 FROM nation")
def data_validations(spark, sf_dir):
    """Half of them in the extension list."""
    df = _table(spark, sf_dir, "nation").select("n_nationkey")

    def build(rows: list[tuple]) -> bytes:
        plain = "".join(f'<dataValidation type="decimal" sqref="A{key + 1}"><formula1>{key}</formula1><formula2>99</formula2></dataValidation>' for (key,) in rows if key % 2)
        more = "".join(f'<x14:dataValidation type="list"><x14:formula1><f>{key}</f></x14:formula1><sqref>A{key + 1}</sqref></x14:dataValidation>' for (key,) in rows if key % 2 == 0)
        return write_xlsx([SheetSpec("S", {1: [1]}, after=f'<dataValidations>{plain}</dataValidations><extLst><ext xmlns:x14="u">{more}</ext></extLst>')])

    return _book(as_files(df, "n_nationkey", build)).first_sheet().data_validations().select("sqref", "type", "formula1", "formula2")


@query("SELECT 'A' || (n_nationkey + 1) AS sqref, 'cellIs' AS type, 'greaterThan' AS operator, n_nationkey::VARCHAR AS priority FROM nation")
def conditional_formats(spark, sf_dir):
    df = _table(spark, sf_dir, "nation").select("n_nationkey")
    build = lambda rows: write_xlsx([SheetSpec("S", {1: [1]}, after="".join(f'<conditionalFormatting sqref="A{key + 1}"><cfRule type="cellIs" operator="greaterThan" priority="{key}"/></conditionalFormatting>' for (key,) in rows))])
    found = _book(as_files(df, "n_nationkey", build)).first_sheet().conditional_formatting()
    return found.select("sqref", "type", F.element_at("attributes", "operator").alias("operator"), F.element_at("attributes", "priority").alias("priority"))


@query("SELECT (n_nationkey + 1)::INTEGER AS col, n_nationkey + 8.5::DOUBLE AS width, CASE WHEN n_nationkey % 2 = 1 THEN '1' END AS bold FROM nation")
def column_attributes_and_styles(spark, sf_dir):
    styles = '<fonts><font/><font><b/></font></fonts><fills><fill/></fills><borders><border/></borders><cellStyleXfs><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs><cellXfs><xf numFmtId="0" fontId="0" fillId="0" borderId="0" xfId="0"/><xf numFmtId="0" fontId="1" fillId="0" borderId="0" xfId="0"/></cellXfs>'
    df = _table(spark, sf_dir, "nation").select("n_nationkey")
    build = lambda rows: write_xlsx(BookSpec([SheetSpec("S", {1: [1]}, before="<cols>" + "".join(f'<col min="{key + 1}" max="{key + 1}" width="{key + 8.5}" style="{key % 2}"/>' for (key,) in rows) + "</cols>")], styles=styles))
    return _book(as_files(df, "n_nationkey", build)).first_sheet().column_styles().select("col", "width", F.element_at("font", "font-style-bold").alias("bold"))


@query("SELECT (n_nationkey + 1)::INTEGER AS r, CASE WHEN n_nationkey % 2 = 0 THEN 15.0 ELSE n_nationkey + 10.5 END::DOUBLE AS height, CASE WHEN n_nationkey % 3 = 0 THEN '1' END AS hidden FROM nation")
def row_attributes_and_heights(spark, sf_dir):
    """Heights of rows, the default where a row has none of its own."""
    df = _table(spark, sf_dir, "nation").select("n_nationkey")
    build = lambda rows: write_xlsx([SheetSpec("S", {key + 1: [key] for (key,) in rows}, row_attrs={key + 1: f'ht="{key + 10.5}"' * (key % 2) + ' hidden="1"' * (key % 3 == 0) for (key,) in rows})])
    found = _book(as_files(df, "n_nationkey", build)).first_sheet().row_attributes()
    return found.select(F.col("row").alias("r"), "height", F.element_at("attributes", "hidden").alias("hidden"))


@query("SELECT (n_nationkey + 1)::INTEGER AS r, (n_nationkey + 10.5)::DOUBLE AS height, CASE WHEN n_nationkey % 3 = 0 THEN '1' END AS hidden, n_nationkey % 2 AS style FROM nation")
def xls_row_attributes(spark, sf_dir):
    df = _table(spark, sf_dir, "nation").select("n_nationkey")

    def build(rows: list[tuple]) -> bytes:
        heads = b"".join(record(0x0208, struct.pack("<HHHHHHI", key, 0, 1, int((key + 10.5) * 20), 0, 0, 0x20 * (key % 3 == 0) | (0x80 | 1 << 16) * (key % 2))) for (key,) in rows)
        return write_xls([XlsSheetSpec("S", {key + 1: [key] for (key,) in rows}, before=heads)])

    found = _book(as_files(df, "n_nationkey", build)).first_sheet().row_attributes()
    return found.select(F.col("row").alias("r"), "height", F.element_at("attributes", "hidden").alias("hidden"), "style")


@query("SELECT 'bucket-' || r_regionkey AS book, r_regionkey::INTEGER AS x, 1::INTEGER AS y, chr((65 + r_regionkey)::INTEGER) || '2' AS top_left, 'FF00000' || r_regionkey AS rgb FROM region WHERE r_regionkey > 0 UNION ALL SELECT 'bucket-0', NULL, NULL, NULL, NULL")
def freeze_panes_and_tab_colors(spark, sf_dir):
    df = _table(spark, sf_dir, "region").select("r_regionkey")

    def build(rows: list[tuple]) -> bytes:
        key = rows[0][0]
        before = f'<sheetPr><tabColor rgb="FF00000{key}"/></sheetPr><sheetViews><sheetView><pane xSplit="{key}" ySplit="1" topLeftCell="{chr(65 + key)}2" state="frozen"/></sheetView></sheetViews>'
        return write_xlsx([SheetSpec("S", {1: [1]}, before=before * (key > 0))])

    view = _book(as_files(df, "r_regionkey", build, 1)).first_sheet().sheet_view()
    return view.select("book", F.col("x_split").alias("x"), F.col("y_split").alias("y"), "top_left", F.col("tab_rgb").alias("rgb"))


# Pictures


@query("SELECT r_regionkey::INTEGER + 1 AS r, 'rich' || r_regionkey || '.png' AS file_name, 'image/png' AS mime FROM region")
def rich_value_images(spark, sf_dir):
    """Pictures placed in cells, found by the value metadata of the cells."""
    df = _table(spark, sf_dir, "region").select("r_regionkey")
    return _book(as_files(df, "r_regionkey", _rich)).images().select(F.col("row").alias("r"), "file_name", "mime")


def _rich(rows: list[tuple]) -> bytes:
    import io
    import zipfile

    keys = [key for (key,) in rows]
    plain = write_xlsx([SheetSpec("S", {key + 1: [Cell("#VALUE!", kind="e", raw="#VALUE!", vm=k)] for k, key in enumerate(keys, 1)})])
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "xl/metadata.xml": f'<metadata><futureMetadata name="XLRICHVALUE">{"".join(f"<bk><extLst><ext><rvb i=\"{k}\"/></ext></extLst></bk>" for k in range(len(keys)))}</futureMetadata><valueMetadata>{"".join(f"<bk><rc t=\"1\" v=\"{k}\"/></bk>" for k in range(len(keys)))}</valueMetadata></metadata>',
        "xl/richData/rdrichvalue.xml": f'<rvData>{"".join(f"<rv s=\"0\"><v>{k}</v><v>5</v></rv>" for k in range(len(keys)))}</rvData>',
        "xl/richData/richValueRel.xml": f'<richValueRels xmlns:r="{rel}">{"".join(f"<rel r:id=\"p{k}\"/>" for k in range(len(keys)))}</richValueRels>',
        "xl/richData/_rels/richValueRel.xml.rels": f'<Relationships>{"".join(f"<Relationship Id=\"p{k}\" Type=\"{rel}/image\" Target=\"../media/rich{key}.png\"/>" for k, key in enumerate(keys))}</Relationships>',
        **{f"xl/media/rich{key}.png": b"\x89PNG" + bytes([key]) for key in keys},
    }
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(plain)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for name in old.namelist():
            data = old.read(name)
            if name == "xl/_rels/workbook.xml.rels":
                data = data.replace(b"</Relationships>", f'<Relationship Id="meta" Type="{rel}/sheetMetadata" Target="metadata.xml"/></Relationships>'.encode())
            new.writestr(name, data)
        for name, data in parts.items():
            new.writestr(name, data)
    return out.getvalue()


@query("SELECT 'bucket-' || r_regionkey AS book, 'extra' || r_regionkey || '.png' AS file FROM region")
def extra_images(spark, sf_dir):
    """Media that no cell shows."""
    df = _table(spark, sf_dir, "region").select("r_regionkey")
    build = lambda rows: write_xlsx(BookSpec([SheetSpec("S", {1: [1]}, images=[(1, 1, "shown.png", b"\x89PNG")])], parts={f"xl/media/extra{rows[0][0]}.png": b"\x89PNG"}))
    return _book(as_files(df, "r_regionkey", build, 1)).extra_images().select("book", F.element_at(F.split("part", "/"), -1).alias("file"))


def _escher(kind: int, body: bytes, instance: int = 0, container: bool = False) -> bytes:
    return struct.pack("<HHI", instance << 4 | (15 if container else 0), kind, len(body)) + body


@query("SELECT 'bucket-' || r_regionkey AS book, (r_regionkey + 3)::INTEGER AS r, 2::INTEGER AS c, 'Pic' || r_regionkey AS name, 'image/png' AS mime, r_regionkey::INTEGER AS last FROM region")
def xls_images(spark, sf_dir):
    df = _table(spark, sf_dir, "region").select("r_regionkey")

    def build(rows: list[tuple]) -> bytes:
        key = rows[0][0]
        blip = _escher(0xF01E, b"\0" * 17 + b"\x89PNG" + bytes([key]), 0x6E0)
        group = _escher(0xF000, _escher(0xF001, _escher(0xF007, b"\0" * 36 + blip), 1, True), 0, True)
        name = f"Pic{key}\0".encode("utf-16-le")
        options = _escher(0xF00B, struct.pack("<HI", 0x4104, 1) + struct.pack("<HI", 0xC380, len(name)) + name, 2)
        shape = _escher(0xF004, _escher(0xF00A, b"\0" * 8) + options + _escher(0xF010, struct.pack("<HHHH", 0, 1, 0, key + 2) + b"\0" * 10), 0, True)
        return write_xls([XlsSheetSpec("S", {1: [key]}, extra=record(0x00EC, _escher(0xF002, shape, 0, True)))], globals_extra=record(0x00EB, group))

    images = _book(as_files(df, "r_regionkey", build, 1)).images()
    return images.select("book", F.col("row").alias("r"), F.col("col").alias("c"), "name", "mime", F.conv(F.hex(F.substring("content", 5, 1)), 16, 10).cast("int").alias("last"))


# Formulas


@query("SELECT o_orderkey, '=A' || r || '*2' AS formula FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey // 4000 ORDER BY o_orderkey) AS r FROM orders)")
def xls_shared_formulas(spark, sf_dir):
    """One formula for a whole column, whose cells name the first of them."""
    df = _table(spark, sf_dir, "orders").select("o_orderkey")

    def build(rows: list[tuple]) -> bytes:
        tokens = b"\x2c" + struct.pack("<HH", 0, 0xC000 | 0xFF) + b"\x1e\x02\x00\x05"  # the cell to the left, times 2
        shared = record(0x04BC, struct.pack("<HHBBBB", 0, len(rows) - 1, 1, 1, 0, 1) + struct.pack("<H", len(tokens)) + tokens)
        names_first = b"\x01" + struct.pack("<HH", 0, 1)
        return write_xls([XlsSheetSpec("S", {k: [float(key), XlsCell(1, tokens=names_first)] for k, (key,) in enumerate(rows, 1)}, extra=shared)])

    at = lambda k: F.get(F.filter("cells", lambda c: c["col"] == k), 0)
    return _book(as_files(df, "o_orderkey", build)).first_sheet().grid().typed_rows().select(at(1)["i"].alias("o_orderkey"), at(2)["f"].alias("formula"))


_FUNCTION_ROWS = ", ".join(f"({k}, '{name}({','.join(map(str, range(_ARGUMENTS.get(k, 1))))})')" for k, name in FUNCTIONS.items())


@query(f"SELECT k::BIGINT AS k, f.text FROM range(400) t(k) LEFT JOIN (VALUES {_FUNCTION_ROWS}) f(k, text) USING (k)")
def xls_function_names(spark, sf_dir):
    """Every function index, with as many arguments as it takes, through the decompiler; null where there is no function."""

    def run(batches):
        for batch in batches:
            texts = []
            for k in batch.column(0).to_pylist():
                n = _ARGUMENTS.get(k, 1)
                call = b"\x21" + struct.pack("<H", k) if k in _ARGUMENTS else b"\x22" + struct.pack("<BH", n, k)
                texts.append(decompile(b"".join(b"\x1e" + struct.pack("<H", i) for i in range(n)) + call))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["k", "text"])

    return spark.range(400).select(F.col("id").alias("k")).mapInArrow(run, "k long, text string")


# Delimited text


@query("SELECT n_nationkey::BIGINT AS key, n_name || ',x' AS name FROM nation")
def csv_escape(spark, sf_dir):
    df = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    build = lambda rows: "".join(f"{key},{name}\\,x\n" for key, name in rows).encode()
    return _csv_rows(as_files(df, "n_nationkey", build), {"delimiter": ",", "escape": "\\"})


@query("SELECT n_nationkey::BIGINT AS key, n_name || '\"q' AS name FROM nation")
def csv_tolerant(spark, sf_dir):
    df = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    build = lambda rows: "".join(f'{key},{name}"q\n' for key, name in rows).encode()
    return _csv_rows(as_files(df, "n_nationkey", build), {"delimiter": ",", "mode": "tolerant"})


@query("SELECT n_nationkey::BIGINT AS key, '  ' || n_name || ' ' AS name FROM nation")
def csv_untrimmed(spark, sf_dir):
    df = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    build = lambda rows: "".join(f"{key},  {name} \n" for key, name in rows).encode()
    return _csv_rows(as_files(df, "n_nationkey", build), {"delimiter": ",", "trimFields": False})


def _csv_rows(files: DataFrame, csv: dict[str, Any]) -> DataFrame:
    rows = _book(files, kind="csv", csv=csv).first_sheet().set_read_area("A:B").rows(types={"A": "long"})
    return rows.select(F.col("A").alias("key"), F.col("B").alias("name"))


@query("SELECT (3 * n_nationkey + 1)::BIGINT AS r, n_name AS name FROM nation")
def csv_empty_lines_and_comments(spark, sf_dir):
    """Skipped lines keep their number."""
    df = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    build = lambda rows: "".join(f"{name}\n\n# no\n" for _, name in rows).encode()
    rows = engine_rows(as_files(df, "n_nationkey", build), {"delimiter": ",", "skip_empty_lines": True, "comment_prefix": "#"}, None, 128)
    return rows.select(F.col("row").cast("bigint").alias("r"), F.element_at("cells", "A").alias("name"))


@query("SELECT (n_nationkey + 2)::BIGINT AS r, n_nationkey::VARCHAR AS id, n_name AS n_name FROM nation")
def csv_engine_header(spark, sf_dir):
    """The engine's header with one name replaced."""
    df = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = engine_rows(as_files(df, "n_nationkey", _csv(df.columns)), {"delimiter": ","}, header=["id"])
    return rows.select(F.col("row").cast("bigint").alias("r"), F.element_at("cells", "id").alias("id"), F.element_at("cells", "n_name").alias("n_name"))


@query("SELECT n_nationkey::BIGINT AS key, CASE n_nationkey % 4 WHEN 1 THEN 1001 WHEN 2 THEN 1003 WHEN 3 THEN 1002 END AS code FROM nation")
def csv_error_codes(spark, sf_dir):
    """Each kind of error in a file of its own."""
    df = _table(spark, sf_dir, "nation").select("n_nationkey")
    forms = ("{},ok\n", '{},x"y\n', '{},"x"y\n', '{},"open\n')
    build = lambda rows: forms[rows[0][0] % 4].format(rows[0][0]).encode()
    found = _book(as_files(df, "n_nationkey", build, 1), csv={"delimiter": ","}).part("records")
    return found.select(F.col("fields")[0].cast("bigint").alias("key"), F.get("errors", 0)["code"].alias("code"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def csv_delimiters_found(spark, sf_dir):
    """A delimiter of another kind in each file, and none named."""
    df = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    build = lambda rows: _csv(df_names, ",;\t|:"[rows[0][0] // 20 % 5])(rows)
    df_names = df.columns
    return _book(as_files(df, "s_suppkey", build, 20), kind="csv").first_sheet().with_header().rows(types={"s_suppkey": "long", "s_acctbal": "double"}).drop("row")


@query("SELECT * FROM (VALUES ('a;b', ',', false), ('a;b|1;2', ',', false), ('a;b|1;2|3;4', ';', true), ('one|two|three', ',', false)) t(sample, delimiter, sure)")
def short_samples(spark, sf_dir):
    """Fewer than three records tell nothing of the delimiter, so it is the comma; bars stand for line ends here."""

    def run(batches):
        for batch in batches:
            found = [detect_delimiter(t.replace("|", "\n")) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d if p >= 0.6 else "," for d, p in found]), pa.array([p >= 0.6 for _, p in found])], names=["sample", "delimiter", "sure"])

    return spark.createDataFrame([(c,) for c in ("a;b", "a;b|1;2", "a;b|1;2|3;4", "one|two|three")], "sample string").mapInArrow(run, "sample string, delimiter string, sure boolean")


# Encodings


@query("SELECT n_nationkey::BIGINT AS key, 'Größe ' || n_name || ' имя 名' AS name FROM nation")
def byte_order_marks(spark, sf_dir):
    """Five encodings by their byte order mark, a file each."""
    marks = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe\0\0", "utf-32-le"), (b"\0\0\xfe\xff", "utf-32-be"))
    df = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    def build(rows: list[tuple]) -> bytes:
        mark, codec = marks[rows[0][0] % 5]
        return mark + "".join(f"{key},Größe {name} имя 名\n" for key, name in rows).encode(codec)

    return _csv_rows(as_files(df, "n_nationkey", build, 1), {"delimiter": ","})


@query("SELECT n_nationkey::BIGINT AS key, n_name || ' これは日本の首都です' AS name FROM nation")
def japanese_encodings(spark, sf_dir):
    df = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    build = lambda rows: "".join(f"{key},{name} これは日本の首都です\n" for key, name in rows).encode(("cp932", "euc-jp", "utf-8")[rows[0][0] % 3])
    return _csv_rows(as_files(df, "n_nationkey", build, 1), {"delimiter": ","})


@query("SELECT n_nationkey::BIGINT AS key, n_name || ', Müller' AS name FROM nation")
def latin_text_by_default(spark, sf_dir):
    """Neither UTF-8 nor Cyrillic nor Japanese: ISO-8859-1."""
    df = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    build = lambda rows: "".join(f"{key};{name}, Müller\n" for key, name in rows).encode("latin-1")
    return _csv_rows(as_files(df, "n_nationkey", build), {"delimiter": ";"})


@query("SELECT * FROM (VALUES ('efbbbf61', 'UTF-8', 'UTF-8', true, false), ('fffe0000', 'UTF-32LE', 'UTF-32LE', false, true), ('c3a9', NULL, 'UTF-8', true, false), ('c3', NULL, 'UTF-8', true, false), ('c328', NULL, 'ISO-8859-1', false, false), ('610062', NULL, 'UTF-8', true, true), ('0102030461', NULL, 'UTF-8', true, true), ('', NULL, 'UTF-8', true, false)) t(sample, bom, encoding, utf8, is_binary)")
def samples_judged(spark, sf_dir):
    """Byte order mark, encoding, UTF-8 validity (the end may cut a character) and whether a sample is text."""
    samples = ["efbbbf61", "fffe0000", "c3a9", "c3", "c328", "610062", "0102030461", ""]

    def run(batches):
        for batch in batches:
            data = [bytes.fromhex(t) for t in batch.column(0).to_pylist()]
            cols = ([f(d) for d in data] for f in (detect_bom, detect_encoding, is_utf8, looks_binary))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.bool_(), pa.bool_()), strict=True))], names=["sample", "bom", "encoding", "utf8", "is_binary"])

    return spark.createDataFrame([(s,) for s in samples], "sample string").mapInArrow(run, "sample string, bom string, encoding string, utf8 boolean, is_binary boolean")


@query("SELECT * FROM (VALUES ('Windows-1251', true), ('CP866', true), ('SJIS-win', true), ('KOI8-R', true), ('no-such', false)) t(name, known)")
def encodings_known(spark, sf_dir):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec_of(n) is not None for n in batch.column(0).to_pylist()])], names=["name", "known"])

    return spark.createDataFrame([(n,) for n in ("Windows-1251", "CP866", "SJIS-win", "KOI8-R", "no-such")], "name string").mapInArrow(run, "name string, known boolean")


# Columns without files


@query("SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS seconds FROM orders")
def text_seconds_of_columns(spark, sf_dir):
    shown = F.date_format(F.col("o_orderdate").cast("timestamp"), "dd.MM.yyyy")
    return _table(spark, sf_dir, "orders").select("o_orderkey", text_seconds(shown).alias("seconds"))


@query("SELECT c_custkey, ((c_custkey + 1462 - 25569) * 86400 + 43200)::BIGINT AS seconds FROM customer")
def serials_of_1904(spark, sf_dir):
    """Half days counted from 1904."""
    serial = F.col("c_custkey").cast("double") + 0.5
    return _table(spark, sf_dir, "customer").select("c_custkey", serial_seconds(serial, True).alias("seconds"))


@query("SELECT o_orderpriority AS name, row_number() OVER (ORDER BY o_orderkey)::BIGINT AS r FROM orders QUALIFY r > 5")
def rows_after_a_header_row(spark, sf_dir):
    """A table seen from its fifth row on, that row a header by position."""
    rows = _sheet_of(_table(spark, sf_dir, "orders"), ["o_orderkey"], ["o_orderpriority"]).from_cell("A5").with_header(["name"]).rows()
    return rows.select("name", F.col("row").cast("bigint").alias("r"))
