"""Complete styles: number format, font, fill and border of a style index, put together by joins of small tables.

A style is a map of its properties. Each level covers the one before: the style of index 0, the parent record (cellStyleXfs),
the record itself (cellXfs). Style tables of a file are bounded by the
format at some tens of thousands of records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import BUILTIN_FORMATS

GROUPS = ("format", "font", "fill", "border")


def _cover(*maps: Column) -> Column:
    """Later maps win; nulls count as empty."""
    empty = F.create_map().cast("map<string,string>")

    def two(under: Column, over: Column) -> Column:
        over = F.coalesce(over, empty)
        return F.map_concat(F.map_filter(F.coalesce(under, empty), lambda k, _: ~F.exists(F.map_keys(over), lambda x: x == k)), over)

    out = maps[0]
    for m in maps[1:]:
        out = two(out, m)
    return out


def complete_styles(tables: DataFrame) -> DataFrame:
    """The style_tables part to (book, s, format, font, fill, border), each a map of properties."""
    spark = tables.sparkSession
    of = {kind: tables.where(F.col("kind") == kind) for kind in ("formats", "fonts", "fills", "borders", "cellStyleXfs", "cellXfs")}
    builtin = spark.createDataFrame([(k, code, kind) for k, (code, kind) in BUILTIN_FORMATS.items()], "num_fmt int, builtin_code string, builtin_kind string")
    own = of["formats"].select("book", F.col("idx").alias("num_fmt"), *(F.element_at("own", f"format-{k}").alias(f"own_{k}") for k in ("pattern", "category")))

    def resolved(records: DataFrame) -> DataFrame:
        out = records.select("book", "idx", "xf", "num_fmt", "font", "fill", "border", F.col("own").alias("align"))
        out = out.join(F.broadcast(builtin), "num_fmt", "left").join(own, ["book", "num_fmt"], "left")
        for kind, name in (("fonts", "font"), ("fills", "fill"), ("borders", "border")):
            out = out.join(of[kind].select("book", F.col("idx").alias(name), F.col("own").alias(f"{name}_map")), ["book", name], "left")
        known = F.col("own_pattern").isNotNull()
        parts = {"format-num-id": F.col("num_fmt").cast("string"), "format-pattern": F.coalesce("own_pattern", "builtin_code"), "format-category": F.when(known, F.col("own_category")).otherwise(F.col("builtin_kind"))}
        number = F.when(F.col("num_fmt").isNotNull(), F.map_filter(F.create_map(*(x for k, v in parts.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull()))
        return out.select("book", "idx", "xf", _cover(number, F.col("align")).alias("format"), F.col("font_map").alias("font"), F.col("fill_map").alias("fill"), F.col("border_map").alias("border"))

    records, parents = resolved(of["cellXfs"]), resolved(of["cellStyleXfs"])
    parent = parents.select("book", F.col("idx").alias("xf"), *(F.col(g).alias(f"parent_{g}") for g in GROUPS))
    base = records.where("idx = 0").select("book", *(F.col(g).alias(f"base_{g}") for g in GROUPS))
    joined = records.join(parent, ["book", "xf"], "left").join(base, "book", "left")
    return joined.select("book", F.col("idx").alias("s"), *(_cover(F.col(f"base_{g}"), F.col(f"parent_{g}"), F.col(g)).alias(g) for g in GROUPS))


def flat_style():
    """All groups of a complete style as one map."""
    return F.map_concat(*(F.col(g) for g in GROUPS))


def with_styles(cells: DataFrame, styles: DataFrame, key: str | None = None, part: str | None = None, flat: bool = False) -> DataFrame:
    """cells (book, s, ...) with their style: its groups as columns, or one map (flat), or one group (part), or one property (key), which
    falls back to the whole flat style as text where a style lacks it."""
    own = styles.withColumnRenamed("s", "_s").withColumnRenamed("book", "_book")
    joined = cells.join(own, (cells["book"] == own["_book"]) & (F.coalesce(cells["s"], F.lit(0)) == own["_s"]), "left").drop("_s", "_book")
    if key is not None:
        whole = flat_style()
        return joined.select(*cells.columns, F.coalesce(F.element_at(whole, key), F.to_json(whole)).alias("style"))
    if part is not None:
        return joined.select(*cells.columns, F.coalesce(F.col(part), F.create_map().cast("map<string,string>")).alias("style"))
    return joined.select(*cells.columns, flat_style().alias("style")) if flat else joined
