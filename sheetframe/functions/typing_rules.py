"""From the raw content of a cell to its typed value, as one expression.

A raw cell (see RAW_CELL) is what a scanner has read; a typed cell has a type tag and exactly one filled slot (i, d, b or x),
or none for null. It is Column arithmetic throughout; _xHHHH_ sequences are decoded by the scanners.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: col, t (the raw type attribute), s (style index), raw (value text, shared strings resolved), f (formula), text (inline
#: text), fmt (format category of the style), code (its date code), base1904.
RAW_CELL = "struct<col:int,t:string,s:int,raw:string,f:string,text:string,fmt:string,code:string,base1904:boolean>"
TYPED_CELL = "struct<col:int,t:string,i:bigint,d:double,b:boolean,x:string,o:string,s:int,f:string>"

_NUMERIC = r"^[ \t\n\r\x0B\f]*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\r\x0B\f]*$"
_INTEGER = r"^[ \t\n\r\x0B\f]*[+-]?(0|[1-9][0-9]*)[ \t\n\r\x0B\f]*$"
_SPACES = " \t\n\r\x00\x0b"
_ESCAPE = re.compile(r"_x005[Ff]_(x[0-9A-Fa-f]{4}_)|_x([0-9A-Fa-f]{4})_")


def trim_expr(value: Column) -> Column:
    """Without blanks, tabs, line ends, NUL and vertical tabs on either side."""
    return F.btrim(value, F.lit(_SPACES))


def unescape(text: str) -> str:
    """_xHHHH_ sequences as their characters, in a single pass; _x005F_ before a sequence protects it."""
    return _ESCAPE.sub(lambda m: "_" + m[1] if m[1] else chr(int(m[2], 16)), text)


def unescape_expr(value: Column) -> Column:
    """unescape() over a column; scanners have done it already for string cells."""

    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        return values.map(unescape, na_action="ignore")

    return F.when(value.contains("_x"), decode(value)).otherwise(value)


class DateMode:
    """How date cells come out: seconds (the default), original (serial text), plain (seconds of numbers, else the original),
    or text by a date_format pattern, by the cell's own code, or by a Column function of (seconds, code, style)."""

    def __init__(self, kind: str = "seconds", pattern: str | None = None, function=None, codes: dict[str, str] | None = None):
        self.kind, self.pattern, self.function, self.codes = kind, pattern, function, codes or {}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once. Within a lambda nothing else holds a part that an expression names twice, so each
    further mention of it would be worked out again. It is the end of a sum over nothing that begins with the value; an array's
    only element would do too, but Spark works out the type of such an array anew for each row."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


def typed_cell(c: Column, dates: DateMode | None = None) -> Column:
    """A raw cell struct as a typed one. What a branch needs is worked out in that branch and once, see let()."""
    raw, t, s = F.coalesce(c["raw"], c["f"]), F.coalesce(c["t"], F.lit("")), c["s"]
    styled = (F.coalesce(s, F.lit(0)) > 0) & (F.coalesce(c["fmt"], F.lit("")) != "") & t.isin("", "n", "s") & F.coalesce(raw != "", F.lit(False))
    known = F.struct(F.when(styled, c["fmt"]).otherwise(t).alias("kind"), raw.alias("raw"))
    return let(known, lambda k: _typed(c, k["kind"], k["raw"], dates or DateMode()))


def _typed(c: Column, kind: Column, raw: Column, dates: DateMode) -> Column:
    def typed(tag: Column | str, original: Column = raw, **slots: Column) -> Column:
        def slot(name: str, kind: str) -> Column:
            return slots.get(name, F.lit(None)).cast(kind).alias(name)

        tag = F.lit(tag) if isinstance(tag, str) else tag
        return F.struct(c["col"].alias("col"), tag.alias("t"), slot("i", "bigint"), slot("d", "double"), slot("b", "boolean"), slot("x", "string"), original.alias("o"), c["s"].alias("s"), c["f"].alias("f"))

    inline = F.coalesce(c["text"], F.lit(""))
    return (
        F.when(kind.isin("s", "string"), typed("string", x=raw))
        .when(kind.isin("d", "date"), F.when(raw.isNull() | (trim_expr(raw) == ""), typed("date", x=F.lit(""))).otherwise(_typed_date(c, raw, dates, typed)))
        .when(kind == "b", typed("bool", b=F.coalesce(~raw.isin("", "0"), F.lit(False))))
        .when(kind == "e", typed("error", x=F.coalesce(raw, F.lit(""))))
        .when(kind == "inlineStr", typed("string", F.when(raw.isNull() & (inline != ""), c["text"]).otherwise(raw), x=inline))
        .otherwise(_typed_number(kind, raw, typed))
    )


def _typed_number(kind: Column, raw: Column, typed: Callable[..., Column]) -> Column:
    """A whole number, a number, or the text as it is. Casts leave blanks on either side out by themselves."""
    long_enough = (F.length(raw) > 2) & ~((F.substring(raw, 1, 1) == "0") & (F.substring(raw, 2, 1) != "."))
    as_int, as_double = F.when(raw.rlike(_INTEGER), raw.try_cast("bigint")), F.when(long_enough & raw.rlike(_NUMERIC), raw.try_cast("double"))
    other = typed(F.when(kind == "n", "number").otherwise(kind), x=raw)
    double = let(as_double, lambda d: F.when(d.isNotNull(), typed("number", d=d)).otherwise(other))
    return let(as_int, lambda i: F.when(i.isNotNull(), typed("number", i=i)).otherwise(double))


def _typed_date(c: Column, raw: Column, dates: DateMode, typed: Callable[..., Column]) -> Column:
    """A date that isn't blank, as the mode says."""
    from .dates import format_seconds, serial_seconds, text_seconds

    def shown(seconds: Column) -> Column:
        if dates.kind == "plain":
            keep = (F.coalesce(c["t"], F.lit("")) != "s") & raw.rlike(_NUMERIC)
            return F.when(keep, typed("date", i=seconds)).otherwise(typed("date", x=raw))
        if dates.kind == "seconds":
            return F.when(seconds != 0, typed("date", i=seconds)).otherwise(typed("date", x=F.when(seconds == 0, raw)))
        if dates.kind == "function":
            text = dates.function(seconds, c["code"], c["s"])
        elif dates.kind == "pattern":
            text = format_seconds(seconds, dates.pattern)
        else:  # own: one branch per code that the book has, so that each formatter is made once
            text = F.lit(None).cast("string")
            for code, pattern in dates.codes.items():
                text = F.when(c["code"] == code, format_seconds(seconds, pattern)).otherwise(text)
            text = F.coalesce(text, format_seconds(seconds, dates.pattern) if dates.pattern else seconds.cast("string"))
        return typed("date", x=F.when(seconds != 0, text).otherwise(raw))

    if dates.kind == "original":
        return typed("date", x=raw)
    serial = let(raw.try_cast("double"), lambda n: serial_seconds(n, F.coalesce(c["base1904"], F.lit(False))))
    return let(F.when(raw.rlike(_NUMERIC), serial).otherwise(text_seconds(raw)), shown)


def as_string(v: Column) -> Column:
    """A typed cell as text; booleans as true and false."""
    return F.coalesce(v["x"], v["i"].cast("string"), v["d"].cast("string"), v["b"].cast("string"))


def as_double(v: Column) -> Column:
    return F.coalesce(v["d"], v["i"].cast("double"), v["b"].cast("int").cast("double"), v["x"].try_cast("double"))


def as_long(v: Column) -> Column:
    return F.coalesce(v["i"], v["d"].try_cast("bigint"), v["b"].cast("bigint"), v["x"].try_cast("bigint"))


def as_timestamp(v: Column) -> Column:
    return F.when(v["t"] == "date", F.timestamp_seconds(v["i"]))


def as_boolean(v: Column) -> Column:
    return F.coalesce(v["b"], v["i"] != 0, v["d"] != 0)


#: Casts by name, for rows(types=...).
CASTS = {"string": as_string, "double": as_double, "long": as_long, "timestamp": as_timestamp, "boolean": as_boolean}
