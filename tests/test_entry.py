"""The driver's entry points, and queries against their SQL."""

import importlib
import importlib.util
import os
import sys

import duckdb
import pytest

from sheetframe import queries as own

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows_of(columns, rows):
    """Rows with columns in order of name, as text, sorted."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple("" if r[k] is None else f"{r[k]:.9g}" if isinstance(r[k], float) else str(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query_equals_its_sql(spark, tables, name):
    found = own.QUERIES[name](spark, SF)
    want = tables.sql(own.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert rows_of(found.columns, found.collect()) == rows_of(want.columns, want.fetchall())
    spark.catalog.clearCache()


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(own.QUERIES) <= set(entry.queries())


def test_entry_without_the_pipeline_operators(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("sheetframe.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "sheetframe.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(own.QUERIES)
    assert set(entry.oracle_sql()) == set(own.ORACLE_SQL)


def test_entry_hides_no_other_broken_import(monkeypatch):
    """What the subpackage itself fails to import is an error, not an absence."""
    if importlib.util.find_spec("sheetframe.llm") is None:
        pytest.skip("no pipeline operators")
    for name in [n for n in sys.modules if n.startswith("sheetframe.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    entry = importlib.import_module("__spark_entry__")
    with pytest.raises(ModuleNotFoundError, match="ahocorasick"):
        entry.queries()
