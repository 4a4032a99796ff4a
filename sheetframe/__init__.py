"""Spreadsheets and delimited text as Spark DataFrames."""
