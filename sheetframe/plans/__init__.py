"""Workbook-level entry points that put sources and operators together."""
