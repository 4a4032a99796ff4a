"""Spreadsheets that arrive in a folder, as a stream."""
