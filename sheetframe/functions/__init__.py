"""Scalar semantics: addresses, cell typing, dates, encodings. All of it as Spark expressions where data flows."""
