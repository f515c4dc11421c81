"""Operators for building training corpora: deduplication, filters, mixing,
tokenization and archive handling.

Nothing outside this subpackage imports it. Every operator takes a DataFrame
(and column names) and returns a DataFrame; ``queries`` binds them to the
supplied tables.
"""
