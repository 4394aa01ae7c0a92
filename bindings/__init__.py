"""The operators bound to the shared tables, each with its SQL twin.

A module holds ``QUERIES`` (name to a function of session and folder) and ``SQL``
(name to the same question in DuckDB's SQL).
"""
