"""Operators for large training corpora: deduplication, language, toxicity, extraction, filters and mixing.

Nothing else in the library imports this subpackage. ``queries.py`` holds the thin steps from the given tables to the
operators, ``oracles.py`` the SQL of those that SQL can express.
"""
