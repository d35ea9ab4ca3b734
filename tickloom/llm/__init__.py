"""Operators for large training-text corpora, their registered queries and SQL.

Nothing outside this subpackage imports it; the entry module adds its queries
only where it is present.
"""
