"""All queries of the subpackage and their SQL."""

from paperloom.llm import leaks, personal, reading, repetition, scans, splits, tokenize

_PARTS = [splits, tokenize, leaks, reading, repetition, scans, personal]

QUERIES: dict = {}
SQL: dict = {}
for _m in _PARTS:
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
