"""Operators on log tables: DataFrames with ``ts`` (milliseconds, BIGINT) and ``_seq`` (write order, BIGINT)."""

TS, SEQ = "ts", "_seq"
