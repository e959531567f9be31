"""Errors with a stable code.

Fixed values: the codes, where they are raised (``DEF_`` of definitions, ``COL_``
of values, ``JRN_`` and ``TBL_`` of tables, ``STO_`` of stores, ``INT_`` of times,
``SQL_`` of the dialect), are part of the public interface.
"""

from __future__ import annotations


class TidemarkError(Exception):
    """``code`` names the rule that was broken; ``details`` says with what."""

    def __init__(self, code: str, message: str = "", **details):
        self.code, self.details = code, details
        said = ", ".join(f"{k}={v!r}" for k, v in details.items())
        super().__init__(": ".join(x for x in (code, message) if x) + (f" ({said})" if said else ""))


class SqlSyntaxError(TidemarkError):
    """SQL text that the dialect doesn't take, and where."""

    def __init__(self, position: int, message: str):
        self.position = position
        super().__init__("SQL_SYNTAX", f"SQL syntax error at position {position}: {message}")


def is_code(error: BaseException, code: str) -> bool:
    return isinstance(error, TidemarkError) and error.code == code


def require(holds: bool, code: str, message: str = "", **details) -> None:
    if not holds:
        raise TidemarkError(code, message, **details)
