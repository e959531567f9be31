"""Filters as lists of (field, op, value), all of which must hold.

The logic has two values: a null fails a comparison and is told apart by ``ne``
and ``nin``. Numbers compare with numbers only; text, booleans and numbers are
never equal to each other. A field that the table lacks reads as null.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import require

OPS = ("eq", "ne", "lt", "le", "gt", "ge", "in", "nin", "isNull", "isNotNull", "startsWith")


class Condition(NamedTuple):
    field: str
    op: str
    value: object = None


def conditions(where: Iterable | None, op_code: str = "JRN_SCAN_WHERE_OP") -> list[Condition]:
    """Check a filter given as tuples, mappings or Conditions."""
    out = []
    for w in where or ():
        c = Condition(w.get("field"), w.get("op"), w.get("value")) if isinstance(w, dict) else Condition(*w)
        require(isinstance(c.field, str) and bool(c.field), "JRN_SCAN_WHERE_FIELD", "a field name")
        require(c.op in OPS, op_code, f"one of {', '.join(OPS)}", op=c.op)
        require(c.op not in ("in", "nin") or isinstance(c.value, (list, tuple, set)), "JRN_SCAN_WHERE_IN", "a list of values", field=c.field)
        out.append(c)
    return out


def _is_number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _comparable(kind: T.DataType | None, v) -> bool:
    """Whether a column of this type can equal the value."""
    if isinstance(v, float) and math.isnan(v):
        return False
    if isinstance(kind, T.BooleanType):
        return isinstance(v, bool)
    if isinstance(kind, T.NumericType):
        return _is_number(v)
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return isinstance(v, str)
    return False


def _literal(kind: T.DataType, v) -> Column:
    """A literal of the column's own type where that loses nothing, so the filter reaches the scan."""
    if isinstance(kind, T.IntegralType) and float(v).is_integer() and abs(v) < 1 << 31:
        return F.lit(int(v)).cast(kind)
    if isinstance(kind, T.DoubleType):
        return F.lit(float(v))
    return F.lit(v)


def condition(schema: T.StructType, c: Condition) -> Column:
    """One condition as a Column that is never null."""
    kinds = {f.name: f.dataType for f in schema}
    kind = kinds.get(c.field)
    col = F.col(f"`{c.field}`") if kind is not None else F.lit(None)
    no, yes = F.lit(False), F.lit(True)
    if c.op == "isNull":
        return col.isNull() if kind is not None else yes
    if c.op == "isNotNull":
        return col.isNotNull() if kind is not None else no
    if c.op in ("eq", "ne"):
        if c.value is None:
            same = col.isNull() if kind is not None else yes
        else:
            same = col.eqNullSafe(_literal(kind, c.value)) if _comparable(kind, c.value) else no
        return same if c.op == "eq" else ~same
    if c.op in ("in", "nin"):
        values = [_literal(kind, v) for v in c.value if v is not None and _comparable(kind, v)]
        found = F.coalesce(col.isin(values), no) if values else no
        if any(v is None for v in c.value):
            found = found | col.isNull() if kind is not None else yes
        return found if c.op == "in" else ~found
    if c.op == "startsWith":
        fits = isinstance(kind, T.StringType) and isinstance(c.value, str)
        return F.coalesce(col.startswith(c.value), no) if fits else no
    if not (isinstance(kind, T.NumericType) and _is_number(c.value)) or math.isnan(c.value):
        return no
    v = _literal(kind, c.value) if not math.isinf(c.value) else F.lit(float(c.value))
    held = {"lt": col < v, "le": col <= v, "gt": col > v, "ge": col >= v}[c.op]
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        held = held & ~F.isnan(col)
    return held  # null where the column is: a filter takes that as false


def all_of(schema: T.StructType, where: Sequence[Condition]) -> Column:
    """All conditions as one Column that is never null; no condition holds always."""
    return F.coalesce(reduce(lambda a, b: a & b, (condition(schema, c) for c in where)), F.lit(False)) if where else F.lit(True)


def matching(df: DataFrame, where: Iterable | None, op_code: str = "JRN_SCAN_WHERE_OP") -> DataFrame:
    """The rows for which every condition holds, each a filter of its own so that it can be pushed down."""
    for c in conditions(where, op_code):
        df = df.where(condition(df.schema, c))
    return df
