"""The scan: time range, filter, projection or grouped aggregation, order by one key, offset and limit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import require
from . import SEQ, TS
from .aggregates import BASIC, named
from .predicates import Condition, conditions, matching


def _is_whole(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= 0


@dataclass
class Scan:
    """A checked scan. Bounds are inclusive milliseconds; see ``check`` for the rules."""

    start: int | float | None = None
    end: int | float | None = None
    where: Sequence = ()
    select: Sequence[str] = ()
    group_by: Sequence[str] = ()
    agg: Mapping[str, Sequence[str]] = field(default_factory=dict)
    order: str | None = None
    limit: int | None = None
    offset: int = 0
    #: What a row scan without ts among its fields is sorted by, if it is one of them; else the first field.
    key: str | None = None

    def check(self) -> Scan:
        require(self.start is None or self.end is None or self.start <= self.end, "JRN_SCAN_RANGE", "start must not be after end")
        self.where: list[Condition] = conditions(self.where)
        for f, fns in self.agg.items():
            require(isinstance(f, str) and bool(f), "JRN_SCAN_AGG_FIELD", "a field name")
            require(isinstance(fns, (list, tuple)) and bool(fns), "JRN_SCAN_AGG_FNS", "a list of functions", field=f)
            for fn in fns:
                require(fn in BASIC, "JRN_SCAN_AGG_FN", f"one of {', '.join(BASIC)}", fn=fn)
        if isinstance(self.group_by, str):
            self.group_by = [self.group_by]
        self.group_by = list(self.group_by or ())
        require(all(isinstance(g, str) and g for g in self.group_by), "JRN_SCAN_GROUPBY", "field names")
        require(not self.group_by or bool(self.agg), "JRN_SCAN_GROUPBY_AGG", "grouping needs aggregates")
        require(not isinstance(self.select, str), "JRN_SCAN_SELECT", "a list of fields")
        self.select = list(self.select or ())
        require(all(isinstance(s, str) and s for s in self.select), "JRN_SCAN_SELECT_FIELD", "field names")
        require(self.order in (None, "asc", "desc"), "JRN_SCAN_ORDER", "asc or desc", order=self.order)
        require(self.limit is None or _is_whole(self.limit), "JRN_SCAN_LIMIT", "a whole number", limit=self.limit)
        self.offset = self.offset or 0
        require(_is_whole(self.offset), "JRN_SCAN_OFFSET", "a whole number", offset=self.offset)
        return self


def in_range(df: DataFrame, start=None, end=None) -> DataFrame:
    """Rows with start <= ts <= end. Rows without a ts go as soon as there is a bound."""
    if start is not None:
        df = df.where(F.col(TS) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(TS) <= F.lit(end))
    return df


def project(df: DataFrame, fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The fields, null where the table lacks one; all but the write order if none is named."""
    fields = list(fields) or [c for c in df.columns if c != SEQ]
    have = set(df.columns)
    return df.select(*[F.col(f"`{c}`") if c in have else F.lit(None).cast("string").alias(c) for c in dict.fromkeys([*fields, *keep])])


def sorted_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """Nulls last either way; ties in the order they were written."""
    c = F.col(f"`{key}`")
    return df.orderBy(c.asc_nulls_last() if order == "asc" else c.desc_nulls_last(), *([F.col(SEQ).asc()] if SEQ in df.columns else []))


def cut(df: DataFrame, limit: int | None, offset: int) -> DataFrame:
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def scan(df: DataFrame, spec: Scan) -> DataFrame:
    """Run a scan over a log table.

    Aggregating scans are sorted by their first aggregate (``desc`` unless asked
    otherwise), row scans by ``ts`` or else their first field (``asc``). Without
    grouping an aggregating scan gives one row, also over nothing.
    """
    spec.check()
    rows = matching(in_range(df, spec.start, spec.end), spec.where)
    if spec.agg:
        out = [f"{f}_{fn}" for f, fns in spec.agg.items() for fn in fns]
        if not spec.group_by:
            return cut(rows.agg(*named(rows, spec.agg)), spec.limit, spec.offset)
        have = set(rows.columns)
        keys = [F.col(f"`{g}`") if g in have else F.lit(None).cast("string").alias(g) for g in spec.group_by]
        first = [F.min(SEQ).alias(SEQ)] if SEQ in have else []
        grouped = rows.groupBy(*keys).agg(*named(rows, spec.agg), *first)
        return cut(sorted_by(grouped, out[0], spec.order or "desc"), spec.limit, spec.offset).select(*spec.group_by, *out)
    fields = spec.select or [c for c in df.columns if c != SEQ]
    key = TS if TS in fields else spec.key if spec.key in fields else fields[0]
    rows = sorted_by(project(rows, fields, [SEQ] if SEQ in df.columns else []), key, spec.order or "asc")
    return cut(rows, spec.limit, spec.offset).select(*[F.col(f"`{c}`") for c in dict.fromkeys(fields)])
