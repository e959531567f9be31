"""Time-series reads: ranges, tails, pages, dense timelines, downsampling, aggregates and percentiles."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import require
from ..functions.interval import duration, period
from . import SEQ, TS
from .aggregates import ALL, BASIC, aggregate, level, named, number, per_field, percentiles
from .predicates import condition, conditions, matching
from .scan import Scan, in_range, scan, sorted_by


def query(df: DataFrame, start=None, end=None) -> DataFrame:
    """Rows in an inclusive time range, by time."""
    return scan(df, Scan(start=start, end=end))


def _written(df: DataFrame, newest: bool = False) -> list[Column]:
    c = F.col(SEQ)
    return [c.desc() if newest else c.asc()]


def all_rows(df: DataFrame) -> DataFrame:
    """Every row in the order it was written."""
    return df.orderBy(*_written(df)).drop(SEQ)


def tail(df: DataFrame, n: int) -> DataFrame:
    """The n rows written last, oldest first."""
    require(isinstance(n, int) and n >= 0, "TBL_TAIL_COUNT", "a whole number", n=n)
    return df.orderBy(*_written(df, newest=True)).limit(n).orderBy(*_written(df)).drop(SEQ)


def page(df: DataFrame, limit: int, offset: int = 0, order: str = "asc") -> DataFrame:
    """A window on the rows in the order they were written, or the reverse. No rows for a limit below 1."""
    require(order in ("asc", "desc"), "JRN_SCAN_ORDER", "asc or desc", order=order)
    return df.orderBy(*_written(df, order == "desc")).offset(max(offset, 0)).limit(max(limit, 0)).drop(SEQ)


def marks(df: DataFrame) -> DataFrame:
    """All times, sorted."""
    return df.where(F.col(TS).isNotNull()).select(TS).orderBy(TS)


def time_range(df: DataFrame) -> DataFrame:
    """One row with the first and last time."""
    return df.agg(F.min(TS).alias("min_ts"), F.max(TS).alias("max_ts"))


def lookup(df: DataFrame, field: str, value) -> DataFrame:
    """The row of the latest time in which a field has a value; of several, the one written first."""
    c = conditions([(field, "eq", value)])[0]
    return sorted_by(df.where(condition(df.schema, c)), TS, "desc").limit(1).drop(SEQ)


def _dense(df: DataFrame, n: int, buckets: DataFrame, start: Column, end: Column) -> DataFrame:
    """A row for each of n buckets, with what ``buckets`` (i, count, ...) says of it."""
    rest = [c for c in buckets.columns if c not in ("i", "count")]
    all_of = df.sparkSession.range(n).select(F.col("id").alias("i"))
    count = F.coalesce("count", F.lit(0)).cast("long")
    return all_of.join(buckets, "i", "left").select(start.alias("start"), end.alias("end"), count.alias("count"), (count > 0).alias("hasData"), *rest)


def timeline(df: DataFrame, interval: int | str, start, end=None, now: int | None = None, whole_only: bool = False) -> DataFrame:
    """Rows in each bucket of a period, empty ones included: start, end (excluded), count, hasData.

    Buckets start with the period; the last one ends with it, or is left out if
    ``whole_only``. An empty period has no buckets.
    """
    step = duration(interval, "TBL_TL_INTERVAL")
    a, b = period(start, end, now)
    a, b = int(a), int(b)
    n = (b - a) // step if whole_only else -(-(b - a) // step)
    i = F.expr(f"(ts - {a}L) div {step}L")
    rows = df.where((F.col(TS) >= a) & (F.col(TS) < min(b, a + n * step))) if n > 0 else df.limit(0)
    first = F.lit(a) + F.col("i") * step
    return _dense(df, n, rows.groupBy(i.alias("i")).agg(F.count(F.lit(1)).alias("count")), first, F.least(first + step, F.lit(b)))


def downsample(df: DataFrame, start, end, bucket: int | str, field: str, fns: Sequence[str], now: int | None = None) -> DataFrame:
    """Aggregates of a field in buckets of the epoch's grid, the outer ones cut to [start, end). ``count`` counts the field's numbers."""
    require(isinstance(field, str) and bool(field), "JRN_DS_FIELD", "a field name")
    require(isinstance(fns, (list, tuple)) and bool(fns), "JRN_DS_FNS", "a list of functions")
    for fn in fns:
        require(fn in BASIC, "JRN_DS_FN", f"one of {', '.join(BASIC)}", fn=fn)
    step = duration(bucket, "JRN_DS_BUCKET_POS" if not isinstance(bucket, str) else "JRN_DS_BUCKET")
    a, b = period(start, end, now)
    a, b = int(a), int(b)
    first = a - a % step
    n = max(1, -(-(b - first) // step))
    x = number(df.schema, field)
    rows = df.where((F.col(TS) >= a) & (F.col(TS) < b)).where(x.isNotNull())
    own = [aggregate(df, field, fn).alias(fn) for fn in dict.fromkeys(fns) if fn != "count"]
    grouped = rows.groupBy(F.expr(f"(ts - {first}L) div {step}L").alias("i")).agg(F.count(F.lit(1)).alias("count"), *own)
    at = F.lit(first) + F.col("i") * step
    return _dense(df, n, grouped, F.greatest(at, F.lit(a)), F.least(at + step, F.lit(b)))


def aggregate_range(df: DataFrame, start, end, exprs: Iterable, where: Iterable | None = None, now: int | None = None) -> DataFrame:
    """One row of ``<field>_<fn>`` over an inclusive time range and a filter."""
    agg = per_field(exprs, "TBL_AGG_EXPRS", "TBL_AGG_FIELD_EMPTY", "TBL_AGG_EXPR_FN", ALL)
    a, b = period(start, end, now)
    rows = matching(in_range(df, a, b), where, "TBL_WHERE_OP")
    return rows.agg(*named(rows, agg))


def percentile(df: DataFrame, start, end, levels, field: str = "value", now: int | None = None) -> DataFrame:
    """Exact interpolated percentiles of a field over an inclusive time range, one column for each level."""
    require(isinstance(field, str) and bool(field), "JRN_PCTL_FIELD", "a field name")
    a, b = period(start, end, now)
    return percentiles(in_range(df, a, b), field, level(levels, "TBL_PCTL_LEVEL"))
