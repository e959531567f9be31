"""Aggregates over the finite numbers of a field.

``min max sum avg count`` and, by time, ``last`` and ``first``. Anything that
isn't a finite number is left out, so ``count`` counts numbers and not rows. Over
nothing ``count`` is 0 and the others are null.

Partial results are stored columns (``<field>_<fn>``, and ``<field>_last_ts``,
``<field>_first_ts``) that merge: this is what coarse tiers hold.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import require
from . import SEQ, TS

BASIC = ("min", "max", "sum", "avg", "count")
BY_TIME = ("last", "first")
ALL = BASIC + BY_TIME


def number(schema: T.StructType, field: str) -> Column:
    """A field's finite numbers; null for everything else and for a field that isn't there."""
    kind = {f.name: f.dataType for f in schema}.get(field)
    col = F.col(f"`{field}`")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col) & (F.abs(col) < float("inf")), col)
    return col if isinstance(kind, T.NumericType) else F.lit(None).cast("double")


def when_order(df: DataFrame) -> Column:
    """Time, and the write order among rows of the same time."""
    return F.struct(TS, SEQ) if SEQ in df.columns else F.struct(TS)


def aggregate(df: DataFrame, field: str, fn: str) -> Column:
    """One aggregate of a field of ``df`` as a Column."""
    x = number(df.schema, field)
    if fn in ("last", "first"):
        at = F.when(x.isNotNull() & F.col(TS).isNotNull(), when_order(df))
        return (F.max_by if fn == "last" else F.min_by)(x, at)
    return {"min": F.min, "max": F.max, "sum": F.sum, "avg": F.avg, "count": F.count}[fn](x)


def named(df: DataFrame, agg: Mapping[str, Sequence[str]]) -> list[Column]:
    """``<field>_<fn>`` for all functions of all fields."""
    return [aggregate(df, f, fn).alias(f"{f}_{fn}") for f, fns in agg.items() for fn in fns]


def per_field(exprs: Iterable, empty: str, field_code: str, fn_code: str, allowed: Sequence[str]) -> dict[str, list[str]]:
    """(field, fn) pairs to the functions of each field, each once."""
    exprs = list(exprs or ())
    require(bool(exprs), empty, "a list of (field, function)")
    out: dict[str, list[str]] = {}
    for e in exprs:
        field, fn = (e.get("field"), e.get("fn")) if isinstance(e, dict) else e
        require(isinstance(field, str) and bool(field), field_code, "a field name")
        require(fn in allowed, fn_code, f"one of {', '.join(allowed)}", fn=fn)
        if fn not in out.setdefault(field, []):
            out[field].append(fn)
    return out


def stored_functions(fns: Sequence[str]) -> list[str]:
    """The functions of which partial results are stored for ``fns``: always a sum and a count beside them, so that any average stays exact."""
    return list(dict.fromkeys([*fns, "sum", "count"]))


def stored_columns(field: str, fns: Sequence[str]) -> list[str]:
    out = []
    for fn in stored_functions(fns):
        out.append(f"{field}_{fn}")
        if fn in BY_TIME:
            out.append(f"{field}_{fn}_ts")
    return out


@dataclass
class Accumulator:
    """The same aggregates outside of Spark, one value at a time; two of them merge."""

    count: int = 0
    sum: float = 0.0
    min: float | None = None
    max: float | None = None
    last: tuple | None = None
    first: tuple | None = None

    def add(self, value, ts: int = 0) -> None:
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
            return
        self.merge(Accumulator(1, value, value, value, (ts, value), (ts, value)))

    def add_summary(self, count: int, total: float | None, low: float | None, high: float | None) -> None:
        """Take in what is known of many numbers at once; their times aren't known."""
        if not count:
            return
        self.sum = self.sum + total if self.count else total  # whole numbers stay whole
        self.count += count
        self.min = low if self.min is None else min(self.min, low)
        self.max = high if self.max is None else max(self.max, high)

    def merge(self, later: Accumulator) -> None:
        """Take in what was gathered elsewhere, after this."""
        if not later.count:
            return
        self.count, self.sum = self.count + later.count, self.sum + later.sum
        self.min = later.min if self.min is None else min(self.min, later.min)
        self.max = later.max if self.max is None else max(self.max, later.max)
        self.last = later.last if self.last is None or later.last[0] >= self.last[0] else self.last
        self.first = later.first if self.first is None or later.first[0] < self.first[0] else self.first

    def value(self, fn: str):
        require(fn in ALL, "TBL_AGG_EXPR_FN", f"one of {', '.join(ALL)}", fn=fn)
        if fn == "count":
            return self.count
        if not self.count:
            return None
        if fn == "avg":
            return self.sum / self.count
        return getattr(self, fn)[1] if fn in BY_TIME else getattr(self, fn)


def apply(fn: str, values: Iterable):
    """One aggregate of plain values, in their order."""
    acc = Accumulator()
    for i, v in enumerate(values):
        acc.add(v, i)
    return acc.value(fn)


def level(levels: Iterable[float], code: str) -> list[float]:
    out = list(levels) if not isinstance(levels, (int, float)) else [levels]
    for x in out:
        require(isinstance(x, (int, float)) and not isinstance(x, bool) and 0 < x < 1, code, "between 0 and 1, both excluded", level=x)
    return out


def level_name(x: float) -> str:
    """0.5 is p50, 0.999 is p99.9."""
    n = int(x * 1000 + 0.5) / 10
    return f"p{int(n) if n == int(n) else n}"


#: Up to so many numbers are held in one task for an exact percentile.
DIRECT = 1_000_000
_ACCURACY = 10_000


def percentiles(df: DataFrame, field: str, levels: Sequence[float]) -> DataFrame:
    """Exact percentiles, interpolated between neighbours, in one row; nulls over nothing.

    Of more than ``DIRECT`` numbers the wanted ranks are closed in on first, see
    ``at_ranks``, so that no task has to hold them all; neighbours are weighed as
    Spark's ``percentile`` does, so the result is the same to the last digit.
    """
    x = number(df.schema, field).cast("double")
    numbers = df.select(x.alias("x")).where(F.col("x").isNotNull())
    n = numbers.count()
    names = [level_name(v) for v in levels]
    if n <= DIRECT:
        return numbers.agg(F.percentile("x", F.array(*[F.lit(float(v)) for v in levels])).alias("p")).select(*[F.get("p", F.lit(i)).alias(c) for i, c in enumerate(names)])
    places = [(n - 1) * v for v in levels]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    found = dict(zip(ranks, at_ranks(numbers, ranks, n), strict=True))
    out = []
    for p in places:
        low, high = found[math.floor(p)], found[math.ceil(p)]
        out.append(low if low == high else (math.ceil(p) - p) * low + (p - math.floor(p)) * high)
    return df.sparkSession.createDataFrame([tuple(out)], ", ".join(f"`{c}` double" for c in names))


def at_ranks(numbers: DataFrame, ranks: Sequence[int], n: int) -> list[float]:
    """The numbers (column x, n rows) at places of their order.

    Each pass takes approximate quantiles around every rank inside the bounds
    known so far, counts what lies below them, and so narrows the bounds by a
    factor of thousands; once few numbers are left they are sorted. One pass
    serves all ranks.
    """
    bounds = {r: (-math.inf, math.inf, 0, n) for r in ranks}  # both excluded; how many lie below, and between
    found: dict[int, float] = {}
    spread = 2 / _ACCURACY
    x = F.col("x")

    def inside(r: int) -> Column:
        low, high, _, _ = bounds[r]
        return F.when((x > low) & (x < high), x)

    while wide := [r for r in ranks if r not in found and bounds[r][3] > DIRECT]:
        shares = {r: (r - bounds[r][2]) / (bounds[r][3] - 1) for r in wide}
        near = [F.percentile_approx(inside(r), F.array(F.lit(max(0.0, shares[r] - spread)), F.lit(min(1.0, shares[r] + spread))), F.lit(_ACCURACY)).alias(f"r{r}") for r in wide]
        cuts = numbers.agg(*near).first()
        counted = []
        for r in wide:
            a, b = cuts[f"r{r}"]
            counted += [F.count_if(inside(r) < a), F.count_if(inside(r) <= a), F.count_if(inside(r) < b), F.count_if(inside(r) <= b)]
        counts, missed = list(numbers.agg(*[c.alias(f"c{i}") for i, c in enumerate(counted)]).first()), False
        for i, r in enumerate(wide):
            (a, b), (low, high, below, m) = cuts[f"r{r}"], bounds[r]
            under_a, upto_a, under_b, upto_b = (below + c for c in counts[4 * i : 4 * i + 4])
            if under_a <= r < upto_a:
                found[r] = a
            elif under_b <= r < upto_b:
                found[r] = b
            elif upto_a <= r < under_b:
                bounds[r] = (a, b, upto_a, under_b - upto_a)
            else:  # the quantiles lay beside the rank
                bounds[r] = (low, a, below, under_a - below) if r < under_a else (b, high, upto_b, below + m - upto_b)
                missed = True
        if missed:
            spread *= 4
    rest = [r for r in ranks if r not in found]
    if rest:
        row = numbers.agg(*[F.get(F.sort_array(F.collect_list(inside(r))), F.lit(r - bounds[r][2])).alias(f"r{r}") for r in rest]).first()
        found |= {r: row[f"r{r}"] for r in rest}
    return [found[r] for r in ranks]
