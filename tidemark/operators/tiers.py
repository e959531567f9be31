"""Resolution tiers: rolling rows up to coarser times, and reading over all tiers.

Tier 0 holds rows as they came. A coarser tier holds a row for each bucket and
combination of dimensions with stored partial results (see ``aggregates``). A row
is in one tier only. Tier 0 serves everything up to ``now``; tier i serves the
times between its own lifetime and that of the tier before.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.interval import period
from ..functions.retention import Tier
from . import SEQ, TS
from .aggregates import ALL, number, per_field, stored_columns
from .predicates import matching
from .scan import Scan, cut, in_range, project, sorted_by

#: What is known of a field in a row or group: count, sum, smallest, largest, last and first with their times.
PARTS = ("count", "sum", "min", "max", "last", "last_ts", "first", "first_ts")


def partials(df: DataFrame, field: str) -> dict[str, Column]:
    """The parts of a field in each row: of a rolled-up row its stored ones, of another its number."""
    have = set(df.columns)
    x = number(df.schema, field)
    seen = x.isNotNull()
    raw = {"count": seen.cast("long"), "sum": x, "min": x, "max": x, "last": x, "last_ts": F.when(seen, F.col(TS)), "first": x, "first_ts": F.when(seen, F.col(TS))}
    if f"{field}_count" not in have:
        return raw
    rolled = F.col(f"`{field}_count`").isNotNull()
    return {p: F.when(rolled, F.col(f"`{field}_{p}`") if f"{field}_{p}" in have else F.lit(None)).otherwise(raw[p]) for p in PARTS}


def merged(df: DataFrame, field: str) -> dict[str, Column]:
    """Aggregates that merge the parts of a field over a group."""
    p = partials(df, field)
    tie = [F.col(SEQ)] if SEQ in df.columns else []
    return {
        "count": F.coalesce(F.sum(p["count"]), F.lit(0)),
        "sum": F.sum(p["sum"]),
        "min": F.min(p["min"]),
        "max": F.max(p["max"]),
        "last": F.max_by(p["last"], F.when(p["last_ts"].isNotNull(), F.struct(p["last_ts"], *tie))),
        "last_ts": F.max(p["last_ts"]),
        "first": F.min_by(p["first"], F.when(p["first_ts"].isNotNull(), F.struct(p["first_ts"], *tie))),
        "first_ts": F.min(p["first_ts"]),
    }


def functions_of(fn: str | Sequence[str]) -> list[str]:
    return [fn] if isinstance(fn, str) else list(fn)


def all_functions(agg: Mapping[str, str | Sequence[str]], extra: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """The functions of each field in ``agg`` and then those that only ``extra`` names."""
    return {f: list(dict.fromkeys([*functions_of(agg.get(f, ())), *extra.get(f, ())])) for f in [*agg, *(f for f in extra if f not in agg)]}


def is_multi(fn: str | Sequence[str]) -> bool:
    """Whether a field's results are stored under names of their own; a single plain function also stands in the field itself."""
    return not isinstance(fn, str) or fn in ("last", "first")


def bucket_of(res_ms: int) -> Column:
    """The multiple of ``res_ms`` at or before ts (towards zero before 1970)."""
    return F.col(TS) - F.col(TS) % F.lit(res_ms).cast("long")


def promote(df: DataFrame, res_ms: int, dims: Sequence[str], agg: Mapping[str, str | Sequence[str]], extra: Mapping[str, Sequence[str]] = MappingProxyType({})) -> DataFrame:
    """Roll rows up to buckets of ``res_ms``; rows that are rolled up already are merged.

    Columns: ts (the bucket), the dimensions, and for each field its stored
    parts; a field with a single function other than last and first also has the
    value under its own name. ``extra`` names functions to be stored besides. Over
    no numbers all are null. Rows without a ts are left out.
    """
    rows = df.where(F.col(TS).isNotNull())
    have = set(df.columns)
    keys = [F.col(f"`{d}`") if d in have else F.lit(None).cast("string").alias(d) for d in dims]
    stored = all_functions(agg, extra)
    parts = {f: merged(rows, f) for f in stored}
    columns = [c.alias(f"_{p}_{f}") for f, own in parts.items() for p, c in own.items()]
    order = [F.min(SEQ).alias(SEQ)] if SEQ in have else []
    grouped = rows.groupBy(bucket_of(res_ms).alias("_bucket"), *keys).agg(*columns, *order)
    out = [F.col("_bucket").alias(TS), *[F.col(f"`{d}`") for d in dims]]
    for f, fns in stored.items():
        n = F.col(f"`_count_{f}`")
        value = {p: F.when(n > 0, F.col(f"`_{p}_{f}`")) for p in PARTS} | {"avg": F.when(n > 0, F.col(f"`_sum_{f}`") / n)}
        if f in agg and not is_multi(agg[f]):
            out.append(value[agg[f]].alias(f))
        for name in stored_columns(f, fns):
            out.append(value[name[len(f) + 1 :]].alias(name))
    return grouped.select(*out, *([SEQ] if order else []))


def window(tiers: Sequence[Tier], i: int, start, end, now: int) -> tuple | None:
    """The part of an inclusive range that tier i serves, or None."""
    last = min(end, now) if i == 0 else min(end, now - tiers[i - 1].ttl_ms)
    first = start if i == 0 else max(start, now - tiers[i].ttl_ms)
    return (first, last) if first <= last else None


def read(frames: Sequence[DataFrame], tiers: Sequence[Tier], now: int, start=None, end=None, where: Iterable | None = None) -> list[tuple[int, DataFrame]]:
    """The tiers that have a part in a range, filtered to it. Empty parts are not planned at all."""
    start, end, out = 0 if start is None else start, now if end is None else end, []
    for i, df in enumerate(frames):
        part = window(tiers, i, start, end, now)
        if part is not None:
            out.append((i, matching(in_range(df, *part), where, "TBL_WHERE_OP")))
    return out


def union(parts: Sequence[tuple[int, DataFrame]], like: DataFrame) -> DataFrame:
    """All parts one after the other with their tier's number; missing columns are null."""
    out = None
    for i, df in parts:
        df = df.withColumn("_tier", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return like.limit(0).withColumn("_tier", F.lit(0)) if out is None else out


def tier_scan(frames: Sequence[DataFrame], tiers: Sequence[Tier], now: int, spec: Scan) -> DataFrame:
    """A row scan over all tiers, by time, ties in the order of tiers. Each tier is cut to the limit before they are put together."""
    spec.check()
    order = spec.order or "asc"
    parts = read(frames, tiers, now, spec.start, spec.end, spec.where)
    if spec.limit is not None:
        parts = [(i, cut(sorted_by(df, TS, order), spec.limit + spec.offset, 0)) for i, df in parts]
    rows = union(parts, frames[0])
    fields = spec.select or [c for c in frames[0].columns if c != SEQ]
    ts = F.col(TS).asc_nulls_last() if order == "asc" else F.col(TS).desc_nulls_last()
    rows = rows.orderBy(ts, "_tier", *([F.col(SEQ)] if SEQ in rows.columns else []))
    return project(cut(rows, spec.limit, spec.offset), fields)


def tier_aggregate(frames: Sequence[DataFrame], tiers: Sequence[Tier], now: int, start, end, exprs: Iterable, where: Iterable | None = None, group_by: Sequence[str] = (), weighted: bool = True) -> DataFrame:
    """``<field>_<fn>`` over a range of all tiers.

    Rolled-up rows count with their stored parts. With ``weighted`` off the value
    under a field's own name counts as one number, whatever it was rolled up from.
    """
    agg = per_field(exprs, "TBL_AGG_EXPRS", "TBL_AGG_FIELD_EMPTY", "TBL_AGG_EXPR_FN", ALL)
    a, b = period(start, end, now)
    parts = read(frames, tiers, now, a, b, where)
    if not weighted:
        parts = [(i, df.drop(*[f"{f}_{p}" for f in agg for p in PARTS])) for i, df in parts]
    rows = union(parts, frames[0])
    sums = {f: merged(rows, f) for f in agg}
    columns = [(sums[f]["sum"] / F.when(sums[f]["count"] > 0, sums[f]["count"]) if fn == "avg" else sums[f][fn]).alias(f"{f}_{fn}") for f, fns in agg.items() for fn in fns]
    return rows.groupBy(*group_by).agg(*columns) if group_by else rows.agg(*columns)


def roll_cut(now: int, fine: Tier, coarse: Tier) -> int:
    """Rows before this time go to the coarse tier: older than the fine one keeps, in whole buckets."""
    past = now - fine.ttl_ms
    return past - past % coarse.res_ms


