"""Merge engines: what rows of one key become when a table is merged.

``log`` leaves rows alone; ``upsert`` keeps the one of the highest version;
``summing`` adds columns up; ``collapsing`` cancels rows against later reverts.
Each is a function of a DataFrame with ``_seq`` and gives one back; merging what
was merged changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import require
from . import SEQ, TS


@dataclass(frozen=True)
class Engine:
    """An engine's name and the columns it goes by."""

    kind: str = "log"
    key: tuple[str, ...] = ()
    version: str | None = None
    sum: tuple[str, ...] = ()
    sign: str | None = None


def as_number(df: DataFrame, field: str) -> Column:
    """A column as a number for comparing: text is read, booleans are 1 and 0, what isn't a finite number is 0."""
    c = F.col(f"`{field}`")
    kind = df.schema[field].dataType
    if isinstance(kind, T.IntegralType):
        return F.coalesce(c.cast("long"), F.lit(0))
    if isinstance(kind, T.StringType):
        c = c.try_cast("double")
    elif isinstance(kind, T.BooleanType):
        c = c.cast("int").cast("double")
    else:
        c = c.cast("double")
    return F.coalesce(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c), F.lit(0.0))


def _version(df: DataFrame, engine: Engine) -> Column:
    return as_number(df, engine.version) if engine.version else F.col(SEQ)


def log(df: DataFrame, engine: Engine) -> DataFrame:
    return df


def upsert(df: DataFrame, engine: Engine) -> DataFrame:
    """The row of the highest version of each key, of equal ones the one written last. Nulls in a key are a value."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.groupBy(*[F.col(f"`{k}`") for k in engine.key]).agg(F.max_by(whole, F.struct(_version(df, engine), F.col(SEQ))).alias("_row"))
    return best.select("_row.*")


def summing(df: DataFrame, engine: Engine) -> DataFrame:
    """One row for each key: that of the highest version (of equal ones the first; without versions the last), with the finite numbers of the ``sum`` columns added up."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    place = F.struct(_version(df, engine), -F.col(SEQ)) if engine.version else F.struct(F.col(SEQ))
    adds = []
    for c in engine.sum:
        kind = df.schema[c].dataType
        x = F.col(f"`{c}`")
        if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
            x = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
        adds.append((F.sum(x) if isinstance(kind, T.NumericType) else F.lit(None)).cast(kind).alias(f"_sum_{c}"))
    merged = df.groupBy(*[F.col(f"`{k}`") for k in engine.key]).agg(F.max_by(whole, place).alias("_row"), *adds)
    return merged.select(*[F.coalesce(F.col(f"`_sum_{c}`"), F.col(f"_row.`{c}`")).alias(c) if c in engine.sum else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def collapsing(df: DataFrame, engine: Engine) -> DataFrame:
    """Cancel rows of positive sign against later reverts of negative sign, oldest first, by key.

    A sign of k stands for k rows. A revert that finds fewer live rows than it
    cancels stays, once. With S the running sum of signs and M its running
    minimum (0 at most), reverts lower M where they find nothing, and the units
    that reverts do cancel are the oldest ones.
    """
    s = F.floor(F.abs(as_number(df, engine.sign)) + 0.5).cast("long") * F.signum(as_number(df, engine.sign)).cast("long")
    w = Window.partitionBy(*[F.col(f"`{k}`") for k in engine.key]).orderBy(_version(df, engine), F.col(SEQ)).rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy(*[F.col(f"`{k}`") for k in engine.key])
    rows = df.withColumn("_s", s).where("_s <> 0")
    rows = rows.withColumn("_run", F.sum("_s").over(w)).withColumn("_low", F.least(F.lit(0), F.min("_run").over(w)))
    rows = rows.withColumn("_before", F.least(F.lit(0), F.min(F.col("_run") - F.col("_s")).over(w)))
    rows = rows.withColumn("_adds", F.sum(F.greatest(F.col("_s"), F.lit(0))).over(w))
    rows = rows.withColumn("_cancelled", F.sum(F.greatest(-F.col("_s"), F.lit(0))).over(over) + F.min("_low").over(over))
    live = F.greatest(F.lit(0), F.least(F.col("_s"), F.col("_adds") - F.col("_cancelled")))
    copies = F.when(F.col("_s") > 0, live).otherwise(F.when(F.col("_low") < F.col("_before"), 1).otherwise(0)).cast("int")
    rows = rows.withColumn("_copies", copies).where("_copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[F.col(f"`{c}`") for c in df.columns])


ENGINES: dict[str, Callable[[DataFrame, Engine], DataFrame]] = {"log": log, "upsert": upsert, "summing": summing, "collapsing": collapsing}


def register(kind: str, merge: Callable[[DataFrame, Engine], DataFrame]) -> None:
    """Add an engine of one's own."""
    ENGINES[kind] = merge


def final_view(df: DataFrame, engine: Engine) -> DataFrame:
    """The table as it is once everything is merged."""
    require(engine.kind in ENGINES, "DEF_KIND", f"one of {', '.join(ENGINES)}", kind=engine.kind)
    return ENGINES[engine.kind](df, engine)


def cluster_keys(cluster: Sequence[str]) -> list[Column]:
    """Dimensions ascending, nulls last, then time (a missing one counts as 0)."""
    return [F.col(f"`{c}`").asc_nulls_last() for c in cluster] + [F.coalesce(F.col(TS), F.lit(0)).asc()]


def cluster_sort(df: DataFrame, cluster: Sequence[str]) -> DataFrame:
    """All rows in the order of the cluster key."""
    return df.orderBy(*cluster_keys(cluster), *([F.col(SEQ)] if SEQ in df.columns else []))


def cluster_layout(df: DataFrame, cluster: Sequence[str], parts: int) -> DataFrame:
    """Dealt into ranges of the cluster key, sorted within, for writing: a filter on a dimension then meets few files."""
    keys = cluster_keys(cluster)
    return df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys, *([F.col(SEQ)] if SEQ in df.columns else []))
