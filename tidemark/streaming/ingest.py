"""Feeding tables from streams, and rolling up while rows come in."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import TS
from ..operators.aggregates import aggregate
from ..sources.table import Table


def stream_into(table: Table, rows: DataFrame, checkpoint: str, name: str, trigger: Mapping[str, object] | None = None) -> StreamingQuery:
    """Append every micro-batch of a stream to a table, each once.

    The table's manifest holds the last batch of ``name``, so a batch that Spark
    runs again after a failure adds nothing. The table's own maintenance (rollup,
    lifetimes) runs as after any append.
    """

    def batch(df: DataFrame, number: int) -> None:
        table.append(df, batch=(name, number))

    return rows.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(**(trigger or {"availableNow": True})).start()


def rolling(rows: DataFrame, res_ms: int, late_ms: int, dims: Sequence[str], agg: Mapping[str, Sequence[str]]) -> DataFrame:
    """A stream of rows to a stream of finished buckets (append mode): ts, dimensions, ``<field>_<fn>``.

    A bucket is given out once no row that is at most ``late_ms`` behind the
    newest can fall into it; later rows are dropped by the watermark. Functions
    by time (last, first) need the stored table's rollup instead.
    """
    timed = rows.where(F.col(TS).isNotNull()).withColumn("_at", F.timestamp_millis(F.col(TS))).withWatermark("_at", f"{late_ms} milliseconds")
    grouped = timed.groupBy(F.window("_at", f"{res_ms} milliseconds").alias("_window"), *dims)
    columns = [aggregate(timed, f, fn).alias(f"{f}_{fn}") for f, fns in agg.items() for fn in fns]
    return grouped.agg(*columns).select(F.unix_millis("_window.start").alias(TS), *dims, *[f"{f}_{fn}" for f, fns in agg.items() for fn in fns])
