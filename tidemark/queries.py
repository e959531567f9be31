"""The registered queries over the ``events``, ``orders`` and ``lineitem`` tables, each with the same in DuckDB's SQL.

``events`` plays a log table: ts in milliseconds, dimensions user_id and
event_type, the metric value, and event_id as the write order. All queries use a
fixed clock.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.retention import parse_retention
from .operators import SEQ, engines, series, tiers
from .operators.engines import Engine
from .operators.predicates import matching
from .operators.scan import Scan, in_range, scan

NOW = 1706659200000  # 2024-01-31T00:00Z
HOUR, DAY = 3_600_000, 86_400_000
FROM, TO = NOW - 20 * DAY, NOW - 5 * DAY

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _stamp(ms: int) -> str:
    return datetime.fromtimestamp(ms / 1000, UTC).strftime("%Y-%m-%d %H:%M:%S.%f")


def events(spark: SparkSession, sf_dir: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """``events`` as a log table. Bounds (inclusive) are also put on the stored timestamp, where the scan can use them."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    if start is not None:
        df = df.where(F.expr(f"ts >= TIMESTAMP_NTZ'{_stamp(start)}'"))
    if end is not None:
        df = df.where(F.expr(f"ts < TIMESTAMP_NTZ'{_stamp(end + 1)}'"))
    df = df.select(F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias(SEQ), "user_id", "event_type", "value", "props")
    return in_range(df, start, end)


_E = "WITH e AS (SELECT CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts, event_id AS _seq, user_id, event_type, value, props FROM events)"


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of doubles depend on the order of adding: compared to six decimals."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


# Scans

_add("scan_range", lambda s, d: scan(events(s, d, FROM, TO), Scan(start=FROM, end=TO)), f"{_E} SELECT ts, user_id, event_type, value, props FROM e WHERE ts BETWEEN {FROM} AND {TO}")
_add("scan_project_filter", lambda s, d: scan(events(s, d, FROM), Scan(start=FROM, where=[("value", "gt", 50), ("event_type", "in", ["click", "purchase"])], select=["ts", "value", "missing"])), f"{_E} SELECT ts, value, CAST(NULL AS VARCHAR) AS missing FROM e WHERE ts >= {FROM} AND value > 50 AND event_type IN ('click', 'purchase')")
_add("scan_topk", lambda s, d: scan(events(s, d), Scan(where=[("value", "gt", 10)], select=["value", "user_id", "event_type"], order="desc", limit=20)), f"{_E} SELECT value, user_id, event_type FROM e WHERE value > 10 ORDER BY value DESC NULLS LAST, _seq LIMIT 20")
_add("scan_offset", lambda s, d: scan(events(s, d, FROM), Scan(start=FROM, select=["ts", "user_id"], limit=30, offset=15)), f"{_E} SELECT ts, user_id FROM e WHERE ts >= {FROM} ORDER BY ts, _seq LIMIT 30 OFFSET 15")


# Predicates, over a column with nulls

_WHERE = {
    "eq": ("event_type", "eq", "click", "k IS NOT DISTINCT FROM 'click'"),
    "ne": ("event_type", "ne", "click", "k IS DISTINCT FROM 'click'"),
    "lt": ("value", "lt", 20, "value < 20"),
    "le": ("value", "le", 20.5, "value <= 20.5"),
    "gt": ("value", "gt", 120, "value > 120"),
    "ge": ("value", "ge", 120.25, "value >= 120.25"),
    "in": ("event_type", "in", ["click", None], "(coalesce(k IN ('click'), false) OR k IS NULL)"),
    "nin": ("event_type", "nin", ["click", "purchase"], "NOT coalesce(k IN ('click', 'purchase'), false)"),
    "isnull": ("event_type", "isNull", None, "k IS NULL"),
    "isnotnull": ("event_type", "isNotNull", None, "k IS NOT NULL"),
    "startswith": ("event_type", "startsWith", "p", "coalesce(starts_with(k, 'p'), false)"),
}


def _where(field: str, op: str, value) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        df = events(s, d).withColumn("event_type", F.nullif(F.col("event_type"), F.lit("view")))
        return matching(df, [(field, op, value)]).select("ts", "user_id", "event_type", "value")

    return run


for _name, (_field, _op, _value, _sql) in _WHERE.items():
    _add(f"where_{_name}", _where(_field, _op, _value), f"{_E}, n AS (SELECT *, nullif(event_type, 'view') AS k FROM e) SELECT ts, user_id, k AS event_type, value FROM n WHERE {_sql}")


# Aggregates

_ALL = ["min", "max", "sum", "avg", "count"]
_ALL_SQL = "min(value) AS value_min, max(value) AS value_max, round(sum(value), 6) AS value_sum, round(avg(value), 6) AS value_avg, count(value) AS value_count"
_add("agg_global", lambda s, d: rounded(scan(events(s, d), Scan(agg={"value": _ALL})), "value_sum", "value_avg"), f"{_E} SELECT {_ALL_SQL} FROM e")
_add("agg_empty_range", lambda s, d: rounded(scan(events(s, d, 0, 1000), Scan(start=0, end=1000, agg={"value": _ALL})), "value_sum", "value_avg"), f"{_E} SELECT {_ALL_SQL} FROM e WHERE ts BETWEEN 0 AND 1000")
_add("agg_groupby_one", lambda s, d: rounded(scan(events(s, d), Scan(group_by=["event_type"], agg={"value": _ALL})), "value_sum", "value_avg"), f"{_E} SELECT event_type, {_ALL_SQL} FROM e GROUP BY event_type")
_add("agg_groupby_multi", lambda s, d: rounded(scan(events(s, d), Scan(group_by=["event_type", "user_id"], agg={"value": ["sum", "count"], "ts": ["count"]}, order="desc")), "value_sum"), f"{_E} SELECT event_type, user_id, round(sum(value), 6) AS value_sum, count(value) AS value_count, count(ts) AS ts_count FROM e GROUP BY event_type, user_id")
_add("agg_topk", lambda s, d: scan(events(s, d), Scan(where=[("value", "gt", 5)], group_by=["user_id"], agg={"value": ["max", "count"]}, limit=4)), f"{_E} SELECT user_id, max(value) AS value_max, count(value) AS value_count FROM e WHERE value > 5 GROUP BY user_id ORDER BY value_max DESC NULLS LAST, min(_seq) LIMIT 4")
_add(
    "agg_last_first",
    lambda s, d: series.aggregate_range(events(s, d, FROM, TO), FROM, TO, [("value", "last"), ("value", "first"), ("value", "count")], [("event_type", "ne", "view")], NOW),
    f"{_E} SELECT arg_max(value, (ts, _seq)) AS value_last, arg_min(value, (ts, _seq)) AS value_first, count(value) AS value_count FROM e WHERE ts BETWEEN {FROM} AND {TO} AND event_type <> 'view'",
)
_add(
    "percentile_exact",
    lambda s, d: rounded(series.percentile(events(s, d, FROM, TO), FROM, TO, [0.5, 0.9, 0.99, 0.999]).withColumnRenamed("p99.9", "p999"), "p50", "p90", "p99", "p999"),
    f"{_E} SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_cont(value, 0.999), 6) AS p999 FROM e WHERE ts BETWEEN {FROM} AND {TO}",
)


# Time series


def _timeline_sql(step: int, start: int, end: int, whole: bool = False, source: str = "e") -> str:
    n = (end - start) // step if whole else -(-(end - start) // step)
    return f"""
, g AS (SELECT unnest(range({n})) AS i), k AS (SELECT (ts - {start}) // {step} AS i, count(*) AS n FROM {source} WHERE ts >= {start} AND ts < {end} GROUP BY 1)
SELECT {start} + g.i * {step} AS start, least({start} + (g.i + 1) * {step}, {end}) AS "end", coalesce(n, 0) AS count, coalesce(n, 0) > 0 AS "hasData" FROM g LEFT JOIN k ON g.i = k.i"""


_add("timeline_hour", lambda s, d: series.timeline(events(s, d, NOW - 7 * DAY, NOW), "1h", "now-7d", "now", NOW), _E + _timeline_sql(HOUR, NOW - 7 * DAY, NOW))
_add("timeline_partial_last", lambda s, d: series.timeline(events(s, d, FROM, TO), 7 * HOUR, FROM, TO, NOW), _E + _timeline_sql(7 * HOUR, FROM, TO))
_add(
    "downsample_hour_clamped",
    lambda s, d: rounded(series.downsample(events(s, d, FROM + 1234567, TO), FROM + 1234567, TO, "6h", "value", _ALL), "sum", "avg"),
    f"""{_E}, g AS (SELECT unnest(range({FROM + 1234567} // {6 * HOUR}, -(-{TO} // {6 * HOUR}))) AS i),
c AS (SELECT ts // {6 * HOUR} AS i, count(value) AS n, min(value) AS lo, max(value) AS hi, sum(value) AS s, avg(value) AS a FROM e WHERE ts >= {FROM + 1234567} AND ts < {TO} GROUP BY 1)
SELECT greatest(g.i * {6 * HOUR}, {FROM + 1234567}) AS start, least((g.i + 1) * {6 * HOUR}, {TO}) AS "end", coalesce(n, 0) AS count, coalesce(n, 0) > 0 AS "hasData", lo AS min, hi AS max, round(s, 6) AS sum, round(a, 6) AS avg FROM g LEFT JOIN c ON g.i = c.i""",
)
_add("tail_n", lambda s, d: series.tail(events(s, d), 25), f"{_E} SELECT ts, user_id, event_type, value, props FROM e ORDER BY _seq DESC LIMIT 25")
_add("page_desc", lambda s, d: series.page(events(s, d), 20, 40, "desc"), f"{_E} SELECT ts, user_id, event_type, value, props FROM e ORDER BY _seq DESC LIMIT 20 OFFSET 40")
_add("lookup_latest", lambda s, d: series.lookup(events(s, d), "event_type", "purchase"), f"{_E} SELECT ts, user_id, event_type, value, props FROM e WHERE event_type = 'purchase' ORDER BY ts DESC, _seq LIMIT 1")
_add("time_range", lambda s, d: series.time_range(events(s, d)), f"{_E} SELECT min(ts) AS min_ts, max(ts) AS max_ts FROM e")
_add("marks", lambda s, d: series.marks(events(s, d)), f"{_E} SELECT ts FROM e")
_add("all_rows", lambda s, d: series.all_rows(events(s, d)), f"{_E} SELECT ts, user_id, event_type, value, props FROM e")


# Merge engines

_add("engine_log", lambda s, d: engines.final_view(events(s, d), Engine()).select("ts", "user_id", "value"), f"{_E} SELECT ts, user_id, value FROM e")
_add(
    "engine_upsert",
    lambda s, d: engines.final_view(events(s, d), Engine("upsert", ("user_id", "event_type"), "ts")).drop(SEQ),
    f"{_E} SELECT ts, user_id, event_type, value, props FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, _seq DESC) = 1",
)
_add(
    "engine_summing",
    lambda s, d: rounded(engines.final_view(events(s, d), Engine("summing", ("user_id",), "ts", ("value",))).drop(SEQ, "props"), "value"),
    f"{_E} SELECT max(ts) AS ts, user_id, arg_max(event_type, (ts, -_seq)) AS event_type, round(sum(value), 6) AS value FROM e GROUP BY user_id",
)
_SIGN = {"purchase": -1, "click": 1, "view": 2, "scroll": -2}


def _signed(s: SparkSession, d: str) -> DataFrame:
    sign = F.lit(0)
    for name, v in _SIGN.items():
        sign = F.when(F.col("event_type") == name, v).otherwise(sign)
    return events(s, d).withColumn("sign", sign).drop("props")


_add(
    "engine_collapsing",
    lambda s, d: engines.final_view(_signed(s, d), Engine("collapsing", ("user_id",), "ts", (), "sign")).drop(SEQ),
    f"""{_E}, x AS (SELECT *, CASE event_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _SIGN.items())} ELSE 0 END AS sign FROM e),
r AS (SELECT *, sum(sign) OVER w AS run, sum(greatest(sign, 0)) OVER w AS adds, sum(greatest(-sign, 0)) OVER (PARTITION BY user_id) AS reverts FROM x WHERE sign <> 0 WINDOW w AS (PARTITION BY user_id ORDER BY ts, _seq ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, least(0, min(run) OVER (PARTITION BY user_id ORDER BY ts, _seq ROWS UNBOUNDED PRECEDING)) AS low FROM r),
l AS (SELECT *, coalesce(lag(low) OVER (PARTITION BY user_id ORDER BY ts, _seq), 0) AS bef, reverts + min(low) OVER (PARTITION BY user_id) AS gone FROM m),
c AS (SELECT *, CASE WHEN sign > 0 THEN greatest(0, least(sign, adds - gone)) WHEN low < bef THEN 1 ELSE 0 END AS n FROM l)
SELECT ts, user_id, event_type, value, sign FROM (SELECT *, unnest(range(CAST(n AS BIGINT))) FROM c WHERE n > 0)""",
)
_add(
    "engine_upsert_orders",
    lambda s, d: engines.final_view(
        s.read.parquet(f"{d}/orders.parquet").select(F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts"), F.col("o_orderkey").alias(SEQ), "o_custkey", "o_orderstatus", "o_totalprice"),
        Engine("upsert", ("o_custkey",), "ts"),
    ).select("o_custkey", "o_orderstatus", "o_totalprice"),
    "SELECT o_custkey, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
)


def _clustered(s: SparkSession, d: str) -> DataFrame:
    return engines.cluster_sort(events(s, d), ["event_type", "user_id"]).select("event_type", "user_id", "ts", "value")


_add("cluster_sorted", _clustered, f"{_E} SELECT event_type, user_id, ts, value FROM e ORDER BY event_type NULLS LAST, user_id NULLS LAST, ts, _seq")


# Rollup and tiers

_MULTI = {"value": ["min", "max", "sum", "count", "last", "first"]}
_MULTI_SQL = "min(value) AS value_min, max(value) AS value_max, round(sum(value), 6) AS value_sum, count(value) AS value_count, arg_max(value, (ts, _seq)) AS value_last, max(ts) AS value_last_ts, arg_min(value, (ts, _seq)) AS value_first, min(ts) AS value_first_ts"
_add(
    "rollup_single_fn",
    lambda s, d: rounded(tiers.promote(events(s, d), HOUR, ["event_type"], {"value": "avg"}).select("ts", "event_type", "value", "value_count"), "value"),
    f"{_E} SELECT ts - ts % {HOUR} AS ts, event_type, round(avg(value), 6) AS value, count(value) AS value_count FROM e GROUP BY ALL",
)
_add("rollup_multi", lambda s, d: rounded(tiers.promote(events(s, d), HOUR, ["event_type"], _MULTI).drop(SEQ), "value_sum"), f"{_E} SELECT ts - ts % {HOUR} AS ts, event_type, {_MULTI_SQL} FROM e GROUP BY ts - ts % {HOUR}, event_type")
_add(
    "rollup_two_hop",
    lambda s, d: rounded(tiers.promote(tiers.promote(events(s, d), HOUR, ["event_type"], _MULTI), DAY, ["event_type"], _MULTI).drop(SEQ), "value_sum"),
    f"{_E} SELECT ts - ts % {DAY} AS ts, event_type, {_MULTI_SQL} FROM e GROUP BY ts - ts % {DAY}, event_type",
)

SPEC = parse_retention("1h:1w, 1d:60d")
CUT = tiers.roll_cut(NOW, *SPEC)


def _frames(s: SparkSession, d: str, agg=None, dims=("event_type",)) -> list[DataFrame]:
    """``events`` after a rollup: what the fine tier still holds, and the coarse tier."""
    agg = agg or _MULTI
    return [events(s, d, CUT), tiers.promote(events(s, d, None, CUT - 1), SPEC[1].res_ms, list(dims), agg)]


_COARSE = f"c AS (SELECT ts - ts % {DAY} AS ts, event_type, {_MULTI_SQL}, round(avg(value), 6) AS a FROM e WHERE ts < {CUT} GROUP BY ts - ts % {DAY}, event_type)"
_FINE_WHERE, _COARSE_WHERE = f"ts >= {CUT} AND ts <= {NOW}", f"ts <= {NOW - 7 * DAY} AND ts >= {NOW - 60 * DAY}"
_add(
    "tier_query",
    lambda s, d: rounded(tiers.tier_scan(_frames(s, d), SPEC, NOW, Scan(select=["ts", "event_type", "value", "value_sum"])), "value_sum"),
    f"{_E}, {_COARSE} SELECT ts, event_type, value, CAST(NULL AS DOUBLE) AS value_sum FROM e WHERE {_FINE_WHERE} UNION ALL SELECT ts, event_type, NULL, value_sum FROM c WHERE {_COARSE_WHERE}",
)
_add(
    "tier_scan_topk",
    lambda s, d: tiers.tier_scan(_frames(s, d, dims=[]), SPEC, NOW, Scan(where=[("event_type", "isNull")], select=["ts", "value_count"], order="desc", limit=5)),
    f"{_E}, c AS (SELECT ts - ts % {DAY} AS ts, count(value) AS value_count FROM e WHERE ts < {CUT} GROUP BY 1) SELECT ts, value_count FROM c WHERE {_COARSE_WHERE} ORDER BY ts DESC LIMIT 5",
)
_PARTS_SQL = f"p AS (SELECT event_type, ts, _seq, value, 1 AS n FROM e WHERE {_FINE_WHERE} UNION ALL SELECT event_type, ts, _seq, value, 1 FROM e WHERE ts < {CUT} AND ts - ts % {DAY} >= {NOW - 60 * DAY})"
_add(
    "tier_aggregate_multi",
    lambda s, d: rounded(tiers.tier_aggregate(_frames(s, d), SPEC, NOW, 0, NOW, [("value", x) for x in ("min", "max", "sum", "avg", "count", "last", "first")]), "value_sum", "value_avg"),
    f"{_E}, {_PARTS_SQL} SELECT {_ALL_SQL}, arg_max(value, (ts, _seq)) AS value_last, arg_min(value, (ts, _seq)) AS value_first FROM p",
)
_add(
    "tier_aggregate_grouped",
    lambda s, d: rounded(tiers.tier_aggregate(_frames(s, d), SPEC, NOW, 0, NOW, [("value", "sum"), ("value", "count")], group_by=["event_type"]), "value_sum"),
    f"{_E}, {_PARTS_SQL} SELECT event_type, round(sum(value), 6) AS value_sum, count(value) AS value_count FROM p GROUP BY event_type",
)
_add(
    "tier_aggregate_single_fn",
    lambda s, d: rounded(tiers.tier_aggregate(_frames(s, d, {"value": "max"}), SPEC, NOW, 0, NOW, [("value", "max"), ("value", "count"), ("value", "sum")], weighted=False), "value_sum"),
    f"{_E}, p AS (SELECT value FROM e WHERE {_FINE_WHERE} UNION ALL SELECT max(value) FROM e WHERE ts < {CUT} GROUP BY ts - ts % {DAY}, event_type HAVING ts - ts % {DAY} >= {NOW - 60 * DAY}) SELECT max(value) AS value_max, count(value) AS value_count, round(sum(value), 6) AS value_sum FROM p",
)
_add(
    "timeline_tiered",
    lambda s, d: series.timeline(tiers.union(tiers.read(_frames(s, d), SPEC, NOW, NOW - 25 * DAY, NOW), events(s, d)), "2d", NOW - 25 * DAY, NOW, whole_only=True),
    f"{_E}, {_COARSE}, u AS (SELECT ts FROM e WHERE {_FINE_WHERE} UNION ALL SELECT ts FROM c WHERE {_COARSE_WHERE})" + _timeline_sql(2 * DAY, NOW - 25 * DAY, NOW, True, "u"),
)


# Stored tables


def _stored(s: SparkSession, d: str, **knobs):
    """``events`` written to a table of its own in two appends, for the length of the session."""
    from . import Store, define_log
    from .sources.scratch import scratch

    store = Store(s, scratch(s), lambda: NOW)
    knobs = {"auto_rollup": False, "auto_purge": False} | knobs
    columns = {"ts": "delta", "user_id": "raw bigint", "event_type": "dictionary", "value": "auto double", "props": "raw"}
    t = store.create(define_log(f"events_{uuid.uuid4().hex}", columns, **knobs))
    t.append(events(s, d, None, FROM))
    t.append(events(s, d, FROM + 1))
    return t


def _changed(change: Callable, **knobs) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        t = _stored(s, d, **knobs)
        change(t)
        return t.tier().select("ts", "user_id", "event_type", "value")

    return run


_ROWS = "SELECT ts, user_id, event_type, value FROM e"
_add("purge_before", _changed(lambda t: t.purge(TO)), f"{_E} {_ROWS} WHERE ts >= {TO}")
_add("delete_by", _changed(lambda t: t.delete_by([("event_type", "eq", "view"), ("value", "lt", 40)])), f"{_E} {_ROWS} WHERE NOT coalesce(event_type = 'view' AND value < 40, false)")
_add("delete_all", _changed(lambda t: t.delete_by([])), f"{_E} {_ROWS} WHERE false")
_add("ttl_single_tier", _changed(lambda t: t.append([{"ts": NOW, "event_type": "beat"}]) and t.delete_by([("event_type", "eq", "beat")]), retention="1h:10d", auto_purge=True, maintenance_interval_ms=0), f"{_E} {_ROWS} WHERE ts >= {NOW - 10 * DAY}")
_add("compact_clustered", _changed(lambda t: t.compact(), cluster=["event_type", "user_id"]), f"{_E} {_ROWS}")
_add(
    "rollup_stored",
    lambda s, d: _rolled(s, d).select("ts", "event_type", "value_max", "value_count"),
    f"{_E} SELECT ts - ts % {DAY} AS ts, event_type, max(value) AS value_max, count(value) AS value_count FROM e WHERE ts < {CUT} GROUP BY ts - ts % {DAY}, event_type",
)


def _rolled(s: SparkSession, d: str) -> DataFrame:
    t = _stored(s, d, retention="1h:1w, 1d:60d", agg={"value": ["max"]}, dims=["event_type"])
    t.rollup()
    return t.tier(1)


_add("cluster_compacted", _changed(lambda t: t.cluster_compact(FROM - DAY, NOW), cluster=["event_type"]), f"{_E} {_ROWS}")


def _rolled_one(s: SparkSession, d: str) -> DataFrame:
    """A rollup by functions of its own beside those that are declared."""
    t = _stored(s, d, retention="1h:1w, 1d:60d", agg={"value": ["avg"]}, dims=["event_type"])
    t.rollup_one("1d", agg={"value": ["max", "last"]})
    return rounded(t.tier(1).select("ts", "event_type", "value_sum", "value_count", "value_max", "value_last"), "value_sum")


_add(
    "rollup_one_custom",
    _rolled_one,
    f"{_E} SELECT ts - ts % {DAY} AS ts, event_type, round(sum(value), 6) AS value_sum, count(value) AS value_count, max(value) AS value_max, arg_max(value, (ts, _seq)) AS value_last FROM e WHERE ts < {CUT} GROUP BY ts - ts % {DAY}, event_type",
)


def _tiered(read: Callable) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        t = _stored(s, d, retention="1h:1w, 1d:60d", agg=_MULTI, dims=["event_type"])
        t.rollup()
        return read(t)

    return run


_add(
    "tier_stored_aggregate",
    _tiered(lambda t: rounded(t.aggregate(0, NOW, [("value", x) for x in ("min", "max", "sum", "avg", "count", "last", "first")]), "value_sum", "value_avg")),
    SQL["tier_aggregate_multi"],
)
_add("tier_stored_tail", _tiered(lambda t: t.tail(15).select("ts", "event_type", "value")), f"{_E} SELECT ts, event_type, value FROM (SELECT * FROM e WHERE {_FINE_WHERE} ORDER BY ts DESC, _seq LIMIT 15)")
_add("tier_stored_percentile", _tiered(lambda t: t.percentile(0, NOW, [0.5, 0.9])), f"{_E} SELECT quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90 FROM e WHERE {_FINE_WHERE}")

# Totals of a stored table: the first append lies whole in the range and isn't read, of the second a part is.
_TOTALS = [("value", x) for x in ("sum", "count", "min", "max", "avg")] + [("user_id", "max"), ("user_id", "sum")]
_TOTALS_SQL = "round(sum(value), 6) AS value_sum, count(value) AS value_count, min(value) AS value_min, max(value) AS value_max, round(avg(value), 6) AS value_avg, max(user_id) AS user_id_max, CAST(sum(user_id) AS BIGINT) AS user_id_sum"
_add("stored_aggregate_partly_known", lambda s, d: rounded(_stored(s, d).aggregate(0, TO, _TOTALS), "value_sum", "value_avg"), f"{_E} SELECT {_TOTALS_SQL} FROM e WHERE ts <= {TO}")
_add("stored_aggregate_known", lambda s, d: rounded(_stored(s, d).aggregate(0, 2 * NOW, _TOTALS), "value_sum", "value_avg"), f"{_E} SELECT {_TOTALS_SQL} FROM e")


def _stats(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(x["tier"], x["generations"], x["rows"], x["min_ts"], x["max_ts"]) for x in _stored(s, d).stats()], "tier long, generations long, n_rows long, min_ts long, max_ts long")


_add("stored_stats", _stats, f"{_E} SELECT 0::BIGINT AS tier, 2::BIGINT AS generations, count(*) AS n_rows, min(ts) AS min_ts, max(ts) AS max_ts FROM e")


def _taken_in(s: SparkSession, d: str) -> DataFrame:
    """A folder of plain Parquet files opened as a table."""
    from . import Store
    from .sources.scratch import scratch

    store, name = Store(s, scratch(s), lambda: NOW), f"found_{uuid.uuid4().hex}"
    events(s, d).drop(SEQ).write.parquet(f"{store.folder.root}/{name}")
    return store.open(name).all_rows().select("ts", "user_id", "event_type", "value")


_add("open_plain_parquet", _taken_in, f"{_E} {_ROWS}")


def _merged_once(define: Callable, rows: Callable) -> Query:
    """A table filled by one append and then compacted."""

    def run(s: SparkSession, d: str) -> DataFrame:
        from . import Store
        from .sources.scratch import scratch

        df = rows(s, d)
        t = Store(s, scratch(s), lambda: NOW).create(define(f"merged_{uuid.uuid4().hex}", {"ts": "delta"} | {c: f"raw {k}" for c, k in df.dtypes if c not in ("ts", SEQ)}))
        t.append(df)
        t.compact()
        return t.tier().drop(SEQ)

    return run


def _definer(kind: str, *args) -> Callable:
    def define(name: str, columns: dict, **knobs):
        from .sources import definitions

        return getattr(definitions, f"define_{kind}")(name, columns, *args, **knobs)

    return define


_add("compact_upsert", _merged_once(_definer("upsert", ["user_id", "event_type"], "ts"), events), SQL["engine_upsert"])
_add("compact_summing", lambda s, d: rounded(_merged_once(_definer("summing", ["user_id"], ["value"], "ts"), events)(s, d).drop("props"), "value"), SQL["engine_summing"])
_add("compact_collapsing", _merged_once(_definer("collapsing", ["user_id"], "sign", "ts"), _signed), SQL["engine_collapsing"])


def _storage(s: SparkSession, d: str) -> DataFrame:
    t = _stored(s, d, storage=True)
    t.storage_apply()
    return s.createDataFrame([(x["id"], x["rows"]) for x in t.storage_status()], "id string, n_rows long")


_add(
    "storage_tier_status",
    _storage,
    f"""{_E}, g AS (SELECT ts <= {FROM} AS first, max(ts) AS m, count(*) AS n FROM e GROUP BY 1),
k AS (SELECT unnest(['hot', 'warm', 'cold', 'archive']) AS id, unnest([0, 7, 30, 365]::BIGINT[]) AS a, unnest([7, 30, 365, 1000000]::BIGINT[]) AS b)
SELECT id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows FROM k LEFT JOIN g ON ({NOW} - m) >= a * {DAY} AND ({NOW} - m) < b * {DAY} GROUP BY id""",
)


# What a table says of itself


def _store(s: SparkSession):
    from . import Store
    from .sources.scratch import scratch

    return Store(s, scratch(s), lambda: NOW)


def _described(s: SparkSession, d: str) -> DataFrame:
    t = _stored(s, d, desc="clicks")
    found = next(x for x in _store(s).describe() if x["name"] == t.name)
    return s.createDataFrame([(found["engine"], found["desc"], len(found["columns"]), found["rows"], found["tiers"])], "engine string, description string, n_columns long, n_rows long, tiers long")


_add("store_describe", _described, f"{_E} SELECT 'log' AS engine, 'clicks' AS description, 5::BIGINT AS n_columns, count(*) AS n_rows, 1::BIGINT AS tiers FROM e")
_add("generation_rows", lambda s, d: (lambda t: t.generation(t.generations()[1].path).select("ts", "user_id", "event_type", "value"))(_stored(s, d)), f"{_E} {_ROWS} WHERE ts > {FROM}")
_add("distinct_values", lambda s, d: s.createDataFrame([(x,) for x in _stored(s, d).distinct("event_type")], "event_type string"), f"{_E} SELECT DISTINCT event_type FROM e")


def _logical(s: SparkSession, d: str) -> DataFrame:
    df, out = events(s, d), []
    t = _store(s).create(_definer("upsert", ["user_id"], "ts")(f"logical_{uuid.uuid4().hex}", {"ts": "delta", "user_id": "raw bigint", "value": "auto double"}))
    t.append(df.select("ts", "user_id", "value"))
    for _ in range(2):
        out.append((t.stats()[0]["rows"], t.logical_rows()))
        t.compact()
    return s.createDataFrame(out, "stored long, logical long")


_add("logical_row_counts", _logical, f"{_E} SELECT count(*) AS stored, count(DISTINCT coalesce(user_id, -1)) AS logical FROM e UNION ALL SELECT count(DISTINCT coalesce(user_id, -1)), count(DISTINCT coalesce(user_id, -1)) FROM e")


def _rolled_over(s: SparkSession, d: str) -> DataFrame:
    t = _store(s).create(_definer("log")(f"rolled_{uuid.uuid4().hex}", {"ts": "delta", "value": "auto double"}, rows_per_file=250))
    t.append(events(s, d).select("ts", "value").coalesce(1))
    return s.createDataFrame([(len(t.tier().inputFiles()),)], "files long")


_add("files_roll_over", _rolled_over, f"{_E} SELECT CAST(ceil(count(*) / 250.0) AS BIGINT) AS files FROM e")


def _small_appends(s: SparkSession, d: str) -> DataFrame:
    """Ten appends of a table that merges four generations of like size."""
    t = _store(s).create(_definer("log")(f"small_{uuid.uuid4().hex}", {"ts": "delta", "user_id": "raw bigint", "event_type": "dictionary", "value": "auto double"}, compact_fanout=4))
    for k in range(10):
        t.append(events(s, d).where(F.col(SEQ) % 10 == k).coalesce(1))
    return t.tier().select("ts", "user_id", "event_type", "value", F.lit(len(t.generations()) < 7).alias("few"))


_add("small_appends_merged", _small_appends, f"{_E} SELECT ts, user_id, event_type, value, true AS few FROM e")


def _reports(s: SparkSession, d: str) -> DataFrame:
    out = []
    for name, change in (("purge", lambda t: t.purge(TO)), ("delete_by", lambda t: t.delete_by([("event_type", "eq", "view")])), ("truncate", lambda t: t.truncate())):
        out.append((name, change(_stored(s, d))["removed_rows"]))
    return s.createDataFrame(out, "change string, removed long")


_add("delete_reports", _reports, f"{_E} SELECT 'purge' AS change, count(*) FILTER (WHERE ts < {TO}) AS removed FROM e UNION ALL SELECT 'delete_by', count(*) FILTER (WHERE event_type = 'view') FROM e UNION ALL SELECT 'truncate', count(*) FROM e")


def _clustered_later(s: SparkSession, d: str) -> DataFrame:
    t = _stored(s, d)
    t.set_cluster(["event_type"])
    t.compact()
    return t.tier().select("ts", "user_id", "event_type", "value")


_add("cluster_set_later", _clustered_later, f"{_E} {_ROWS}")


def _defaults(s: SparkSession, d: str) -> DataFrame:
    """What is aggregated and kept as a dimension where a definition doesn't say."""
    from .sources.definitions import define_collapsing, define_log, define_summing

    columns = {"ts": "delta", "a": "auto", "b": "auto", "k": "raw"}
    made = [define_log("x", columns), define_summing("x", columns, ["k"], ["b"]), define_collapsing("x", columns, ["k"], "a"), define_log("x", columns, agg={"b": "max"}, dims=["k"])]
    return s.createDataFrame([(i, ",".join(f"{f}={fn}" for f, fn in m.rolled().items()), ",".join(m.dimensions())) for i, m in enumerate(made)], "i int, rolled string, dims string")


_add("rollup_defaults", _defaults, "SELECT * FROM (VALUES (0, 'a=avg', 'b,k'), (1, 'b=sum', 'a,k'), (2, 'a=sum', 'b,k'), (3, 'b=max', 'k')) AS t(i, rolled, dims)")


def _tier_facts(s: SparkSession, d: str) -> DataFrame:
    t = _stored(s, d, retention="1h:1w, 1d:60d", agg={"value": ["max"]}, dims=["event_type"])
    t.rollup()
    return s.createDataFrame([(x["tier"], x["rows"], t.tier_name(x["tier"]).rpartition("/")[2], len(t.rollup_columns("value"))) for x in t.stats()], "tier long, n_rows long, name string, parts long")


_add("tier_stats", _tier_facts, f"{_E} SELECT 0::BIGINT AS tier, count(*) AS n_rows, 'r{HOUR}' AS name, 3::BIGINT AS parts FROM e WHERE ts >= {CUT} UNION ALL SELECT 1, count(*), 'r{DAY}', 3 FROM (SELECT DISTINCT ts - ts % {DAY}, event_type FROM e WHERE ts < {CUT})")


def _storage_by_tier(s: SparkSession, d: str) -> DataFrame:
    """What one storage tier would rewrite, and what is left to do after it did."""
    t, out = _stored(s, d, storage=True), []
    before = [p["storage"] for p in t.storage_plan()]
    for name in dict.fromkeys(before):
        t.storage_compact_tier(name)
        out.append((name, before.count(name), sum(p["storage"] == name for p in t.storage_plan())))
    return s.createDataFrame(out, "id string, planned long, left_over long")


_add(
    "storage_plan_by_tier",
    _storage_by_tier,
    f"""{_E}, g AS (SELECT ts <= {FROM} AS first, max(ts) AS m FROM e GROUP BY 1),
k AS (SELECT unnest(['hot', 'warm', 'cold', 'archive']) AS id, unnest([0, 7, 30, 365]::BIGINT[]) AS a, unnest([7, 30, 365, 1000000]::BIGINT[]) AS b)
SELECT id, count(*) AS planned, 0::BIGINT AS left_over FROM k JOIN g ON greatest(0, {NOW} - m) >= a * {DAY} AND greatest(0, {NOW} - m) < b * {DAY} GROUP BY id""",
)


def _codes(s: SparkSession, d: str) -> DataFrame:
    """The codes of what a table refuses."""
    from . import TidemarkError, define_log
    from .sources import manifest

    store = _store(s)
    t = store.create(define_log(f"codes_{uuid.uuid4().hex}", {"ts": "delta", "value": "auto double"}, retention="1h:1w, 1d:60d", agg={"value": "max"}))
    late = t.manifest()
    t.update_metadata({"owner": "ops"})
    tries = {
        "late writer": lambda: manifest.save(t.folder, t.name, late),
        "row without a time": lambda: t.append([{"value": 1}]),
        "no such table": lambda: store.open("absent"),
        "no such tier": lambda: t.tier(7),
        "grouped scan of tiers": lambda: t.sql(f"SELECT value, max(value) FROM {t.name} GROUP BY value"),
        "unknown function": lambda: t.aggregate(0, 1, [("value", "median")]),
        "no cluster key": lambda: t.cluster_compact(),
        "not a resolution": lambda: t.rollup_one(7),
        "too many values": lambda: t.sql(f"INSERT INTO {t.name} VALUES (1, 2, 3)"),
        "an OR": lambda: t.sql("SELECT a FROM t WHERE a = 1 OR b = 2"),
        "closed": lambda: (t.close(), t.tail(1)),
    }
    out = []
    for name, attempt in tries.items():
        try:
            attempt()
            out.append((name, "none", None))
        except TidemarkError as e:
            out.append((name, e.code, getattr(e, "position", None)))
    return s.createDataFrame(out, "attempt string, code string, position int")


_add(
    "coded_errors",
    _codes,
    """SELECT * FROM (VALUES ('late writer', 'TBL_CONFLICT', NULL), ('row without a time', 'COL_DELTA_TYPE', NULL), ('no such table', 'STO_TABLE_NOT_FOUND', NULL), ('no such tier', 'TBL_JOURNAL_INDEX', NULL),
('grouped scan of tiers', 'TBL_SCAN_AGG', NULL), ('unknown function', 'TBL_AGG_EXPR_FN', NULL), ('no cluster key', 'JRN_NO_CLUSTER', NULL), ('not a resolution', 'TBL_ROLLUP_ONE_RES', NULL),
('too many values', 'SQL_ARITY', NULL), ('an OR', 'SQL_SYNTAX', 28), ('closed', 'TBL_NOT_OPEN', NULL)) AS t(attempt, code, position)""",
)


def _command_line(s: SparkSession, d: str) -> DataFrame:
    from .__main__ import run
    from .sources.scratch import scratch

    root = ["--root", f"{scratch(s)}/cli-{uuid.uuid4().hex}"]
    run(s, [*root, "create", "m", "--columns", "ts=delta,host=raw,value=auto", "--engine", "upsert", "--key", "host", "--version", "ts"])
    for row in ('{"ts": 5, "host": "a", "value": 1}', '{"ts": 6, "host": "a", "value": 2}', '{"ts": 7, "host": "b", "value": 3}'):
        run(s, [*root, "append", "m", row])
    run(s, [*root, "compact", "m"])
    return s.createDataFrame([(r["ts"], r["host"], r["value"], x["engine"]) for r in run(s, [*root, "query", "SELECT * FROM m"]) for x in run(s, [*root, "tables"])], "ts long, host string, value double, engine string")


_add("command_line", _command_line, "SELECT * FROM (VALUES (6000::BIGINT, 'a', 2::DOUBLE, 'upsert'), (7000, 'b', 3, 'upsert')) AS t(ts, host, value, engine)")


def _applied(s: SparkSession, d: str) -> DataFrame:
    """One aggregate of plain values, outside of Spark."""
    from .operators.aggregates import ALL, apply

    values = [3.0, None, 8.5, float("nan"), -2.0, True, "x", 8.5]
    return s.createDataFrame([(fn, float(apply(fn, values))) for fn in ALL], "fn string, v double")


_add("apply_aggregate", _applied, "SELECT * FROM (VALUES ('min', -2::DOUBLE), ('max', 8.5), ('sum', 18), ('avg', 4.5), ('count', 4), ('last', 8.5), ('first', 3)) AS t(fn, v)")


# The SQL dialect


def _sql(text: str, *round_columns: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        from .plans import sql

        spec = sql.lower(sql.parse(text), NOW)
        return rounded(scan(events(s, d, spec.start, spec.end), spec), *round_columns)

    return run


_add(
    "sql_select_groupby",
    _sql("SELECT event_type, avg(value), max(value) FROM events WHERE ts >= 'now-20d' AND value > 10 GROUP BY event_type LIMIT 5", "value_avg"),
    f"{_E} SELECT event_type, round(avg(value), 6) AS value_avg, max(value) AS value_max FROM e WHERE ts >= {FROM} AND value > 10 GROUP BY event_type ORDER BY avg(value) DESC LIMIT 5",
)
_add("sql_select_where", _sql("select ts, value from events where event_type not in ('view', 'click') and user_id is not null and value >= 30 order by ts desc limit 40"), f"{_E} SELECT ts, value FROM e WHERE event_type NOT IN ('view', 'click') AND value >= 30 ORDER BY ts DESC, _seq LIMIT 40")
_add("sql_select_order", _sql("SELECT value, user_id FROM events WHERE event_type = purchase ORDER BY value DESC LIMIT 12 OFFSET 3"), f"{_E} SELECT value, user_id FROM e WHERE event_type = 'purchase' ORDER BY value DESC, _seq LIMIT 12 OFFSET 3")
_add("sql_select_global", _sql("SELECT count(value), sum(value) AS total FROM events WHERE ts > 'now-20d' AND ts < 'now-5d'", "value_sum"), f"{_E} SELECT count(value) AS value_count, round(sum(value), 6) AS value_sum FROM e WHERE ts BETWEEN {FROM} AND {TO}")


_add("sql_plain_column_beside_aggregate", _sql("SELECT user_id, event_type, count(value) FROM events WHERE ts <= 'now-20d' GROUP BY event_type"), f"{_E} SELECT event_type, count(value) AS value_count FROM e WHERE ts <= {FROM} GROUP BY event_type")
_add("sql_group_without_aggregate", _sql("SELECT ts, value FROM events WHERE ts >= 'now-2d' GROUP BY event_type LIMIT 25"), f"{_E} SELECT ts, value FROM e WHERE ts >= {NOW - 2 * DAY} ORDER BY ts, _seq LIMIT 25")


def _true_and_false(s: SparkSession, d: str) -> DataFrame:
    t = _store(s).create(_definer("log")(f"marks_{uuid.uuid4().hex}", {"ts": "delta", "good": "raw boolean", "word": "raw"}))
    t.sql(f"INSERT INTO {t.name} VALUES (1, TRUE, plain), (2, false, \"quoted \"\"x\"\"\"), (3, NULL, 'it''s')")
    return t.sql(f"SELECT ts, good, word FROM {t.name} WHERE good = TRUE").unionByName(t.sql(f"SELECT ts, good, word FROM {t.name} WHERE good IS NULL")).unionByName(t.sql(f"SELECT ts, good, word FROM {t.name} WHERE good = FALSE"))


_add("sql_true_and_false", _true_and_false, """SELECT * FROM (VALUES (1::BIGINT, true, 'plain'), (2, false, 'quoted "x"'), (3, NULL, 'it''s')) AS t(ts, good, word)""")


def _inserted(s: SparkSession, d: str) -> DataFrame:
    t = _stored(s, d)
    t.sql("INSERT INTO events (ts, user_id, event_type, value) VALUES (1, 7, 'made', 1.5), (2, 8, 'made', -2), (3, NULL, 'it''s', 4e2)")
    return t.sql("SELECT ts, user_id, event_type, value FROM events WHERE ts <= 1000")


_add("sql_insert_then_select", _inserted, "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(7 AS BIGINT), 'made', CAST(1.5 AS DOUBLE)), (2, 8, 'made', -2), (3, NULL, 'it''s', 400)) AS t(ts, user_id, event_type, value)")


# Undeclared fields


def _catchall(s: SparkSession, d: str) -> DataFrame:
    from .sources.scratch import scratch
    from . import Store, define_log

    t = Store(s, scratch(s), lambda: NOW).create(define_log(f"flex_{uuid.uuid4().hex}", {"ts": "delta", "payload": "catchall"}))
    t.append(events(s, d).select("ts", SEQ, "user_id", "event_type"))
    return t.tier().groupBy(F.get_json_object("payload", "$.event_type").alias("event_type")).agg(F.count("*").alias("n"), F.max(F.get_json_object("payload", "$.user_id").cast("bigint")).alias("top_user"))


_add("catchall_json", _catchall, f"{_E} SELECT event_type, count(*) AS n, max(user_id) AS top_user FROM e GROUP BY event_type")


# Volume

_LINES = {"l_quantity": ["sum", "avg", "count"], "l_extendedprice": ["max"]}
_add(
    "scan_lineitem_groups",
    lambda s, d: rounded(scan(s.read.parquet(f"{d}/lineitem.parquet").withColumn("ts", F.unix_millis(F.col("l_shipdate").cast("timestamp"))), Scan(where=[("l_discount", "gt", 0.02)], group_by=["l_returnflag", "l_linestatus"], agg=_LINES)), "l_quantity_sum", "l_quantity_avg"),
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 6) AS l_quantity_sum, round(avg(l_quantity), 6) AS l_quantity_avg, count(l_quantity) AS l_quantity_count, max(l_extendedprice) AS l_extendedprice_max FROM lineitem WHERE l_discount > 0.02 GROUP BY ALL",
)
_add(
    "conversation_tail",
    lambda s, d: engines.final_view(s.read.parquet(f"{d}/conversations.parquet").select(F.col("turn").alias("ts"), F.col("turn").alias(SEQ), "conv_id", "role"), Engine("upsert", ("conv_id",), "ts")).select("conv_id", "ts", "role"),
    "SELECT conv_id, turn AS ts, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["sql_select_groupby"](spark, sf_dir)

