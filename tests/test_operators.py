"""Operators against literal examples and against plain Python over seeded rows."""

import math
import random
from collections import defaultdict

import pytest

from tidemark import Scan, TidemarkError, Tier, aggregates, scan
from tidemark.operators import engines, series, tiers
from tidemark.operators.engines import Engine
from tidemark.operators.predicates import matching
from tidemark.operators.scan import in_range

BASE = 1_700_000_000_000
METRIC = "ts long, host string, value double, _seq long"


def frame(spark, rows, schema=METRIC):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], schema)


def plain(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def random_rows():
    rng, out, ts = random.Random(42), [], BASE
    for k in range(800):
        ts += 1 + rng.randrange(999)
        out.append((ts if rng.random() > 0.03 else None, f"web-{rng.randrange(1, 6)}" if rng.random() > 0.05 else None, None if rng.random() < 0.1 else rng.choice([float("nan"), float("inf")]) if rng.random() < 0.02 else float(round(math.sin(k / 10) * 50 + 50 + rng.random() * 20))))
    return out


TABLE = [(BASE + 1, "a", 10.0), (BASE + 2, "b", 20.0), (BASE + 3, "c", None), (BASE + 4, "a", 40.0), (None, "d", 999.0), (BASE + 6, "b", 60.0)]


@pytest.mark.parametrize(
    ("condition", "n"),
    [
        (("host", "eq", "a"), 2), (("host", "ne", "a"), 3), (("value", "lt", 40), 2), (("value", "le", 40), 3), (("value", "gt", 40), 1), (("value", "ge", 40), 2),
        (("host", "in", ["a", "b"]), 4), (("host", "nin", ["a", "b"]), 1), (("value", "isNull"), 1), (("value", "isNotNull"), 4),
        (("host", "startsWith", "a"), 2), (("host", "startsWith", "b"), 2), (("host", "startsWith", "x"), 0),
        (("value", "ne", 10), 4), (("value", "in", [10, None]), 2), (("value", "nin", [10, None]), 3), (("host", "in", []), 0), (("host", "nin", []), 5),
        (("host", "eq", 1), 0), (("value", "eq", "10"), 0), (("value", "ne", "10"), 5), (("host", "gt", "a"), 0), (("none", "isNull"), 5), (("none", "eq", 1), 0), (("none", "ne", 1), 5), (("none", "eq", None), 5),
    ],
)
def test_predicates(spark, condition, n):
    assert matching(in_range(frame(spark, TABLE), BASE, BASE + 100), [condition]).count() == n


def finite(v):
    return isinstance(v, (int, float)) and math.isfinite(v)


def test_scan_against_brute_force(spark, random_rows):
    df, lo, hi = frame(spark, random_rows), BASE + 50_000, BASE + 300_000
    kept = [r for r in random_rows if r[0] is not None and lo <= r[0] <= hi and r[2] is not None and r[2] > 30 and not math.isnan(r[2])]
    got = scan(df, Scan(start=lo, end=hi, where=[("value", "gt", 30)], select=["host", "value"], order="desc", limit=20, offset=5)).collect()
    keyed = sorted(kept, key=lambda r: (r[1] is None, [-ord(c) for c in r[1] or ""]))
    assert [(r.host, r.value) for r in got] == [(r[1], r[2]) for r in keyed[5:25]]
    groups = defaultdict(list)
    for r in kept:
        groups[r[1]].append(r[2])
    got = scan(df, Scan(start=lo, end=hi, where=[("value", "gt", 30)], group_by=["host"], agg={"value": ["sum", "avg", "min", "max", "count"]})).collect()
    want = {h: [x for x in v if finite(x)] for h, v in groups.items()}
    assert {r.host: (r.value_sum, r.value_min, r.value_max, r.value_count) for r in got} == {h: (sum(v), min(v), max(v), len(v)) for h, v in want.items()}
    assert [r.value_sum for r in got] == sorted([r.value_sum for r in got], reverse=True)


def test_scan_over_nothing(spark):
    df = frame(spark, TABLE)
    assert plain(scan(df, Scan(start=0, end=1, agg={"value": ["count", "sum", "avg"]}))) == [{"value_count": 0, "value_sum": None, "value_avg": None}]
    assert scan(df, Scan(start=0, end=1, group_by=["host"], agg={"value": ["count"]})).count() == 0
    assert scan(df, Scan()).count() == 6  # rows without a time stay if there is no bound
    assert scan(df, Scan(start=0)).count() == 5
    assert scan(df, Scan(select=["ts", "nothing"])).columns == ["ts", "nothing"]


@pytest.mark.parametrize(
    ("spec", "code"),
    [
        (Scan(start=2, end=1), "JRN_SCAN_RANGE"), (Scan(where=[("", "eq", 1)]), "JRN_SCAN_WHERE_FIELD"), (Scan(where=[("a", "like", 1)]), "JRN_SCAN_WHERE_OP"), (Scan(where=[("a", "in", 1)]), "JRN_SCAN_WHERE_IN"),
        (Scan(agg={"a": []}), "JRN_SCAN_AGG_FNS"), (Scan(agg={"a": ["median"]}), "JRN_SCAN_AGG_FN"), (Scan(group_by=["a"]), "JRN_SCAN_GROUPBY_AGG"), (Scan(order="up"), "JRN_SCAN_ORDER"), (Scan(limit=-1), "JRN_SCAN_LIMIT"),
        (Scan(offset=1.5), "JRN_SCAN_OFFSET"), (Scan(select=[""]), "JRN_SCAN_SELECT_FIELD"), (Scan(agg={"": ["sum"]}), "JRN_SCAN_AGG_FIELD"),
    ],
)
def test_scan_errors(spec, code):
    with pytest.raises(TidemarkError) as e:
        spec.check()
    assert e.value.code == code


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    frame(spark, TABLE).write.parquet(str(tmp_path / "t"))
    plan = scan(spark.read.parquet(str(tmp_path / "t")), Scan(start=BASE, where=[("value", "gt", 5)], group_by=["host"], agg={"value": ["max"]}))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,5.0)" in plan and "GreaterThanOrEqual(ts" in plan


def test_timeline(spark):
    day = 86_400_000
    df = frame(spark, [(BASE + k, "a", 1.0) for k in (0, 5, day, day + 1, day + 2, 2 * day, 4 * day)] + [(None, "a", 1.0)])
    got = series.timeline(df, "1d", BASE, BASE + 4 * day).orderBy("start").collect()
    assert [r["count"] for r in got] == [2, 3, 1, 0] and [r.hasData for r in got] == [True, True, True, False]
    assert [r.end for r in series.timeline(df, "1d", BASE, BASE + day // 2).collect()] == [BASE + day // 2]
    assert series.timeline(df, 10, BASE, BASE).count() == 0
    with pytest.raises(TidemarkError):
        series.timeline(df, "0s", BASE, BASE + 1)


def test_downsample_against_brute_force(spark, random_rows):
    lo, hi, step = BASE + 12_345, BASE + 200_001, 60_000
    got = series.downsample(frame(spark, random_rows), lo, hi, step, "value", ["avg", "max"]).orderBy("start").collect()
    first = lo - lo % step
    for i, r in enumerate(got):
        a, b = max(lo, first + i * step), min(hi, first + (i + 1) * step)
        v = [x[2] for x in random_rows if x[0] is not None and a <= x[0] < b and x[2] is not None and finite(x[2])]
        assert (r.start, r.end, r["count"], r.max) == (a, b, len(v), max(v, default=None))
        assert r.avg == pytest.approx(sum(v) / len(v)) if v else r.avg is None
    assert got[-1].end == hi


def test_ends_of_a_table(spark, random_rows):
    df = frame(spark, random_rows)
    assert [tuple(r) for r in series.tail(df, 3).select("ts", "host").collect()] == [r[:2] for r in random_rows[-3:]]
    assert series.tail(df, 0).count() == 0
    assert [tuple(r) for r in series.page(df, 2, 1, "desc").select("ts", "host").collect()] == [r[:2] for r in random_rows[-2:-4:-1]]
    assert series.page(df, -1).count() == 0
    timed = [r[0] for r in random_rows if r[0] is not None]
    assert tuple(series.time_range(df).first()) == (min(timed), max(timed))
    twice = frame(spark, [(1, "a", 1.0), (5, "a", 2.0), (5, "a", 3.0)])
    assert series.lookup(twice, "host", "a").first().value == 2.0


def test_percentiles(spark):
    df = frame(spark, [(k, "a", float(k)) for k in range(1, 101)])
    assert series.percentile(df, 0, 1000, [0.5, 0.9, 0.999]).first().asDict() == pytest.approx({"p50": 50.5, "p90": 90.1, "p99.9": 99.901})
    assert series.percentile(df, 5000, 6000, [0.5]).first().p50 is None
    with pytest.raises(TidemarkError):
        series.percentile(df, 0, 1, [1])


@pytest.mark.parametrize("kind", ["random", "ties", "one"])
def test_percentiles_of_more_numbers_than_a_task_holds(spark, monkeypatch, kind):
    rng = random.Random(8)
    v = {"random": [rng.gauss(0, 5) for _ in range(6000)], "ties": [float(rng.choice([1, 1, 1, 2, 7])) for _ in range(6000)], "one": [3.0] * 6000}[kind]
    df = frame(spark, [(k, "a", x) for k, x in enumerate(v)])
    want = series.percentile(df, 0, 10_000, [0.001, 0.5, 0.9, 0.999]).first()
    monkeypatch.setattr(aggregates, "DIRECT", 40)
    monkeypatch.setattr(aggregates, "_ACCURACY", 60)
    assert tuple(series.percentile(df, 0, 10_000, [0.001, 0.5, 0.9, 0.999]).first()) == tuple(want)


def test_first_and_last(spark):
    df = frame(spark, [(5, "a", 1.0), (5, "a", 2.0), (9, "a", None), (1, "a", 7.0), (1, "a", 8.0)])
    assert series.aggregate_range(df, 0, 10, [("value", "last"), ("value", "first")]).first().asDict() == {"value_last": 2.0, "value_first": 7.0}


def test_upsert(spark):
    df = frame(spark, [(10, "web-1", "cpu", 42.0), (20, "web-1", "cpu", 55.0), (15, "web-2", "cpu", 30.0), (20, "web-1", "cpu", 56.0), (1, None, "cpu", 1.0), (2, None, "cpu", 2.0)], "ts long, host string, metric string, value double, _seq long")
    e = Engine("upsert", ("host", "metric"), "ts")
    got = engines.final_view(df, e)
    assert {(r.host, r.ts, r.value) for r in got.collect()} == {("web-1", 20, 56.0), ("web-2", 15, 30.0), (None, 2, 2.0)}
    assert sorted(map(tuple, engines.final_view(got, e).collect()), key=str) == sorted(map(tuple, got.collect()), key=str)


def test_summing(spark):
    df = frame(spark, [(1, "web-1", 100.0), (2, "web-1", 200.0), (1, "web-2", 50.0), (3, "web-3", None)])
    got = engines.final_view(df, Engine("summing", ("host",), "ts", ("value",)))
    assert {(r.host, r.ts, r.value) for r in got.collect()} == {("web-1", 2, 300.0), ("web-2", 1, 50.0), ("web-3", 3, None)}
    assert {(r.host, r.ts) for r in engines.final_view(frame(spark, [(9, "a", 1.0), (4, "a", 2.0)]), Engine("summing", ("host",), None, ("value",))).collect()} == {("a", 4)}


def collapse(rows):
    """Rows (id, sign, ts) of one key in order; direct simulation."""
    live, kept = [], []
    for r in rows:
        n = int(math.floor(abs(r[1]) + 0.5))
        if r[1] > 0:
            live += [r] * n
        elif n:
            if len(live) < n:
                kept.append(r)
            live = live[n:]
    return kept + live


def test_collapsing_against_simulation(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(30), float(rng.choice([1, 1, -1, -1, 2, -3, 0, 0.4, 1.5])), rng.randrange(50)) for _ in range(1500)]
    df = frame(spark, rows, "id long, sign double, ts long, _seq long")
    want = []
    for k in range(30):
        own = sorted(((r, i) for i, r in enumerate(rows) if r[0] == k), key=lambda x: (x[0][2], x[1]))
        want += collapse([r for r, _ in own])
    got = engines.final_view(df, Engine("collapsing", ("id",), "ts", (), "sign"))
    assert sorted(tuple(r)[:3] for r in got.collect()) == sorted(want)


def test_cluster_order(spark):
    df = frame(spark, [(3, "b", 1.0), (1, None, 2.0), (2, "a", 3.0), (1, "a", 4.0)])
    assert [r.value for r in engines.cluster_sort(df, ["host"]).collect()] == [4.0, 3.0, 1.0, 2.0]


def test_promote(spark):
    df = frame(spark, [(1000, "h1", 10.0), (2000, "h1", 20.0), (70_000, "h1", 30.0), (1000, "h2", 100.0), (2000, "h2", 200.0), (70_000, "h2", 300.0), (None, "h1", 1.0)])
    assert {(r.ts, r.host, r.value) for r in tiers.promote(df, 60_000, ["host"], {"value": "avg"}).collect()} == {(0, "h1", 15.0), (60_000, "h1", 30.0), (0, "h2", 150.0), (60_000, "h2", 300.0)}
    multi = tiers.promote(frame(spark, [(1000, "a", 5.0), (2000, "a", 9.0), (3000, "a", 2.0), (4500, "a", 7.0)]), 5000, [], {"value": ["min", "max", "sum", "count", "last", "first"]}).first()
    assert (multi.value_min, multi.value_max, multi.value_sum, multi.value_count, multi.value_last, multi.value_last_ts, multi.value_first, multi.value_first_ts) == (2.0, 9.0, 23.0, 4, 7.0, 4500, 5.0, 1000)


def test_rolling_up_twice_is_rolling_up_once(spark, random_rows):
    df, agg = frame(spark, random_rows), {"value": ["min", "max", "sum", "count", "last", "first", "avg"]}
    once = tiers.promote(df, 120_000, ["host"], agg).drop("_seq")
    twice = tiers.promote(tiers.promote(df, 20_000, ["host"], agg), 120_000, ["host"], agg).drop("_seq")
    key = lambda r: (r.ts, str(r.host))
    for a, b in zip(sorted(once.collect(), key=key), sorted(twice.collect(), key=key), strict=True):
        assert a.asDict() == pytest.approx(b.asDict(), nan_ok=True) if None not in a else a.asDict() == b.asDict()


def test_windows():
    t = [Tier(1000, 100_000), Tier(10_000, 1_000_000)]
    assert tiers.window(t, 0, 0, 9_000_000, 5_000_000) == (0, 5_000_000)
    assert tiers.window(t, 1, 0, 9_000_000, 5_000_000) == (4_000_000, 4_900_000)
    assert tiers.window(t, 1, 4_950_000, 9_000_000, 5_000_000) is None


def test_accumulators():
    a, b = aggregates.Accumulator(), aggregates.Accumulator()
    for ts, v in ((5, 10.0), (9, 20.0), (9, float("nan")), (3, True)):
        a.add(v, ts)
    for ts, v in ((1, 1.0), (40, 5.0), (2, None)):
        b.add(v, ts)
    a.merge(b)
    assert [a.value(f) for f in aggregates.ALL] == [1.0, 20.0, 36.0, 9.0, 4, 5.0, 1.0]
    assert aggregates.apply("avg", []) is None and aggregates.apply("count", ["x"]) == 0 and aggregates.apply("last", [3, 4]) == 4
