"""Stored tables: commits, merges, deletes, tiers, storage by age, streams and the command line."""

import json

import pytest

from tidemark import Store, TidemarkError, define_collapsing, define_log, define_summing, define_upsert
from tidemark.__main__ import run
from tidemark.sources import manifest
from tidemark.streaming.ingest import rolling, stream_into

METRIC = {"ts": "delta", "value": "auto", "host": "dictionary"}
DAY = 86_400_000
NOW = 1_700_000_000_000 - 1_700_000_000_000 % DAY


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), lambda: NOW)


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=str)


def test_append_and_sql(store):
    t = store.create(define_log("m", METRIC))
    t.append([{"ts": k, "host": h, "value": v} for k, h, v in ((1, "web-1", 10), (2, "web-1", 20), (3, "web-2", 30), (4, "web-2", 40))])
    assert store.sql("INSERT INTO m VALUES (5, 50, 'web-1')") == 1
    assert store.sql("SELECT * FROM m WHERE value > 25").count() == 3
    got = {r.host: (r.value_avg, r.value_max) for r in store.sql("SELECT host, avg(value), max(value) FROM m GROUP BY host").collect()}
    assert got == {"web-1": (pytest.approx(80 / 3), 50), "web-2": (35, 40)}
    assert [r.value for r in store.sql("SELECT value FROM m ORDER BY value DESC LIMIT 2").collect()] == [50, 40]
    assert [r.ts for r in t.tail(2).collect()] == [4, 5] and [r.ts for r in t.all_rows().collect()] == [1, 2, 3, 4, 5]
    assert t.time_range().first().max_ts == 5 and t.lookup("host", "web-1").first().ts == 5
    with pytest.raises(TidemarkError):
        store.sql("INSERT INTO m VALUES (6, 1, 'a', 2)")
    with pytest.raises(TidemarkError) as e:
        store.sql("SELECT * FROM absent")
    assert e.value.code == "STO_TABLE_NOT_FOUND"


def test_a_bad_batch_adds_nothing(store, spark):
    t = store.create(define_log("m", METRIC))
    with pytest.raises(TidemarkError) as e:
        t.append([{"ts": 1}, {"host": "no time"}])
    assert e.value.code == "COL_DELTA_TYPE"
    with pytest.raises(Exception, match="COL_DELTA_TYPE"):
        t.append(spark.createDataFrame([(1, "a"), (None, "b")], "ts long, host string"))
    assert t.all_rows().count() == 0 and t.stats()[0]["rows"] == 0


def test_writers_notice_each_other(store):
    t = store.create(define_log("m", METRIC))
    late = t.manifest()
    t.append([{"ts": 1}])
    with pytest.raises(TidemarkError) as e:
        manifest.save(t.folder, "m", late)
    assert e.value.code == "TBL_CONFLICT"


def test_undeclared_fields_and_new_columns(store):
    t = store.create(define_log("flex", {"ts": "delta", "level": "dictionary", "payload": "catchall"}))
    t.append([{"ts": 1, "level": "info", "user": "alice", "code": 42}, {"ts": 2, "level": "warn"}])
    assert [r.payload for r in t.all_rows().collect()] == ['{"user":"alice","code":42}', None]
    t = store.create(define_log("plain", {"ts": "delta", "val": "raw"}))
    t.append([{"ts": 1, "val": "x", "dropped": 1}])
    t = store.create(define_log("plain", {"ts": "delta", "val": "raw", "later": "raw"}))
    t.append([{"ts": 2, "val": "y", "later": "z"}])
    assert [tuple(r) for r in t.all_rows().collect()] == [(1, "x", None), (2, "y", "z")]


def test_existing_parquet_is_taken_in(store, spark):
    spark.createDataFrame([(1, "a"), (2, "b")], "ts long, k string").write.parquet(f"{store.folder.root}/found")
    assert store.open("found").all_rows().count() == 2 and store.engine_of("found") == "log"


def test_engines_merge_on_compact(store):
    u = store.create(define_upsert("u", {"ts": "delta", "host": "raw", "metric": "raw", "value": "auto"}, ["host", "metric"], "ts", cluster=["host"]))
    for ts, host, v in ((10, "web-1", 42), (20, "web-1", 55), (15, "web-2", 30)):
        u.append([{"ts": ts, "host": host, "metric": "cpu", "value": v}])
    assert u.all_rows().count() == 3 and u.final().count() == 2
    assert u.compact() == {"merged": 3, "rows_before": 3, "rows_after": 2, "collapsed": 1}
    assert u.compact()["merged"] == 0
    assert {(r.host, r.value, r.ts) for r in u.all_rows().collect()} == {("web-1", 55, 20), ("web-2", 30, 15)}
    s = store.create(define_summing("s", {"ts": "delta", "host": "raw", "value": "auto"}, ["host"], ["value"], "ts"))
    for ts, host, v in ((1, "web-1", 100), (2, "web-1", 200), (1, "web-2", 50)):
        s.append([{"ts": ts, "host": host, "value": v}])
    s.compact()
    s.append([{"ts": 3, "host": "web-1", "value": 1}])
    s.compact()
    assert {(r.host, r.ts, r.value) for r in s.all_rows().collect()} == {("web-1", 3, 301), ("web-2", 1, 50)}
    c = store.create(define_collapsing("c", {"id": "dictionary", "sign": "raw int", "ts": "delta"}, ["id"], "sign", "ts"))
    for i, sign, ts in (("1", 1, 1), ("1", -1, 2), ("2", 1, 3)):
        c.append([{"id": i, "sign": sign, "ts": ts}])
    c.compact()
    assert [r.id for r in c.all_rows().collect()] == ["2"]
    assert u.vacuum() == 3


def test_clustering(store):
    t = store.create(define_log("k", {"ts": "delta", "host": "raw", "value": "auto"}))
    with pytest.raises(TidemarkError):
        t.cluster_compact()
    t.set_cluster(["host"])
    for part in range(2):
        t.append([{"ts": k, "host": f"h{k % 3}", "value": k} for k in range(part * 30, part * 30 + 30)])
    before = rows(t.all_rows())
    assert t.cluster_compact()["rewritten"] == 2 and rows(t.all_rows()) == before
    assert store.open("k").definition.cluster == ("host",)
    for bad, code in (([], "DEF_CLUSTER_EMPTY"), (["x"], "DEF_CLUSTER_FIELD"), (["ts"], "DEF_CLUSTER_TS"), (["host", "host"], "DEF_CLUSTER_DUP")):
        with pytest.raises(TidemarkError) as e:
            t.set_cluster(bad)
        assert e.value.code == code


def test_purge_and_delete(store):
    t = store.create(define_log("p", {"ts": "raw bigint", "val": "raw", "host": "raw"}))
    t.append([{"ts": 1, "val": "a", "host": "x"}, {"ts": 2, "val": "b", "host": "x"}])
    t.append([{"ts": 2, "val": "c", "host": "y"}, {"ts": 3, "val": "d", "host": "y"}, {"ts": None, "val": "e"}])
    t.append([{"ts": 9, "val": "f", "host": "z"}])
    assert t.purge(3) == {"removed_rows": 3, "removed_generations": 1, "rewritten_generations": 1}
    assert {r.val for r in t.all_rows().collect()} == {"d", "e", "f"} and t.purge(3)["removed_rows"] == 0
    assert t.delete_by([("host", "eq", "z")]) == {"removed_rows": 1, "removed_generations": 0, "rewritten_generations": 1}
    assert t.delete_by([("host", "eq", "z")])["removed_rows"] == 0
    assert t.delete_by([])["removed_rows"] == 2 and t.all_rows().count() == 0
    with pytest.raises(TidemarkError) as e:
        t.delete_by([("host", "like", "z")])
    assert e.value.code == "TBL_WHERE_OP"


def test_rollup_is_repeatable_and_takes_late_rows(store):
    t = store.create(define_log("r", METRIC, retention="5s:1d,1m:1mon", agg={"value": "avg"}, dims=["host"], auto_rollup=False, auto_purge=False))
    old = NOW - 2 * DAY
    t.append([{"ts": old + k * 1000, "host": "a", "value": k} for k in range(10)])
    assert t.rollup() == {"pairs": 1, "rolled_rows": 10, "purged_rows": 10} and t.rollup()["rolled_rows"] == 0
    t.append([{"ts": old + 5, "host": "a", "value": 100}])  # late, into the same bucket
    t.rollup()
    got = t.aggregate(old, NOW, [("value", "avg"), ("value", "count"), ("value", "sum")]).first()
    assert (got.value_count, got.value_sum, got.value_avg) == (11, 145, pytest.approx(145 / 11))
    assert t.query(old, NOW).count() == 2
    t.compact()
    assert [(r.ts, r.value_count) for r in t.tier(1).collect()] == [(old, 11)]
    with pytest.raises(TidemarkError) as e:
        t.scan(group_by=["host"], agg={"value": ["sum"]})
    assert e.value.code == "TBL_SCAN_AGG"


def test_three_tiers(store):
    t = store.create(define_log("c", METRIC, retention="5s:1d,15s:1w,1m:1mon", agg={"value": "avg"}, dims=["host"], auto_rollup=False, auto_purge=False))
    at = NOW - 10 * DAY
    t.append([{"ts": at + 1000, "host": "a", "value": 100}, {"ts": at + 2000, "host": "a", "value": 200}])
    t.rollup()
    assert [(r.ts, r.value) for r in t.tier(2).collect()] == [(at, 150)] and t.tier(0).count() == t.tier(1).count() == 0
    assert t.rollup_columns("value") == ["value_avg", "value_sum", "value_count"]
    with pytest.raises(TidemarkError):
        t.rollup_one(7)


def test_maintenance_purges_what_is_too_old(store):
    t = store.create(define_log("ttl", METRIC, retention="1s:1d", maintenance_interval_ms=0))
    t.append([{"ts": NOW - 2 * DAY, "value": 1, "host": "a"}, {"ts": NOW - 5, "value": 2, "host": "a"}])
    assert [r.value for r in t.all_rows().collect()] == [2]


def test_storage_by_age(store):
    t = store.create(define_log("s", METRIC, storage=True))
    for age in (1, 1, 10, 100, 400):
        t.append([{"ts": NOW - age * DAY, "value": age, "host": "a"}])
    before = rows(t.all_rows())
    assert {x["id"]: x["generations"] for x in t.storage_status()} == {"hot": 2, "warm": 1, "cold": 1, "archive": 1}
    assert t.storage_apply() == {"groups": 4, "generations": 5} and t.storage_apply()["groups"] == 0
    assert rows(t.all_rows()) == before and all(x["settled"] == x["generations"] for x in t.storage_status())
    with pytest.raises(TidemarkError):
        store.create(define_log("n", METRIC)).storage_status()


@pytest.mark.parametrize(
    ("make", "code"),
    [
        (lambda: define_log("", METRIC), "DEF_NAME_EMPTY"), (lambda: define_log("a/b", METRIC), "DEF_NAME_SLASH"), (lambda: define_log("a", {}), "DEF_COLUMNS_EMPTY"), (lambda: define_log("a", METRIC, retention="1s:1d,1m:1w"), "DEF_RETENTION_AGG"),
        (lambda: define_log("a", METRIC, agg={"x": "sum"}), "DEF_AGG_FIELD"), (lambda: define_log("a", METRIC, agg={"value": "median"}), "DEF_AGG_FN"), (lambda: define_log("a", METRIC, dims=["x"]), "DEF_DIMS_FIELD"), (lambda: define_log("a", METRIC, tiers=[]), "DEF_TIERS_EMPTY"),
        (lambda: define_upsert("a", METRIC, [], "ts"), "DEF_KEY_EMPTY"), (lambda: define_upsert("a", METRIC, ["x"], "ts"), "DEF_KEY_FIELD"), (lambda: define_upsert("a", METRIC, ["host"], "x"), "DEF_COLUMN_NOT_FOUND"), (lambda: define_summing("a", METRIC, ["host"], []), "DEF_SUMMING_SUM"),
    ],
)
def test_definition_errors(make, code):
    with pytest.raises(TidemarkError) as e:
        make()
    assert e.value.code == code


def test_one_append_is_merged_too(store):
    u = store.create(define_upsert("one", {"ts": "delta", "host": "raw", "value": "auto"}, ["host"], "ts"))
    u.append([{"ts": 1, "host": "a", "value": 1}, {"ts": 2, "host": "a", "value": 2}, {"ts": 1, "host": "b", "value": 3}])
    assert u.logical_rows() == 2
    assert u.compact() == {"merged": 1, "rows_before": 3, "rows_after": 2, "collapsed": 1} and u.compact()["merged"] == 0
    assert u.logical_rows() == 2 and {(r.host, r.value) for r in u.all_rows().collect()} == {("a", 2), ("b", 3)}
    log = store.create(define_log("plainlog", METRIC))
    log.append([{"ts": 1, "value": 1, "host": "a"}])
    assert log.compact()["merged"] == 0 and log.logical_rows() == 1


def test_rollup_by_functions_of_its_own_loses_nothing(store):
    t = store.create(define_log("own", METRIC, retention="5s:1d,1m:1mon", agg={"value": "avg"}, dims=["host"], auto_rollup=False, auto_purge=False))
    old = NOW - 2 * DAY
    t.append([{"ts": old + k * 1000, "host": "ab"[k % 2], "value": k} for k in range(10)])
    assert t.rollup_one("1m", agg={"value": ["max", "last"]})["rolled_rows"] == 10
    got = {r.host: (r.value, r.value_sum, r.value_count, r.value_max, r.value_last, r.value_last_ts) for r in t.tier(1).collect()}
    assert got == {"a": (None, 20, 5, 8, 8, old + 8000), "b": (None, 25, 5, 9, 9, old + 9000)}
    t = store.open("own")  # the functions are in the table's definition now
    assert set(t.rollup_columns("value")) == {"value_avg", "value_max", "value_last", "value_last_ts", "value_sum", "value_count"}
    assert t.aggregate(old, NOW, [("value", "max"), ("value", "avg")]).first() == (9, 4.5)
    t.append([{"ts": old + 500, "host": "a", "value": 100}])
    t.rollup()
    t.compact()
    assert {r.host: (r.value_max, r.value_last, r.value_count) for r in t.tier(1).collect()} == {"a": (100, 8, 6), "b": (9, 9, 5)}
    t.append([{"ts": old + 60_000, "host": "a", "value": 7}])
    t.rollup_one("1m", agg={"value": "max"}, dims=["host"])
    assert [(r.value, r.value_count) for r in t.tier(1).where(f"ts = {old + 60_000}").collect()] == [(7, 1)]
    for bad, code in (({"agg": {"none": "max"}}, "DEF_AGG_FIELD"), ({"agg": {"value": "median"}}, "DEF_AGG_FN"), ({"dims": ["none"]}, "DEF_DIMS_FIELD")):
        with pytest.raises(TidemarkError) as e:
            t.rollup_one("1m", **bad)
        assert e.value.code == code


def folders(df):
    return {f.rsplit("/", 2)[1] for f in df.inputFiles()}


def test_reads_open_only_what_the_range_touches(store):
    t = store.create(define_log("pruned", METRIC))
    for day in range(5):
        t.append([{"ts": NOW + day * DAY + k, "host": "a", "value": k} for k in range(3)])
    own = [g.path.rsplit("/", 1)[1] for g in t.generations()]
    assert folders(t.scan(NOW + DAY, NOW + 2 * DAY)) == set(own[1:3])
    assert folders(t.timeline("1d", NOW + 3 * DAY, NOW + 4 * DAY)) >= {own[3]} and own[0] not in folders(t.timeline("1d", NOW + 3 * DAY, NOW + 4 * DAY))
    assert folders(t.downsample(NOW, NOW + 10, "1m", "value", ["sum"])) == {own[0]} and folders(t.percentile(NOW, NOW + 10, [0.5])) == {own[0]}
    assert folders(t.all_rows()) == set(own) and t.scan(NOW - 9, NOW - 5).count() == 0
    tiered = store.create(define_log("pruned2", METRIC, retention="1s:10d,1m:1mon", agg={"value": "avg"}, auto_rollup=False, auto_purge=False))
    for day in (3, 2, 1):
        tiered.append([{"ts": NOW - day * DAY, "host": "a", "value": 1}])
    own = [g.path.rsplit("/", 1)[1] for g in tiered.generations()]
    assert folders(tiered.scan(NOW - 2 * DAY, NOW - 2 * DAY + 5)) == {own[1]}


def pushed(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.split("PushedFilters")[1:]]


def test_old_rows_are_looked_for_by_time(store, monkeypatch):
    t = store.create(define_log("cut", METRIC, retention="5s:1d,1m:1mon", agg={"value": "avg"}, dims=["host"], auto_rollup=False, auto_purge=False))
    old = NOW - 2 * DAY
    t.append([{"ts": old + k, "host": "a", "value": k} for k in range(4)] + [{"ts": NOW, "host": "a", "value": 9}])
    t.append([{"ts": NOW, "host": "b", "value": 1}])
    read, seen = type(t)._read, []

    def spying(self, own, tier):
        seen.append([g.path for g in own])
        return read(self, own, tier)

    monkeypatch.setattr(type(t), "_read", spying)
    late = t.generations()[1].path
    t.rollup()
    assert seen and all(late not in own for own in seen)
    assert "LessThan(ts" in pushed(read(t, t.generations(), 0).where("ts < 5"))[0]
    before = len(t.folder.names("cut/r60000"))
    t.rollup()
    t.rollup()
    assert len(t.folder.names("cut/r60000")) == before
    assert (t.tier(1).first().value_count, t.tier(0).count()) == (4, 2)


def test_totals_of_whole_generations_are_known(store, spark):
    t = store.create(define_log("known", {"ts": "delta", "value": "auto", "n": "raw bigint", "host": "raw"}))
    t.append([{"ts": k, "value": float(k), "n": k} for k in range(10)])
    t.append([{"ts": k, "value": None if k % 2 else 1.5, "n": 2} for k in range(100, 110)])
    t.append([{"ts": 200, "value": float("nan"), "n": None}])
    exprs = [(f, fn) for f in ("value", "n") for fn in ("count", "sum", "min", "max", "avg")]
    whole = t.aggregate(0, 500, exprs)
    assert not whole.inputFiles()
    assert whole.first() == (15, 52.5, 0, 9, 3.5, 20, 65, 0, 9, 3.25)
    said = store.sql("SELECT sum(value), count(n) FROM known WHERE ts <= 150")
    assert not said.inputFiles() and said.first() == (52.5, 20) and not t.scan(agg={"n": ["max"]}).inputFiles()
    assert t.scan(agg={"n": ["max"]}, offset=1).count() == 0 and t.scan(0, 150, where=[("n", "gt", 5)], agg={"n": ["count"]}).first() == (4,)
    part = t.aggregate(5, 500, exprs)
    assert len(folders(part)) == 1 and part.first() == (10, 42.5, 1.5, 9, 4.25, 15, 55, 2, 9, pytest.approx(55 / 15))
    assert t.aggregate(0, 500, [("value", "last")]).first() == (1.5,) and t.aggregate(0, 500, [("n", "max")], [("n", "lt", 9)]).first() == (8,)
    assert t.aggregate(300, 500, [("n", "sum"), ("n", "count")]).first() == (None, 0) and t.aggregate(0, 500, [("host", "count")]).first() == (0,)
    t.append([{"ts": 300, "value": 1.0, "n": (1 << 62)}, {"ts": 301, "value": 1.0, "n": (1 << 62)}])
    assert t.aggregate(299, 500, [("n", "max")]).first() == (1 << 62,)


def test_many_small_appends_leave_few_folders(store):
    t = store.create(define_log("many", METRIC, compact_fanout=3))
    u = store.create(define_upsert("manyu", METRIC, ["host"], "ts", compact_fanout=3))
    for k in range(40):
        t.append([{"ts": k, "host": f"h{k % 4}", "value": k}])
    for k in range(12):
        u.append([{"ts": k, "host": f"h{k % 4}", "value": k}])
    assert len(t.generations()) <= 8 and [r.value for r in t.all_rows().collect()] == list(range(40))
    assert len(u.generations()) <= 6 and {(r.host, r.value) for r in u.final().collect()} == {("h0", 8), ("h1", 9), ("h2", 10), ("h3", 11)}
    kept = [n for n in t.folder.names("many/_manifest") if n.endswith(".json")]
    assert len(kept) <= manifest.KEPT + manifest.CLEARED and t.manifest().commit > 50
    assert t.vacuum() > 30 and t.all_rows().count() == 40


def test_reverts_are_not_lost_in_small_merges(store):
    c = store.create(define_collapsing("cs", {"id": "dictionary", "sign": "raw int", "ts": "delta", "v": "raw"}, ["id"], "sign", "ts", compact_fanout=2))
    for sign, ts, v in ((1, 1, "a"), (1, 2, "b"), (-1, 3, "r"), (1, 4, "c")):
        c.append([{"id": "x", "sign": sign, "ts": ts, "v": v}])
    assert [r.v for r in sorted(c.final().collect(), key=lambda r: r.ts)] == ["b", "c"]
    c.compact()
    assert sorted(r.v for r in c.all_rows().collect()) == ["b", "c"]


def test_an_append_that_met_another_is_committed_anew(store, monkeypatch):
    t, other = store.create(define_log("race", METRIC)), store.open("race")
    write = type(t)._write

    def slow(self, *a, **k):
        g = write(self, *a, **k)
        monkeypatch.setattr(type(t), "_write", write)
        other.append([{"ts": 1, "value": 1, "host": "other"}])
        return g

    monkeypatch.setattr(type(t), "_write", slow)
    assert t.append([{"ts": 2, "value": 2, "host": "mine"}]) == 1
    assert {r.host for r in t.all_rows().collect()} == {"other", "mine"}


def test_the_write_order_has_no_bound(store, spark):
    t = store.create(define_log("long", METRIC))
    m = t.manifest()
    m.commit = 50_000_000
    manifest.save(t.folder, "long", m)
    t.append([{"ts": 1, "value": 1}, {"ts": 2, "value": 2}])
    t.append(spark.range(1).selectExpr("3L AS ts", "3D AS value"))
    assert [r.ts for r in t.all_rows().collect()] == [1, 2, 3] and [r.ts for r in t.tail(2).collect()] == [2, 3]


def test_files_of_about_so_many_bytes(store, spark):
    t = store.create(define_log("sized", METRIC, bytes_per_file=20_000))
    rows = spark.range(20_000).selectExpr("id AS ts", "rand(1) AS value", "'a' AS host").coalesce(1)
    t.append(rows)
    t.append(rows)
    assert len(t.generation(t.generations()[0].path).inputFiles()) == 1 and len(t.generation(t.generations()[1].path).inputFiles()) > 4


def test_bounded_batches_of_cluster_compaction(store):
    t = store.create(define_log("batches", METRIC, cluster=["host"], compact_rows=25, compact_fanout=0))
    for k in range(6):
        t.append([{"ts": 100 * k + j, "host": f"h{j % 2}", "value": j} for j in range(10)])
    before = rows(t.all_rows())
    commits = t.manifest().commit
    assert t.cluster_compact() == {"rewritten": 6} and len(t.generations()) == 3 and t.manifest().commit == commits + 3
    assert rows(t.all_rows()) == before


def test_close_all(store):
    a, b = store.create(define_log("a", METRIC)), store.create(define_log("b", METRIC))
    store.close_all()
    assert not a.is_open and not b.is_open and store.open("a").is_open


def test_looking_into_a_table(store):
    t = store.create(define_log("m", METRIC, retention="1s:1d"))
    t.append([{"ts": NOW - k, "host": f"h{k % 3}", "value": k} for k in range(9)])
    g = t.generations()
    assert (len(g), g[0].rows, g[0].min_ts, g[0].max_ts, g[0].path.startswith(t.tier_name())) == (1, 9, NOW - 8, NOW, True)
    assert t.generation(g[0].path).count() == 9 and sorted(t.distinct("host")) == ["h0", "h1", "h2"] and t.distinct("host", 2) is None
    t.update_metadata({"owner": "ops"})
    assert store.open("m").metadata() == {"owner": "ops"} and store.stats() == {"tables": 1, "rows": 9, "bytes": g[0].bytes}
    for call, code in ((lambda: t.tier(1), "TBL_JOURNAL_INDEX"), (lambda: t.generation("x"), "JRN_SEG_UNKNOWN"), (lambda: t.tail(-1), "TBL_TAIL_COUNT"), (lambda: t.aggregate(0, 1, []), "TBL_AGG_EXPRS"), (lambda: t.rollup(float("nan")), "TBL_ROLLUP_NOW")):
        with pytest.raises(TidemarkError) as e:
            call()
        assert e.value.code == code
    t.flush()
    t.close()
    assert not t.is_open
    with pytest.raises(TidemarkError) as e:
        t.tail(1)
    assert e.value.code == "TBL_NOT_OPEN"


def test_streams_append_once(store, spark, tmp_path):
    source = str(tmp_path / "source")
    spark.createDataFrame([(k * 1000, "a", float(k)) for k in range(20)], "ts long, host string, value double").coalesce(1).write.parquet(source)
    t = store.create(define_log("fed", METRIC))
    for _ in range(2):
        stream_into(t, spark.readStream.schema("ts long, host string, value double").parquet(source), str(tmp_path / "cp"), "feed").awaitTermination(60)
    assert t.all_rows().count() == 20
    assert t.append([{"ts": 1, "value": 1, "host": "a"}], batch=("feed", 0)) == 0
    q = rolling(spark.readStream.schema("ts long, host string, value double").parquet(source), 5000, 1000, ["host"], {"value": ["sum", "count"]}).writeStream.format("memory").queryName("rolled").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.ts, r.value_sum, r.value_count) for r in spark.table("rolled").collect()} == {(0, 10.0, 5), (5000, 35.0, 5), (10_000, 60.0, 5)}


def test_command_line(spark, tmp_path):
    root = ["--root", str(tmp_path / "cli")]
    run(spark, [*root, "create", "m", "--columns", "ts=delta,host=raw,value=auto", "--engine", "upsert", "--key", "host", "--version", "ts"])
    assert run(spark, [*root, "append", "m", json.dumps({"ts": 5, "host": "a", "value": 1})]) == [{"appended": 1}]
    run(spark, [*root, "append", "m", json.dumps({"ts": 6, "host": "a", "value": 2})])
    assert run(spark, [*root, "compact", "m"])[0]["collapsed"] == 1
    assert run(spark, [*root, "query", "SELECT * FROM m"]) == [{"ts": 6000, "host": "a", "value": 2.0}]
    assert run(spark, [*root, "tables"])[0]["engine"] == "upsert" and run(spark, [*root, "stats"])[0]["rows"] == 1
