"""A stored table: appends, reads, merges, deletes, tiers and storage by age."""

from __future__ import annotations

import json
import random
import re
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TidemarkError, require
from ..functions.interval import now_ms, period, resolve
from ..functions.retention import Tier
from ..operators import SEQ, TS, engines, series, tiers
from ..operators.aggregates import ALL, BASIC, Accumulator, level, named, number, per_field, percentiles, stored_columns
from ..operators.predicates import all_of, conditions, matching
from ..operators.scan import Scan, cut, in_range, scan
from ..plans import sql as dialect
from . import manifest
from .definitions import Definition, StorageTier, check_cluster
from .manifest import Folder, Generation, Manifest

#: The write order is a whole number: the commit, a draw that tells writers of one commit number apart, and Spark's number of the row in the write.
DRAWS, ROWS = 1 << 20, 1 << 63
#: How often an append is committed anew when another writer was faster.
RETRIES = 20


class Table:
    """One table of a store. Reads give DataFrames; changes commit at once."""

    def __init__(self, spark: SparkSession, folder: Folder, name: str, now: Callable[[], int] | None = None):
        self.spark, self.folder, self.name, self._now = spark, folder, name, now or now_ms
        m = manifest.load(folder, name)
        require(m is not None, "STO_TABLE_NOT_FOUND", "no such table", name=name)
        self.definition = Definition.from_json(m.definition)
        self._open = True

    # What is there

    def now(self) -> int:
        return self._now()

    def manifest(self) -> Manifest:
        require(self._open, "TBL_NOT_OPEN", "the table was closed", name=self.name)
        return manifest.load(self.folder, self.name)

    @property
    def tiers(self) -> list[Tier]:
        return list(self.definition.tiers)

    @property
    def tiered(self) -> bool:
        return len(self.definition.tiers) > 1

    def tier_count(self) -> int:
        return max(1, len(self.definition.tiers))

    def _read(self, generations: Sequence[Generation], tier: int) -> DataFrame:
        schema = self.definition.schema(tier)
        if not generations:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder.root}/{g.path}" for g in generations])

    @staticmethod
    def _overlapping(own: Sequence[Generation], start=None, end=None) -> list[Generation]:
        """The generations that may hold rows of an inclusive time range; without bounds all."""
        if start is None and end is None:
            return list(own)
        return [g for g in own if g.min_ts is not None and (start is None or g.max_ts >= start) and (end is None or g.min_ts <= end)]

    def tier(self, i: int = 0, start=None, end=None) -> DataFrame:
        """The rows of a tier as they are stored, with their write order; of a time range only the generations that it touches."""
        require(0 <= i < self.tier_count(), "TBL_JOURNAL_INDEX", "no such tier", index=i)
        return self._read(self._overlapping(self.manifest().tiers[i], start, end), i)

    def frames(self, start=None, end=None) -> list[DataFrame]:
        """The rows of all tiers; of a time range what each tier serves of it."""
        m, now, out = self.manifest(), self.now(), []
        for i in range(self.tier_count()):
            own = m.tiers[i]
            if start is not None or end is not None:
                part = tiers.window(self.tiers, i, 0 if start is None else start, now if end is None else end, now)
                own = [] if part is None else self._overlapping(own, *part)
            out.append(self._read(own, i))
        return out

    def tier_name(self, i: int = 0) -> str:
        require(0 <= i < self.tier_count(), "TBL_JOURNAL_INDEX", "no such tier", index=i)
        return f"{self.name}/r{self.tiers[i].res_ms if self.tiers else 0}"

    def generations(self, tier: int = 0) -> list[Generation]:
        """The folders that a tier consists of, with their rows, times and bytes."""
        require(0 <= tier < self.tier_count(), "TBL_JOURNAL_INDEX", "no such tier", index=tier)
        return self.manifest().tiers[tier]

    def generation(self, path: str) -> DataFrame:
        """The rows of one folder."""
        found = [(i, g) for i, own in enumerate(self.manifest().tiers) for g in own if g.path == path]
        require(bool(found), "JRN_SEG_UNKNOWN", "no such generation", path=path)
        return self._read([found[0][1]], found[0][0])

    def distinct(self, field: str, limit: int = 64, tier: int = 0) -> list | None:
        """The distinct values of a field, or None if there are more than ``limit``."""
        found = [r[0] for r in self.tier(tier).select(field).distinct().limit(limit + 1).collect()]
        return None if len(found) > limit else found

    def flush(self) -> None:
        """An append is durable when it returns; nothing to do."""

    def close(self) -> None:
        """Later changes and reads through this object fail."""
        self._open = False

    @property
    def is_open(self) -> bool:
        return self._open

    def rollup_columns(self, field: str) -> list[str]:
        """The columns in which coarse tiers hold a field's parts."""
        fns = tiers.all_functions(self.definition.rolled(), self.definition.extra).get(field)
        return [] if fns is None else stored_columns(field, fns)

    def stats(self) -> list[dict]:
        """Rows, bytes and time range of each tier, from the manifest alone."""
        out = []
        for i, own in enumerate(self.manifest().tiers):
            low, high = [g.min_ts for g in own if g.min_ts is not None], [g.max_ts for g in own if g.max_ts is not None]
            out.append({"tier": i, "rows": sum(g.rows for g in own), "generations": len(own), "bytes": sum(g.bytes for g in own), "min_ts": min(low, default=None), "max_ts": max(high, default=None)})
        return out

    def logical_rows(self) -> int:
        """How many rows the fine tier will have once everything is merged; from the manifest if everything is."""
        own = self.manifest().tiers[0]
        if self.definition.engine.kind == "log" or len(own) < 2 and all(g.merged for g in own):
            return sum(g.rows for g in own)
        return self.final().count()

    def metadata(self) -> dict:
        return self.manifest().metadata

    def update_metadata(self, values: Mapping[str, object]) -> None:
        m = self.manifest()
        m.metadata |= dict(values)
        manifest.save(self.folder, self.name, m)

    # Writing

    def _prepare(self, df: DataFrame) -> DataFrame:
        """The table's columns in order; missing ones null, others gathered as JSON if there is a catch-all column, else left out."""
        d, have = self.definition, set(df.columns)
        extras = [c for c in df.columns if c not in d.columns and c != SEQ]
        gathered = F.to_json(F.struct(*[F.col(f"`{c}`") for c in extras])) if extras else F.lit(None).cast("string")
        if extras:
            gathered = F.when(F.coalesce(*[F.col(f"`{c}`").cast("string") for c in extras]).isNotNull(), gathered)
        out = []
        for c in d.columns:
            kind = d.spark_type(c)
            if d.hint(c) == "catchall" and c not in have:
                out.append(gathered.alias(c))
            elif c in have:
                x = F.col(f"`{c}`")
                if isinstance(df.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType)) and kind == "string":
                    x = F.to_json(x)
                out.append(self._checked(c, x.cast(kind)).alias(c))
            else:
                out.append(self._checked(c, F.lit(None).cast(kind)).alias(c))
        return df.select(*out, *([SEQ] if SEQ in have else []))

    def _checked(self, column: str, value: Column) -> Column:
        """A delta column takes numbers only; the check runs with the write, before anything is committed."""
        if self.definition.hint(column) != "delta":
            return value
        bad = value.isNull() if "double" not in self.definition.spark_type(column) else value.isNull() | F.isnan(value)
        return F.when(bad, F.raise_error(F.lit(f"COL_DELTA_TYPE: {column} takes numbers only"))).otherwise(value)

    def _from_rows(self, rows: Iterable[Mapping]) -> DataFrame:
        d = self.definition
        fields = [c for c in d.columns if d.hint(c) != "catchall"]
        schema = T._parse_datatype_string(", ".join([f"`{c}` {d.spark_type(c)}" for c in fields] + ["_extra string"]))
        catchall = next((c for c in d.columns if d.hint(c) == "catchall"), None)

        def value(c: str, v):
            kind = schema[c].dataType
            if v is None:
                return None
            if isinstance(kind, T.StringType):
                return v if isinstance(v, str) else json.dumps(v)
            if isinstance(kind, (T.DoubleType, T.FloatType)):
                require(isinstance(v, (int, float)) and not isinstance(v, bool), "COL_TYPE", "a number", column=c, value=v)
                return float(v)
            if isinstance(kind, T.IntegralType):
                require(isinstance(v, (int, float)) and not isinstance(v, bool) and float(v).is_integer(), "COL_DELTA_TYPE" if d.hint(c) == "delta" else "COL_TYPE", "a whole number", column=c, value=v)
                return int(v)
            return v

        data = []
        for r in rows:
            for c in fields:
                require(d.hint(c) != "delta" or r.get(c) is not None, "COL_DELTA_TYPE", "a number is missing", column=c)
            extra = {k: v for k, v in r.items() if k not in d.columns}
            given = r.get(catchall) if catchall else None
            text = json.dumps(extra, separators=(",", ":")) if extra else None if given is None else given if isinstance(given, str) else json.dumps(given, separators=(",", ":"))
            data.append(tuple(value(c, r.get(c)) for c in fields) + (text,))
        df = self.spark.createDataFrame(data, schema)
        return df.withColumnRenamed("_extra", catchall) if catchall else df.drop("_extra")

    def _numbers(self, tier: int) -> list[T.StructField]:
        """The columns of numbers of which the manifest keeps facts."""
        return [f for f in self.definition.schema(tier) if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.IntegralType))]

    def _write(self, df: DataFrame, tier: int, compression: str | None = None, storage: str = "", merged: bool = False) -> Generation:
        """A new generation; not part of the table before a manifest names it. What is known of its rows is counted while they are written."""
        path = f"{self.name}/r{self.tiers[tier].res_ms if self.tiers else 0}/{uuid.uuid4().hex}"
        schema, seen = self.definition.schema(tier), Observation()
        facts = []
        for i, f in enumerate(self._numbers(tier)):
            x = number(schema, f.name)
            facts += [F.count(x).alias(f"n{i}"), F.try_sum(x).alias(f"s{i}"), F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}")]
        out = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(TS).alias("timed"), F.min(TS).alias("min_ts"), F.max(TS).alias("max_ts"), *facts).write
        if compression:
            out = out.option("compression", compression)
        most = [n for n in (self.definition.rows_per_file, self._rows_of_bytes(tier)) if n]
        if most:
            out = out.option("maxRecordsPerFile", min(most))
        out.parquet(f"{self.folder.root}/{path}")
        n = seen.get
        known = {f.name: [n[f"n{i}"], n[f"s{i}"], n[f"l{i}"], n[f"h{i}"]] for i, f in enumerate(self._numbers(tier))}
        return Generation(path, n["rows"], n["timed"], n["min_ts"], n["max_ts"], self.folder.size(path), storage, merged, known)

    def _rows_of_bytes(self, tier: int) -> int:
        """How many rows fill a file of the wanted bytes, going by what the tier holds already; 0 if that is open."""
        own = [g for g in manifest.load(self.folder, self.name).tiers[tier] if g.rows and g.bytes] if self.definition.bytes_per_file else []
        return max(1, self.definition.bytes_per_file * sum(g.rows for g in own) // sum(g.bytes for g in own)) if own else 0

    def append(self, rows: DataFrame | Mapping | Iterable[Mapping], batch: tuple[str, int] | None = None) -> int:
        """Add rows to the fine tier and return how many. A bad row fails the whole call and nothing is added.

        ``batch`` (query, number) makes the call once-only: a number that was
        committed for the query before, or a smaller one, adds nothing.
        """
        m = self.manifest()
        if batch and m.batches.get(batch[0], -1) >= batch[1]:
            return 0
        df = rows if isinstance(rows, DataFrame) else self._from_rows([rows] if isinstance(rows, Mapping) else rows)
        df = self._prepare(df)
        kind = "decimal(38,0)"
        if SEQ not in df.columns:
            first = (m.commit * DRAWS + random.randrange(DRAWS)) * ROWS
            df = df.withColumn(SEQ, F.lit(Decimal(first)).cast(kind) + F.monotonically_increasing_id().cast("decimal(19,0)"))
        df = df.withColumn(SEQ, F.col(SEQ).cast(kind))
        if self.definition.cluster:
            df = df.sortWithinPartitions(*engines.cluster_keys(self.definition.cluster))
        g = self._write(df, 0, merged=self.definition.engine.kind == "log")
        for left in range(RETRIES, -1, -1):
            if g.rows:
                m.tiers[0].append(g)
            if batch:
                m.batches[batch[0]] = batch[1]
            try:
                manifest.save(self.folder, self.name, m)
                break
            except TidemarkError as e:
                m = self.manifest()
                if e.code != "TBL_CONFLICT" or not left or m.definition != self.definition.to_json():
                    raise
                if batch and m.batches.get(batch[0], -1) >= batch[1]:
                    return 0
        self._maintain()
        self._compact_small()
        return g.rows

    def _compact_small(self) -> None:
        """Merge generations of like size once there are ``compact_fanout`` of them, so that n appends leave a number of folders that grows with log n.

        A row is rewritten once for each size that it goes through. Rows of a
        collapsing table are put together only: a revert that has not met all rows
        of its key may not cancel one.
        """
        d = self.definition
        if d.compact_fanout < 2:
            return
        while True:
            m, now, groups = self.manifest(), self.now(), {}
            for i, own in enumerate(m.tiers):
                for g in own:
                    if g.rows <= d.compact_rows:
                        size = 0
                        while d.compact_fanout ** (size + 1) <= g.rows:
                            size += 1
                        age = (self._age_tier(g, now).id, (g.min_ts or 0) // self._age_tier(g, now).block) if d.storage else ()
                        groups.setdefault((i, size, age, g.storage), []).append(g)
            full = [(k, own) for k, own in groups.items() if len(own) >= d.compact_fanout]
            if not full:
                return
            (i, _, _, storage), own = full[0]
            own = own[: d.compact_fanout]
            rows = self._read(own, i)
            alone = len(own) == len(m.tiers[i])
            if i:
                rows = self._fit(self._promoted(rows, i), i)
            elif d.engine.kind not in ("log", "collapsing"):
                rows = engines.final_view(rows, d.engine)
            kinds = {t.id: t.compression for t in d.storage or ()}
            new = self._write(self._layout(rows.coalesce(max(1, sum(g.rows for g in own) // 1_000_000))), i, kinds.get(storage), storage, merged=i > 0 or d.engine.kind != "collapsing" and alone or d.engine.kind == "log")
            gone = {g.path for g in own}
            m.tiers[i] = [g for g in m.tiers[i] if g.path not in gone] + ([new] if new.rows else [])
            try:
                manifest.save(self.folder, self.name, m)
            except TidemarkError as e:
                if e.code != "TBL_CONFLICT":
                    raise
                return  # the next append comes by here again

    def _maintain(self) -> None:
        d, m, now = self.definition, self.manifest(), self.now()
        if not d.tiers or now - m.maintained < d.maintenance_interval_ms or not (d.auto_rollup or d.auto_purge):
            return
        if d.auto_rollup and self.tiered:
            self.rollup(now)
        if d.auto_purge:
            self._purge_tier(self.tier_count() - 1, now - self.tiers[-1].ttl_ms)
        m = self.manifest()
        m.maintained = now
        manifest.save(self.folder, self.name, m)

    # Reading

    def _bounds(self, start, end) -> tuple:
        now = self.now()
        return (None if start is None else resolve(start, now), None if end is None else resolve(end, now))

    def scan(self, start=None, end=None, **rest) -> DataFrame:
        """See ``operators.scan``; a tiered table takes row scans only."""
        a, b = self._bounds(start, end)
        spec = Scan(start=a, end=b, **rest)
        if not self.tiered:
            if spec.check().agg and not spec.group_by:
                return cut(self._totals(a, b, spec.agg, spec.where), spec.limit, spec.offset)
            return scan(self.tier(0, a, b), spec)
        require(not spec.agg and not spec.group_by, "TBL_SCAN_AGG", "aggregate() reads over tiers")
        return tiers.tier_scan(self.frames(0 if a is None else a, b), self.tiers, self.now(), spec)

    def query(self, start=None, end=None) -> DataFrame:
        return self.scan(start, end)

    def all_rows(self) -> DataFrame:
        return self.query(0, self.now()) if self.tiered else series.all_rows(self.tier())

    def _rows(self) -> DataFrame:
        """All that a read over the whole table sees, with a write order."""
        if not self.tiered:
            return self.tier()
        return tiers.union(tiers.read(self.frames(), self.tiers, self.now()), self.tier())

    def tail(self, n: int) -> DataFrame:
        require(isinstance(n, int) and n >= 0, "TBL_TAIL_COUNT", "a whole number", n=n)
        if not self.tiered:
            return series.tail(self.tier(), n)
        return self.scan(order="desc", limit=n).orderBy(F.col(TS).asc_nulls_first())

    def page(self, limit: int, offset: int = 0, order: str = "asc") -> DataFrame:
        return series.page(self._rows().drop("_tier"), limit, offset, order)

    def marks(self) -> DataFrame:
        return series.marks(self._rows())

    def time_range(self) -> DataFrame:
        return series.time_range(self._rows())

    def lookup(self, field: str, value) -> DataFrame:
        if not self.tiered:
            return series.lookup(self.tier(), field, value)
        return self.scan(where=[(field, "eq", value)], order="desc", limit=1)

    def timeline(self, interval, start, end=None) -> DataFrame:
        a, b = period(start, end, self.now())
        if not self.tiered:
            return series.timeline(self.tier(0, a, b), interval, a, b)
        parts = tiers.read(self.frames(a, b), self.tiers, self.now(), a, b)
        return series.timeline(tiers.union(parts, self.tier()), interval, a, b, whole_only=True)

    def downsample(self, start, end, bucket, field: str, fns: Sequence[str]) -> DataFrame:
        a, b = period(start, end, self.now())
        return series.downsample(self.tier(0, a, b), a, b, bucket, field, fns)

    def aggregate(self, start, end, exprs: Iterable, where: Iterable | None = None) -> DataFrame:
        per_field(exprs := list(exprs or ()), "TBL_AGG_EXPRS", "TBL_AGG_FIELD_EMPTY", "TBL_AGG_EXPR_FN", ALL)
        a, b = period(start, end, self.now())
        if not self.tiered:
            return self._totals(a, b, per_field(exprs, "TBL_AGG_EXPRS", "TBL_AGG_FIELD_EMPTY", "TBL_AGG_EXPR_FN", ALL), where)
        return tiers.tier_aggregate(self.frames(a, b), self.tiers, self.now(), a, b, exprs, where)

    def _totals(self, a, b, agg: Mapping[str, Sequence[str]], where: Iterable | None = None) -> DataFrame:
        """One row of aggregates over an inclusive range (without bounds all rows). Generations that lie whole in it count with what the manifest knows of them; only the others are read."""
        own, where = self._overlapping(self.manifest().tiers[0], a, b), list(where or ())

        def whole(g: Generation) -> bool:
            return a is None and b is None or g.timed == g.rows and (a is None or a <= g.min_ts) and (b is None or g.max_ts <= b)

        known = [g for g in own if not where and whole(g) and all(f in g.facts and (not g.facts[f][0] or g.facts[f][1] is not None) for f in agg)]
        if not known or any(fn not in BASIC for fns in agg.values() for fn in fns):
            rows = matching(in_range(self._read(own, 0), a, b), where, "TBL_WHERE_OP")
            return rows.agg(*named(rows, agg))
        fields = list(agg)
        kinds = {f.name: f.dataType for f in self.definition.schema() if f.name in agg}
        add = {f: "long" if isinstance(kinds[f], T.IntegralType) else "double" for f in fields}
        total = {f: Accumulator() for f in fields}
        for g in known:
            for f in fields:
                total[f].add_summary(*g.facts[f])
        one = []
        for i, (f, t) in enumerate(total.items()):
            kind = kinds[f].simpleString()
            one += [F.lit(v).cast(k).alias(n) for n, v, k in ((f"n{i}", t.count, "long"), (f"s{i}", t.sum if t.count else None, add[f]), (f"l{i}", t.min, kind), (f"h{i}", t.max, kind))]
        rows = self.spark.range(1, numPartitions=1).select(*one)
        rest = [g for g in own if g not in known]
        if rest:
            df = in_range(self._read(rest, 0), a, b)
            x = {f: number(df.schema, f) for f in fields}
            rows = rows.unionByName(df.agg(*[c for i, f in enumerate(fields) for c in (F.count(x[f]).alias(f"n{i}"), F.sum(x[f]).alias(f"s{i}"), F.min(x[f]).alias(f"l{i}"), F.max(x[f]).alias(f"h{i}"))]))
        merged = {f: {"count": F.sum(f"n{i}"), "sum": F.sum(f"s{i}"), "min": F.min(f"l{i}"), "max": F.max(f"h{i}")} for i, f in enumerate(fields)}
        for i, f in enumerate(fields):
            merged[f]["avg"] = F.sum(f"s{i}") / F.when(F.sum(f"n{i}") > 0, F.sum(f"n{i}"))
        return rows.agg(*[merged[f][fn].alias(f"{f}_{fn}") for f, fns in agg.items() for fn in fns])

    def percentile(self, start, end, levels, field: str = "value") -> DataFrame:
        """Over raw rows: of a tiered table those of the fine tier."""
        a, b = period(start, end, self.now())
        if not self.tiered:
            return series.percentile(self.tier(0, a, b), a, b, levels, field)
        part = tiers.read(self.frames(a, b)[:1], self.tiers[:1], self.now(), a, b)
        return percentiles(tiers.union(part, self.tier()), field, level(levels, "TBL_PCTL_LEVEL"))

    def final(self) -> DataFrame:
        """The fine tier as it will be once everything is merged."""
        return engines.final_view(self.tier(), self.definition.engine).drop(SEQ)

    def sql(self, text: str) -> DataFrame | int:
        """Run a statement of the dialect; an INSERT returns how many rows it added."""
        return self.run(dialect.parse(text))

    def run(self, statement: dialect.Select | dialect.Insert) -> DataFrame | int:
        if isinstance(statement, dialect.Insert):
            names = statement.columns or self.definition.fields()
            for r in statement.rows:
                require(len(r) == len(names), "SQL_ARITY", "as many values as columns", values=len(r), columns=len(names))
            return self.append([dict(zip(names, r, strict=True)) for r in statement.rows])
        spec = dialect.lower(statement, self.now())
        return self.scan(**{k: getattr(spec, k) for k in ("start", "end", "where", "select", "group_by", "agg", "order", "limit", "offset", "key")})

    # Merging

    def _layout(self, df: DataFrame) -> DataFrame:
        c = self.definition.cluster
        if not c:
            return df.sortWithinPartitions(F.col(TS).asc_nulls_last(), SEQ)
        return engines.cluster_layout(df, c, max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))

    def compact(self) -> dict:
        """Merge each tier's generations by the engine and write them in the order of the cluster key. A single one is left alone if it is merged."""
        m, report = self.manifest(), {"merged": 0, "rows_before": 0, "rows_after": 0, "collapsed": 0}
        for i, own in enumerate(m.tiers):
            if len(own) < 2 and all(g.merged for g in own):
                continue
            rows = self._read(own, i)
            if i == 0:
                rows = engines.final_view(rows, self.definition.engine)
            else:
                rows = self._fit(self._promoted(rows, i), i)
            g = self._write(self._layout(rows), i, merged=True)
            before = sum(x.rows for x in own)
            report["merged"] += len(own)
            report["rows_before"] += before
            report["rows_after"] += g.rows
            report["collapsed"] += before - g.rows
            m.tiers[i] = [g] if g.rows else []
        if report["merged"]:
            manifest.save(self.folder, self.name, m)
        return report

    def cluster_compact(self, start=None, end=None) -> dict:
        """Rewrite the generations that a time range touches in the order of the cluster key; rows don't change.

        They are taken in the order of their times, so many at once as have
        ``compact_rows`` rows (or one larger one), each batch in a commit of its own.
        """
        require(bool(self.definition.cluster), "JRN_NO_CLUSTER", "the table has no cluster key")
        a, b = self._bounds(start, end)
        n = 0
        for i, own in enumerate(self.manifest().tiers):
            hit = [g for g in own if (a is None or g.max_ts is None or g.max_ts >= a) and (b is None or g.min_ts is None or g.min_ts <= b)]
            hit.sort(key=lambda g: (g.min_ts is not None, g.min_ts or 0, g.path))
            while hit:
                size, part = 0, []
                while hit and (not part or size + hit[0].rows <= self.definition.compact_rows):
                    size += hit[0].rows
                    part.append(hit.pop(0))
                g = self._write(self._layout(self._read(part, i)), i, merged=len(part) == 1 and part[0].merged or self.definition.engine.kind == "log" and not i)
                m, gone = self.manifest(), {x.path for x in part}
                require(gone <= {x.path for x in m.tiers[i]}, "TBL_CONFLICT", "the table was changed by another writer meanwhile")
                m.tiers[i] = [x for x in m.tiers[i] if x.path not in gone] + [g]
                manifest.save(self.folder, self.name, m)
                n += len(part)
        return {"rewritten": n}

    def set_cluster(self, cluster: Sequence[str]) -> None:
        """Change the cluster key; what is stored stays as it is until it is rewritten."""
        self.definition = replace(self.definition, cluster=check_cluster(self.definition.columns, cluster))
        m = self.manifest()
        m.definition = self.definition.to_json()
        manifest.save(self.folder, self.name, m)

    # Deleting

    def _rewrite(self, m: Manifest, i: int, gone: Column, whole: Callable[[Generation], bool | None]) -> tuple[int, int, int]:
        """Take the rows away for which ``gone`` holds. ``whole`` says of a generation: all go, none does, or look (None)."""
        rows = dropped = rewritten = 0
        kept, look = [], []
        for g in m.tiers[i]:
            all_go = whole(g)
            if all_go:
                rows, dropped = rows + g.rows, dropped + 1
            elif all_go is None:
                look.append(g)
            else:
                kept.append(g)
        if look:
            at = self._read(look, i).where(gone).groupBy(F.regexp_extract(F.col("_metadata.file_path"), r"/([0-9a-f]{32})/[^/]*$", 1).alias("g")).count()
            hits = {r[0]: r[1] for r in at.collect()}  # a row for each generation that is hit
            hit = [g for g in look if g.path.rpartition("/")[2] in hits]
            kept += [g for g in look if g not in hit]
            if hit:
                rows += sum(hits.values())
                rewritten = len(hit)
                rest = self._read(hit, i).where(~F.coalesce(gone, F.lit(False)))
                new = self._write(self._layout(rest), i, merged=len(hit) == 1 and hit[0].merged or self.definition.engine.kind == "log" and not i)
                if new.rows:
                    kept.append(new)
        m.tiers[i] = kept
        return rows, dropped, rewritten

    def _purge_tier(self, i: int, before: int) -> tuple[int, int, int]:
        m = self.manifest()

        def whole(g: Generation) -> bool | None:
            if g.min_ts is None or g.min_ts >= before:
                return False
            return True if g.timed == g.rows and g.max_ts < before else None

        done = self._rewrite(m, i, F.col(TS) < before, whole)
        if any(done):
            manifest.save(self.folder, self.name, m)
        return done

    @staticmethod
    def _report(parts: Iterable[tuple[int, int, int]]) -> dict:
        total = [sum(x) for x in zip(*parts, strict=True)]
        return {"removed_rows": total[0], "removed_generations": total[1], "rewritten_generations": total[2]}

    def purge(self, before) -> dict:
        """Take away rows older than a time; rows of that time and rows without one stay."""
        at = int(resolve(before, self.now()))
        return self._report([self._purge_tier(i, at) for i in range(self.tier_count())])

    def delete_by(self, where: Iterable | None) -> dict:
        """Take away the rows that a filter matches, in all tiers; an empty filter matches all."""
        checked = conditions(where, "TBL_WHERE_OP")
        if not checked:
            return self.truncate()
        m = self.manifest()
        done = [self._rewrite(m, i, all_of(self.definition.schema(i), checked), lambda g: None) for i in range(self.tier_count())]
        if any(any(x) for x in done):
            manifest.save(self.folder, self.name, m)
        return self._report(done)

    def truncate(self) -> dict:
        m = self.manifest()
        own = [g for t in m.tiers for g in t]
        m.tiers, m.checkpoints = [[] for _ in range(self.tier_count())], {}
        manifest.save(self.folder, self.name, m)
        return {"removed_rows": sum(g.rows for g in own), "removed_generations": len(own), "rewritten_generations": 0}

    def vacuum(self) -> int:
        """Delete folders that the last manifest doesn't name. Only when nothing reads older versions."""
        known = {g.path for t in self.manifest().tiers for g in t}
        n = 0
        for tier in [x for x in self.folder.names(self.name) if re.fullmatch(r"r\d+", x)]:
            for g in self.folder.names(f"{self.name}/{tier}"):
                if f"{self.name}/{tier}/{g}" not in known:
                    self.folder.delete(f"{self.name}/{tier}/{g}")
                    n += 1
        return n

    # Tiers

    def _fit(self, df: DataFrame, tier: int) -> DataFrame:
        """Rolled-up rows in the columns of a coarse tier."""
        have = set(df.columns)
        return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.definition.schema(tier)])

    def _promoted(self, rows: DataFrame, tier: int) -> DataFrame:
        d = self.definition
        return tiers.promote(rows, self.tiers[tier].res_ms, d.dimensions(), d.rolled(), d.extra)

    def _roll(self, i: int, now: int, agg: Mapping | None = None, dims: Sequence[str] | None = None) -> tuple[int, int]:
        """Move the rows of tier i that it keeps no longer to the next one, in one commit. Late rows go the same way, whatever their time.

        Functions of ``agg`` that the definition lacks are added to what coarse tiers store, in the same commit.
        """
        m, fine, coarse = self.manifest(), self.tiers[i], self.tiers[i + 1]
        end = tiers.roll_cut(now, fine, coarse)
        old = F.col(TS) < end
        own = [g for g in m.tiers[i] if g.min_ts is not None and g.min_ts < end]
        if not own:
            return 0, 0
        d = self.definition
        wanted = d.rolled() | dict(agg or {})
        extra = {f: [fn for fn in fns if fn not in tiers.functions_of(d.rolled().get(f, ()))] for f, fns in tiers.all_functions(wanted, tiers.all_functions(d.rolled(), d.extra)).items()}
        extra = {f: fns for f, fns in extra.items() if fns}
        if extra != {f: list(fns) for f, fns in d.extra.items()}:
            self.definition = replace(d, extra=extra)
            m.definition = self.definition.to_json()
        keys = list(dims) if dims else [c for c in d.dimensions() if c not in wanted]
        rolled = tiers.promote(self._read(own, i).where(old), coarse.res_ms, keys, wanted, tiers.all_functions(d.rolled(), extra))
        new = self._write(self._fit(rolled, i + 1), i + 1, merged=True)

        def whole(g: Generation) -> bool | None:
            if g.min_ts is None or g.min_ts >= end:
                return False
            return True if g.timed == g.rows and g.max_ts < end else None

        gone = self._rewrite(m, i, old, whole)[0]
        if new.rows:
            m.tiers[i + 1].append(new)
        m.checkpoints[str(i + 1)] = end
        manifest.save(self.folder, self.name, m)
        return gone, gone

    def rollup(self, now: int | None = None) -> dict:
        """Roll all tiers up, fine to coarse. A second call with the same ``now`` finds nothing."""
        require(bool(self.definition.tiers), "TBL_ROLLUP_NO_TIERS", "the table has no tiers")
        require(now is None or isinstance(now, (int, float)) and now == now and abs(now) != float("inf"), "TBL_ROLLUP_NOW", "a finite number", now=now)
        at = self.now() if now is None else int(now)
        done = [self._roll(i, at) for i in range(len(self.tiers) - 1)]
        return {"pairs": len(done), "rolled_rows": sum(a for a, _ in done), "purged_rows": sum(b for _, b in done)}

    def rollup_one(self, res: int | str | None = None, now: int | None = None, agg=None, dims=None) -> dict:
        """Roll up into the tier of one resolution only (the first coarse one if none is named).

        ``agg`` maps fields to a function or several, in addition to what the
        definition stores: nothing that is declared is lost, and a single plain
        function gives the value under the field's own name. ``dims`` takes the
        place of the declared dimensions.
        """
        require(self.tiered, "TBL_ROLLUP_ONE_NO_TIERS", "the table has no coarse tier")
        from ..functions.interval import parse_interval

        res = self.tiers[1].res_ms if res is None else parse_interval(res) if isinstance(res, str) else res
        at = next((i for i, t in enumerate(self.tiers) if i and t.res_ms == res), None)
        require(at is not None, "TBL_ROLLUP_ONE_RES", "not the resolution of a coarse tier", res=res)
        for f, fn in (agg or {}).items():
            require(f in self.definition.columns, "DEF_AGG_FIELD", "not a column", field=f)
            fns = tiers.functions_of(fn)
            require(bool(fns) and all(x in ALL for x in fns), "DEF_AGG_FN", f"of {', '.join(ALL)}", field=f, fn=fn)
        for f in dims or ():
            require(f in self.definition.columns, "DEF_DIMS_FIELD", "not a column", field=f)
        rolled, purged = self._roll(at - 1, self.now() if now is None else int(now), agg, dims)
        return {"tier": at, "rolled_rows": rolled, "purged_rows": purged}

    # Storage by age

    def _storage(self) -> tuple[StorageTier, ...]:
        require(self.definition.storage is not None, "TBL_NO_STORAGE", "the table has no storage tiers")
        return self.definition.storage

    def _age_tier(self, g: Generation, now: int) -> StorageTier:
        kept = self._storage()
        age = max(0, now - (g.max_ts if g.max_ts is not None else now))
        return next((t for t in kept if age >= t.since and (t.upto is None or age < t.upto)), kept[-1])

    def storage_status(self, now: int | None = None) -> list[dict]:
        """For each storage tier: generations, rows and bytes of its age, and how many are kept as it wants."""
        now, out = self.now() if now is None else now, []
        own = [(g, self._age_tier(g, now).id) for t in self.manifest().tiers for g in t]
        for t in self._storage():
            mine = [g for g, i in own if i == t.id]
            out.append({"id": t.id, "generations": len(mine), "rows": sum(g.rows for g in mine), "bytes": sum(g.bytes for g in mine), "settled": sum(g.storage == t.id for g in mine)})
        return out

    def storage_plan(self, now: int | None = None) -> list[dict]:
        """What ``storage_apply`` would rewrite: generations of one age and block, if there are several or they are kept otherwise."""
        now, out = self.now() if now is None else now, []
        for i, own in enumerate(self.manifest().tiers):
            groups: dict[tuple[str, int], list[Generation]] = {}
            for g in own:
                t = self._age_tier(g, now)
                groups.setdefault((t.id, (g.min_ts or 0) // t.block), []).append(g)
            for (name, block), found in sorted(groups.items()):
                if len(found) > 1 or found[0].storage != name:
                    out.append({"tier": i, "storage": name, "block": block, "paths": [g.path for g in found]})
        return out

    def storage_apply(self, now: int | None = None, only: str | None = None) -> dict:
        """Rewrite generations as their age asks; rows don't change. A second call with the same ``now`` finds nothing."""
        plan = [p for p in self.storage_plan(now) if only in (None, p["storage"])]
        m, kinds = self.manifest(), {t.id: t for t in self._storage()}
        for p in plan:
            own = [g for g in m.tiers[p["tier"]] if g.path in p["paths"]]
            rows = self._layout(self._read(own, p["tier"]))
            new = self._write(rows, p["tier"], kinds[p["storage"]].compression, p["storage"], merged=len(own) == 1 and own[0].merged or self.definition.engine.kind == "log" and not p["tier"])
            m.tiers[p["tier"]] = [g for g in m.tiers[p["tier"]] if g not in own] + [new]
        if plan:
            manifest.save(self.folder, self.name, m)
        return {"groups": len(plan), "generations": sum(len(p["paths"]) for p in plan)}

    def storage_compact_tier(self, name: str, now: int | None = None) -> dict:
        require(any(t.id == name for t in self._storage()), "DEF_STORAGE_TIERS", "no such storage tier", id=name)
        return self.storage_apply(now, name)
