"""Table definitions: columns, engine, tiers, cluster key, checked when they are made."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import types as T

from ..errors import require
from ..functions.retention import Tier, parse_retention
from ..operators import SEQ, TS
from ..operators.aggregates import ALL, stored_columns
from ..operators.engines import Engine
from ..operators.tiers import all_functions, functions_of, is_multi

DAY = 86_400_000

# How a column may be declared, and its type. A hint about storage leaves the type open: text unless a type follows it ("auto double").
HINTS = {"raw": "string", "dictionary": "string", "delta": "bigint", "rle": "string", "auto": "double", "catchall": "string"}


@dataclass(frozen=True)
class StorageTier:
    """How rows of an age are kept: Parquet codec and the time that a file covers. ``upto`` None: any age."""

    id: str
    since: int
    upto: int | None
    compression: str = "snappy"
    block: int = DAY


# The ages and blocks that data is kept by unless a table says otherwise.
STORAGE_TIERS = (
    StorageTier("hot", 0, 7 * DAY, "snappy", 3_600_000),
    StorageTier("warm", 7 * DAY, 30 * DAY, "snappy", 3_600_000),
    StorageTier("cold", 30 * DAY, 365 * DAY, "zstd", DAY),
    StorageTier("archive", 365 * DAY, None, "gzip", DAY),
)


@dataclass(frozen=True)
class Definition:
    """A table. Make one with ``define_log``, ``define_upsert``, ``define_summing`` or ``define_collapsing``."""

    name: str
    columns: Mapping[str, str]
    engine: Engine = field(default_factory=Engine)
    desc: str = ""
    tiers: tuple[Tier, ...] = ()
    agg: Mapping[str, str | Sequence[str]] = field(default_factory=dict)
    dims: tuple[str, ...] = ()
    cluster: tuple[str, ...] = ()
    storage: tuple[StorageTier, ...] | None = None
    auto_rollup: bool = True
    auto_purge: bool = True
    maintenance_interval_ms: int = 600_000
    rows_per_file: int = 0
    bytes_per_file: int = 0
    #: So many generations of like size are merged into one after an append; 0 turns that off.
    compact_fanout: int = 16
    #: Generations of more rows are not merged on their own.
    compact_rows: int = 5_000_000
    #: Functions that coarse tiers store besides those of ``agg`` (see ``Table.rollup_one``).
    extra: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def hint(self, column: str) -> str:
        return self.columns[column].split()[0]

    def spark_type(self, column: str) -> str:
        hint, _, kind = self.columns[column].partition(" ")
        return kind if kind else HINTS.get(hint, hint) if column != TS else "bigint"

    def fields(self) -> list[str]:
        return list(self.columns)

    def schema(self, tier: int = 0) -> T.StructType:
        """Of the stored rows, with the write order; coarse tiers have the stored parts too."""
        parts = [f"`{c}` {self.spark_type(c)}" for c in self.columns]
        if tier:
            for f, fns in all_functions(self.rolled(), self.extra).items():
                kind = self.spark_type(f)
                for c in stored_columns(f, fns):
                    parts.append(f"`{c}` {'bigint' if c.endswith(('_count', '_ts')) else kind if not c.endswith(('_sum', '_avg')) else 'double'}")
            parts = [f"`{c}` double" if (c := p.split('`')[1]) in self.rolled() and not is_multi(self.rolled()[c]) else p for p in parts]
        return T._parse_datatype_string(", ".join([*parts, f"`{SEQ}` decimal(38,0)"]))

    def rolled(self) -> dict[str, str | Sequence[str]]:
        """What is aggregated: as declared, or else sign and sum columns, or else the average of the first column."""
        if self.agg:
            return dict(self.agg)
        if self.engine.kind in ("summing", "collapsing"):
            own = [c for c in (self.engine.sign, *self.engine.sum) if c]
            if own:
                return dict.fromkeys(own, "sum")
        first = next((c for c in self.columns if c != TS), None)
        require(first is not None, "TBL_ROLLUP_NEED_FIELDS", "a column besides ts")
        return {first: "sum" if self.engine.kind in ("summing", "collapsing") else "avg"}

    def dimensions(self) -> list[str]:
        return list(self.dims) or [c for c in self.columns if c != TS and c not in self.rolled()]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Definition:
        d = json.loads(text)
        e = {k: tuple(v) if isinstance(v, list) else v for k, v in d["engine"].items()}
        d |= {"engine": Engine(**e), "tiers": tuple(Tier(**t) for t in d["tiers"]), "dims": tuple(d["dims"]), "cluster": tuple(d["cluster"])}
        d["storage"] = None if d["storage"] is None else tuple(StorageTier(**t) for t in d["storage"])
        return Definition(**d)


def check_cluster(columns: Mapping[str, str], cluster: Sequence[str]) -> tuple[str, ...]:
    require(isinstance(cluster, (list, tuple)) and bool(cluster), "DEF_CLUSTER_EMPTY", "a list of dimensions")
    for i, f in enumerate(cluster):
        require(isinstance(f, str) and f in columns, "DEF_CLUSTER_FIELD", "not a column", field=f)
        require(f != TS, "DEF_CLUSTER_TS", "time is sorted by anyway")
        require(f not in cluster[:i], "DEF_CLUSTER_DUP", "named twice", field=f)
    return tuple(cluster)


def _check(d: Definition) -> Definition:
    require(isinstance(d.name, str) and bool(d.name.strip()), "DEF_NAME_EMPTY", "a name")
    require("/" not in d.name, "DEF_NAME_SLASH", "no / in a name", name=d.name)
    require(isinstance(d.columns, Mapping), "DEF_COLUMNS_OBJECT", "a mapping of columns to types")
    require(bool(d.columns), "DEF_COLUMNS_EMPTY", "one column at least")
    columns = dict(d.columns)
    if TS not in columns:
        columns = {TS: "delta", **columns}
    for fine, coarse in zip(d.tiers, d.tiers[1:], strict=False):
        require(fine.res_ms <= coarse.res_ms and fine.ttl_ms <= coarse.ttl_ms, "DEF_TIERS_ORDER", "tiers go from fine to coarse")
    require(all(t.res_ms > 0 and t.ttl_ms > 0 for t in d.tiers), "DEF_TIERS_POSITIVE", "above 0")
    require(len(d.tiers) < 2 or bool(d.agg), "DEF_RETENTION_AGG", "what to aggregate when rows are rolled up")
    for f, fn in d.agg.items():
        require(f in columns, "DEF_AGG_FIELD", "not a column", field=f)
        fns = functions_of(fn)
        require(bool(fns) and all(x in ALL for x in fns), "DEF_AGG_FN", f"of {', '.join(ALL)}", field=f, fn=fn)
    for f in d.dims:
        require(f in columns, "DEF_DIMS_FIELD", "not a column", field=f)
    for t in d.storage or ():
        require(isinstance(t, StorageTier) and bool(t.id), "DEF_STORAGE_TIERS", "storage tiers")
    if d.cluster:
        check_cluster(columns, d.cluster)
    e = d.engine
    if e.kind != "log":
        require(bool(e.key), "DEF_KEY_EMPTY", "key columns", kind=e.kind)
        for f in e.key:
            require(f in columns, "DEF_KEY_FIELD", "not a column", field=f)
    for f in (e.version, e.sign, *e.sum):
        require(f is None or f in columns, "DEF_COLUMN_NOT_FOUND", "not a column", field=f)
    require(e.kind != "upsert" or bool(e.version), "DEF_COLUMN_NAME", "a version column")
    require(e.kind != "collapsing" or bool(e.sign), "DEF_COLUMN_NAME", "a sign column")
    require(e.kind != "summing" or bool(e.sum), "DEF_SUMMING_SUM", "columns to add up")
    return replace(d, columns=columns)


def _define(name: str, columns: Mapping[str, str], engine: Engine, retention: str | None = None, tiers: Sequence | None = None, dims: Sequence[str] | None = None, cluster: Sequence[str] | None = None, storage: Sequence[StorageTier] | bool | None = None, **rest) -> Definition:
    if tiers is not None:
        require(bool(tiers), "DEF_TIERS_EMPTY", "one tier at least")
        found = tuple(t if isinstance(t, Tier) else Tier(*t) for t in tiers)
    else:
        found = tuple(parse_retention(retention)) if retention is not None else ()
    require(dims is None or bool(dims), "DEF_DIMS_EMPTY", "one dimension at least")
    if cluster is not None and isinstance(columns, Mapping):
        check_cluster({TS: "delta", **columns}, cluster)
    kept = STORAGE_TIERS if storage is True else tuple(storage) if storage else None
    return _check(Definition(name, columns, engine, tiers=found, dims=tuple(dims or ()), cluster=tuple(cluster or ()), storage=kept, **rest))


def define_log(name: str, columns: Mapping[str, str], **rest) -> Definition:
    """Rows are kept as they come."""
    return _define(name, columns, Engine("log"), **rest)


def define_upsert(name: str, columns: Mapping[str, str], key: Sequence[str], version: str, **rest) -> Definition:
    """Of each key the row of the highest version."""
    return _define(name, columns, Engine("upsert", tuple(key), version), **rest)


def define_summing(name: str, columns: Mapping[str, str], key: Sequence[str], sum: Sequence[str], version: str | None = None, **rest) -> Definition:  # noqa: A002
    """Of each key one row with sums."""
    return _define(name, columns, Engine("summing", tuple(key), version, tuple(sum)), **rest)


def define_collapsing(name: str, columns: Mapping[str, str], key: Sequence[str], sign: str, version: str | None = None, **rest) -> Definition:
    """Rows that later ones take back."""
    return _define(name, columns, Engine("collapsing", tuple(key), version, (), sign), **rest)
