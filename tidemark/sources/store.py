"""A store: tables below one folder, on any file system that Spark knows."""

from __future__ import annotations

import weakref
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ..errors import require
from ..plans import sql as dialect
from . import manifest
from .definitions import Definition, define_log
from .manifest import Folder, Manifest
from .table import Table


class Store:
    def __init__(self, spark: SparkSession, root: str, now: Callable[[], int] | None = None):
        self.spark, self.folder, self._now = spark, Folder(spark, root), now
        self._opened: list[weakref.ref[Table]] = []

    def create(self, definition: Definition) -> Table:
        """The table of this definition. If it is there already it is opened, and columns that are new are added to it."""
        m = manifest.load(self.folder, definition.name)
        if m is None:
            m = Manifest(definition.to_json(), tiers=[[] for _ in range(max(1, len(definition.tiers)))])
            manifest.save(self.folder, definition.name, m)
        else:
            old = Definition.from_json(m.definition)
            if list(definition.columns) != list(old.columns) and set(old.columns) <= set(definition.columns):
                m.definition = replace(definition, extra=old.extra).to_json()
                manifest.save(self.folder, definition.name, m)
        return self.open(definition.name)

    def open(self, name: str) -> Table:
        """A table by name; Parquet files that have no manifest are taken in as a log table."""
        if manifest.load(self.folder, name) is None:
            found = [x for x in self.folder.names(name) if not x.startswith(("_", "."))]
            require(bool(found), "STO_TABLE_NOT_FOUND", "no such table", name=name)
            df = self.spark.read.parquet(f"{self.folder.root}/{name}")
            self.create(define_log(name, {c: f"auto {t}" for c, t in df.dtypes})).append(df)
        t = Table(self.spark, self.folder, name, self._now)
        self._opened = [r for r in self._opened if r() is not None] + [weakref.ref(t)]
        return t

    def close_all(self) -> None:
        """Close every table that this store has opened."""
        for r in self._opened:
            if (t := r()) is not None:
                t.close()
        self._opened = []

    def tables(self) -> list[str]:
        return [n for n in self.folder.names() if manifest.load(self.folder, n) is not None]

    def engine_of(self, name: str) -> str:
        return self.open(name).definition.engine.kind

    def describe(self) -> list[dict]:
        """What the tables are for and what is in them, from their manifests alone."""
        out = []
        for n in self.tables():
            t = self.open(n)
            s = t.stats()
            out.append({"name": n, "engine": t.definition.engine.kind, "desc": t.definition.desc, "columns": dict(t.definition.columns), "rows": sum(x["rows"] for x in s), "bytes": sum(x["bytes"] for x in s), "tiers": len(s)})
        return out

    def stats(self) -> dict:
        own = self.describe()
        return {"tables": len(own), "rows": sum(d["rows"] for d in own), "bytes": sum(d["bytes"] for d in own)}

    def sql(self, text: str) -> DataFrame | int:
        """Run a statement on the table that it names."""
        statement = dialect.parse(text)
        return self.open(statement.table).run(statement)

    def clear_cache(self) -> None:
        self.spark.catalog.clearCache()

    def drop(self, name: str) -> None:
        self.folder.delete(name)
