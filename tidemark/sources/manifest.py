"""What a table consists of, as numbered JSON files of which the last one counts.

A change writes new data first and then one new manifest, whole under another
name, which then gets its number: by a hard link on local files, which fails if
the number is taken, and by a rename elsewhere. HDFS and file systems like it
rename as one step and not onto a file that is there, so that of two writers one
learns that it was late. Object stores whose rename is a copy give no such
promise: there a table may have one writer at a time only.

A few of the last manifests stay for those who are reading them.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..errors import TidemarkError


class Folder:
    """Small files of a folder on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str = "") -> list[str]:
        at = self.at(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """False if the name is taken."""
        temporary = self.at(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        out = self._fs.create(temporary)
        out.write(bytearray(text.encode()))
        out.close()
        at = self.at(name)
        if self._fs.getScheme() == "file":
            local = lambda p: p.toUri().getPath()
            try:
                os.link(local(temporary), local(at))
                done = True
            except FileExistsError:
                done = False
            self._fs.delete(temporary, False)
            return done
        done = not self._fs.exists(at) and self._fs.rename(temporary, at)
        if not done:
            self._fs.delete(temporary, False)
        return done

    def size(self, name: str) -> int:
        at = self.at(name)
        return self._fs.getContentSummary(at).getLength() if self._fs.exists(at) else 0

    def delete(self, name: str) -> None:
        self._fs.delete(self.at(name), True)


@dataclass
class Generation:
    """An immutable folder of Parquet files and what is known of its rows."""

    path: str
    rows: int
    timed: int
    min_ts: int | None
    max_ts: int | None
    bytes: int = 0
    storage: str = ""
    #: Whether the engine has merged all of its rows with each other.
    merged: bool = False
    #: Of each column of numbers: how many finite ones there are, their sum, smallest and largest.
    facts: dict[str, list] = field(default_factory=dict)


@dataclass
class Manifest:
    definition: str
    commit: int = 0
    tiers: list[list[Generation]] = field(default_factory=list)
    checkpoints: dict[str, int] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    metadata: dict[str, object] = field(default_factory=dict)
    maintained: int = 0

    def text(self) -> str:
        return json.dumps(self.__dict__ | {"tiers": [[g.__dict__ for g in t] for t in self.tiers]})

    @staticmethod
    def of(text: str) -> Manifest:
        d = json.loads(text)
        return Manifest(**d | {"tiers": [[Generation(**g) for g in t] for t in d["tiers"]]})


FOLDER = "_manifest"


#: Manifests that are kept, and how many commits pass from one clearing to the next.
KEPT, CLEARED = 32, 32


def _numbered(folder: Folder, table: str) -> list[str]:
    return [n for n in folder.names(f"{table}/{FOLDER}") if n.endswith(".json") and not n.startswith(".")]


def load(folder: Folder, table: str) -> Manifest | None:
    found = _numbered(folder, table)
    return Manifest.of(folder.read(f"{table}/{FOLDER}/{found[-1]}")) if found else None


def save(folder: Folder, table: str, m: Manifest) -> None:
    """Make ``m`` the table's next version."""
    m.commit += 1
    if not folder.write_new(f"{table}/{FOLDER}/{m.commit:012d}.json", m.text()):
        raise TidemarkError("TBL_CONFLICT", "the table was changed by another writer meanwhile", commit=m.commit)
    if m.commit % CLEARED == 0:
        for n in _numbered(folder, table)[:-KEPT]:
            folder.delete(f"{table}/{FOLDER}/{n}")
