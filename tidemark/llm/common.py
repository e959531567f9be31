"""What the corpus operators share: the cluster's shared folder, tables kept in it, null-safe ids."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a missing id where ids are ordered: after every real one.
NO_ID = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session may go without that setting (as in tests): it gets a
    temporary folder, which goes when Python ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def _clear(jvm, root: str) -> None:
    """Delete a folder, if the JVM still answers."""
    try:
        at = jvm.org.apache.hadoop.fs.Path(root)
        at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
    except Exception:  # noqa: BLE001  the driver ends anyway
        pass


class Workspace:
    """Parquet tables and files of one operator run, below the shared folder.

    ``keep`` cuts lineage: what it returns is read from files that outlive any
    executor. What a lazily returned result still reads must stay; the rest goes
    with ``drop``, and all that is left when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(_clear, spark.sparkContext._jvm, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write ``df`` (partitioned by column ``by``) and read it back."""
        out = df.write.mode("overwrite")
        (out.partitionBy(by) if by else out).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_width(spark: SparkSession) -> int:
    """How many partitions a keyed exchange gets in this session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ordered_id(name: str) -> Column:
    """An id column as a long in which a missing id comes last."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that no column of ``df`` has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def tidy(run):
    """The same work on batches; at its end, memory that the task had is handed back to the system, since the worker lives on for other tasks."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not this C library
                pass

    return inner
