"""Line dedup against levelled sorted runs of line hashes.

A run is a table of (line hash, owner), bucketed by the hash and sorted within
each bucket, in the shared folder. Runs of a store never share a hash. A new
batch of documents is reduced to one row per hash, sorted, and merge-joined with
every run (the runs are neither shuffled nor sorted again: a bucket is one file
that lies as the join needs it), and what no run holds becomes a new run of level 0. Once a level holds ``fanout`` runs they are
merged into one run of the next level, so that n batches leave O(log n) runs.

Batches must come in ascending order of document id if the smallest id is to own
a line, as ``dedup_lines`` does it; in a feed, the earliest batch owns.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, as_bytes, fresh_name, ordered_id, shuffle_width, tidy

#: White space that is stripped from a line: space and the ASCII controls 09 to 0D.
BLANK = b" \t\n\x0b\x0c\r"
MIN_KEY = 10


def line_key(line: bytes) -> bytes:
    """A line without white space at its ends, A-Z lower-cased, other letters as they are."""
    return line.strip(BLANK).lower()


def line_hash(key: bytes, least: int = MIN_KEY) -> bytes | None:
    """128 bits of a key, or None if it has fewer than ``least`` code points."""
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return xxhash.xxh3_128_digest(key)


@contextmanager
def in_order(spark: SparkSession, buckets: int):
    """Within this, plans take a bucket of one file to be in its order, and exchanges have as many partitions as there are buckets."""
    held = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.shuffle.partitions": str(buckets)}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class LineRuns:
    """The levelled store. Tables are bucketed, with their files in the shared folder; ``close`` deletes them."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, max(2, fanout)
        self.space = Workspace(spark, "runs")
        self.buckets = shuffle_width(spark)
        self.name = f"tidemark_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.made = 0

    def _write(self, df: DataFrame) -> str:
        self.made += 1
        name = f"{self.name}_{self.made}"
        with in_order(self.spark, self.buckets):
            df.write.bucketBy(self.buckets, "h").sortBy("h").format("parquet").option("path", self.space.path(name)).saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.space.drop(name)

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def run(self, name: str) -> DataFrame:
        return self.spark.table(name).where("fresh").select("h", "owner")

    def compact(self) -> None:
        """Merge every level that is full into one run of the next; a merge is a full outer merge join of disjoint keys."""
        k = 0
        while k < len(self.levels):
            full = self.levels[k]
            if len(full) >= self.fanout:
                merged = self.run(full[0])
                for name in full[1:]:
                    other = self.run(name).withColumnRenamed("owner", "other")
                    merged = merged.join(other.hint("merge"), "h", "full").select("h", F.coalesce("owner", "other").alias("owner"))
                name = self._write(merged.select("h", "owner", F.lit(True).alias("fresh"), F.lit(False).alias("shared")))
                self._drop(full)
                self.levels[k] = []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(name)
            k += 1

    def ingest(self, lines: DataFrame) -> DataFrame:
        """Take a batch of (h, k): the hash of a line, the id of a document that holds it.

        Returns (h, owner) of those hashes that more than one document has had so
        far, and adds the hashes that no run has.
        """
        self.compact()
        batch = lines.groupBy("h").agg(F.min("k").alias("first"), F.max("k").alias("last"))
        if not self.runs():
            batch = batch.repartition(self.buckets, "h")
        owner, seen = F.col("first"), F.lit(False)
        for i, name in enumerate(self.runs()):
            batch = batch.join(self.run(name).withColumnRenamed("owner", f"o{i}").hint("merge"), "h", "left")
            owner, seen = F.coalesce(F.col(f"o{i}"), owner), seen | F.col(f"o{i}").isNotNull()
        found = batch.select("h", owner.alias("owner"), (~seen).alias("fresh"), (owner < F.col("last")).alias("shared"))
        name = self._write(found)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        return self.spark.table(name).where("shared").select("h", "owner")

    def close(self) -> None:
        """Delete all runs, also after an ingest that failed half-way."""
        self._drop([f"{self.name}_{k + 1}" for k in range(self.made)])
        self.levels = []


def _lines(batches):
    schema = pa.schema([("h", pa.binary()), ("k", pa.int64()), ("b", pa.int32())])
    for batch in batches:
        hs, ks, bs = [], [], []
        for text, k, b in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            own = {h for line in (text or b"").split(b"\n") if (h := line_hash(line_key(line))) is not None}
            hs += own
            ks += [k] * len(own)
            bs += [b] * len(own)
            if len(hs) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(hs, pa.binary()), pa.array(ks, pa.int64()), pa.array(bs, pa.int32())], schema=schema)
                hs, ks, bs = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(hs, pa.binary()), pa.array(ks, pa.int64()), pa.array(bs, pa.int32())], schema=schema)


def _kept(names):
    """The last two columns (text, hashes to drop) give way to the number of lines, that of dropped ones, and the kept text."""

    def run(batches):
        for batch in batches:
            n = batch.num_columns - 2
            lines, dropped, kept = [], [], []
            for text, drop in zip(as_bytes(batch.column(n)), batch.column(n + 1).to_pylist(), strict=True):
                own = (text or b"").split(b"\n")
                lines.append(len(own))
                if drop:
                    gone = set(drop)
                    own = [x for x in own if line_hash(line_key(x)) not in gone]
                dropped.append(lines[-1] - len(own))
                kept.append(b"\n".join(own))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [*batch.schema.names[:n], *names])

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 4, fanout: int = 2) -> DataFrame:
    """Drop every line (of a key of 10 code points or more) that a document of smaller id holds too.

    Returns the columns of ``docs`` but the text, then ``n_lines`` (before), ``n_dropped``
    and ``kept_text`` (underscores are added to these names if ``docs`` has them).

    Documents enter the store in ``batches`` ranges of their id. Null or empty
    text is one empty line. Rows of one id are one document; rows without an id
    are together one document that comes after all others. A line that only one
    document repeats stays. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "lines")
    k, b, drop = (fresh_name(docs, x) for x in ("_k", "_b", "_drop"))
    parts = [F.lit(i / batches) for i in range(1, batches)]
    found = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), F.array(*parts), F.lit(1000))).first()[0] if parts else None
    cuts = sorted(set(found or ()))
    number = F.lit(0)
    for cut in cuts:
        number = number + (ordered_id(id_col) > cut).cast("int")
    lines = docs.select(F.col(text_col).alias("text"), ordered_id(id_col).alias("k"), number.alias("b")).mapInArrow(tidy(_lines), "h binary, k long, b int")
    lines = space.keep(lines, "lines", by="b")
    store, shared = LineRuns(spark, fanout=fanout), []
    try:
        for i in range(len(cuts) + 1):
            shared.append(space.keep(store.ingest(lines.where(F.col("b") == i).select("h", "k")), f"shared-{i}").withColumn("b", F.lit(i)))
    finally:
        store.close()
    owners = shared[0]
    for more in shared[1:]:
        owners = owners.unionByName(more)
    gone = lines.join(owners, ["h", "b"]).where(F.col("k") != F.col("owner")).groupBy(F.col("k").alias(k)).agg(F.collect_list("h").alias(drop))
    rest = [c for c in docs.columns if c != text_col]
    names = [fresh_name(docs, x) for x in ("n_lines", "n_dropped", "kept_text")]
    both = docs.withColumn(k, ordered_id(id_col)).join(gone, k, "left").select(*rest, text_col, drop)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col] + [f"`{names[0]}` long", f"`{names[1]}` long", f"`{names[2]}` string"])
    return both.mapInArrow(tidy(_kept(names)), schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = """
WITH l AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), k AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), o AS (
  SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
)
SELECT k.doc_id AS doc_id, count(*) AS n_lines,
       CAST(count(*) FILTER (WHERE o.owner <> k.doc_id) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.owner IS NULL OR o.owner = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN o ON k.key = o.key
GROUP BY k.doc_id
"""
