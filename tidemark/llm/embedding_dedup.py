"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Vectors are centred, projected on their principal components and rotated so that
the signs of the components lose as little as possible; the signs are the code.
Several rotations, from different starts, make a longer code. The code is cut
into chunks, and each chunk is the key of a hash table: near vectors differ in
few bits and so agree in whole chunks. Of a small bucket only those go on whose
whole codes lie within a Hamming distance of each other; then all pairs in a
bucket are compared by the cosine of the original vectors.

A pair that meets in several tables counts in the first one only, so links are
counted without being listed. A large bucket is dealt out in pairs of blocks.
Equal vectors are compared once, with their number.
"""

from __future__ import annotations

from math import acos, ceil, log, log1p, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, shuffle_width
from .graph import components
from .vectors import lists, matrix, usable

COSINE = 0.95
#: Tables at least; wide chunks have more.
TABLES = 18
#: How likely a pair at the least cosine meets in some table, at any number of vectors.
MEETING = 0.995
#: Vectors that rotations are learned from, at most (about); chosen by hash.
SAMPLE = 10_000
ROUNDS = 30
#: A bucket of more vectors is cut into blocks of about so many.
BLOCK = 512
#: In buckets of so many vectors at most codes are compared first.
SMALL = 32
#: The share of bits in which codes may differ there. A pair at cosine 0.95 differs in a tenth of them, unrelated ones in half.
RADIUS = 0.4


def rotations(x: np.ndarray, bits: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The mean of a sample and the columns that give at least ``bits`` code bits, a rotation of all components at a time."""
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    c = x - mean
    axes = np.linalg.eigh(c.T @ c)[1][:, ::-1]
    v, out, rng = c @ axes, [], np.random.default_rng(seed)
    d = x.shape[1]
    for _ in range(ceil(bits / d)):
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(ROUNDS):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out.append(axes @ r)
    return mean, np.concatenate(out, 1)[:, :bits]


def code_shape(count: int, cosine: float, tables: int = TABLES) -> tuple[int, int]:
    """The width of a chunk and the number of tables for ``count`` vectors.

    Two directions differ in a sign with a chance of their angle over pi, so a
    chunk of a pair at ``cosine`` is equal with the power of its width; there are
    as many tables as ``MEETING`` takes with chunks that are equal independently.
    """
    width = max(4, min(60, ceil(log2(max(count, 2) / 2))))
    equal = min((1 - acos(max(-1.0, min(1.0, cosine))) / pi) ** width, 1 - 1e-12)
    return width, max(tables, ceil(log(1 - MEETING) / log1p(-equal)))


def chunk_keys(x: np.ndarray, mean: np.ndarray, columns: np.ndarray, tables: int) -> np.ndarray:
    """The code of each row in ``tables`` chunks, as numbers."""
    return _keys((x - mean) @ columns >= 0, tables)


def _keys(bits: np.ndarray, tables: int) -> np.ndarray:
    bits = bits.reshape(len(bits), tables, -1)
    return bits @ (1 << np.arange(bits.shape[2], dtype=np.int64))


def _packed(column: pa.Array) -> np.ndarray:
    """A column of codes (binary, all of one length) as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _unpacked(column: pa.Array, tables: int, width: int) -> np.ndarray:
    return _keys(np.unpackbits(_packed(column), axis=1)[:, : tables * width].astype(bool), tables)


def _near_codes(radius: int):
    """Small buckets in order (id, code, table, bucket) to those of their rows that have a code within ``radius`` bits in the bucket."""

    def work(rows: pa.Table):
        code = _packed(rows.column("code").combine_chunks())
        table, bucket = np.asarray(rows.column("table")), np.asarray(rows.column("bucket"))
        group = np.concatenate([[0], np.cumsum((table[1:] != table[:-1]) | (bucket[1:] != bucket[:-1]))])
        near = np.zeros(len(group), bool)
        for step in range(1, int(np.bincount(group).max())):
            i = np.flatnonzero(group[:-step] == group[step:])
            i = i[np.bitwise_count(code[i] ^ code[i + step]).sum(1, dtype=np.int64) <= radius]
            near[i] = near[i + step] = True
        yield from rows.select(["id", "table", "bucket"]).filter(pa.array(near)).to_batches()

    return _by_group(work, ("table", "bucket"))


def _first_meeting(keys: np.ndarray, i: np.ndarray, j: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether pairs of rows have no equal key in a table before theirs."""
    before = np.arange(keys.shape[1])[None, :] < table[:, None]
    return ~((keys[i] == keys[j]) & before).any(1)


def _pairs(group: np.ndarray, block: np.ndarray, gi: np.ndarray, gj: np.ndarray, unit: np.ndarray, keys: np.ndarray, table: np.ndarray, cosine: float):
    """Linked pairs (i, j) of rows that lie next to each other by group and meet here first."""
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.concatenate([start, [len(group)]]))
    small = size <= 32
    most = int(size[small].max(initial=0))
    left, right = [], []
    in_small = np.repeat(small, size)
    for step in range(1, most):
        i = np.flatnonzero((group[:-step] == group[step:]) & in_small[:-step])
        j = i + step
        near = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
        left.append(i[near])
        right.append(j[near])
    for s, n in zip(start[~small].tolist(), size[~small].tolist(), strict=True):
        for k in range(s, s + n, 1024):
            upto = min(s + n, k + 1024)
            i, j = np.nonzero(unit[k:upto] @ unit[s : s + n].T >= cosine)
            i, j = i + k, j + s
            left.append(i[i < j])
            right.append(j[i < j])
    i = np.concatenate(left) if left else np.zeros(0, np.int64)
    j = np.concatenate(right) if right else np.zeros(0, np.int64)
    # In a pair of different blocks, only pairs across them.
    across = (gi[i] == gj[i]) | (block[i] != block[j])
    i, j = i[across], j[across]
    first = _first_meeting(keys, i, j, table[i])
    return i[first], j[first]


def _links(cosine: float, tables: int, width: int):
    """Groups of rows in order to (id, n, to): how many vectors an id links with here, and an id that it hangs together with."""

    def work(rows: pa.Table):
        t = [rows.column(c).combine_chunks() for c in ("id", "n", "code", "vector", "table", "block", "gi", "gj", "bucket")]
        ids, n, table, block, gi, gj, bucket = (np.asarray(t[k]) for k in (0, 1, 4, 5, 6, 7, 8))
        keys, unit = _unpacked(t[2], tables, width), matrix(t[3])
        unit = unit / np.sqrt((unit * unit).sum(1, keepdims=True))
        change = (bucket[1:] != bucket[:-1]) | (table[1:] != table[:-1]) | (gi[1:] != gi[:-1]) | (gj[1:] != gj[:-1])
        group = np.concatenate([[0], np.cumsum(change)])
        i, j = _pairs(group, block, gi, gj, unit, keys, table, cosine)
        if not len(i):
            return
        who, at = np.unique(np.concatenate([ids[i], ids[j]]), return_inverse=True)
        count = np.bincount(at, np.concatenate([n[j], n[i]]), len(who)).astype(np.int64)
        a, b = at[: len(i)], at[len(i) :]
        root = np.arange(len(who))
        while True:  # the smallest place that links lead to
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(count), pa.array(who[root])], ["id", "n", "to"])

    return _by_group(work, ("table", "bucket", "gi", "gj"))


def _by_group(work, names: tuple[str, ...]):
    """``work`` on some whole groups of rows at a time, of rows that lie in the order of ``names``."""

    def run(batches):
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size < 8192:
                continue
            whole = pa.concat_tables(held)
            mark = [np.asarray(whole.column(c)) for c in names]
            last = np.flatnonzero(np.logical_or.reduce([m[1:] != m[:-1] for m in mark]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
            if cut:
                yield from work(whole.slice(0, cut))
            held, size = [whole.slice(cut)], len(whole) - cut
        if size:
            yield from work(pa.concat_tables(held))

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, tables: int = TABLES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``.

    ``n_links`` counts the other rows whose cosine, in double precision, is at
    least ``cosine``; equal vectors are links too. ``component_id`` is the
    smallest id that links lead to and ``kept`` whether that is its own. Vectors
    that are null, zero, or hold null or non-finite components, and rows without
    an id, link with nothing and are kept (without an id the component is null).
    Vectors of different lengths don't link. An empty table gives an empty one.

    The width of a chunk follows the number of distinct vectors (its logarithm),
    so that a bucket of unrelated vectors stays small at any size. The number of
    tables (``tables`` at least) grows with it, so that a pair at ``cosine`` meets
    with a chance of about ``MEETING`` at any size, more alike ones with a higher.
    """
    spark = vectors.sparkSession
    space = Workspace(spark, "itq")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("vector"))
    real = rows.where(F.col("vec_id").isNotNull() & usable("vector"))
    same = space.keep(real.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "distinct")
    found = None
    for r in same.groupBy(F.size("vector").alias("dim")).count().collect():  # lengths of vectors: normally one
        own = same.where(F.size("vector") == r["dim"])
        links = _of_one_length(own, r["dim"], r["count"], cosine, tables, space)
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = spark.createDataFrame([], "id long, n long, to long")
    found = space.keep(found, "links")
    counts = found.groupBy("id").agg(F.sum("n").alias("links"))
    root = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")), space)
    known = same.select("vector", F.col("id").alias("rep"), F.col("n")).join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(root.withColumnRenamed("id", "rep"), "rep", "left")
    known = space.keep(known.select("vector", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id")), "known")
    out = real.join(known, "vector").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    rest = rows.where(~(F.col("vec_id").isNotNull() & usable("vector"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(rest)


def _of_one_length(same: DataFrame, dim: int, count: int, cosine: float, tables: int, space: Workspace) -> DataFrame:
    spark = same.sparkSession
    share = min(1.0, SAMPLE / count)
    draw = F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) / float(1 << 30)
    sample = np.array(sorted(tuple(r[0]) for r in same.where(draw < share).select("vector").collect()), np.float64).reshape(-1, dim)
    sample /= np.sqrt((sample * sample).sum(1, keepdims=True))
    width, tables = code_shape(count, cosine, tables)
    mean, columns = rotations(sample, width * tables)

    def code(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(2))
                bits = (x / np.sqrt((x * x).sum(1, keepdims=True)) - mean) @ columns >= 0
                packed = pa.array([r.tobytes() for r in np.packbits(bits, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, packed, lists(_keys(bits, tables), pa.int64())], ["id", "n", "vector", "code", "keys"])

    coded = space.keep(same.select("id", "n", "vector").mapInArrow(code, "id long, n long, vector array<float>, code binary, keys array<long>"), f"coded-{dim}")
    entries = coded.select("id", "code", F.posexplode("keys").alias("table", "bucket"))
    sizes = space.keep(entries.groupBy("table", "bucket").agg(F.count("*").alias("size")).where("size > 1"), f"sizes-{dim}")
    # Where an id goes: its buckets that aren't its own, and in a large one to each pair of blocks with its own block.
    all_met, whole = entries.join(sizes, ["table", "bucket"]), ["table", "bucket"]
    few = all_met.where(F.col("size") <= SMALL).select("id", "code", "table", "bucket").repartition(shuffle_width(spark), *whole).sortWithinPartitions(*whole)
    few = few.mapInArrow(_near_codes(int(RADIUS * width * tables)), "id long, table int, bucket long").withColumn("size", F.lit(1).cast("long"))
    live = few.unionByName(all_met.where(F.col("size") > SMALL).select("id", "table", "bucket", "size"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id", "table"), F.col("blocks")).cast("int")
    met = live.withColumn("blocks", blocks).withColumn("block", mine)
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("id", "table", "bucket", "block", F.least("block", "other").alias("gi"), F.greatest("block", "other").alias("gj"))
    met = met.join(coded.drop("keys"), "id").select("id", "n", "code", "vector", "table", "bucket", "block", "gi", "gj")
    by = ["table", "bucket", "gi", "gj"]
    dealt = met.repartition(shuffle_width(spark), *by).sortWithinPartitions(*by)
    return dealt.mapInArrow(_links(cosine, tables, width), "id long, n long, to long").groupBy("id", "to").agg(F.sum("n").alias("n")).select("id", "n", "to")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), r(id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.other = l.a
), c AS (
  SELECT id, min(other) AS component_id FROM r GROUP BY id
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = c.id LEFT JOIN n ON vec_id = n.a
"""
