"""Nearest neighbours by inner product: a navigable small-world graph per shard.

Distinct vectors are dealt to shards by their hash. Each shard is a hierarchy of
graphs: all nodes on layer 0, about one in M of a layer's nodes on the one above.
A graph is a flat array of neighbours, a fixed number of places for each node,
-1 where there is none. A search goes down the layers from the nodes of the top
one and keeps the ``ef`` best it has seen on the way. Searches run side by side:
each step expands some nodes for every query that isn't done.

Vectors get one more component, so that all have the same length; the largest
inner product is then the nearest neighbour.

The index is a table with a row for each node and can be kept; a shard is loaded
by one task, which then streams any number of queries. Queries go to all shards,
and their results are merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace
from .vectors import dots, lists, matrix, usable

M = 16
EF_BUILD = 96
EF = 192
SHARDS = 8
#: A shard has about so many vectors at most; a larger table gets more shards.
SHARD_ROWS = 1_000_000
#: Bytes of a shard's vectors, about.
SHARD_BYTES = 256_000_000
SEED_NODES = 64


def top(sims: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest of each row, largest first."""
    if sims.shape[1] > 2 * k:
        at = np.argpartition(-sims, k, axis=1)[:, :k]
        own = np.take_along_axis(sims, at, 1)
        return np.take_along_axis(at, np.argsort(-own, axis=1, kind="stable"), 1)
    return np.argsort(-sims, axis=1, kind="stable")[:, :k]


def search_layer(x: np.ndarray, nb: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """For each query the best ``ef`` nodes that a greedy beam from its ``entry`` nodes reaches, best first; -1 where there are fewer."""
    n = len(queries)
    ids = np.full((n, ef), -1, np.int32)
    sims = np.full((n, ef), -np.inf, np.float32)
    done = np.ones((n, ef), bool)
    e = np.sort(entry, 1)
    e[:, 1:][e[:, 1:] == e[:, :-1]] = -1
    e = e[:, -ef:]
    s = np.where(e >= 0, np.einsum("bkd,bd->bk", x[e], queries), -np.inf)
    at = top(s, e.shape[1])
    ids[:, : e.shape[1]], sims[:, : e.shape[1]] = np.take_along_axis(e, at, 1), np.take_along_axis(s, at, 1)
    done[:, : e.shape[1]] = ids[:, : e.shape[1]] < 0
    live = np.arange(n)
    width = min(width, ef)
    while len(live):
        own, d = ids[live], done[live]
        first = np.argsort(d, axis=1, kind="stable")[:, :width]  # the list is sorted: its first that aren't done
        go = ~np.take_along_axis(d, first, 1)
        more = go.any(1)
        live, own, d, first, go = live[more], own[more], d[more], first[more], go[more]
        if not len(live):
            break
        rows = np.arange(len(live))[:, None]
        nodes = np.where(go, own[rows, first], -1)
        d[rows, first] = True
        found = np.where(nodes[:, :, None] >= 0, nb[nodes], -1).reshape(len(live), -1)
        found.sort(1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        fs = np.where(found >= 0, np.einsum("bkd,bd->bk", x[found], queries[live]), -np.inf)
        fs[fs <= sims[live, -1:]] = -np.inf
        # What is in the list already has an equal there.
        fs[(found[:, :, None] == own[:, None, :]).any(2)] = -np.inf
        all_s = np.concatenate([sims[live], fs], 1)
        at = top(all_s, ef)
        s = np.take_along_axis(all_s, at, 1)
        none = np.isneginf(s)
        ids[live] = np.where(none, -1, np.take_along_axis(np.concatenate([own, found], 1), at, 1))
        sims[live] = s
        done[live] = np.take_along_axis(np.concatenate([d, np.zeros_like(found, bool)], 1), at, 1) | none
    return ids, sims


def choose(x: np.ndarray, cand: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Of each row's candidates (best first) up to m neighbours: those nearer to the node than to any chosen one, then the best of the rest."""
    n, c = cand.shape
    v = x[cand]
    between = v @ v.transpose(0, 2, 1)
    taken = np.zeros((n, c), bool)
    count = np.zeros(n, np.int64)
    for t in range(c):
        near = ((between[:, t, :] > sims[:, t, None]) & taken).any(1)
        take = ~near & (cand[:, t] >= 0) & (count < m)
        taken[:, t] = take
        count += take
    order = np.argsort(np.where(taken, 0, np.where(cand >= 0, 1, 2)), axis=1, kind="stable")[:, :m]
    out = np.take_along_axis(cand, order, 1)
    return out if out.shape[1] == m else np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)


def _link(x: np.ndarray, nb: np.ndarray, sources: np.ndarray, targets: np.ndarray) -> None:
    """Enter each source among its target's neighbours, choosing anew where there is no place left."""
    places = nb.shape[1]
    order = np.argsort(targets, kind="stable")
    t, s = targets[order], sources[order]
    nodes, start, added = np.unique(t, return_index=True, return_counts=True)
    have = (nb[nodes] >= 0).sum(1)
    rank = np.arange(len(t)) - np.repeat(start, added)
    slot = np.repeat(have, added) + rank
    fits = slot < places
    over = have + added > places
    row = np.repeat(np.arange(len(nodes)), added)
    plain = fits & ~over[row]
    nb[t[plain], slot[plain]] = s[plain]
    for i in range(0, int(over.sum()), 512):
        own = np.flatnonzero(over)[i : i + 512]
        width = int((have + added)[own].max())
        cand = np.full((len(own), width), -1, np.int32)
        cand[:, :places] = nb[nodes[own]]
        place = np.full(len(nodes), -1)
        place[own] = np.arange(len(own))
        mine = place[row] >= 0
        cand[place[row[mine]], slot[mine]] = s[mine]
        sims = np.where(cand >= 0, np.einsum("bkd,bd->bk", x[cand], x[nodes[own]]), -np.inf)
        at = top(sims, min(width, 2 * places))
        nb[nodes[own]] = choose(x, np.take_along_axis(cand, at, 1), np.take_along_axis(sims, at, 1), places)


@dataclass
class Graph:
    """Nodes in insertion order (higher layers first); ``layers[l]`` has the neighbours of the first ``len`` nodes."""

    x: np.ndarray
    layers: list[np.ndarray]

    @staticmethod
    def build(vectors: np.ndarray, levels: np.ndarray, m: int = M, ef: int = EF_BUILD) -> Graph:
        """``levels`` (highest first) says up to which layer each vector goes."""
        x = lengthened(vectors)
        g = Graph(x, [])
        for level in range(int(levels.max()) if len(levels) else 0, -1, -1):
            n = int((levels >= level).sum())
            places = 2 * m if level == 0 else m
            nb = np.full((n, places), -1, np.int32)
            k = min(n, SEED_NODES)
            g._insert(nb, 0, k, np.zeros((k, 0), np.int32), m)
            while k < n:
                size = min(n - k, max(16, min(k // 2, 1024)))
                new = np.arange(k, k + size)
                entry = g.entries(x[new])
                entry = np.where(entry < k, entry, 0)  # those that aren't in this layer yet lead nowhere
                found, _ = search_layer(x, nb, x[new], entry, ef)
                g._insert(nb, k, size, found, m)
                k += size
            g.layers.insert(0, nb)
        return g

    def _insert(self, nb: np.ndarray, k: int, size: int, found: np.ndarray, m: int) -> None:
        """Link nodes k to k + size with what was found for them and with each other."""
        x, new = self.x, np.arange(k, k + size)
        among = x[new] @ x[new].T
        np.fill_diagonal(among, -np.inf)
        near = top(among, min(size, m))
        own = np.where(np.isneginf(np.take_along_axis(among, near, 1)), -1, near + k).astype(np.int32)
        cand = np.concatenate([found.astype(np.int32), own], 1)
        sims = np.where(cand >= 0, np.einsum("bkd,bd->bk", x[cand], x[new]), -np.inf)
        at = top(sims, cand.shape[1])
        cand, sims = np.take_along_axis(cand, at, 1), np.take_along_axis(sims, at, 1)
        cand = np.where(np.isneginf(sims), -1, cand)
        chosen = choose(x, cand, sims, min(m, cand.shape[1]))
        for i in range(0, size, 1024):
            c = chosen[i : i + 1024]
            nb[new[i : i + 1024], : c.shape[1]] = c
        src, dst = np.repeat(new, chosen.shape[1]), chosen.ravel()
        good = dst >= 0
        src, dst = src[good], dst[good]
        known = (nb[dst] == src[:, None]).any(1)
        _link(x, nb, src[~known].astype(np.int32), dst[~known])

    def entries(self, queries: np.ndarray, lowest: int = 0) -> np.ndarray:
        """Where a search below layer ``lowest`` starts: the best that this layer and those above lead to."""
        e = np.zeros((len(queries), 1), np.int32)
        for nb in reversed(self.layers[lowest:]):
            e = search_layer(self.x, nb, queries, e, 8)[0][:, :4]
        return e

    def search(self, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        q = np.concatenate([queries, np.zeros((len(queries), 1), np.float32)], 1).astype(np.float32)
        return search_layer(self.x, self.layers[0], q, self.entries(q, 1), min(ef, len(self.x)))


def lengthened(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    square = (v * v).sum(1)
    return np.concatenate([v, np.sqrt(np.maximum(square.max(initial=0) - square, 0))[:, None]], 1).astype(np.float32)


def levels_of(n: int, m: int = M, seed: int = 7) -> np.ndarray:
    """Random top layers of n nodes, highest first."""
    u = np.random.default_rng(seed).random(n)
    return -np.sort(-np.floor(-np.log(1 - u) / np.log(m)).astype(np.int64))


INDEX = "shard int, dim int, node int, level int, ids array<long>, vector array<float>, neighbours array<array<int>>"


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, shards: int | None = None) -> DataFrame:
    """A row for each distinct usable vector: its shard and place, its smallest k + 1 ids, its neighbours on each layer.

    Vectors that are null, zero, or hold null or non-finite components, and rows
    without an id, take no part; rows of one id and vector are one. Vectors of
    different lengths stand in graphs of their own. An empty table has no rows.
    """
    spark = vectors.sparkSession
    space = Workspace(spark, "hnsw")
    rows = vectors.where(F.col(id_col).isNotNull()).where(usable(vector_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))
    few = rows.distinct().withColumn("r", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("r") <= k + 1)
    nodes = space.keep(few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")), "nodes")
    if not shards:
        count, numbers = nodes.agg(F.count("*"), F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0))).first()
        shards = max(SHARDS, -(-count // SHARD_ROWS), -(-4 * numbers // SHARD_BYTES))
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int")).withColumn("draw", F.xxhash64("vector", F.lit(1)))
    dealt = nodes.repartitionById(shards, F.col("shard")).sortWithinPartitions("draw", F.element_at("ids", 1)).select("shard", "ids", "vector", F.size("vector").alias("dim"))

    def run(batches):
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        shard = table.column("shard")[0].as_py()
        dims = np.asarray(table.column("dim"))
        for dim in np.unique(dims).tolist():
            own = table.take(pa.array(np.flatnonzero(dims == dim))).combine_chunks()
            x = matrix(own.column("vector").combine_chunks(), np.float32)
            level = levels_of(len(x))
            g = Graph.build(x, level)
            for i in range(0, len(x), 4096):
                upto = min(len(x), i + 4096)
                near = [[g.layers[v][j][g.layers[v][j] >= 0].tolist() for v in range(level[j] + 1)] for j in range(i, upto)]
                n = upto - i
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * n, pa.int32()), pa.array([dim] * n, pa.int32()), pa.array(range(i, upto), pa.int32()), pa.array(level[i:upto], pa.int32()), own.column("ids").combine_chunks()[i:upto], own.column("vector").combine_chunks()[i:upto], pa.array(near, pa.list_(pa.list_(pa.int32())))],
                    [x.split()[0] for x in INDEX.split(", ")],
                )

    return dealt.mapInArrow(run, INDEX)


def _graph(rows: list[pa.RecordBatch]) -> dict[int, tuple[Graph, list[list[int]]]]:
    """The graphs of a shard by vector length, from its index rows."""
    t = pa.Table.from_batches(rows)
    dims, out = np.asarray(t.column("dim")), {}
    for dim in np.unique(dims).tolist():
        own = t.take(pa.array(np.flatnonzero(dims == dim))).combine_chunks()
        own = own.take(pa.array(np.argsort(np.asarray(own.column("node")), kind="stable"))).combine_chunks()
        x = matrix(own.column("vector").combine_chunks(), np.float32)
        level = np.asarray(own.column("level"))
        layers = []
        near = own.column("neighbours").combine_chunks()
        per_node, flat = near.flatten(), near.flatten().flatten()
        size = np.diff(np.asarray(per_node.offsets)) if len(per_node) else np.zeros(0, np.int64)
        begin = np.cumsum(size) - size
        first = np.cumsum(level + 1) - (level + 1)
        flat = np.asarray(flat)
        for v in range(int(level.max()) + 1):
            nodes = np.flatnonzero(level >= v)
            s, b = size[first[nodes] + v], begin[first[nodes] + v]
            nb = np.full((len(nodes), 2 * M if v == 0 else M), -1, np.int32)
            row = np.repeat(np.arange(len(nodes)), s)
            col = np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s)
            nb[row, col] = flat[np.repeat(b, s) + col]
            layers.append(nb)
        out[dim] = (Graph(lengthened(x), layers), x, own.column("ids").to_pylist())
    return out


def search_index(index: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, ef: int = EF) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, other rows than its own, nearest first, ties to the smaller id.

    ``index`` should be kept, with at least k + 1 ids for each vector. Queries that are not usable
    vectors find nothing. Of vectors of equal score more than ``ef`` may be near a
    query; then those that a graph's search has come by are ranked, not all of them.
    """
    shards = index.agg(F.coalesce(F.max("shard") + 1, F.lit(1))).first()[0]
    q = queries.where(F.col(id_col).isNotNull()).where(usable(vector_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector")).distinct()
    q = q.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    empty = {"node": "int", "level": "int", "ids": "array<long>", "neighbours": "array<array<int>>"}
    q = q.select("shard", F.size("vector").alias("dim"), *[F.lit(None).cast(t).alias(c) for c, t in empty.items()], "vector", F.col("id").alias("query"))
    both = index.withColumn("query", F.lit(None).cast("long")).unionByName(q)
    dealt = both.repartitionById(shards, F.col("shard")).sortWithinPartitions(F.col("query").isNotNull(), "node")

    def run(batches):
        rows, graphs = [], None
        for batch in batches:
            asked = np.asarray(batch.column("query").is_valid())
            here = int((~asked).sum())
            if here:
                rows.append(batch.slice(0, here))
            if here == batch.num_rows:
                continue
            if graphs is None:
                graphs, rows = _graph(rows) if rows else {}, []
            batch = batch.slice(here)
            dims = np.asarray(batch.column("dim"))
            for dim, (g, x, ids) in graphs.items():
                own = batch.filter(pa.array(dims == dim))
                for i in range(0, own.num_rows, 256):
                    part = own.slice(i, 256)
                    yield _answers(g, x, ids, np.asarray(part.column("query")), matrix(part.column("vector"), np.float32), k, ef)

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answers(g: Graph, x: np.ndarray, ids: list[list[int]], query: np.ndarray, v: np.ndarray, k: int, ef: int) -> pa.RecordBatch:
    found, _ = g.search(v, max(ef, k + 1))
    exact = np.where(found >= 0, dots(x[found], v[:, None, :]), -np.inf)
    out = []
    for own, nodes, scores in zip(query.tolist(), found.tolist(), exact.tolist(), strict=True):
        near = sorted((-s, i) for node, s in zip(nodes, scores, strict=True) if node >= 0 for i in ids[node] if i != own)
        out += [(own, i, -s) for s, i in near[:k]]
    a, b, c = zip(*out, strict=True) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["query_id", "vec_id", "score"])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    index = Workspace(spark, "index").keep(build_index(vectors), "nodes")
    return search_index(index, vectors.where(F.col("vec_id") % 20 == 0))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
