"""Near-duplicate documents by order MinHash, verified by banded alignment.

A text is the sequence of its five-word shingles (words: runs without white
space, in lower case). Each shingle is labelled with its occurrence number, so
repeats count. A sketch samples the few labelled shingles that come first in a
random order and keeps them in the order of the text; texts share it in
proportion to how much of one stands in the other in the same order. Texts that
share a sketch form a bucket, and every pair of a bucket is compared unless it
hangs together by other links already. Buckets all of whose members lie in
another bucket too are left to that one.

A bucket of many texts is cut into blocks. First the texts of each block are
compared with each other and with the bucket's leader, the text whose sketches
most others share; where a bucket then still holds several components, the pairs
across them are compared, in pairs of blocks. A pair is aligned only if it has
enough labelled shingles in common, whatever their order; these are counted for
all pairs of a block at once.

The similarity of two texts is c / (n + m - c) for n and m shingles of which c
can be aligned in order (their longest common subsequence); for texts that keep
their order this is the Jaccard similarity of their shingles. Only alignments in
a band as wide as the similarity allows are looked at.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, fresh_name, shuffle_width, tidy
from .graph import components

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 12
SAMPLED = 3
#: A bucket of more texts, or of more shingles, is cut into blocks of about so many.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
_SLICE = 2_000_000


@lru_cache(maxsize=1)
def _constants():
    rng = np.random.default_rng(20240229)
    draw = lambda n: rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    return {"byte": draw(256), "place": draw(1 << 16), "word": draw(SHINGLE), "sketch": draw(SKETCHES), "sampled": draw(SAMPLED), "repeat": draw(1)[0], "short": draw(SHINGLE + 1)}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a hash's bits (a fixed bijection of 64-bit numbers)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """A 64-bit hash of each word of each text."""
    c, out, k = _constants(), [], 0
    while k < len(texts):
        raws, size = [], 0
        while k < len(texts) and (not raws or size + len(texts[k]) < _SLICE):
            raws.append(texts[k].lower().encode("utf-8", "replace"))
            size += len(raws[-1]) + 1
            k += 1
        b = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
        blank = _BLANK[b]
        edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(starts):
            out += [np.zeros(0, np.uint64)] * len(raws)
            continue
        place = np.arange(len(b)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(b)]])))
        v = c["byte"][b] * c["place"][place & 0xFFFF]
        v[blank] = 0
        h = mix(np.add.reduceat(v, starts) + (ends - starts).astype(np.uint64))
        after = np.cumsum([len(r) + 1 for r in raws])
        out += np.split(h, np.searchsorted(starts, after[:-1]))
    return out


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five words; of all words as one run if there are fewer."""
    c = _constants()["word"]
    n = len(words)
    if n == 0:
        return words
    if n < SHINGLE:
        return mix((words * c[:n]).sum(dtype=np.uint64, keepdims=True) + _constants()["short"][n])
    h = words[: n - SHINGLE + 1] * c[0]
    for j in range(1, SHINGLE):
        h = h + words[j : n - SHINGLE + 1 + j] * c[j]
    return mix(h)


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingles told apart by how many equal ones stand before them; the first of equal ones stays as it is, so that texts with and without repeats agree."""
    order = np.argsort(s, kind="stable")
    run = s[order]
    same = np.concatenate([[False], run[1:] == run[:-1]])
    if not same.any():
        return s
    at = np.arange(len(s))
    number = at - np.maximum.accumulate(np.where(same, 0, at))
    out = s.copy()
    again = number > 0
    out[order[again]] = mix(run[again] + number[again].astype(np.uint64) * _constants()["repeat"])
    return out


def sketches(s: np.ndarray) -> np.ndarray:
    """The order sketches of a shingle sequence."""
    c = _constants()
    own = labelled(s)
    take = min(SAMPLED, len(own))
    if take == len(own):
        at = np.broadcast_to(np.arange(take), (SKETCHES, take))
    elif len(own) * SKETCHES > 4_000_000:
        at = np.stack([np.sort(np.argpartition(own * a, take - 1)[:take]) for a in c["sketch"]])
    else:
        at = np.sort(np.argpartition(own * c["sketch"][:, None], take - 1, axis=1)[:, :take], axis=1)
    return mix((own[at] * c["sampled"][:take]).sum(1, dtype=np.uint64) + c["sketch"])


def whole_hash(words: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(words.tobytes())


def least_common(n: int, m: int, similarity: float = SIMILARITY) -> int:
    """How many of n and m shingles must align for the similarity."""
    return int(np.ceil(similarity * (n + m) / (1 + similarity) - 1e-9))


def aligned(a: np.ndarray, b: np.ndarray, need: int) -> int:
    """The length of the longest common subsequence, if it reaches ``need``; else something below ``need``.

    Common ends are cut off. The rest is aligned bit-parallel: a bit for a place
    of a tells whether the best alignment of what was read of b grows there. An
    alignment that reaches ``need`` leaves out at most len(a) - need and len(b) -
    need elements, so that at a place of b only the places of a in a band around
    it matter; the state is the bits of that band, which moves along.
    """
    n, m = len(a), len(b)
    if need > min(n, m):
        return 0
    below, above = m - need, n - need
    k = min(n, m)
    differ = np.flatnonzero(a[:k] != b[:k])
    head = int(differ[0]) if len(differ) else k
    a, b = a[head:], b[head:]
    k = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - k :] != b[len(b) - k :])
    tail = k - 1 - int(differ[-1]) if len(differ) else k
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    ends = head + tail
    if not len(a) or not len(b):
        return ends
    shared = np.isin(b, a)
    if ends + min(int(np.isin(a, b).sum()), int(shared.sum())) < need:
        return 0
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a.tolist()):
        places.setdefault(x, []).append(i)
    width = below + above + 1
    full = (1 << width) - 1
    state, low, grown = full, -below, 0  # bit i of the state stands for place low + i of a
    at = np.flatnonzero(shared)
    for j, x in zip(at.tolist(), b[at].tolist(), strict=True):
        own = places[x]
        first = j - below
        if len(own) > 1:
            own = own[bisect_left(own, first) : bisect_right(own, j + above)]
        hit = 0
        for i in own:
            if first <= i <= j + above:
                hit |= 1 << (i - first)
        if not hit:
            continue
        step, low = first - low, first
        if step:  # the band moves along; what leaves it is settled
            gone = min(step, width)
            grown += gone - (state & ((1 << gone) - 1)).bit_count()
            state = state >> gone | ((1 << gone) - 1) << (width - gone)
        new = state & hit
        state = (state + new | state - new) & full
    return ends + grown + width - state.bit_count()


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    need = least_common(len(a), len(b), similarity)
    return aligned(a, b, need) >= max(1, need)


def _words(batches):
    """(id, text) batches to lists of ids and of word hashes, some rows at a time; texts without a word are left out."""
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            rows = [(k, w) for k, w in zip(part.column(0).to_pylist(), word_hashes(part.column(1).to_pylist()), strict=True) if len(w)]
            yield [k for k, _ in rows], [w for _, w in rows]


def _sketch(batches):
    for ks, words in _words(batches):
        seqs = [shingles(w) for w in words]
        flat = pa.array(np.concatenate([sketches(s) for s in seqs]).view(np.int64) if seqs else np.zeros(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, SKETCHES * len(seqs) + 1, SKETCHES, dtype=np.int32)), flat)
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(map(whole_hash, words), pa.binary()), pa.array(map(len, seqs), pa.int64()), lists], ["k", "whole", "n", "sketch"])


def _sequences(batches):
    for ks, words in _words(batches):
        yield pa.RecordBatch.from_arrays([pa.array(map(whole_hash, words), pa.binary()), pa.array([shingles(w).tobytes() for w in words], pa.binary())], ["whole", "seq"])


def in_common(seqs: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many labelled shingles each text of ``left`` shares with each of ``right`` (places in ``seqs``).

    Shingles of few texts are counted pair by pair, others by a matrix product.
    """
    n = len(seqs)
    row = np.repeat(np.arange(n), [len(s) for s in seqs])
    name, often = np.unique(np.concatenate([labelled(s) for s in seqs]), return_inverse=True, return_counts=True)[1:]
    keep = often[name] > 1
    name, row = name[keep], row[keep]
    order = np.argsort(name, kind="stable")
    name, row = name[order], row[order]
    rare = often[name] <= RARE
    out = np.zeros((n, n), np.float32)
    few, own = name[rare], row[rare]
    for step in range(1, min(RARE, len(few))):
        same = np.flatnonzero(few[step:] == few[:-step])
        if not len(same):
            break
        out += np.bincount(own[same] * n + own[same + step], minlength=n * n).reshape(n, n)
    out = (out + out.T)[np.ix_(left, right)]
    name, row = np.unique(name[~rare], return_inverse=True)[1], row[~rare]
    cuts = np.searchsorted(name, np.arange(0, (int(name[-1]) if len(name) else -1) + 1 + COLUMNS, COLUMNS))
    for c, (s, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        held = np.zeros((n, COLUMNS), np.float32)
        held[row[s:e], name[s:e] - c * COLUMNS] = 1
        out += held[left] @ held[right].T
    return out


#: A shingle of more texts is counted by a matrix product, of so many shingles at a time.
RARE, COLUMNS = 16, 2048


def _cell(ids: list[int], roots: np.ndarray, seqs: list[np.ndarray], sketch: np.ndarray, compared: np.ndarray, place: int, block: np.ndarray, across: bool, similarity: float):
    """Links between texts of a cell that don't hang together yet, over ``roots`` or over links found here.

    Pairs that share a sketch before ``place`` are left out if its bit is set in ``compared``.
    """
    every = np.arange(len(ids))
    left, right = (every[block == block.min()], every[block != block.min()]) if across else (every, every)
    if not len(left) or not len(right):
        return
    size = np.array([len(s) for s in seqs])
    label = np.unique(roots, return_inverse=True)[1]
    if len(ids) > 2:
        shared = in_common(seqs, left, right)
        need = np.ceil(similarity * (size[left][:, None] + size[right][None, :]) / (1 + similarity) - 1e-9)
        likely = shared >= np.maximum(need, 1)
    else:
        shared, likely = np.zeros((len(left), len(right)), np.float32), np.ones((len(left), len(right)), bool)
    likely &= label[left][:, None] != label[right][None, :]
    if not across:
        likely &= left[:, None] < right[None, :]
    if not likely.any():
        return
    for q in range(place):
        bit = (compared[left] >> q & 1 == 1)[:, None]
        likely &= ~((sketch[left, q][:, None] == sketch[right, q][None, :]) & bit)
    for at, i in enumerate(left.tolist()):
        js = np.flatnonzero(likely[at])
        js = js[label[right[js]] != label[i]]
        for j in right[js[np.argsort(-shared[at, js], kind="stable")]].tolist():
            if label[j] != label[i] and similar(seqs[i], seqs[j], similarity):
                label[label == label[j]] = label[i]
                yield ids[i], ids[j]


def _compare(similarity: float):
    """Cells in order (k, root, place, bucket, block, gi, gj, sketch, compared, seq) to links."""

    def work(rows: pa.Table):
        col = {c: rows.column(c).combine_chunks() for c in rows.column_names}
        ids, roots = col["k"].to_pylist(), np.asarray(col["root"])
        place, block, gi, gj, bucket, compared = (np.asarray(col[c]) for c in ("place", "block", "gi", "gj", "bucket", "compared"))
        sketch = np.asarray(col["sketch"].flatten()).reshape(len(ids), SKETCHES)
        seqs = [np.frombuffer(x.as_buffer(), np.uint64) for x in col["seq"]]
        change = (bucket[1:] != bucket[:-1]) | (place[1:] != place[:-1]) | (gi[1:] != gi[:-1]) | (gj[1:] != gj[:-1])
        start = np.concatenate([[0], np.flatnonzero(change) + 1, [len(ids)]]).tolist()
        found = []
        for s, e in zip(start[:-1], start[1:], strict=True):
            if e - s > 1:
                found += _cell(ids[s:e], roots[s:e], seqs[s:e], sketch[s:e], compared[s:e], int(place[s]), block[s:e], bool(gi[s] != gj[s]), similarity)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    def run(batches):
        held: list[pa.Table] = []
        size = 0
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                held.append(pa.Table.from_batches([batch]))
                size += batch.num_rows
                if size < 500:
                    continue
                rows = pa.concat_tables(held)
                mark = [np.asarray(rows.column(c)) for c in ("place", "bucket", "gi", "gj")]
                last = np.flatnonzero(np.logical_or.reduce([m[1:] != m[:-1] for m in mark]))
                cut = int(last[-1]) + 1 if len(last) else 0  # the last cell may go on in the next batch
                if cut:
                    yield from work(rows.slice(0, cut))
                held, size = [rows.slice(cut)], len(rows) - cut
        if size:
            yield from work(pa.concat_tables(held))

    return run


_CELL = ["place", "bucket", "gi", "gj"]


def _links(cells: DataFrame, full: DataFrame, compared: str, similarity: float) -> DataFrame:
    """Links of cells (whole, root, place, bucket, block, gi, gj, lead); a missing root is the text itself."""
    rows = cells.join(full, "whole")
    rows = rows.select("k", F.coalesce("root", "k").alias("root"), "place", "bucket", "block", "gi", "gj", "lead", "sketch", F.col(compared).alias("compared"), "seq")
    dealt = rows.repartition(shuffle_width(cells.sparkSession), *_CELL).sortWithinPartitions(*_CELL, "lead").drop("lead")
    return dealt.mapInArrow(tidy(_compare(similarity)), "a long, b long")


def _blocks(texts: str, words: str):
    return F.greatest(F.ceil(F.col(texts) / BLOCK), F.ceil(F.col(words) / BLOCK_SHINGLES)).cast("int")


def _across(met: DataFrame, wide: DataFrame, root: DataFrame, space: Workspace) -> DataFrame | None:
    """Cells of the pairs across components in buckets of several blocks; None if there are none.

    In each bucket the component of most texts is left out of comparison with
    itself: its blocks meet those of the others, and these meet each other.
    """
    at = met.join(wide.select("place", "bucket"), ["place", "bucket"]).join(root.toDF("k", "root"), "k", "left")
    at = space.keep(at.select("whole", "n", "place", "bucket", F.coalesce("root", "k").alias("root")), "wide")
    shares = at.groupBy("place", "bucket", "root").agg(F.count("*").alias("texts"), F.sum("n").alias("words"))
    most = shares.groupBy("place", "bucket").agg(F.sum("texts").alias("texts"), F.sum("words").alias("words"), F.count("*").alias("roots"), F.max(F.struct("texts", "words", "root")).alias("most")).where("roots > 1")
    most = most.select("place", "bucket", "most.root", *[F.col(f"most.{c}").alias(c) for c in ("texts", "words")], *[(F.col(c) - F.col(f"most.{c}")).alias(f"rest_{c}") for c in ("texts", "words")])
    most = space.keep(most.select("place", "bucket", F.col("root").alias("main"), _blocks("texts", "words").alias("p"), _blocks("rest_texts", "rest_words").alias("q")), "open-wide")
    if most.isEmpty():
        return None
    own, draw = F.col("root") == F.col("main"), F.xxhash64("whole", "place")
    block = F.when(own, F.pmod(draw, F.col("p"))).otherwise(F.col("p") + F.pmod(draw, F.col("q"))).cast("int")
    cells = at.join(most, ["place", "bucket"]).withColumn("block", block)
    cells = cells.withColumn("other", F.explode(F.sequence(F.when(own, F.col("p")).otherwise(F.lit(0)), F.col("p") + F.col("q") - 1)))
    return cells.select("whole", "root", "place", "bucket", "block", F.least("block", "other").alias("gi"), F.greatest("block", "other").alias("gj"), F.lit(0).alias("lead"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(k, class): each id and the smallest id that it is a copy of, directly or over others.

    Copies with the same words are found by a hash of all words; links between
    different texts are verified. Ids that are missing, and texts without a word
    (null, empty, blank), are not in the result: nothing is a copy of them. Rows
    that share an id are one document.
    """
    space = Workspace(docs.sparkSession, "near")
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("text"))
    sketched = space.keep(texts.mapInArrow(tidy(_sketch), "k long, whole binary, n long, sketch array<long>"), "sketches")
    copies = space.keep(sketched.groupBy("whole").agg(F.min("k").alias("rep")), "whole")

    # From here on one row for each distinct text, and only texts that share a sketch with another one.
    own = sketched.join(copies.withColumnRenamed("rep", "k"), ["whole", "k"], "left_semi").distinct()
    rows = space.keep(own.select("whole", "k", "n", F.posexplode("sketch").alias("place", "bucket")), "buckets")
    sizes = rows.groupBy("place", "bucket").agg(F.count("*").alias("texts"), F.sum("n").alias("words")).where("texts > 1")
    met = space.keep(rows.join(sizes, ["place", "bucket"]), "met")
    at = lambda q, c: F.max(F.when(F.col("place") == q, F.col(c)))
    every = range(SKETCHES)
    shared = met.groupBy("whole", "k").agg(F.sum("texts").alias("score"), *[at(q, "bucket").alias(f"s{q}") for q in every], *[F.coalesce(at(q, "texts"), F.lit(0)).alias(f"t{q}") for q in every])
    shared = space.keep(shared, "shared")

    # A bucket is left out if all of its texts are in one other bucket together: a larger one, or the same texts at an earlier place.
    both = met.join(shared.drop("k"), "whole")
    about = [F.max("texts").alias("texts"), F.max("words").alias("words"), F.max(F.struct("score", "whole")).getField("whole").alias("leader")]
    about += [((F.min(f"s{q}") == F.max(f"s{q}")) & ((F.min(f"t{q}") > F.max("texts")) | (F.min(f"t{q}") == F.max("texts")) & (F.lit(q) < F.max("place")))).alias(f"in{q}") for q in every]
    open_ = both.groupBy("place", "bucket").agg(*about)
    kept = ~reduce(lambda a, b: a | b, [F.coalesce(F.col(f"in{q}"), F.lit(False)) for q in every])
    open_ = space.keep(open_.where(kept).select("place", "bucket", "leader", _blocks("texts", "words").alias("blocks")), "open")

    met = met.join(open_, ["place", "bucket"]).select("whole", "k", "n", "place", "bucket", "blocks", "leader")
    met = space.keep(met, "met-open")
    bit = F.expr("shiftleft(1, place)")
    bits = met.groupBy("whole").agg(F.sum(bit).alias("open"), F.sum(F.when(F.col("blocks") == 1, bit).otherwise(0)).alias("single"))
    facts = space.keep(shared.select("whole", "k", F.array(*[F.coalesce(f"s{q}", F.lit(0)) for q in every]).alias("sketch")).join(bits, "whole"), "facts")
    # Texts are dealt out by id at any size: a broadcast of ids would have no bound.
    near = texts.join(facts.select("k").hint("shuffle_hash"), "k", "left_semi")
    near = near.mapInArrow(tidy(_sequences), "whole binary, seq binary").dropDuplicates(["whole"])
    full = space.keep(near.join(facts, "whole"), "full")
    space.drop("buckets", "met", "shared", "facts")

    block = F.pmod(F.xxhash64("whole", "place"), F.col("blocks")).cast("int")
    inner = met.select("whole", F.lit(None).cast("long").alias("root"), "place", "bucket", block.alias("block"), block.alias("gi"), block.alias("gj"), F.lit(1).alias("lead"))
    wide = open_.where("blocks > 1")
    leads = wide.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    leads = leads.where(F.pmod(F.xxhash64("leader", "place"), F.col("blocks")) != F.col("block"))
    leads = leads.select(F.col("leader").alias("whole"), F.lit(None).cast("long").alias("root"), "place", "bucket", "block", F.col("block").alias("gi"), F.col("block").alias("gj"), F.lit(0).alias("lead"))
    links = _links(inner.unionByName(leads), full, "single", similarity)
    # Rows of one id with different texts hold together.
    several = sketched.groupBy("k").agg(F.min(F.xxhash64("whole")).alias("low"), F.max(F.xxhash64("whole")).alias("high")).where("low < high").select("k")
    same = sketched.join(several, "k").join(copies, "whole").groupBy("k").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b")
    root = components(space.keep(links.unionByName(same), "links"), space)
    if not wide.isEmpty():
        cells = _across(met, wide, root, space)
        if cells is not None:
            found = space.keep(_links(cells, full, "open", similarity), "links-across")
            if not found.isEmpty():
                root = components(root.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(found), space, "components-across")
    space.drop("met-open", "open", "wide", "open-wide", "full", "links", "links-across")
    classes = copies.join(root.withColumnRenamed("id", "rep"), "rep", "left").select("whole", F.coalesce("root", "rep").alias("class"))
    return sketched.join(classes, "whole").groupBy("k").agg(F.min("class").alias("class"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with ``class_id`` and ``kept`` (underscores are added to names that ``docs`` has).

    ``class_id`` is the smallest id of the document's class and ``kept`` whether
    that is its own. Documents without an id or without a word are kept; their
    class is their own id.
    """
    k, c = fresh_name(docs, "_k"), fresh_name(docs, "_class")
    names = [fresh_name(docs, "class_id"), fresh_name(docs, "kept")]
    classes = near_classes(docs, id_col, text_col, similarity).toDF(k, c)
    own = F.col(id_col).cast("long")
    both = docs.withColumn(k, own).join(classes, k, "left")
    of = F.coalesce(F.col(c), own)
    return both.select(*docs.columns, of.alias(names[0]), F.coalesce(of == own, F.lit(True)).alias(names[1]))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    classes = near_classes(docs).toDF("id", "class")
    return docs.select("doc_id").join(classes, F.col("doc_id") == F.col("id"), "left").select("doc_id", F.coalesce("class", F.col("doc_id").cast("long")).alias("class_id"), F.coalesce(F.col("class") == F.col("doc_id"), F.lit(True)).alias("kept"))
