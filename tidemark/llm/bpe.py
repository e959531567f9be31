"""Byte-level BPE by merge replay over a corpus slice, and decoding.

The distinct pieces of a slice (a batch of whole texts in one task) are laid end
to end as bytes. An inverted index leads from a pair of adjacent tokens, named by
the rank of what they merge to, to every position at which the pair stands. The
merges are replayed in rank order: all positions of the lowest rank are merged at
once, and only the pairs that touch a merged position are looked up anew and
entered in the index. Since merges never cross pieces, replaying each slice by
itself gives what one replay over the whole corpus would.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_name, tidy
from .pretokens import PieceEncoder, compile_pattern, laid


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Merges:
    """The ranks of a vocabulary file (base64 token, rank in each line)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.token: dict[int, bytes] = {r: t for t, r in self.ranks.items()}
        self.wide = max(self.token) + 1
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.wide + right] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.merged = np.fromiter(pairs.values(), np.int32, len(pairs))[order]
        #: Whether a token takes part in a merge of a lower rank than the one that makes it.
        self.falls = np.zeros(self.wide, bool)
        for side in (self.keys // self.wide, self.keys % self.wide):
            self.falls[side[self.merged < side]] = True

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair merges to, or -1."""
        if not len(self.keys):
            return np.full(len(left), -1, np.int32)
        key = left.astype(np.int64) * self.wide + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.merged[at], -1).astype(np.int32)

    def one(self, piece: bytes) -> list[int]:
        """A single piece, merge by merge; for the rare ones that replay can't order (see ``replay``).

        Pairs wait in a heap by rank and place, so the lowest and leftmost is next; a merge enters the two pairs that it touches.
        """
        n = len(piece)
        token = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, bytes, bytes]] = []

        def enter(i: int) -> None:
            if i >= 0 and after[i] < n:
                left, right = token[i], token[after[i]]
                rank = self.ranks.get(left + right)
                if rank is not None:
                    heapq.heappush(heap, (rank, i, left, right))

        for i in range(n):
            enter(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if token[i] != left or j >= n or token[j] != right:
                continue  # one of the two was merged meanwhile
            token[i], token[j] = left + right, b""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            enter(before[i])
            enter(i)
        return [self.ranks[x] for x in token if x]

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after the other, and how many each has."""
        return self.replay_laid(np.frombuffer(b"".join(pieces), np.uint8), np.fromiter(map(len, pieces), np.int64, len(pieces)))

    def replay_laid(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of pieces that lie end to end as bytes."""
        n, pieces = len(data), len(size)
        tok = self.byte[data]
        piece = np.repeat(np.arange(pieces, dtype=np.int32), size)
        nxt = np.arange(1, n + 1, dtype=np.int32)
        prv = np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(size)[size > 0] - 1
        nxt[ends] = -1
        prv[(ends + 1)[:-1]] = -1
        rank = np.full(n, -1, np.int32)  # of the pair that starts here
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Look up the pairs at these positions and put them in the index."""
            after = nxt[at]
            inner = after >= 0
            rank[at[~inner]] = -1
            at, after = at[inner], after[inner]
            found = self.look_up(tok[at], tok[after])
            rank[at] = found
            known = found >= 0
            at, found = at[known], found[known]
            if not len(at):
                return
            order = np.argsort(found, kind="stable")
            at, sorted_ranks = at[order], found[order]
            cuts = np.flatnonzero(np.diff(sorted_ranks)) + 1
            starts = [0, *cuts.tolist(), len(at)]
            for r, i, j in zip(sorted_ranks[starts[:-1]].tolist(), starts, starts[1:], strict=False):
                if r in index:
                    index[r].append(at[i:j])
                else:
                    index[r] = [at[i:j]]
                    heapq.heappush(heap, r)

        if n:
            enter(np.arange(n, dtype=np.int32))
        redo: set[int] = set()
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else distinct(np.concatenate(lists))
            at = at[rank[at] == r]
            if not len(at):
                continue
            after = nxt[at]
            if len(at) > 1 and (rank[after] == r).any():  # overlapping: the leftmost goes first
                at, after = self._leftmost(at, after)
            beyond = nxt[after]
            many = len(at) > 1 and bool(self.falls[r])
            if many:  # what the leftmost of two merges side by side would see of the other one
                second = np.searchsorted(at, beyond)
                second[second == len(at)] = 0
                beside = np.flatnonzero(at[second] == beyond)
                if len(beside):
                    seen = self.look_up(np.full(len(beside), r), tok[beyond[beside]])
                    redo.update(piece[at[beside[(seen >= 0) & (seen < r)]]].tolist())
            tok[at] = r
            nxt[at] = beyond
            rank[after] = -1
            inner = beyond >= 0
            prv[beyond[inner]] = at[inner]
            before = prv[at]
            before = before[before >= 0]
            touched = distinct(np.concatenate([at, before])) if len(before) else at
            enter(touched)
            if many:
                # In a piece, a merge of this rank may make room for a lower one, which comes before the next of this rank.
                lower = touched[(rank[touched] >= 0) & (rank[touched] < r)]
                if len(lower):
                    own, times = np.unique(piece[at], return_counts=True)
                    redo.update(np.intersect1d(own[times > 1], piece[lower]).tolist())
        alive = np.ones(n, bool)
        dead = self._dead(nxt, prv, n, ends)
        alive[dead] = False
        count = np.bincount(piece[alive], minlength=pieces).astype(np.int64)
        flat = tok[alive]
        self.redone = len(redo)
        if redo:
            parts = np.split(flat, np.cumsum(count)[:-1])
            upto = np.cumsum(size)
            for k in redo:
                parts[k] = np.array(self.one(data[upto[k] - size[k] : upto[k]].tobytes()), np.int32)
            count = np.array([len(x) for x in parts], np.int64)
            flat = np.concatenate(parts).astype(np.int32)
        return flat, count

    @staticmethod
    def _leftmost(at: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        take, taken = np.ones(len(at), bool), -1
        for i, (a, b) in enumerate(zip(at.tolist(), after.tolist(), strict=True)):
            if a == taken:
                take[i] = False
            else:
                taken = b
        return at[take], after[take]

    @staticmethod
    def _dead(nxt: np.ndarray, prv: np.ndarray, n: int, ends: np.ndarray) -> np.ndarray:
        """Positions that were merged into the one before: nothing that lives leads to them."""
        led = np.zeros(n, bool)
        first = np.ones(len(ends), np.int64)
        first[0:1] = 0
        first[1:] = ends[:-1] + 1
        led[first] = True
        at = first
        while len(at):
            at = nxt[at]
            at = at[at >= 0]
            led[at] = True
        return np.flatnonzero(~led)


class Codec:
    """Encoding and decoding for one vocabulary and one pattern."""

    def __init__(self, path: str, pattern: str):
        self.merges = Merges(path)
        self.pieces = PieceEncoder(compile_pattern(pattern), lambda pieces: self.merges.replay_laid(*laid(pieces)))
        self.decimal = [str(i) for i in range(self.merges.wide)]
        self.token = [self.merges.token.get(i, b"") for i in range(self.merges.wide)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) one after the other, and how many each has."""
        return self.pieces.texts(texts)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """This worker's codec; the file must be at ``path`` on every executor."""
    return Codec(path, pattern)


#: Texts are taken in batches of about so many bytes, to bound a worker's memory.
BATCH_BYTES = 6_000_000


def text_batches(batches, column: int, size: int = BATCH_BYTES):
    """Batches put together or cut so that the texts of each have about ``size`` bytes (or are one text), with their texts (null: empty)."""
    held: list[pa.RecordBatch] = []
    have = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        length = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        start = 0
        for i, n in enumerate(np.cumsum(length).tolist()):
            if have + n >= size:
                held.append(batch.slice(start, i + 1 - start))
                yield _with_texts(held, column)
                held, have, start = [], -n, i + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
            have += int(length.sum())
        else:
            have = 0
    if held:
        yield _with_texts(held, column)


def _with_texts(held: list[pa.RecordBatch], column: int) -> tuple[pa.RecordBatch, pa.Array]:
    whole = held[0] if len(held) == 1 else pa.concat_batches(held)
    return whole, pc.fill_null(whole.column(column), "").cast(pa.string())


def encode_table(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_name: str = "ids") -> DataFrame:
    """``docs`` with an array of token ids in place of its text; null text has none.

    Works batch by batch without a shuffle; every row gives one row, whatever
    its other columns hold. If ``docs`` has a column of the name, underscores are added.
    """
    rest, ids_name = [f for f in docs.schema if f.name != text_col], fresh_name(docs, ids_name)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"`{ids_name}` array<int>"])

    def run(batches):
        c = codec(path, pattern)
        for part, texts in text_batches(batches, len(rest)):
            ids, counts = c.encode(texts)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], [*[f.name for f in rest], ids_name])

    return docs.select(*[f.name for f in rest], text_col).mapInArrow(tidy(run), schema)


def decode_table(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids in place of them; null ids give null, an id that the vocabulary lacks fails."""
    rest, name = [f for f in encoded.schema if f.name != ids_col], fresh_name(encoded, name)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"`{name}` binary"])

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            out = [None if ids is None else c.decode(ids) for ids in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(out, pa.binary())], [*[f.name for f in rest], name])

    return encoded.select(*[f.name for f in rest], ids_col).mapInArrow(tidy(run), schema)


def digest_table(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode the ids again, and return (id, n_tokens, ids_sha256, decoded_sha256) for each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(path, pattern)
        for part, texts in text_batches(batches, 1):
            flat, counts = c.encode(texts)
            left, right, start = [], [], 0
            for n in counts.tolist():
                ids = flat[start : start + n].tolist()
                start += n
                left.append(hashlib.sha256(" ".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                right.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(left), pa.array(right)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(run), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary() -> tuple[str, str]:
    """The public vocabulary that the registered queries use: its path and pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_table(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), *vocabulary())
