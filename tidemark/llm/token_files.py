"""Token ids in files of independent zstandard frames with a seek table.

A file holds, one after the other:

1. for each document a zstandard frame of its ids, little-endian unsigned, two
   bytes each if the vocabulary allows it and else four;
2. a skippable frame, the directory: a compressed record of the id width and the
   documents' ids and counts;
3. a skippable frame, the seek table in zstandard's public seekable format: for
   each frame its compressed size, its size and a checksum (the low 32 bits of
   XXH64 of its content), and a footer.

Plain zstandard tools decompress the ids of a whole file; ``read_some`` fetches
the seek table and directory and then only the frames of the documents asked for.
"""

from __future__ import annotations

import os
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import text_batches
from .common import Workspace, shuffle_width, tidy
from .files import open_file, whole_file
from .pretokens import PieceEncoder, compile_pattern, expand, laid, spaced, strings

# Fixed values of the zstandard format: skippable frames (the second is the seek table's), the seek table's footer.
DIRECTORY_MAGIC = 0x184D2A50
SEEK_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
FOOTER = struct.Struct("<IBI")
SKIPPABLE = struct.Struct("<II")
HAS_CHECKSUMS = 0x80
#: Of a document without an id, in the directory.
NO_DOC = -(1 << 63)


class TokenFileWriter:
    def __init__(self, out, width: int, level: int = 3):
        self.out, self.width, self.dtype = out, width, np.dtype(f"<u{width}")
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.add_all([doc_id], ids, np.array([len(ids)]))

    def add_all(self, doc_ids: list[int | None], flat: np.ndarray, counts: np.ndarray) -> None:
        """A frame for each document; their ids stand one after the other."""
        if len(flat) and (flat.min() < 0 or flat.max() > np.iinfo(self.dtype).max):
            raise ValueError(f"an id does not fit into {self.width} bytes")
        every, start = memoryview(np.ascontiguousarray(flat, self.dtype)).cast("B"), 0
        for doc_id, n in zip(doc_ids, counts.tolist(), strict=True):
            raw = every[start : start + n * self.width]
            start += n * self.width
            frame = self.zstd.compress(raw)
            self.out.write(frame)
            self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.ids.append(NO_DOC if doc_id is None else doc_id)
            self.counts.append(n)

    def close(self) -> None:
        n = len(self.ids)
        directory = self.zstd.compress(struct.pack("<II", self.width, n) + np.array(self.ids, "<i8").tobytes() + np.array(self.counts, "<i8").tobytes())
        self.out.write(SKIPPABLE.pack(DIRECTORY_MAGIC, len(directory)) + directory)
        table = np.array(self.entries, "<u4").tobytes() + FOOTER.pack(n, HAS_CHECKSUMS, FOOTER_MAGIC)
        self.out.write(SKIPPABLE.pack(SEEK_MAGIC, len(table)) + table)


class TokenFile:
    """Random access to one file (an open, seekable binary file)."""

    def __init__(self, source):
        self.source = source
        source.seek(0, os.SEEK_END)
        size = source.tell()
        n, kind, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != FOOTER_MAGIC or kind != HAS_CHECKSUMS:
            raise ValueError("not a token file: the seek table's footer is missing")
        table = self._at(size - FOOTER.size - 12 * n, 12 * n)
        self.frames = np.frombuffer(table, "<u4").reshape(n, 3).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        magic, length = SKIPPABLE.unpack(self._at(int(self.start[-1]), SKIPPABLE.size))
        if magic != DIRECTORY_MAGIC:
            raise ValueError("not a token file: the directory is missing")
        self.zstd = zstandard.ZstdDecompressor()
        directory = self.zstd.decompress(self._at(int(self.start[-1]) + SKIPPABLE.size, length))
        self.width, m = struct.unpack_from("<II", directory)
        self.ids = np.frombuffer(directory, "<i8", m, 8)
        self.counts = np.frombuffer(directory, "<i8", m, 8 + 8 * m)

    def _at(self, start: int, length: int) -> bytes:
        self.source.seek(start)
        return self.source.read(length)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document; fails if its checksum doesn't hold."""
        raw = self.zstd.decompress(self._at(int(self.start[k]), int(self.frames[k, 0])))
        if len(raw) != self.frames[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, f"<u{self.width}").astype(np.uint32)


class LibraryEncoder:
    """What the tokenizers library's ``encode(text, add_special_tokens=False)`` gives, each distinct piece of a batch encoded once.

    Texts that hold the string of an added token (such as ``<|endoftext|>``) go to
    the library whole, which makes that token's id of it; with
    ``special_as_text`` such strings are ordinary text.
    """

    def __init__(self, path: str, pattern: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.pieces = PieceEncoder(compile_pattern(pattern), self._pieces)
        self.largest = max(self.tokenizer.get_vocab().values(), default=0)
        #: Bytes of each token; the vocabulary writes a byte as one character.
        self.width = np.zeros(self.largest + 1, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, count = [np.zeros(0, np.int32)], []
        for i in range(0, len(texts), 1024):
            for x in self.tokenizer.encode_batch_fast(texts[i : i + 1024], add_special_tokens=False):
                flat.append(np.array(x.ids, np.int32))
                count.append(len(flat[-1]))
        return np.concatenate(flat), np.array(count, np.int64)

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Many pieces go to the library as one text: one that starts with a space and doesn't end with white space stands for itself there too."""
        plain = spaced(pieces, SPACE)
        joined, rest = pieces.filter(pa.array(plain)), pieces.filter(pa.array(~plain)).to_pylist()
        flat, count = self._joined(joined)
        more, many = self._each(rest)
        place = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        back = np.argsort(place, kind="stable")  # to the order of the pieces
        count = np.concatenate([count, many])
        return expand(np.concatenate([flat, more]), count, back), count[back]

    def _joined(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        groups = [strings(pieces.slice(i, JOINED)) for i in range(0, len(pieces), JOINED)]
        flat, _ = self._each(groups)
        ends, at = np.cumsum(laid(pieces)[1]), np.cumsum(self.width[flat])
        last = np.searchsorted(at, ends)
        if len(ends) and not (at[-1] == ends[-1] and (at[last] == ends).all()):  # a vocabulary whose tokens aren't bytes of the text
            return self._each(pieces.to_pylist())
        return flat, np.diff(last, prepend=-1)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) one after the other, and how many each has."""
        texts = pc.fill_null(texts, "")
        own = np.zeros(len(texts), bool)
        for token in self.added:
            own |= np.asarray(pc.match_substring(texts, token))
        if not own.any():
            return self.pieces.texts(texts)
        mask = pa.array(own)
        flat, count = self.pieces.texts(texts.filter(pc.invert(mask)))
        more, many = self._each(texts.filter(mask).to_pylist())
        out = np.zeros(len(texts), np.int64)
        out[~own], out[own] = count, many
        place = np.concatenate([np.flatnonzero(~own), np.flatnonzero(own)])
        return expand(np.concatenate([flat, more]).astype(np.int32), np.concatenate([count, many]), np.argsort(place, kind="stable")), out


@lru_cache(maxsize=2)
def library_encoder(path: str, pattern: str, special_as_text: bool = False) -> LibraryEncoder:
    return LibraryEncoder(path, pattern, special_as_text)


#: Pieces that the library encodes as one text.
JOINED = 200
SPACE = np.arange(256) == 32


def id_width(largest: int, end_id: int | None = None, wide: bool = False) -> int:
    """The bytes of an id: two if all ids of a vocabulary up to ``largest`` fit, and ``end_id`` does, else four."""
    return 4 if wide or max(largest, end_id or 0) > 0xFFFF else 2


MANIFEST = "part int, path string, docs long, tokens long"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, pattern: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, wide_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """Encode ``docs`` in ascending order of id into files below ``folder``, and return their manifest.

    Rows are dealt to files by ranges of the id, so that files in the order of
    ``part`` hold the ids in ascending order, rows without an id last, rows of
    the same id in the order of their texts. Null text is empty; each document
    ends with ``end_id`` if there is one. Files appear whole or not at all, and
    each attempt of a task writes its own: read those that a kept manifest names.
    An empty table has no files. Ids take four bytes each with ``wide_ids``, or if
    the vocabulary or ``end_id`` goes beyond two. The string of a special token in
    a text becomes that token, as the library has it, unless ``special_as_text``.
    Other columns of ``docs``, whatever their names, play no part.
    """
    spark = docs.sparkSession
    by = F.col("id").asc_nulls_last()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(parts or shuffle_width(spark), by).sortWithinPartitions(by, "text")
    def run(batches):
        writer = None
        task = TaskContext.get()
        part = task.partitionId()
        path = f"{folder}/part-{part:06d}-{task.taskAttemptId()}.ids.zst"
        end = np.zeros(0, np.int32) if end_id is None else np.array([end_id], np.int32)
        parts = text_batches(batches, 1)
        first = next(parts, None)
        if first is None:
            return
        encoder = library_encoder(tokenizer, pattern, special_as_text)
        with whole_file(path) as out:
            writer = TokenFileWriter(out, id_width(encoder.largest, end_id, wide_ids))
            while first is not None:
                piece, texts = first
                flat, counts = encoder.texts(texts)
                writer.add_all(piece.column(0).to_pylist(), np.insert(flat, np.repeat(np.cumsum(counts), len(end)), np.tile(end, len(counts))), counts + len(end))
                first = next(parts, None)
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([len(writer.ids)], pa.int64()), pa.array([sum(writer.counts)], pa.int64())], ["part", "path", "docs", "tokens"])

    return rows.mapInArrow(tidy(run), MANIFEST)


def read_token_files(manifest: DataFrame, summary: bool = False) -> DataFrame:
    """Every document of the files: (doc_id, start, n_tokens, ids_crc32), and ``ids`` unless only a ``summary`` is asked for.

    ``start`` counts the ids of all documents before it, over all files.
    """
    spark = manifest.sparkSession
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", before.alias("before"), "part")  # a row for each file
    files = files.repartitionById(shuffle_width(spark), F.pmod("part", F.lit(shuffle_width(spark))))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * (not summary)

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_file(path) as source:
                    file, rows = TokenFile(source), []
                    for k, doc in enumerate(file.ids.tolist()):
                        ids = file.document(k)
                        rows.append((None if doc == NO_DOC else doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids)[: len(names)])
                        start += len(ids)
                        if len(rows) == 2000:
                            yield _rows(rows, names)
                            rows = []
                    yield _rows(rows, names)

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * (not summary))


def _rows(rows, names):
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    out = [pa.array(c, pa.int64()) for c in columns[:4]]
    if len(names) > 4:
        out.append(pa.array([x.astype(np.int64) for x in columns[4]], pa.list_(pa.int64())))
    return pa.RecordBatch.from_arrays(out, names)


def read_some(paths: list[str], wanted: set[int]) -> dict[int, np.ndarray]:
    """The ids of a few documents, decompressing only their frames."""
    out = {}
    for path in paths:
        with open_file(path) as source:
            file = TokenFile(source)
            for k in np.flatnonzero(np.isin(file.ids, list(wanted))).tolist():
                out[int(file.ids[k])] = file.document(k)
    return out


def library_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


#: The id that ends a document in the registered query.
END_ID = 2


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "ids")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    manifest = space.keep(write_token_files(docs, space.path("files"), *library_vocabulary(), end_id=END_ID), "manifest")
    return read_token_files(manifest, summary=True)
