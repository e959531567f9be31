"""WARC archives: a writer with revisit records, and a reader that splits gzipped files.

Each record is a gzip member of its own. The reader's tasks get byte ranges of
the files. A task looks for the gzip magic in its range, takes a place for the
start of a member only if what follows decodes to a WARC header, and owns the
records that start inside its range: it follows member after member, past the end
of its range where the last one needs it, and stops at the first member that
starts beyond. No index is needed, and no record is read by two tasks.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, as_bytes, shuffle_width
from .files import open_file, whole_file

# Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 31  # zlib's window bits for one gzip member

#: Record ids are UUIDs: this half marks those that hold a page's id in the other half.
PAGE_MARK = 0x7469_6465_6D61_8172
READ_CHUNK = 1 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, salt: bytes = b"") -> str:
    """A page's record id; one without a page id gets a UUID from ``salt``."""
    if page_id is None:
        h = hashlib.sha256(salt).hexdigest()
        return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"
    h = f"{PAGE_MARK:016x}{page_id & (1 << 64) - 1:016x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def page_of(record: str | None) -> int | None:
    """The page id in a record id, if it has one."""
    h = (record or "").strip("<>").removeprefix("urn:uuid:").replace("-", "")
    if len(h) != 32 or int(h[:16], 16) != PAGE_MARK:
        return None
    low = int(h[16:], 16)
    return low - (1 << 64) if low >> 63 else low


def _clean(value: str) -> str:
    """A header value: controls and spaces, which would end it, percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(kind: str, rid: str, date: str, url: str | None, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """A whole record. A revisit keeps the HTTP header, with the payload's length, and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to:
        head += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    return z.compress(raw) + z.flush()


MANIFEST = "path string, bytes long, records long"


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row below ``folder`` and return the manifest of the files.

    Of rows with equal payloads of at least ``least`` bytes, those with the
    smallest id are responses and the others revisit them. Null payload is empty.
    Rows without an id are always responses and nothing refers to them; rows that
    share the smallest id are all responses. A null address is left out.
    """
    spark = pages.sparkSession
    space = Workspace(spark, "warc")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    same = rows.where(F.octet_length("payload") >= least).groupBy(F.sha1("payload").alias("digest")).agg(F.min("id").alias("first"), F.max("id").alias("last"))
    same = space.keep(same.where("first < last").select("digest", "first"), "same")
    rows = rows.withColumn("digest", F.sha1("payload")).join(same, "digest", "left").select("id", "url", "payload", F.when(F.col("id") > F.col("first"), F.col("first")).alias("first"))

    def run(batches):
        batches = (b for b in batches if b.num_rows)
        batch = next(batches, None)
        if batch is None:
            return
        task = TaskContext.get()
        path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        size = n = 0
        with whole_file(path) as out:
            while batch is not None:
                urls = batch.column(1).to_pylist()
                for page, url, body, first in zip(batch.column(0).to_pylist(), urls, as_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                    salt = b"%s %d" % (path.encode(), n)
                    kind = "response" if first is None else "revisit"
                    raw = member(record(kind, record_id(page, salt), date, url, body, payload_digest(body), None if first is None else record_id(first)))
                    out.write(raw)
                    size += len(raw)
                    n += 1
                batch = next(batches, None)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "bytes", "records"])

    return rows.mapInArrow(run, MANIFEST)


class Range:
    """The members of a gzipped WARC file that start in [start, end)."""

    def __init__(self, source, start: int, end: int):
        self.source, self.at, self.end = source, start, end
        source.seek(start)
        self.buffer, self.base = bytearray(), start

    def _more(self) -> bool:
        new = self.source.read(READ_CHUNK)
        self.buffer += new
        return bool(new)

    def _forget(self, upto: int) -> None:
        if upto - self.base > READ_CHUNK:
            del self.buffer[: upto - self.base]
            self.base = upto

    def _find(self) -> bool:
        """Move to the next place with the magic; False if none starts in the range."""
        while True:
            k = self.buffer.find(MAGIC, self.at - self.base)
            if k >= 0:
                self.at = self.base + k
                return self.at < self.end
            tail = self.base + len(self.buffer) - len(MAGIC) + 1
            self.at = max(self.at, tail)
            self._forget(self.at)
            if self.at >= self.end or not self._more():
                return False

    def _member(self) -> tuple[bytes, int] | None:
        """The content of the member here and where it ends; None if none starts here."""
        z, out, fed, seen = zlib.decompressobj(GZIP), [], self.at - self.base, 0
        while not z.eof:
            if fed >= len(self.buffer) and not self._more():
                if seen < len(VERSION):
                    return None
                raise ValueError(f"the record at {self.at} is cut off")
            piece = self.buffer[fed : fed + READ_CHUNK]
            fed += len(piece)
            try:
                got = z.decompress(piece)
            except zlib.error:
                if seen < len(VERSION):
                    return None
                raise
            out.append(got)
            if seen < len(VERSION):
                begins = b"".join(out)[: len(VERSION)]
                if not VERSION.startswith(begins[: len(VERSION)]) and not begins.startswith(VERSION):
                    return None
            seen += len(got)
        if seen < len(VERSION):
            return None
        return b"".join(out), self.base + fed - len(z.unused_data)

    def __iter__(self):
        while self.at < self.end and self._find():
            found = self._member()
            if found is None:
                self.at += 1
                continue
            content, self.at = found
            self._forget(self.at)
            yield content


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """A record's header fields (names in lower case) and its block."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, rest[: int(fields.get("content-length", 0))]


def http_parts(block: bytes) -> tuple[int, bytes]:
    """The length that an HTTP block's header states for the payload, and the payload."""
    head, _, body = block.partition(b"\r\n\r\n")
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return int(value), body
    return len(body), body


RECORDS = "page_id long, record_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def byte_ranges(files: DataFrame, split: int) -> DataFrame:
    """(path, bytes) of files to ranges of ``split`` bytes."""
    files = files.where("bytes > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long")))
    return files.select("path", "bytes", starts.alias("start")).select("path", "start", F.least(F.col("start") + split, F.col("bytes")).alias("end"))


def read_warc(files: DataFrame, split: int = 32 << 20, payload: bool = True) -> DataFrame:
    """The response and revisit records of files (path, bytes), and ``payload`` (null in a revisit) if wanted.

    Each payload is held against its digest; one that differs, and a file that
    is cut off, fail. ``page_id`` and ``refers_to`` are null in records that
    ``write_warc`` didn't make. No files give an empty table.
    """
    n = shuffle_width(files.sparkSession)
    ranges = byte_ranges(files, split)
    place = F.pmod(F.xxhash64("path") + F.floor(F.col("start") / split), F.lit(n)).cast("int")
    ranges = ranges.repartitionById(n, place)

    def run(batches):
        names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * payload
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * payload
        for batch in batches:
            for path, start, end in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows, size = [], 0
                with open_file(path) as source:
                    for content in Range(source, start, end):
                        fields, block = parse(content)
                        kind = fields.get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        length, body = http_parts(block)
                        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        if kind == "response":
                            found = payload_digest(body)
                            if length != len(body) or digest and digest != found:
                                raise ValueError(f"{path}: the payload of {fields.get('warc-record-id')} is damaged")
                            digest = found
                        refers = page_of(fields.get("warc-refers-to"))
                        rows.append((page_of(fields.get("warc-record-id")), fields.get("warc-record-id"), fields.get("warc-target-uri"), kind, length, digest, refers, body if kind == "response" else None)[: len(names)])
                        size += len(body) * payload + 200
                        if size > 8 << 20:
                            yield _table(rows, names, kinds)
                            rows, size = [], 0
                if rows:
                    yield _table(rows, names, kinds)

    return ranges.mapInArrow(run, RECORDS + ", payload binary" * payload)


def _table(rows, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def archive_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, bytes) of existing archives; Spark lists them and reads no content."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "archive")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    files = space.keep(write_warc(pages, space.path("warc")), "manifest")
    return read_warc(files, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS s FROM pages
), o AS (
  SELECT s, min(page_id) AS first FROM p GROUP BY s
), b AS (
  SELECT p.*, o.first, CAST(CAST(unhex(p.s) AS BIT) AS VARCHAR) AS bits FROM p JOIN o USING (s)
)
SELECT page_id, strlen(body) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
         + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM b
"""
