"""Operator 5: WARC archives, written with revisit records and read by byte ranges.

Writing. Records with equal payloads of at least ``min_bytes`` become one
response (the largest page id) and revisits of it. Each record is a gzip member
of its own. Spark's text sink writes the members, so its commit protocol covers
lost tasks: a member ends with its size, whose last byte is 0 below 16 MiB (an
empty member follows larger ones), and that byte is given to the sink as its
line separator. The part files are plain concatenations of gzip members.

Reading. The archive files are cut into byte ranges; a task scans its range for
the gzip magic, takes a candidate for a record only if decoding it yields a WARC
version line, and owns the records that start inside its range, reading past
the end to finish the last one. Ranges are rows of a table, so a large file is
read by many tasks and a lost task is read again.

Scale: one shuffle of the digests to find the groups' largest ids (pre-summed
per task) and a join that adaptive execution splits where one payload holds
many rows. Nothing is collected but the list of archive files' sizes, which the
reader handles as a table as well.

Edge cases: null html is an empty payload, which takes part in revisits like any
other if ``min_bytes`` is 0; rows repeated with one page id: one of equal payload
is the response under that id, and all of them are (a record never revisits its
own id); null ids, and ids that
are no numbers, are written as an empty id and read back as null; an empty
table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import shared_folder

MAGIC = b"\x1f\x8b\x08"
#: An empty gzip member; it ends with a zero byte.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff0300") + bytes(8)
RANGE_BYTES = 32 << 20
CHUNK = 1 << 20
DATE = "2000-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def assigned(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, body, digest, refers_to): refers_to is null for responses."""
    number = F.col("page_id") if dict(pages.dtypes)["page_id"] == "bigint" else F.expr("try_cast(page_id AS BIGINT)")
    rows = pages.select(number.alias("page_id"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("body")).withColumn("digest", F.unhex(F.sha1("body")))
    keys = rows.select("page_id", "digest", F.octet_length("body").alias("n"))
    groups = keys.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("rows")).where("rows > 1").select(F.col("digest").alias("of"), "first")
    joined = rows.join(groups, F.col("digest") == F.col("of"), "left")
    other = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "body", "digest", F.when(other, F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, body: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member whose last byte is 0."""
    revisit = refers_to is not None
    name = "" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"X-Payload-Length: {len(body)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = b"" if revisit else body
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = packer.compress(raw) + packer.flush()
    return member if member[-1] == 0 else member + EMPTY_MEMBER


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        members = [record(*row)[:-1] for row in zip(*(b.column(k).to_pylist() for k in range(5)))]
        yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], names=["member"])


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write one record per row of (page_id, url, html) below ``path``."""
    members = assigned(pages, min_bytes).mapInArrow(_records, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def byte_ranges(spark, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, start, stop) for every archive file below ``path``; reads no contents."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    return files.where("length > 0").select("path", starts.alias("start")).withColumn("stop", F.col("start") + F.lit(range_bytes))


class _Window:
    """A file seen through a buffer that moves forward."""

    def __init__(self, uri: str):
        fs, name = pafs.FileSystem.from_uri(uri)
        self.file, self.at, self.data = fs.open_input_file(name), 0, b""
        self.size = self.file.size()

    def upto(self, start: int, stop: int) -> bytes:
        """The bytes from start to stop, or to the end of the file."""
        stop = min(stop, self.size)
        if not self.at <= start <= self.at + len(self.data):
            self.at, self.data = start, b""
        if (have := self.at + len(self.data)) < stop:
            self.data = self.data[start - self.at :] + self.file.read_at(max(stop - have, CHUNK), have)
            self.at = start
        return self.data[start - self.at : stop - self.at]

    def find(self, start: int, stop: int) -> int:
        """Where the next magic begins in [start, stop), else -1."""
        while start < stop:
            piece = self.upto(start, min(start + CHUNK, stop) + len(MAGIC) - 1)
            if (k := piece.find(MAGIC)) >= 0:
                return start + k if start + k < stop else -1
            start += CHUNK
        return -1

    def member(self, start: int) -> tuple[bytes, int] | None:
        """The decoded member at ``start`` and where it ends; None if there is no WARC record."""
        decoder, out, at = zlib.decompressobj(31), [], start
        head = b""
        try:
            while not decoder.eof:
                piece = self.upto(at, at + CHUNK // 16)
                if not piece:
                    return None
                out.append(decoder.decompress(piece))
                at += len(piece)
                if len(head) < 7:
                    head = b"".join(out)[:7]
                    if head and not b"WARC/1.".startswith(head):
                        return None
            body = b"".join(out)
        except zlib.error:
            return None
        return (body, at - len(decoder.unused_data)) if body.startswith(b"WARC/1.") else None


def parse(raw: bytes) -> tuple:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload)"""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    kind, body = fields["WARC-Type"], rest[: int(fields["Content-Length"])]
    revisit = kind == "revisit"
    return (
        number(fields["WARC-Record-ID"]),
        fields["WARC-Target-URI"],
        kind,
        number(fields.get("WARC-Refers-To")),
        int(fields["X-Payload-Length"]) if revisit else len(body),
        fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else base32_sha1(body),
        None if revisit else body,
    )


RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _scan(with_payload: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, stop in zip(*(b.column(k).to_pylist() for k in range(3))):
                view, at, rows, held = _Window(path), start, [], 0
                while (at := view.find(at, stop)) >= 0:
                    if (found := view.member(at)) is None:
                        at += 1
                        continue
                    row = parse(found[0])
                    rows.append(row if with_payload else (*row[:-1], None))
                    held, at = held + len(found[0]), found[1]
                    if held > 8 << 20:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    return scan


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def read_archive(spark, path: str, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """The records of all archives below ``path`` (see RECORD_SCHEMA); payload is null for revisits."""
    ranges = byte_ranges(spark, path, range_bytes)
    n = max(1, ranges.count())
    return ranges.repartition(n).mapInArrow(_scan(with_payload), RECORD_SCHEMA)


def digest(pages: DataFrame) -> DataFrame:
    """What op5 returns, from an archive written to the shared folder and read back."""
    path = shared_folder(pages.sparkSession, "warc")
    write_archive(pages, path)
    found = read_archive(pages.sparkSession, path, with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top = page_id THEN NULL ELSE top END AS refers_to
FROM g
"""
