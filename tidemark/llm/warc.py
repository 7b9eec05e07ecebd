"""WARC archives: a writer that refers repeated payloads to their first capture, and a sequential reader.

An archive is a row of gzip members, one per record. The reader inflates it in small steps, takes the header
block, then exactly Content-Length bytes and the closing blank lines, expects the member to end there, and
verifies the digest of the block and of a response's payload; so it holds one record at a time. Tasks write
through Arrow's file systems under names of their own and report them in a manifest, which is written before
anything is read: files of failed or repeated attempts are never read.

Of captures with equal payloads that with the smallest page id is a response, the others are revisits of it.

Defined cases: a null payload is empty; captures with equal page id and payload are alike, all responses or all
revisits; a capture without page id revisits another of its payload where that has an id, else it is a
response; a null url is the empty target; line breaks and other control characters in a url are percent-encoded;
a payload is held whole by the task that writes or reads its record, and no other; repeated rows are records of
their own; an empty table gives no archive and no records; other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, materialize, scratch_path, split_by, table

#: Bytes of an archive after which the next one begins, and bytes read at a time.
ARCHIVE_BYTES, STEP = 64 << 20, 1 << 16
LEAST_REVISIT = 0
CAPTURED = "1970-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: RFC 9562, URLs
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value: WARC 1.1
_MANIFEST = "file string, records long, bytes long"
_RECORD = "page_id long, record_id string, record_type string, target_uri string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {url}')}>"


def _uri(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or without its payload a revisit, before compression."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = _uri(url)
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, uri),
        "WARC-Date": CAPTURED,
        "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if page_id is not None:
        head["X-Page-Id"] = str(page_id)
    if revisit:
        head |= {"WARC-Profile": PROFILE, "X-Refers-To-Page-Id": str(refers_to)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def compress(record: bytes, level: int = 4) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def captures(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """`(page_id, url, payload, refers_to)`; only payloads that may be repeated are shuffled, and very common ones aren't."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.unhex(F.sha1("html")))
    again = F.octet_length("html") >= least
    first = materialize(rows.where(again).groupBy("key").agg(F.min("page_id").alias("low"), F.count("*").alias("n")).where("n > 1"), "repeated")
    maybe, once = split_by(rows, first, "key")
    joined = join_counted(maybe, first, ["key"], how="left").unionByName(once, allowMissingColumns=True).withColumn("low", F.when(again, F.col("low")))
    refers = F.when(F.col("low").isNotNull() & ~F.col("low").eqNullSafe(F.col("page_id")), F.col("low"))
    return joined.select("page_id", "url", F.col("html").cast("binary").alias("payload"), refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the pages as `.warc.gz` files under `path`, a folder that all executors reach; returns the manifest."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(path)
        out, name, records, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    system.create_dir(folder, recursive=True)
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{folder}/{name}", compression=None)
                member = compress(make_record(*row))
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return materialize(captures(pages).mapInArrow(run, _MANIFEST), "manifest")


class RecordStream:
    """The records of one archive, one at a time."""

    def __init__(self, stream, name: str = ""):
        self.stream, self.name, self.rest, self.members = stream, name, b"", 0
        self.inflate, self.held = None, b""

    def _more(self) -> bool:
        """Inflate a step of the member; whether there was more."""
        if self.inflate.eof:
            return False
        data = self.inflate.unconsumed_tail or self.rest or self.stream.read(STEP)
        self.rest = b""
        if not data:
            raise self._wrong("ends within a member")
        self.held += self.inflate.decompress(data, STEP)
        if self.inflate.eof:
            self.rest = self.inflate.unused_data
        return True

    def _wrong(self, what: str) -> ValueError:
        return ValueError(f"{self.name}, member {self.members}: {what}")

    def _take(self, n: int) -> bytes:
        parts, left = [], n
        while True:
            part, self.held = self.held[:left], self.held[left:]
            parts.append(part)
            left -= len(part)
            if not left:
                return b"".join(parts)
            if not self._more():
                raise self._wrong("is shorter than its length says")

    def _until(self, mark: bytes) -> bytes:
        while mark not in self.held:
            if not self._more():
                raise self._wrong("has no end of header")
        head, _, self.held = self.held.partition(mark)
        return head

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """(header, block) with its digest verified."""
        while self.rest or (data := self.stream.read(STEP)):
            self.rest = self.rest or data
            self.members += 1
            self.inflate, self.held = zlib.decompressobj(31), b""
            version, *lines = self._until(b"\r\n\r\n").decode().split("\r\n")
            if not version.startswith("WARC/1."):
                raise self._wrong(f"has version {version[:20]!r}")
            head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
            if not head.get("content-length", "").isdigit():
                raise self._wrong("has no length")
            block = self._take(int(head["content-length"]))
            if self._take(4) != b"\r\n\r\n":
                raise self._wrong("doesn't end where its length says")
            while self._more():
                pass
            if self.held:
                raise self._wrong("holds more than one record")
            if head.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
                raise self._wrong("block digest differs")
            yield head, block


def parse_record(head: dict[str, str], block: bytes) -> tuple:
    """A row of the reader, a response's payload digest verified."""
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.lower().split(": ", 1) for x in http.decode("latin-1").split("\r\n")[1:])
    claimed, revisit = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"] == "revisit"
    if not revisit and digest(payload) != claimed:
        raise ValueError(f"{head['warc-record-id']}: payload digest differs")
    number = lambda k: int(head[k]) if k in head else None
    size = int(fields["content-length"]) if revisit else len(payload)
    return number("x-page-id"), head["warc-record-id"], head["warc-type"], head["warc-target-uri"], number("x-refers-to-page-id"), size, claimed, None if revisit else payload


def read_archives(manifest: DataFrame, path: str) -> DataFrame:
    """A row for each record of the archives in the manifest."""
    import pyarrow as pa

    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in _RECORD.split(", ")]

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    rows, size = [], 0
                    for head, block in RecordStream(stream, name):
                        rows.append(parse_record(head, block))
                        size += len(block)
                        if size > 4 << 20:
                            yield rows_of(rows)
                            rows, size = [], 0
                    if rows:
                        yield rows_of(rows)

    tasks = max(1, manifest.count())
    return manifest.select("file").repartition(tasks, "file").mapInArrow(run, _RECORD)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    records = read_archives(write_archives(table(spark, sf_dir, "pages"), path), path)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 is the only step that SQL lacks; DuckDB's list functions spell it out over the bits of the digest.
ORACLE = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as payload_bytes, sha1(html) as hex from p),
b as (select *, list_aggregate(list_transform(range(0, 40), lambda i: lpad(bin(instr('0123456789abcdef', substr(hex, i::int + 1, 1)) - 1), 4, '0')), 'string_agg', '') as bits from d),
r as (select *, min(page_id) over (partition by hex) as low from b)
select page_id, payload_bytes::bigint as payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0b' || substr(bits, i::int * 5 + 1, 5))::int) + 1, 1)), 'string_agg', '') as payload_digest,
  case when low = page_id then 'response' else 'revisit' end as record_type,
  case when low <> page_id then low end as refers_to
from r
"""
