"""WARC records and the assembly of capture transactions.

A capture is a response (or resource or revisit) record with the request and metadata records that name it,
or that it names, in WARC-Concurrent-To.  The links are resolved on ids alone; only then do records and
payloads meet, in one shuffle, and one nested row for each capture comes out.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import cut, table

RECORD = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("content_type", pa.string()), ("block", pa.binary())])
RECORD_DDL = "record_id string, type string, uri string, date string, concurrent_to array<string>, content_type string, block binary"
#: Records that stand for a capture.
CAPTURES = ("response", "resource", "revisit")
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _headers(lines: list[bytes]) -> list[tuple[str, str]]:
    """Header fields in order; lines that start with white space continue the one before."""
    out: list[tuple[str, str]] = []
    for raw in lines:
        text = raw.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        elif ":" in text:
            name, value = text.split(":", 1)
            out.append((name.strip().lower(), value.strip()))
    return out


MAGIC = b"\x1f\x8b\x08"


class _Members(io.RawIOBase):
    """The content of gzip members end to end, up to the first damage; ``resume`` goes on from the next member after it."""

    def __init__(self, source) -> None:
        self.source, self.rest, self.made, self.broken = source, b"", b"", False
        self._begin()

    def _begin(self) -> None:
        self.inner, self.fed = zlib.decompressobj(31), False

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while not self.made:
            if self.inner is None or self.broken:
                return 0
            if self.inner.eof:
                self.rest = self.inner.unused_data
                self._begin()
            data = self.rest or self.source.read(1 << 16)
            self.rest = b""
            if not data:
                self.made, self.inner = self.inner.flush(), None
                continue
            try:
                self.made = self.inner.decompress(data)
                self.fed = True
            except zlib.error:
                # A member's own first bytes can't begin the next one.
                self.broken, self.rest = True, data if self.fed else data[1:]
        n = min(len(target), len(self.made))
        target[:n], self.made = self.made[:n], self.made[n:]
        return n

    def resume(self) -> bool:
        """Whether a member follows the damage that ended the stream; it is read from next."""
        if not self.broken:
            return False
        held = self.rest
        while (at := held.find(MAGIC)) < 0:
            more = self.source.read(1 << 16)
            if not more:
                return False
            held = held[-len(MAGIC) + 1 :] + more
        self.rest, self.broken = held[at:], False
        self._begin()
        return True


def read_records(stream) -> Iterator[dict]:
    """Records of a WARC stream, gzip (whole or by record) or plain.

    What follows a damaged record head is skipped up to the next one, and a damaged gzip member, with the
    record that it cuts off, up to the next member.
    """
    buffered = stream if isinstance(stream, io.BufferedReader) else io.BufferedReader(stream)
    if buffered.peek(2)[:2] != MAGIC[:2]:
        yield from plain_records(buffered)
        return
    members = _Members(buffered)
    yield from plain_records(io.BufferedReader(_Shared(members), 1 << 20))
    while members.resume():
        yield from plain_records(io.BufferedReader(_Shared(members), 1 << 20))


class _Shared(io.RawIOBase):
    """Reads on from ``members`` and leaves it open."""

    def __init__(self, members: _Members) -> None:
        self.members = members

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        return self.members.readinto(target)


def plain_records(buffered: io.BufferedReader) -> Iterator[dict]:
    while True:
        line = buffered.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        lines = []
        while (line := buffered.readline()) not in (b"\r\n", b"\n", b""):
            lines.append(line)
        fields = _headers(lines)
        named = dict(reversed(fields))
        size = named.get("content-length", "")
        block = buffered.read(int(size)) if size.isdigit() else b""
        strip = lambda v: v.strip("<>") if v else None
        if size.isdigit() and len(block) == int(size):
            yield {
                "record_id": strip(named.get("warc-record-id")),
                "type": named.get("warc-type", "").lower() or None,
                "uri": strip(named.get("warc-target-uri")),
                "date": named.get("warc-date"),
                "concurrent_to": [strip(v) for n, v in fields if n == "warc-concurrent-to"],
                "content_type": named.get("content-type"),
                "block": block,
            }


def write_record(record: dict) -> bytes:
    """One record in WARC 1.1 form, not compressed."""
    head = [b"WARC/1.1"]
    fields = [("WARC-Type", record["type"]), ("WARC-Record-ID", f"<{record['record_id']}>"), ("WARC-Target-URI", record["uri"]), ("WARC-Date", record["date"])]
    fields += [("WARC-Concurrent-To", f"<{c}>") for c in record["concurrent_to"] or []]
    fields += [("Content-Type", record["content_type"]), ("Content-Length", len(record["block"]))]
    head += [f"{n}: {v}".encode() for n, v in fields if v is not None]
    return b"\r\n".join(head) + b"\r\n\r\n" + record["block"] + b"\r\n\r\n"


def _batches(records: Iterator[dict], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for r in records:
        rows.append(r)
        size += len(r["block"])
        if size > most:
            yield pa.RecordBatch.from_pylist(rows, RECORD)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, RECORD)


def parse_warc(segments: DataFrame, content: str = "content") -> DataFrame:
    """Records of a column of WARC bytes; null and empty bytes hold none, truncated last records are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment in batch.column(0):
                if segment.is_valid and len(segment.as_buffer()):
                    yield from _batches(read_records(io.BufferedReader(io.BytesIO(segment.as_py()))))

    return segments.select(content).mapInArrow(run, RECORD_DDL)


def read_warc(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of WARC files.

    Files on a file system that every executor mounts are streamed, one a task.  Paths with a scheme, such as
    an object store's, go through Spark's own reader, which holds a whole file (2 GB at most) in a task.
    """
    if any("://" in p for p in paths):
        return parse_warc(spark.read.format("binaryFile").load(paths).select("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open(path, "rb") as f:
                    yield from _batches(read_records(f))

    files = spark.createDataFrame([(p,) for p in paths], "path string")
    return files.repartition(max(1, len(paths))).mapInArrow(run, RECORD_DDL)


def _id(kind: str, capture: object) -> str:
    return f"urn:uuid:{uuid.uuid5(_SPACE, f'{kind}:{capture}')}"


def page_records(page: int | None, url: str | None, html: str | None, capture: object) -> list[dict]:
    """Request, response and metadata records of one page, as a crawler would write them; ``capture`` tells rows of one page apart."""
    body = (html or "").encode()
    host, path = re.match(r"(?:[a-z]+://)?([^/?#]*)([^#]*)", url or "").groups()
    common = {"uri": url, "date": "2024-01-01T00:00:00Z"}
    response = _id("response", capture)
    return [
        common | {"record_id": _id("request", capture), "type": "request", "concurrent_to": [response], "content_type": "application/http; msgtype=request", "block": f"GET {path or '/'} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()},
        common | {"record_id": response, "type": "response", "concurrent_to": [], "content_type": "application/http; msgtype=response", "block": b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body},
        common | {"record_id": _id("metadata", capture), "type": "metadata", "concurrent_to": [_id("request", capture)], "content_type": "application/warc-fields", "block": f"page-id: {page}\r\nfetchTimeMs: {len(body) % 1000}\r\n".encode()},
    ]


def pages_to_warc(pages: DataFrame) -> DataFrame:
    """WARC segments (``content``): for each batch of pages three, of its requests, responses and metadata, each record a gzip member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                records = [page_records(*row) for row in zip(*(part[c].to_pylist() for c in ("page_id", "url", "html", "capture")))]
                segments = [b"".join(zlib_member(write_record(r[k])) for r in records) for k in range(3)]
                yield pa.record_batch([pa.array(segments, pa.binary())], names=["content"])

    # Every row is a capture of its own, whatever it repeats; the number follows from the row's place in its file.
    return pages.select("page_id", "url", "html", F.monotonically_increasing_id().alias("capture")).mapInArrow(run, "content binary")


def zlib_member(data: bytes) -> bytes:
    return gzip.compress(data, 1, mtime=0)


def http_status(block: Column) -> Column:
    return F.regexp_extract(F.decode(F.substring(block, 1, 64), "ISO-8859-1"), r"\AHTTP/\S+\s+(\d{3})", 1).try_cast("int")


def http_body(block: Column) -> Column:
    """What follows the first empty line; the whole block if there is none."""
    at = F.position(F.lit(bytearray(b"\r\n\r\n")), block)
    return F.when(at > 0, F.substring(block, at + 4, F.length(block))).otherwise(block)


def assemble(records: DataFrame) -> DataFrame:
    """One row for each capture: record_id, uri, date, status, payload (bytes after the HTTP head), request, metadata.

    ``request`` is a struct (record_id, block) or null, ``metadata`` an array of such structs by id.  A
    request belongs to a capture if either names the other in concurrent_to; metadata also if it is so tied
    to one of the capture's requests.  Of several requests the one of the least id counts; a record tied to
    several captures belongs to each.  Null or repeated record ids: records without an id can name others but
    not be named; of captures that repeat an id one (of the least uri, date and block) counts.  Requests and
    metadata that lead to no capture, and records of other types, are left out.  Extra columns are ignored.
    No records give no rows.
    """
    kind = F.when(F.col("type").isin(*CAPTURES), "capture").otherwise(F.col("type"))
    known = records.select("record_id", F.lower("type").alias("type"), "uri", "date", F.array_compact(F.coalesce("concurrent_to", F.array().cast("array<string>"))).alias("concurrent_to"), "block")
    known = known.where(F.col("type").isin("request", "metadata", *CAPTURES)).withColumn("kind", kind)
    # An id for records without one, from all they hold, so that they can be told apart.
    known = known.withColumn("key", F.coalesce("record_id", F.concat(F.lit("none:"), F.sha2(F.concat(F.coalesce("block", F.lit(bytearray(b""))), F.to_json(F.struct("type", "uri", "date", "concurrent_to")).cast("binary")), 256))))
    # All but the captures' payloads, read once.
    heads = cut(known.select("key", "kind", "record_id", "concurrent_to", F.when(F.col("kind") != "capture", F.col("block")).alias("block")))
    ids = heads.select("key", "kind", "concurrent_to")
    named = ids.select("key", "kind", F.explode("concurrent_to").alias("other"))
    ties = named.join(ids.select(F.col("key").alias("other"), F.col("kind").alias("other_kind")), "other").where("key <> other")
    ties = ties.select("key", "kind", "other", "other_kind").unionByName(ties.select(F.col("other").alias("key"), F.col("other_kind").alias("kind"), F.col("key").alias("other"), F.col("kind").alias("other_kind")))
    ties = cut(ties.distinct())
    asked = ties.where("kind = 'request' and other_kind = 'capture'").select("key", F.col("other").alias("capture"))
    direct = ties.where("kind = 'metadata' and other_kind = 'capture'").select("key", F.col("other").alias("capture"))
    through = ties.where("kind = 'metadata' and other_kind = 'request'").select("key", F.col("other").alias("request")).join(asked.withColumnRenamed("key", "request"), "request").select("key", "capture")
    tied = asked.unionByName(direct).unionByName(through).distinct()
    small = heads.where("kind <> 'capture'").select("key", "kind", "record_id", "block").join(tied, "key")
    part = F.struct("record_id", "block")
    sides = small.groupBy("capture").agg(
        F.min(F.when(F.col("kind") == "request", part)).alias("request"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "metadata", part))).alias("metadata"),
    )
    captures = known.where("kind = 'capture'").withColumnRenamed("key", "capture").select("capture", "record_id", "uri", "date", "block")
    once = captures.groupBy("capture").agg(F.min(F.struct("record_id", "uri", "date", "block")).alias("c"))
    body = F.col("c.block")
    return once.join(sides, "capture", "left").select(
        "c.record_id", "c.uri", "c.date", http_status(body).alias("status"), http_body(body).alias("payload"), "request", F.coalesce("metadata", F.array().cast("array<struct<record_id:string,block:binary>>")).alias("metadata")
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC segments, parsed again and assembled; the page id comes back through the metadata.

    Every row of the table is a capture.  A null or empty url asks for / and comes back as null, a null page has an
    empty payload.
    """
    records = parse_warc(pages_to_warc(table(spark, sf_dir, "pages")))
    rows = assemble(records)
    page = F.regexp_extract(F.decode(F.col("metadata")[0]["block"], "UTF-8"), r"page-id: (-?\d+)", 1).try_cast("long")
    line = F.substring_index(F.decode(F.col("request.block"), "UTF-8"), " HTTP/1.1", 1)
    return rows.select(page.alias("page_id"), F.col("uri").alias("url"), "status", line.alias("request_line"), F.decode("payload", "UTF-8").alias("html"), F.size("metadata").alias("n_metadata"))


WARC_SQL = """
select page_id, nullif(url, '') as url, 200 as status,
  'GET ' || case when p = '' then '/' else p end as request_line, coalesce(html, '') as html, 1 as n_metadata
from (select page_id, url, html, coalesce(regexp_extract(url, '^(?:[a-z]+://)?([^/?#]*)([^#]*)', 2), '') as p from pages)
"""
