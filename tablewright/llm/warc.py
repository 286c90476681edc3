"""WARC archives: written by Spark tasks, read back by byte ranges.

Writing: each record is one gzip member. A member ends in the high byte of its length, which is zero below 16 MiB,
so Spark's text writer puts the members into files of any file system, with that zero byte as line separator, under
its own commit protocol (a larger record is followed by an empty member, which ends in zero too).

Reading: files are listed with their lengths, cut into byte ranges, and each task scans its range for the gzip magic.
A candidate counts only when its first bytes decode to WARC headers and the whole member passes its checksum and
content length. A task owns the records that start inside its range and reads past the end of it to finish them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import match

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 32 << 20
#: Payloads below this size are never replaced by revisits.
LEAST_REVISIT = 100
#: The tables carry no crawl time.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_CHUNK = 1 << 20
#: Tasks of a read; beyond it a task reads several ranges.
MOST_TASKS = 50_000

RECORDS = ("warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, "
           "http_length long, payload binary")


# -- which pages revisit which -----------------------------------------------------------

def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, digest, refers_to) of pages whose payload an earlier page has; one row for each page_id and digest."""
    ids = pages.filter(F.col("bytes") >= least).groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("rows"))
    first = (ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("ids"))
             .filter(F.col("ids") > 1).select("digest", "refers_to"))
    return (ids.join(first, "digest")
            .filter(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")))
            .select("page_id", "digest", "refers_to"))


# -- writing -----------------------------------------------------------------------------

def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


_EMPTY_MEMBER = _member(b"")


def _clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(record_id: str, url: str | None, payload: bytes, digest: str, length: int, refers_to: str | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            whole = _member(record(row["record_id"], row["url"], row["payload"] or b"", row["digest"], row["bytes"],
                                   row["refers_to"]))
            if whole[-1]:
                whole += _EMPTY_MEMBER
            out.append(whole[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def with_payload(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"),
                        F.octet_length(payload).cast("long").alias("bytes"), F.sha2(payload, 256).alias("digest"))


def _urn(page_id: Column) -> Column:
    """Ids of any characters: what a header may not hold is percent-encoded."""
    return F.concat(F.lit("urn:x-page:"), F.coalesce(F.url_encode(page_id.cast("string")), F.lit("")))


def page_of(urn: Column, id_type) -> Column:
    """The page id in a record's id; NULL where it is empty."""
    return F.url_decode(F.nullif(F.substring_index(urn, ":", -1), F.lit(""))).cast(id_type)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               least: int = LEAST_REVISIT) -> None:
    """A record for each row below `path` (a new folder).

    NULL html is an empty payload; NULL url leaves the header out; control characters of a url are percent-encoded.
    Of equal payloads of `least` bytes or more, the smallest id is the response (all rows that repeat that id with
    it too), a NULL id counts as the largest; only NULL ids: all are responses. An empty table gives an empty folder.
    """
    rows = with_payload(pages, id_col, url_col, html_col)
    joined = match(rows, revisits(rows, least), ["page_id", "digest"])
    ready = joined.select(
        _urn(F.col("page_id")).alias("record_id"), "url", "digest", "bytes",
        F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"),
        F.when(F.col("refers_to").isNotNull(), _urn(F.col("refers_to"))).alias("refers_to"))
    (ready.mapInArrow(_members, "value binary").select(F.col("value").cast("string").alias("value"))
     .write.option("compression", "none").option("lineSep", "\x00").text(path))


# -- reading -----------------------------------------------------------------------------

class _Window:
    """Bytes of a file from a moving position, read in chunks."""

    def __init__(self, file, size: int, at: int) -> None:
        self.file, self.size, self.base, self.data = file, size, at, b""

    def upto(self, end: int) -> None:
        """Have all bytes before `end` (as far as the file goes)."""
        have = self.base + len(self.data)
        if end > have and have < self.size:
            self.file.seek(have)
            self.data += self.file.read(min(max(end - have, READ_CHUNK), self.size - have))

    def drop(self, before: int) -> None:
        if before - self.base > READ_CHUNK:
            self.data = self.data[before - self.base:]
            self.base = before

    def find(self, start: int, end: int) -> int:
        """Position of the next magic that starts in [start, end), or -1."""
        while start < end:
            self.upto(min(end, start + READ_CHUNK) + len(MAGIC))
            stop = min(end, self.base + len(self.data))
            found = self.data.find(MAGIC, start - self.base, min(stop + len(MAGIC) - 1, self.size) - self.base)
            if found >= 0:
                return self.base + found
            if stop >= end or self.base + len(self.data) >= self.size:
                return -1
            start = stop - len(MAGIC) + 1
            self.drop(start)
        return -1


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    pairs = (line.partition(":") for line in lines if ":" in line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _decode(window: _Window, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block and end position of the record whose member starts at `at`; None if there is none."""
    unpack, out, pos, head_end = zlib.decompressobj(31), bytearray(), at, -1
    try:
        while not unpack.eof:
            window.upto(pos + 1)
            chunk = window.data[pos - window.base:pos - window.base + (1 << 16)]
            if not chunk:
                return None
            out += unpack.decompress(chunk)
            pos += len(chunk)
            if head_end < 0:
                if not bytes(out[:7]).startswith(b"WARC/1."[:len(out)]):
                    return None
                head_end = out.find(b"\r\n\r\n")
    except zlib.error:
        return None
    if head_end < 0:
        return None
    fields = _headers(bytes(out[:head_end]))
    if "warc-type" not in fields or not fields.get("content-length", "").isdigit():
        return None
    block = bytes(out[head_end + 4:head_end + 4 + int(fields["content-length"])])
    if len(block) != int(fields["content-length"]):
        return None
    return fields, block, pos - len(unpack.unused_data)


def records_of_range(path: str, size: int, start: int, end: int) -> Iterator[dict]:
    """The records that start in [start, end) of a file."""
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as file:
        window, at = _Window(file, size, start), start
        while (found := window.find(at, end)) >= 0:
            window.drop(found)
            decoded = _decode(window, found)
            if decoded is None:
                at = found + 1
                continue
            fields, block, at = decoded
            head, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
            length = _headers(head).get("content-length", "")
            yield {"warc_type": fields["warc-type"], "record_id": fields.get("warc-record-id", "").strip("<>"),
                   "target_uri": fields.get("warc-target-uri"),
                   "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
                   "payload_digest": fields.get("warc-payload-digest"),
                   "http_length": int(length) if length.isdigit() else None, "payload": payload}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("warc_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()),
                        ("refers_to", pa.string()), ("payload_digest", pa.string()), ("http_length", pa.int64()),
                        ("payload", pa.binary())])
    for batch in batches:
        for part in batch.to_pylist():
            rows, held = [], 0
            for row in records_of_range(part["path"], part["length"], part["start"], part["end"]):
                rows.append(row)
                held += len(row["payload"])
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_warc(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every record of the gzip archives below `path`; columns as in RECORDS.

    `path` is a local, hdfs:, s3: or gs: address. payload is the body without its HTTP head. Bytes that are no valid
    record are passed over.
    """
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") > 0).select("path", "length")
    cut = files.select("path", "length", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    cut = cut.withColumn("end", F.least(F.col("start") + range_bytes, F.col("length")))
    # A number of its own: by their few bytes the ranges would be put together, while their records are many.
    tasks = max(1, min(cut.count(), MOST_TASKS))
    return cut.repartition(tasks, "path", "start").mapInArrow(_read, RECORDS)
