"""WARC: archives written and read back by tasks, in byte ranges.

Writing: every task streams its rows into gzip members, one for each record, of one file in the shared folder and reports the
file it finished; readers only see reported files, so what a lost or repeated attempt left behind is never read.
Reading: a file is cut into byte ranges. A task looks for the gzip magic in its range, takes a candidate for a member only if
its first bytes decode to a WARC header and the whole member passes its checksum and ends at another magic or the file's end,
and owns the records that start inside its range, reading past the range's end for the last.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir

#: A gzip member's first bytes, and a record's.
MAGIC, START = b"\x1f\x8b\x08", b"WARC/1."
#: Bytes of a reader's range, and of one read; most tasks of a reader, which then take several ranges each.
RANGE, READ, TASKS = 16 << 20, 1 << 20, 50_000
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_URN = "urn:reelspan:page:"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, digest: str) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP head alone, whose Content-Length still is the payload's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=_PRINTABLE)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_URN}{'' if refers_to is None else refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


_PRINTABLE = "".join(map(chr, range(33, 127))).replace("%", "")


def _write(folder: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        name, out, size, n = f"{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for b in batches:
            for page, url, payload, refers, revisit, digest in zip(*(c.to_pylist() for c in b.columns)):
                out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                member = record(page, url, payload, refers, revisit, base64.b32encode(bytes.fromhex(digest)).decode())
                out.write(member)
                size, n = size + len(member), n + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "size", "records"])

    return task


def write_warc(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Writes a record for each row below folder, a URI that all executors can write; returns the manifest (path, size, records).

    Of rows with equal payloads of at least `least` bytes the smallest id becomes a response (as do rows that repeat this id)
    and the others revisit it; shorter payloads all are responses. Null html is an empty payload, a null url is left out, a null
    id comes after all others. Other columns are ignored; an empty table writes nothing.
    """
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    payload = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    first = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    # only payloads of several pages can be revisited; written first, so that adaptive execution splits one that very many share
    first = cut(first.where("n > 1").select(F.col("digest").alias("d"), "first"))
    rows = rows.join(first, (F.col("digest") == F.col("d")) & (F.octet_length("payload") >= least), "left")
    revisit = F.col("d").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    rows = rows.select("id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"), "digest")
    return cut(rows.mapInArrow(_write(folder), "path string, size long, records long"))


class _Tail:
    """Bytes of an open file from a position on, read as they are asked for; what lies before `keep()` is let go."""

    def __init__(self, file, start: int):
        self.file, self.base, self.data, self.ended = file, start, b"", False
        file.seek(start)

    def upto(self, end: int) -> bool:
        """Whether bytes before position end are there."""
        while not self.ended and self.base + len(self.data) < end:
            more = self.file.read(READ)
            self.ended = not more
            self.data += more
        return self.base + len(self.data) >= end

    def keep(self, start: int) -> None:
        self.data, self.base = self.data[start - self.base :], start


def _member(tail: _Tail, at: int) -> tuple[bytes, int] | None:
    """The member that starts at a candidate position and the position after it, or None if that is no WARC record."""
    z, out, pos, head = zlib.decompressobj(31), [], at, b""
    try:
        while not z.eof:
            if not tail.upto(pos + 1):
                return None
            piece = tail.data[pos - tail.base :][:READ]
            out.append(z.decompress(piece))
            pos += len(piece) - len(z.unused_data)
            # a read may end inside the member's first bytes, which then give no or few bytes yet
            head = head if len(head) == len(START) else (head + out[-1])[: len(START)]
            if not START.startswith(head):
                return None
    except zlib.error:
        return None
    tail.upto(pos + len(MAGIC))
    after = tail.data[pos - tail.base :][: len(MAGIC)]
    data = b"".join(out)
    return (data, pos) if data.startswith(START) and after in (b"", MAGIC) else None


def parse(data: bytes) -> tuple | None:
    """The fields of RECORD from an unpacked record; None if it is no response or revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(re.findall(rb"(?m)^([\w-]+): ?(.*?)\r?$", head))
    kind = fields.get(b"WARC-Type", b"").decode()
    if kind not in ("response", "revisit"):
        return None
    number = lambda x: int(x) if (x := x.strip(b"<>").removeprefix(_URN.encode())) else None
    http, _, payload = rest[: int(fields[b"Content-Length"])].partition(b"\r\n\r\n")
    digest = fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
    if kind == "revisit":
        n, payload = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1]), None
    else:
        n = len(payload)
        if base32_sha1(payload) != digest:
            raise ValueError(f"payload of {fields[b'WARC-Record-ID']!r} differs from its digest")
    url = fields.get(b"WARC-Target-URI")
    return number(fields[b"WARC-Record-ID"]), url and unquote(url.decode()), kind, number(fields.get(b"WARC-Refers-To", b"")), n, digest, payload


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    for b in batches:
        for path, start, end in zip(*(c.to_pylist() for c in b.columns)):
            store, name = fs.FileSystem.from_uri(path)
            rows, held = [], 0
            with store.open_input_file(name) as file:
                tail, pos = _Tail(file, start), start
                while pos < end and tail.upto(pos + len(MAGIC)):
                    at = tail.data.find(MAGIC, pos - tail.base)
                    if at < 0:
                        pos = max(pos, tail.base + len(tail.data) - len(MAGIC) + 1)
                        tail.keep(pos)
                        tail.upto(pos + READ)
                        if tail.ended and tail.data.find(MAGIC) < 0:
                            break
                        continue
                    pos = tail.base + at
                    if pos >= end:
                        break
                    tail.keep(pos)
                    if (found := _member(tail, pos)) is None:
                        pos += 1
                        continue
                    row, (data, pos) = parse(found[0]), found
                    if row:
                        rows.append(row)
                        held += len(data)
                    if held > READ * 4:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def read_warc(manifest: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """Records of the files in manifest (path, size), one task's work being a byte range; columns as in RECORD."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = manifest.where("size > 0").select("path", starts.alias("start"), "size").select("path", "start", F.least(F.col("start") + range_bytes, "size").alias("end"))
    # a stated number of partitions: adaptive execution would join these small rows into one task
    tasks = min(ranges.count(), TASKS) or 1
    return ranges.repartition(tasks).mapInArrow(_read, RECORD)


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
