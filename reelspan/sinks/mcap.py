"""MCAP recordings from rows of messages, with chunks, message indexes and a summary, after the public MCAP format.

df.write.format("mcap") after register(); write_mcap() deals and orders the rows. Columns: output (file name), topic, log_time_ns,
publish_time_ns, sequence, data; optional schema_name, schema_encoding and message_encoding. Options: path, manifest, compression (none, zstd or lz4) and
chunk_bytes. A task streams its files out and holds a chunk and the index; files appear when the job commits (see staging.py).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from reelspan.sources.mcap import CHANNEL, CHUNK, CHUNK_INDEX, DATA_END, FOOTER, HEADER, MAGIC, MESSAGE, MESSAGE_INDEX, SCHEMA, STATISTICS

from .staging import StagedWriter, Written, resolve

LIBRARY = "reelspan"


def record(op: int, *parts: bytes) -> bytes:
    return struct.pack("<BQ", op, sum(map(len, parts))) + b"".join(parts)


def text(s: str) -> bytes:
    return struct.pack("<I", len(s.encode())) + s.encode()


def counted(data: bytes) -> bytes:
    return struct.pack("<I", len(data)) + data


def packed(data: bytes, compression: str) -> bytes:
    if compression == "zstd":
        import zstandard

        return zstandard.ZstdCompressor().compress(data)
    return bytes(pa.Codec("lz4").compress(data)) if compression == "lz4" else data


class Recording:
    """One file in the making: add() messages, then close()."""

    def __init__(self, out, compression: str = "", chunk_bytes: int = 4 << 20):
        self.out, self.compression, self.chunk_bytes, self.at = out, compression, chunk_bytes, 0
        self.schemas: dict[tuple, int] = {}
        self.channels: dict[tuple, int] = {}
        self.definitions: list[bytes] = []
        self.counts: dict[int, int] = {}
        self.indexes: list[bytes] = []
        self.start, self.end = (1 << 64) - 1, 0
        self._write(MAGIC + record(HEADER, text(""), text(LIBRARY)))
        self._fresh()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _fresh(self) -> None:
        self.parts, self.size, self.places = [], 0, {}

    def _put(self, data: bytes) -> None:
        self.parts.append(data)
        self.size += len(data)

    def channel(self, topic: str, encoding: str, schema: str | None, schema_encoding: str) -> int:
        key = (topic, encoding, schema, schema_encoding)
        if key not in self.channels:
            number = 0
            if schema is not None:
                number = self.schemas.setdefault((schema, schema_encoding), len(self.schemas) + 1)
                if number == len(self.schemas) and not any(k[2:] == key[2:] for k in self.channels):
                    self._define(record(SCHEMA, struct.pack("<H", number), text(schema), text(schema_encoding), counted(b"")))
            self.channels[key] = len(self.channels) + 1
            self._define(record(CHANNEL, struct.pack("<HH", self.channels[key], number), text(topic), text(encoding), counted(b"")))
        return self.channels[key]

    def _define(self, data: bytes) -> None:
        self.definitions.append(data)
        self._put(data)

    def add(self, channel: int, sequence: int, log: int, publish: int, data: bytes) -> None:
        self.places.setdefault(channel, []).append((log, self.size))
        self._put(record(MESSAGE, struct.pack("<HIQQ", channel, sequence, log, publish), data))
        self.counts[channel] = self.counts.get(channel, 0) + 1
        self.start, self.end = min(self.start, log), max(self.end, log)
        if self.size >= self.chunk_bytes:
            self.flush()

    def flush(self) -> None:
        if not self.parts:
            return
        inner = b"".join(self.parts)
        times = [t for rows in self.places.values() for t, _ in rows]
        span, body, kind = struct.pack("<QQ", min(times, default=0), max(times, default=0)), packed(inner, self.compression), text(self.compression)
        offset = self.at
        self._write(record(CHUNK, span, struct.pack("<QI", len(inner), zlib.crc32(inner)), kind, struct.pack("<Q", len(body)), body))
        length, offsets = self.at - offset, b""
        behind = self.at
        for c, rows in sorted(self.places.items()):
            offsets += struct.pack("<HQ", c, self.at)
            self._write(record(MESSAGE_INDEX, struct.pack("<H", c), counted(np.array(rows, "<u8").tobytes())))
        self.indexes.append(record(CHUNK_INDEX, span, struct.pack("<QQ", offset, length), counted(offsets), struct.pack("<Q", self.at - behind), kind, struct.pack("<QQ", len(body), len(inner))))
        self._fresh()

    def close(self) -> int:
        """Writes the rest and the summary; the file's size."""
        self.flush()
        self._write(record(DATA_END, struct.pack("<I", 0)))
        start, counts = self.at, b"".join(struct.pack("<HQ", c, n) for c, n in sorted(self.counts.items()))
        told = struct.pack("<QHIIIIQQ", sum(self.counts.values()), len(self.schemas), len(self.channels), 0, 0, len(self.indexes), self.start if self.counts else 0, self.end)
        self._write(b"".join(self.definitions) + record(STATISTICS, told, counted(counts)) + b"".join(self.indexes))
        self._write(record(FOOTER, struct.pack("<QQI", start, 0, 0)) + MAGIC)
        return self.at


class _Writer(StagedWriter):
    def __init__(self, options: dict):
        super().__init__(options)
        kind = options.get("compression", "zstd").lower()
        if kind not in ("", "none", "zstd", "lz4"):
            raise ValueError(f"unknown compression {kind}")
        self.compression, self.chunk_bytes = kind.replace("none", ""), int(options.get("chunk_bytes", 4 << 20))

    def write(self, rows: Iterator[Row]) -> Written:
        done = Written()
        folder = None
        for name, own in groupby(rows, lambda r: r["output"]):
            folder = folder or self.attempt()
            staged = f"{folder}/{len(done.files)}.mcap"
            store, path = resolve(staged)
            with store.open_output_stream(path) as out:
                recording = Recording(out, self.compression, self.chunk_bytes)
                for r in own:
                    r = r.asDict()
                    c = recording.channel(r["topic"], r.get("message_encoding") or "", r.get("schema_name"), r.get("schema_encoding") or "")
                    recording.add(c, r["sequence"] or 0, r["log_time_ns"], r["log_time_ns"] if r.get("publish_time_ns") is None else r["publish_time_ns"], bytes(r["data"] or b""))
                size = recording.close()
            told = {"output": name, "path": f"{self.folder}/{name}", "messages": sum(recording.counts.values()), "chunks": len(recording.indexes), "file_bytes": size}
            done.files.append((name, staged, told))
        return done


class _Mcap(DataSource):
    @classmethod
    def name(cls):
        return "mcap"

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(_Mcap)


def write_mcap(messages: DataFrame, folder: str, manifest: str | None = None, **options: str) -> None:
    """Writes each output's messages by time (then sequence and topic) as one file; a file that exists fails the job, and nothing is published.
    A null payload is empty, a null publish time is the log time."""
    register(messages.sparkSession)
    rows = messages.repartition("output").sortWithinPartitions("output", "log_time_ns", "sequence", "topic")
    rows.write.format("mcap").mode("append").options(path=folder, **({"manifest": manifest} if manifest else {}), **options).save()
