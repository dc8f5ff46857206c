"""MP4 files as DataFrames, after the public ISO base media format: their tracks, sample tables and pairing markers.

Format mp4_tracks: one row a track of each .mp4 file at or below the option path, read from the file's boxes without its media
data; a file that can't be read has one row with an error. A partition reads up to FILES files. register() makes it known to a session.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .mcap import find_files, open_file

#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta"}
#: Bytes of payload that a task holds at a time, and files of a partition.
PART, FILES = 4 << 20, 32

COLUMNS = (
    "file string, track int, kind string, entry string, timescale long, media_duration long, width int, height int, channels int, bits int, co64 boolean, "
    "keyframes long, samples long, fixed_size long, empty_edit_ms long, offsets array<long>, sizes array<long>, stts array<struct<count:long,delta:long>>, "
    "stsc array<struct<first:long,samples:long>>, mdat_start long, mdat_end long, file_size long, pairing string, error string"
)
NAMES = [c.split(" ")[0] for c in COLUMNS.split(", ")]


class Mp4Error(ValueError):
    pass


def boxes(read, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, begin of content, end) of the boxes from at to end; read(at, n) gives bytes."""
    while at < end:
        if at + 8 > end:
            raise Mp4Error("bytes after the last box")
        size, kind = struct.unpack(">I4s", read(at, 8))
        head = 8
        if size == 1:
            head, size = 16, struct.unpack(">Q", read(at + 8, 8))[0] if at + 16 <= end else 0
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise Mp4Error(f"box {kind.decode('latin1')} ends after its parent")
        yield kind, at + head, at + size
        at += size


def _leaves(buffer: bytes, lo: int, hi: int, found: dict[bytes, bytes], tracks: list[dict]) -> None:
    for kind, a, z in boxes(lambda at, n: buffer[at : at + n], lo, hi):
        if kind == b"trak":
            tracks.append({})
            _leaves(buffer, a, z, tracks[-1], tracks)
        elif kind in NESTED:
            _leaves(buffer, a, z, found, tracks)
        else:
            found.setdefault(kind, buffer[a:z])


def _table(box: bytes, at: int, kind: str, columns: int = 1) -> np.ndarray:
    """Rows of big-endian numbers behind a count at `at`."""
    n = struct.unpack_from(">I", box, at)[0]
    if at + 4 + n * columns * int(kind[1]) > len(box):
        raise Mp4Error("a table ends early")
    return np.frombuffer(box, f">{kind}", n * columns, at + 4).astype(np.int64).reshape(n, columns)


#: Boxes without which a track's samples can't be found; one of each row.
REQUIRED = ((b"mdhd",), (b"stts",), (b"stsc",), (b"stsz",), (b"stco", b"co64"))


def _track(t: dict[bytes, bytes]) -> dict:
    lacking = [" or ".join(k.decode() for k in kinds) for kinds in REQUIRED if not t.keys() & set(kinds)]
    if lacking:
        raise Mp4Error(f"no {', '.join(lacking)} box")
    large = b"co64" in t
    offsets = _table(t[b"co64" if large else b"stco"], 4, "u8" if large else "u4")[:, 0]
    fixed, samples = struct.unpack_from(">II", t[b"stsz"], 4)
    stsc = _table(t[b"stsc"], 4, "u4", 3)
    clock = struct.unpack_from(">IQ", t[b"mdhd"], 20) if t[b"mdhd"][0] == 1 else struct.unpack_from(">II", t[b"mdhd"], 12)
    if fixed:  # a size for each chunk: its samples times theirs
        per_chunk = stsc[np.searchsorted(stsc[:, 0], np.arange(1, len(offsets) + 1), side="right") - 1, 1] if len(stsc) and len(offsets) else np.zeros(0, np.int64)
        if per_chunk.sum() != samples:
            raise Mp4Error("stsc and stsz differ in samples")
        sizes = per_chunk * fixed
    else:
        sizes = _table(t[b"stsz"], 8, "u4")[:, 0]
    kind = t.get(b"hdlr", b"\0" * 12)[8:12].rstrip(b"\0").decode("latin1")
    out = {"kind": kind, "timescale": clock[0], "media_duration": clock[1], "co64": large, "samples": samples, "fixed_size": fixed, "empty_edit_ms": 0}
    out |= {"offsets": offsets.tolist(), "sizes": sizes.tolist(), "stts": list(map(tuple, _table(t[b"stts"], 4, "u4", 2).tolist())), "stsc": list(map(tuple, stsc[:, :2].tolist()))}
    out["keyframes"] = struct.unpack_from(">I", t[b"stss"], 4)[0] if b"stss" in t else 0
    if b"stsd" in t:
        out["entry"] = t[b"stsd"][12:16].decode("latin1")
        if kind == "soun":
            out["channels"], out["bits"] = struct.unpack_from(">HH", t[b"stsd"], 32)
    if b"elst" in t and struct.unpack_from(">I", t[b"elst"], 4)[0]:
        length, media = struct.unpack_from(">Qq" if t[b"elst"][0] == 1 else ">Ii", t[b"elst"], 8)
        out["empty_edit_ms"] = length if media == -1 else 0
    if b"tkhd" in t:
        w, h = struct.unpack_from(">II", t[b"tkhd"], 88 if t[b"tkhd"][0] == 1 else 76)
        out["width"], out["height"] = w >> 16, h >> 16
    return out


def pairing(marker: bytes | None) -> str | None:
    """The JSON of a pairing marker that names a group, else null."""
    try:
        found = json.loads(marker.decode("utf-8")) if marker else None
    except ValueError:
        return None
    return marker.decode("utf-8") if isinstance(found, dict) and found.get("group") else None


def tracks_of(file, size: int) -> list[dict]:
    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    top = {}
    for kind, a, z in boxes(read, 0, size):
        top.setdefault(kind, (a, z))
    if not {b"ftyp", b"moov", b"mdat"} <= top.keys():
        raise Mp4Error("ftyp, moov and mdat are not all there")
    movie, tracks = {}, []
    buffer = read(top[b"moov"][0], top[b"moov"][1] - top[b"moov"][0])
    _leaves(buffer, 0, len(buffer), movie, tracks)
    if b"mvhd" not in movie:
        raise Mp4Error("no mvhd box")
    rows = [_track(t) for t in tracks]
    if not any(r["kind"] == "vide" for r in rows):
        raise Mp4Error("no video track")
    every = {"mdat_start": top[b"mdat"][0], "mdat_end": top[b"mdat"][1], "file_size": size, "pairing": pairing(movie.get(b"m2gp"))}
    return [{**r, **every, "track": k} for k, r in enumerate(rows)]


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


class _Tracks(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self):
        files = find_files(self.path, ".mp4")
        return [Files(files[lo : lo + FILES]) for lo in range(0, max(len(files), 1), FILES)]

    def read(self, p):
        for uri, size in p.files:
            try:
                with open_file(uri) as file:
                    rows = tracks_of(file, size)
            except (Mp4Error, struct.error, OSError) as e:
                rows = [{"error": str(e)}]
            for r in rows:
                yield tuple({**r, "file": uri}.get(n) for n in NAMES)


class Mp4Tracks(DataSource):
    @classmethod
    def name(cls):
        return "mp4_tracks"

    def schema(self):
        return COLUMNS

    def reader(self, schema):
        return _Tracks(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Mp4Tracks)


def ranges(offsets: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """(from, length) of the runs of samples that lie one after the other."""
    if not len(offsets):
        return []
    first = np.flatnonzero(np.concatenate([[True], offsets[1:] != offsets[:-1] + sizes[:-1]]))
    return list(zip(offsets[first].tolist(), np.add.reduceat(sizes, first).tolist()))


def payload_digests(tracks: DataFrame) -> DataFrame:
    """file, track, sha256, payload_bytes of each track's samples in order, read back from the files; a task reads a track as a stream, samples
    that lie beside each other at once."""

    def digest(batches):
        for b in batches:
            out = []
            for uri, offsets, sizes in zip(b.column("file").to_pylist(), b.column("offsets"), b.column("sizes")):
                h, n = hashlib.sha256(), 0
                with open_file(uri) as file:
                    for at, size in ranges(np.array(offsets.values), np.array(sizes.values)):
                        file.seek(at)
                        while size > 0 and (part := file.read(min(size, PART))):
                            h.update(part)
                            n, size = n + len(part), size - len(part)
                out.append((h.hexdigest(), n))
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("track"), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.int64())], ["file", "track", "sha256", "payload_bytes"])

    return tracks.where(F.col("error").isNull()).select("file", "track", "offsets", "sizes").repartition("file", "track").mapInArrow(digest, "file string, track int, sha256 string, payload_bytes long")
