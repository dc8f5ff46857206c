"""MP4 files from rows of samples, after the public ISO base media format. Spark orders each file's rows; a task streams them out, in runs of
samples as they lie in Arrow batches, and the driver publishes the files when the job commits (see staging.py).

Rows: output (file name), i (order of writing), track (0 the H.265 video, others PCM audio), t_ns, is_key, data (a video sample, each unit
behind its length, or whole PCM frames), sets (parameter sets, on rows that bring some), rate and channels (audio rows), delay_ms (of the track).
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter

from reelspan.functions.payloads import PPS, SPS, VPS, sps, unit_type
from reelspan.functions.timing import LONE_FRAME, TICKS

from .staging import StagedWriter, Written, resolve

#: Ticks of the film's clock, seconds from 1904 to 1970, the largest 32-bit number, and the unit matrix.
FILM, SINCE_1904, LARGEST = 1000, 2_082_844_800, (1 << 32) - 1
MATRIX = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)


def box(kind: str, *parts: bytes) -> bytes:
    return struct.pack(">I4s", 8 + sum(map(len, parts)), kind.encode()) + b"".join(parts)


def full(kind: str, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def numbers(*values: int, kind: str = "I") -> bytes:
    return struct.pack(f">{len(values)}{kind}", *values)


def counted(rows, kind: str = ">u4") -> bytes:
    """A table behind the number of its rows."""
    rows = np.asarray(rows)
    return numbers(len(rows)) + rows.astype(kind).tobytes()


def dated(kind: str, made: int, fields: bytes, length: int, *rest: bytes, flags: int = 0) -> bytes:
    """A header with its date twice, some fields and its length, in 32 or in 64 bits."""
    wide = "Q" if length > LARGEST else "I"
    return full(kind, numbers(made, made, kind=wide), fields, numbers(length, kind=wide), *rest, version=int(wide == "Q"), flags=flags)


def runs(values: np.ndarray) -> np.ndarray:
    """First places (from 0) of the runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def durations(t_ns: np.ndarray, fps: float | None = None) -> np.ndarray:
    """Ticks of each sample: of the rounded times, one at least, the last as the one before; or all by a constant rate."""
    if fps:
        return np.full(len(t_ns), max(1, round(TICKS / fps)))
    ticks = np.round((t_ns - t_ns[0]).astype(np.longdouble) * TICKS / 10**9).astype(np.int64)
    steps = np.maximum(np.diff(ticks), 1)
    return np.append(steps, steps[-1] if len(steps) else LONE_FRAME)


@dataclass
class Track:
    rate: int = 0
    channels: int = 0
    delay_ms: float = 0.0
    parts: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    large: bool = False

    def close(self) -> None:
        """Joins what batches have brought: places, sizes, times and numbers of key samples."""
        self.offsets, self.sizes, self.times, keys = (np.concatenate(c) for c in zip(*self.parts))
        self.keys = np.flatnonzero(keys) + 1

    def table(self, fps: float | None, sets: dict[int, list[bytes]]) -> tuple[list[bytes], int, int, bytes]:
        """Sample tables, length in own ticks, ticks a second, and the fields of the track's header: volume and size."""
        large = self.large
        places = full("co64" if large else "stco", counted(self.offsets, ">u8" if large else ">u4"))
        if self.rate:
            frame = 2 * self.channels
            samples = self.sizes // frame
            first = runs(samples)
            tables = [
                full("stsd", numbers(1), self._sound()), full("stts", numbers(1, int(samples.sum()), 1)), full("stsc", numbers(len(first)), np.stack([first + 1, samples[first], np.ones_like(first)], 1).astype(">u4").tobytes()),
                full("stsz", numbers(frame, int(samples.sum()))), places,
            ]
            return tables, int(samples.sum()), self.rate, numbers(0x100, 0, kind="H") + MATRIX + numbers(0, 0)
        length = durations(self.times, fps)
        first = runs(length)
        info = sps(sets[SPS][0])
        tables = [
            full("stsd", numbers(1), self._picture(info, sets)), full("stts", numbers(len(first)), np.stack([np.diff(np.append(first, len(length))), length[first]], 1).astype(">u4").tobytes()),
            full("stss", counted(self.keys)), full("stsc", numbers(1, 1, 1, 1)), full("stsz", numbers(0), counted(self.sizes)), places,
        ]
        return tables, int(length.sum()), TICKS, numbers(0, 0, kind="H") + MATRIX + numbers(info[0] << 16, info[1] << 16)

    def _sound(self) -> bytes:
        entry = struct.pack(">6xH8xHHHHI", 1, self.channels, 16, 0, 0, self.rate << 16 if self.rate < 1 << 16 else 0)
        layout = full("chnl", bytes([1, self.channels]) + bytes(8)) if self.channels in (1, 2) else b""
        return box("ipcm", entry, layout, full("pcmC", bytes([1, 16])))

    @staticmethod
    def _picture(info: tuple, sets: dict[int, list[bytes]]) -> bytes:
        width, height, space, tier, profile, compat, constraints, level, chroma, luma, colour, layers, nested = info
        config = bytes([1, space << 6 | tier << 5 | profile]) + numbers(compat) + constraints + bytes([level])
        config += bytes([0xF0, 0, 0xFC, 0xFC | chroma & 3, 0xF8 | luma & 7, 0xF8 | colour & 7, 0, 0, (layers & 7) << 3 | (nested & 1) << 2 | 3, 3])
        for kind in (VPS, SPS, PPS):
            config += bytes([0x80 | kind]) + numbers(len(sets[kind]), kind="H") + b"".join(numbers(len(u), kind="H") + u for u in sets[kind])
        entry = struct.pack(">6xH16xHHIIIH32xHH", 1, width, height, 0x480000, 0x480000, 0, 1, 24, 0xFFFF)
        return box("hev1", entry, box("hvcC", config))

    def trak(self, number: int, made: int, fps: float | None, sets: dict) -> tuple[bytes, int]:
        """The track's box and its end on the film's clock; a delay is an empty edit before its media."""
        tables, length, clock, shape = self.table(fps, sets)
        delay, own = max(0, round(self.delay_ms * FILM / 1000)), round(length * FILM / clock)
        wide = max(delay, own) > LARGEST
        edit = lambda n, at: struct.pack(">QqHH" if wide else ">IiHH", n, at, 1, 0)
        edits = box("edts", full("elst", numbers(2), edit(delay, -1), edit(own, 0), version=int(wide))) if delay else b""
        data = box("dinf", full("dref", numbers(1), full("url ", flags=1)))
        sort, name = ("soun", b"SoundHandler\0") if self.rate else ("vide", b"VideoHandler\0")
        media = full("smhd", bytes(4)) if self.rate else full("vmhd", bytes(8), flags=1)
        head = dated("tkhd", made, numbers(number, 0), delay + own, bytes(8), numbers(0, 0, kind="H"), shape, flags=7)
        mdia = box("mdia", dated("mdhd", made, numbers(clock), length, numbers(0x55C4, 0, kind="H")), full("hdlr", numbers(0), sort.encode(), bytes(12), name), box("minf", media, data, box("stbl", *tables)))
        return box("trak", head, edits, mdia), delay + own


def moov(tracks: list[Track], made: int, fps: float | None, sets: dict, marker: bytes | None) -> bytes:
    found = [t.trak(k + 1, made, fps, sets) for k, t in enumerate(tracks)]
    head = dated("mvhd", made, numbers(FILM), max(end for _, end in found), numbers(1 << 16), numbers(0x100, kind="H"), bytes(10), MATRIX, bytes(24), numbers(len(tracks) + 1))
    return box("moov", head, *(b for b, _ in found), *([box("udta", box("m2gp", marker))] if marker else []))


RESULT = "output string, path string, frames long, keyframes long, payload_bytes long, file_bytes long, sha256 string, error string"
INPUT = ["output", "i", "track", "t_ns", "is_key", "data", "sets", "rate", "channels", "delay_ms"]
#: How chunk offsets are written: as 64-bit numbers where they need it, always, or never (then a file that needs them fails).
AUTO, ALWAYS, OFF = "auto", "always", "off"


class Film:
    """A file in the making. Its media data lie behind a header that is filled in at the end, when their length is known: a 64-bit one, or an
    empty box and a 32-bit one."""

    def __init__(self, path: str):
        self.path, self.tracks, self.sets, self.digest = path, {}, {VPS: [], SPS: [], PPS: []}, hashlib.sha256()
        self.store, self.place = resolve(path)
        self.out = self.store.open_output_stream(self.place)
        self.top = box("ftyp", b"isom" + numbers(0x200) + b"isomiso6mp41hev1")
        self.out.write(self.top + bytes(16))
        self.start = self.at = len(self.top) + 16

    def add(self, rows: pa.RecordBatch) -> None:
        """Rows of this file in order; their data are one run of bytes in the batch."""
        data = rows.column("data")
        ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
        run = memoryview(data.buffers()[2])[ends[0] : ends[-1]] if data.buffers()[2] else memoryview(b"")
        sizes, places, track = np.diff(ends), ends[:-1] - ends[0], rows.column("track").to_numpy()
        times, keys = rows.column("t_ns").fill_null(0).to_numpy(), rows.column("is_key").fill_null(False).to_numpy(zero_copy_only=False)
        for t in np.unique(track).tolist():
            own = track == t
            if t not in self.tracks:
                first = {c: rows.column(c)[int(np.argmax(own))].as_py() for c in ("rate", "channels", "delay_ms")}
                self.tracks[t] = Track(first["rate"] if t else 0, first["channels"] if t else 0, first["delay_ms"] or 0.0)
            self.tracks[t].parts.append((self.at + places[own], sizes[own], times[own], keys[own]))
            if not t:
                self.digest.update(run if own.all() else b"".join(run[a : a + n] for a, n in zip(places[own], sizes[own])))
        for k in np.flatnonzero(rows.column("sets").value_lengths().fill_null(0).to_numpy()).tolist():
            for unit in rows.column("sets")[k].as_py():
                if unit_type(unit) in self.sets and unit not in self.sets[unit_type(unit)]:
                    self.sets[unit_type(unit)].append(unit)
        self.out.write(run)
        self.at += len(run)

    def close(self, made: int, fps: float | None, marker: bytes | None, co64: str) -> dict:
        """What to tell of the file; with an error there is none to publish."""
        for t in self.tracks.values():
            t.close()
        needed = any(t.offsets[-1] > LARGEST for t in self.tracks.values())
        for t in self.tracks.values():
            t.large = co64 == ALWAYS or t.offsets[-1] > LARGEST
        error = "no_video_samples" if 0 not in self.tracks else "missing_parameter_sets" if not all(self.sets.values()) else "co64_needed" if needed and co64 == OFF else None
        if error:
            self.out.close()
            return {"error": error}
        tail = moov([self.tracks[k] for k in sorted(self.tracks)], made, fps, self.sets, marker)
        self.out.write(tail)
        self.out.close()
        size = self.at - self.start
        self._head(struct.pack(">I4sQ", 1, b"mdat", size + 16) if size + 8 > LARGEST else box("free") + struct.pack(">I4s", size + 8, b"mdat"))
        video = self.tracks[0]
        return {"frames": len(video.sizes), "keyframes": len(video.keys), "payload_bytes": int(video.sizes.sum()), "file_bytes": self.at + len(tail), "sha256": self.digest.hexdigest()}

    def _head(self, head: bytes) -> None:
        """Fills in the reserved bytes: in place on a local disk, in a copy on a store whose files can't be changed."""
        if isinstance(self.store, fs.LocalFileSystem):
            with open(self.place, "r+b") as f:
                f.seek(len(self.top))
                f.write(head)
            return
        with self.store.open_input_stream(self.place) as old, self.store.open_output_stream(f"{self.place}.copy") as out:
            old.read(self.start)
            out.write(self.top + head)
            while part := old.read(4 << 20):
                out.write(part)
        self.store.delete_file(self.place)
        self.store.move(f"{self.place}.copy", self.place)


class _Writer(StagedWriter, DataSourceArrowWriter):
    """Options beside path and manifest: fps, created, marker (as hex) and co64."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.fps, self.marker, self.co64 = float(options.get("fps", 0)) or None, bytes.fromhex(options.get("marker", "")) or None, options.get("co64", AUTO)
        if self.co64 not in (AUTO, ALWAYS, OFF):
            raise ValueError(f"co64 is {AUTO}, {ALWAYS} or {OFF}")
        created = int(options.get("created", 0))
        self.made = created + SINCE_1904 if 0 < created < (1 << 32) - SINCE_1904 else 0

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        done, film, name, folder = Written(), None, None, None

        def finish() -> None:
            told = film.close(self.made, self.fps, self.marker, self.co64)
            good = "error" not in told
            done.files.append((name, film.path if good else None, {"output": name, "path": f"{self.folder}/{name}" if good else None, **told}))

        for b in batches:
            b = b.filter(b.column("data").is_valid())  # here and not in the plan, where a filter would decode the frames once more
            names = b.column("output").to_pylist()
            cuts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo and (film is None or names[lo] != name):
                    if film:
                        finish()
                    folder, name = folder or self.attempt(), names[lo]
                    film = Film(f"{folder}/{len(done.files)}.mp4")
                if hi > lo:
                    film.add(b.slice(lo, hi - lo))
        if film:
            finish()
        return done


class _Mp4(DataSource):
    @classmethod
    def name(cls):
        return "mp4"

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(_Mp4)


def write_mp4(samples: DataFrame, folder: str, fps: float | None = None, created: int = 0, marker: bytes | None = None, co64: str = AUTO, manifest: str | None = None) -> DataFrame:
    """Writes each output of samples to folder; one row a file: frames, sizes, the SHA-256 of its video, and an error where there is nothing
    to write, no parameter sets, or a need of 64-bit offsets that co64 forbids (no file then).

    samples are evaluated once; null data are left out. A task holds a batch and its file's sample table. Files appear together when the
    job commits; if one of them exists already, the job fails and none appears. The rows are kept in `manifest`, by default beside the folder.
    """
    spark = samples.sparkSession
    register(spark)
    manifest = manifest or f"{folder.rstrip('/')}.written/{uuid.uuid4().hex}.jsonl"
    missing = {"sets": "array<binary>", "rate": "int", "channels": "int", "delay_ms": "double"}
    rows = samples.withColumns({c: F.lit(None).cast(t) for c, t in missing.items() if c not in samples.columns})
    rows = rows.select(*INPUT).repartition("output").sortWithinPartitions("output", "i")
    options = {"path": folder, "manifest": manifest, "created": created, "co64": co64, **({"fps": fps} if fps else {}), **({"marker": marker.hex()} if marker else {})}
    rows.write.format("mp4").mode("append").options(**options).save()
    return spark.read.schema(RESULT).json(manifest)
