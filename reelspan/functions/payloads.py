"""Message payloads, decoded in Arrow batches: protobuf and CDR messages of cameras and microphones, and H.265 access units.

A payload that can't be read gives a row whose error is set and whose other fields are null; null payloads give null fields and no error.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import codec

#: NAL unit types of parameter sets, and the range of types that begin a group of pictures.
VPS, SPS, PPS, KEYS = 32, 33, 34, tuple(range(16, 22))


class PayloadError(ValueError):
    pass


def wire(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(field, wire type, value) of a protobuf message; wire types 0, 1, 2 and 5."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = 0
        for shift in range(0, 77, 7):
            if at >= len(data):
                raise PayloadError("a varint ends early")
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
        raise PayloadError("a varint is too long")

    while at < len(data):
        field, kind = divmod(varint(), 8)
        if kind == 0:
            yield field, kind, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if kind == 2:
            size = varint()
            if at + size > len(data):
                raise PayloadError("a field ends after its message")
        if size is None:
            raise PayloadError(f"wire type {kind} isn't known")
        yield field, kind, data[at : at + size]
        at += size


def last(data: bytes, wanted: dict[tuple[int, int], str]) -> dict:
    """The last value of each wanted (field, wire type), by name."""
    return {wanted[f, k]: v for f, k, v in wire(data) if (f, k) in wanted}


def stamp(data: bytes | None) -> int | None:
    """Nanoseconds of a protobuf timestamp."""
    if data is None:
        return None
    t = last(data, {(1, 0): "s", (2, 0): "n"})
    return t.get("s", 0) * 10**9 + t.get("n", 0)


def foxglove_video(data: bytes) -> tuple:
    m = last(data, {(1, 2): "stamp", (3, 2): "data", (4, 2): "format"})
    if "data" not in m:
        raise PayloadError("a video message without data")
    return m.get("format", b"").decode("utf-8", "replace"), m["data"], stamp(m.get("stamp"))


def ros2_image(data: bytes) -> tuple:
    """Little-endian CDR: stamp, frame id, format, data; each length is aligned to four bytes."""
    if len(data) < 20 or data[1] != 1:
        raise PayloadError("CDR that is short or big-endian")
    seconds, nanos = struct.unpack_from("<iI", data, 4)
    at, parts = 12, []
    for _ in range(3):
        at = -(-at // 4) * 4
        size = struct.unpack_from("<I", data, at)[0]
        parts.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    if at > len(data):
        raise PayloadError("an image ends after its message")
    return parts[1].rstrip(b"\0").decode("utf-8", "replace"), parts[2], seconds * 10**9 + nanos


#: Decoders of video messages by adapter; further ones may be added.
VIDEO: dict[str, Callable[[bytes], tuple]] = {"foxglove": foxglove_video, "ros2": ros2_image}


def raw_audio(data: bytes) -> tuple:
    m = last(data, {(1, 2): "stamp", (2, 2): "data", (3, 2): "format", (4, 0): "rate", (5, 0): "channels"})
    if not m.get("rate") or not m.get("channels"):
        raise PayloadError("audio without a rate or channels")
    return stamp(m.get("stamp")), m.get("data", b""), m.get("format", b"").decode("utf-8", "replace").strip().lower(), m["rate"], m["channels"]


def units(data: bytes) -> list[bytes]:
    """NAL units of an Annex B stream, without the zeros after them."""
    a = np.frombuffer(data, np.uint8)
    if len(a) < 4:
        return []
    at = np.flatnonzero((a[:-2] == 0) & (a[1:-1] == 0) & (a[2:] == 1))
    at = at[at < len(a) - 3].tolist()
    found = (data[lo + 3 : hi].rstrip(b"\0") for lo, hi in zip(at, [*at[1:], len(data)]))
    return [u for u in found if u]


def unit_type(unit: bytes) -> int:
    return unit[0] >> 1 & 63


class Bits:
    """Bits of a byte string, from the first on."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def read(self, n: int) -> int:
        if n > self.left:
            raise PayloadError("a parameter set ends early")
        self.left -= n
        return self.value >> self.left & (1 << n) - 1

    def golomb(self) -> int:
        n = 0
        while not self.read(1):
            n += 1
            if n > 32:
                raise PayloadError("a code is too long")
        return (1 << n) - 1 + self.read(n)


INFO = "width int, height int, profile_space int, tier int, profile_idc int, compat long, constraints binary, level int, chroma int, luma_depth int, chroma_depth int, temporal_layers int, temporal_nested int"


def sps(unit: bytes) -> tuple:
    """The columns of INFO of a sequence parameter set."""
    b = Bits(re.sub(rb"\0\0\x03", b"\0\0", unit[2:], flags=re.S))
    b.read(4)
    layers, nested = b.read(3), b.read(1)
    space, tier, profile, compat, constraints, level = b.read(2), b.read(1), b.read(5), b.read(32), b.read(48).to_bytes(6, "big"), b.read(8)
    has = [(b.read(1), b.read(1)) for _ in range(layers)]
    b.read(2 * (8 - layers) if layers else 0)
    for own_profile, own_level in has:
        b.read(88 * own_profile + 8 * own_level)
    b.golomb()
    chroma = b.golomb()
    b.read(1 if chroma == 3 else 0)
    width, height = b.golomb(), b.golomb()
    if b.read(1):
        left, right, top, bottom = (b.golomb() for _ in range(4))
        width -= (left + right) * (1 if chroma in (0, 3) else 2)
        height -= (top + bottom) * (2 if chroma == 1 else 1)
    return width, height, space, tier, profile, compat, constraints, level, chroma, b.golomb(), b.golomb(), layers + 1, nested


def _lists(values: pa.Array, of: np.ndarray, rows: int) -> pa.Array:
    """Values that belong to ascending row numbers as one list a row."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values)


def _bytes(parts: list, sizes: np.ndarray) -> pa.Array:
    """Byte strings that lie one after the other, of these sizes."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(parts))])


def access_units(data: pa.Array) -> pa.StructArray:
    """Of a batch of H.265 access units: types, whether one is a key frame, its parameter sets, and the sample (each unit after its length).

    Start codes are looked for in the batch's one buffer. Null data give nulls."""
    rows, ends = len(data), np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    buffer = data.buffers()[2].to_pybytes() if data.buffers()[2] else b""
    a = np.frombuffer(buffer or b"\0", np.uint8)
    at = np.flatnonzero((a[:-2] == 0) & (a[1:-1] == 0) & (a[2:] == 1)) if len(a) > 2 else np.zeros(0, np.int64)
    at = at[(at >= ends[0]) & (at < ends[-1])]
    of = np.searchsorted(ends, at, side="right") - 1
    whole = at + 3 < ends[of + 1]  # neither cut by the row's end nor at it
    at, of = at[whole], of[whole]
    lo, hi = at + 3, ends[of + 1]
    hi[:-1] = np.where(of[:-1] == of[1:], at[1:], hi[:-1])
    while (zero := (hi > lo) & (a[hi - 1] == 0)).any():
        hi = hi - zero
    lo, hi, of = lo[hi > lo], hi[hi > lo], of[hi > lo]
    types = a[lo].astype(np.int32) >> 1 & 63
    view = memoryview(buffer)
    sets = []
    for t in (VPS, SPS, PPS):
        own = np.flatnonzero(types == t)
        sets.append(_lists(_bytes([view[x:y] for x, y in zip(lo[own].tolist(), hi[own].tolist())], (hi - lo)[own]), of[own], rows))
    lengths = (hi - lo).astype(">u4").tobytes()
    parts = [p for k, (x, y) in enumerate(zip(lo.tolist(), hi.tolist())) for p in (lengths[4 * k : 4 * k + 4], view[x:y])]
    samples = _bytes(parts, np.bincount(of, hi - lo + 4, rows).astype(np.int64))
    keys = np.bincount(of, np.isin(types, KEYS), rows) > 0
    columns = [_lists(pa.array(types), of, rows), pa.array(keys), *sets, samples, pa.nulls(rows, pa.string())]
    return pa.StructArray.from_arrays(columns, ["types", "is_key", "vps", "sps", "pps", "sample", "error"], mask=data.is_null())


def _decoder(decode: Callable, schema: str):
    """A pandas UDF that gives decode's fields, and an error."""
    width = len(schema.split(", "))

    def one(*values) -> tuple:
        if any(v is None for v in values):
            return (None,) * (width + 1)
        try:
            return (*decode(*values), None)
        except (PayloadError, struct.error, IndexError) as e:
            return (*(None,) * width, str(e))

    names = [c.split(" ")[0] for c in schema.split(", ")] + ["error"]

    def batch(*columns: pd.Series) -> pd.DataFrame:
        rows = [one(*(bytes(v) if isinstance(v, (bytes, bytearray)) else v for v in vs)) for vs in zip(*columns)]
        return pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(names)})

    return batch, f"{schema}, error string"


def video_frame(adapter: Column, data: Column) -> Column:
    """format (normalised), payload, stamp_ns (null without one), error of a video message, by its channel's adapter."""

    def decode(adapter: str, data: bytes) -> tuple:
        if adapter not in VIDEO:
            raise PayloadError(f"unknown adapter {adapter}")
        return VIDEO[adapter](data)

    batch, schema = _decoder(decode, "format string, payload binary, stamp_ns long")

    @F.pandas_udf(schema)
    def udf(adapter: pd.Series, data: pd.Series) -> pd.DataFrame:
        return batch(adapter, data)

    found = udf(adapter, data)
    return F.when(found["payload"].isNotNull(), found.withField("format", codec(found["format"]))).otherwise(found)


def _one(decode: Callable, schema: str):
    batch, schema = _decoder(decode, schema)

    @F.pandas_udf(schema)
    def udf(data: pd.Series) -> pd.DataFrame:
        return batch(data)

    return udf


def audio_block(data: Column) -> Column:
    """stamp_ns, data, format, rate, channels, error of an audio message."""
    return _one(raw_audio, "stamp_ns long, data binary, format string, rate int, channels int")(data)


def hevc_frame(payload: Column) -> Column:
    """types, is_key, vps, sps, pps (lists of units), sample, error of an H.265 access unit; all null for a null one."""

    @F.arrow_udf("types array<int>, is_key boolean, vps array<binary>, sps array<binary>, pps array<binary>, sample binary, error string")
    def udf(data: pa.Array) -> pa.Array:
        return access_units(data)

    found = udf(payload)
    return F.when(found["sample"].isNotNull(), found)


def sps_info(unit: Column) -> Column:
    """The columns of INFO, and error, of a sequence parameter set."""
    return _one(sps, INFO)(unit)


def describe(info: Column) -> Column:
    """What a report says of a stream with this sps_info."""
    return F.struct(
        info["width"].alias("width"), info["height"].alias("height"), info["profile_idc"].alias("profile_idc"),
        F.when(info["tier"] == 1, "high").when(info["tier"] == 0, "main").alias("tier"), info["level"].alias("level_idc"), F.bround(info["level"] / 30, 1).alias("level"),
        info["chroma"].alias("chroma_format_idc"), (info["luma_depth"] + 8).alias("bit_depth_luma"), (info["chroma_depth"] + 8).alias("bit_depth_chroma"), info["temporal_layers"].alias("temporal_layers"),
    )
