"""Payload decoders, the MP4 sink and source, and their checks, on streams made here bit by bit."""

import hashlib
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelspan.functions import payloads
from reelspan.operators import channels, mp4_checks
from reelspan.sinks import mp4 as sink
from reelspan.sources import mp4


def golomb(v):
    b = bin(v + 1)[2:]
    return "0" * (len(b) - 1) + b


def sps_unit(width=64, height=48, crop=(0, 0, 0, 2), layers=0):
    bits = "0000" + f"{layers:03b}" + "1" + "00" + "1" + "00001" + f"{0x60000000:032b}" + "0" * 48 + f"{93:08b}"
    bits += "".join("11" for _ in range(layers)) + ("00" * (8 - layers) if layers else "") + ("1" * 96) * layers
    bits += golomb(0) + golomb(1) + golomb(width) + golomb(height) + "1" + "".join(map(golomb, crop)) + golomb(0) + golomb(2) + "1"
    bits += "0" * (-len(bits) % 8)
    raw = int(bits, 2).to_bytes(len(bits) // 8, "big")
    out = bytearray()
    for c in raw:  # emulation prevention
        if len(out) > 1 and out[-1] == out[-2] == 0 and c < 4:
            out.append(3)
        out.append(c)
    return bytes([33 << 1, 1]) + bytes(out)


VPS, PPS = bytes([32 << 1, 1, 7]), bytes([34 << 1, 1, 9])


def frame(key, tag, sets=True):
    parts = [VPS, sps_unit(), PPS] if key and sets else []
    return b"".join(b"\0\0\0\1" + u for u in [*parts, bytes([(19 if key else 1) << 1, 1, tag, 5])])


def varint(v):
    return bytes([v & 127 | 128]) + varint(v >> 7) if v > 127 else bytes([v])


def field(n, v):
    return varint(n << 3) + varint(v) if isinstance(v, int) else varint(n << 3 | 2) + varint(len(v)) + v


def test_video_messages(spark):
    stamp = field(1, 3) + field(2, 500)
    cdr = bytes([0, 1, 0, 0]) + struct.pack("<iI", 7, 8) + struct.pack("<I", 4) + b"cam\0" + struct.pack("<I", 5) + b"hevc\0" + bytes(3) + struct.pack("<I", 3) + b"xyz"
    rows = [
        ("foxglove", field(1, stamp) + field(2, b"id") + field(3, b"data") + field(4, b"H265")), ("foxglove", field(3, b"d")), ("foxglove", field(4, b"h264")), ("foxglove", b"\xff"),
        ("ros2", cdr), ("ros2", cdr[:-1]), ("ros2", b"\0\0" + cdr[2:]), ("other", b""), (None, b"x"), ("ros2", None), ("foxglove", varint(3 << 3 | 3)),
    ]
    got = spark.createDataFrame(rows, "a string, d binary").select(payloads.video_frame(F.col("a"), F.col("d")).alias("f")).select("f.*").collect()
    assert [(r.format, bytes(r.payload) if r.payload is not None else None, r.stamp_ns, r.error is None) for r in got] == [
        ("h265", b"data", 3_000_000_500, True), ("unknown", b"d", None, True), (None, None, None, False), (None, None, None, False),
        ("h265", b"xyz", 7_000_000_008, True), (None, None, None, False), (None, None, None, False), (None, None, None, False), (None, None, None, True), (None, None, None, True), (None, None, None, False),
    ]


def test_audio_messages(spark):
    good = field(1, field(1, 2)) + field(2, b"abcd") + field(3, b" PCM-S16 ") + field(4, 16000) + field(5, 2)
    got = spark.createDataFrame([(good,), (good[:-2],), (b"",)], "d binary").select(payloads.audio_block(F.col("d")).alias("a")).select("a.*").collect()
    assert (got[0].stamp_ns, bytes(got[0].data), got[0].format, got[0].rate, got[0].channels) == (2_000_000_000, b"abcd", "pcm-s16", 16000, 2)
    assert all(r.error for r in got[1:])


@pytest.mark.parametrize("layers", [0, 2])
def test_parameter_sets(spark, layers):
    df = spark.createDataFrame([(sps_unit(layers=layers),), (sps_unit()[:8],)], "u binary").select(payloads.sps_info(F.col("u")).alias("i"))
    good, bad = df.select("i.*", payloads.describe(F.col("i")).alias("d")).collect()
    assert (good.width, good.height, good.tier, good.level, good.chroma, good.chroma_depth, good.temporal_layers) == (64, 44, 1, 93, 1, 2, layers + 1)
    assert (good.d.tier, good.d.level, good.d.bit_depth_chroma) == ("high", 3.1, 10) and bad.error


def test_batches_of_access_units():
    import random

    r = random.Random(4)
    rows = [None, b"", b"\0\0\1", b"\0\0\1a\0\0\1", b"\0\0", b"\0\1b\0\0\1c"] + [bytes(r.choice([0, 0, 0, 1, 64, 66, 68, 38, 2]) for _ in range(r.randrange(40))) for _ in range(400)]
    for lo in (0, 3):
        got = payloads.access_units(pa.array(rows)[lo:]).to_pylist()
        for data, g in zip(rows[lo:], got):
            if data is None:
                assert g is None
                continue
            found = payloads.units(data)
            types = [u[0] >> 1 & 63 for u in found]
            sets = [[u for u, t in zip(found, types) if t == k] for k in (32, 33, 34)]
            sample = b"".join(struct.pack(">I", len(u)) + u for u in found)
            assert g == {"types": types, "is_key": any(16 <= t < 22 for t in types), "vps": sets[0], "sps": sets[1], "pps": sets[2], "sample": sample, "error": None}


def test_units_cut_at_start_codes():
    assert payloads.units(b"\0\0\1ab\0\0\0\1c\0\0\1d\0\0") == [b"ab", b"c", b"d"] and payloads.units(b"abc") == [] and payloads.units(b"\0\0\1") == []


def encoded(spark, rows):
    df = spark.createDataFrame(rows, "output string, i long, t_ns long, data binary").withColumn("h", payloads.hevc_frame(F.col("data")))
    sets = F.concat("h.vps", "h.sps", "h.pps")
    return df.select("output", "i", F.lit(0).alias("track"), "t_ns", "h.is_key", F.col("h.sample").alias("data"), sets.alias("sets"))


def test_files_round_trip(spark, tmp_path):
    mp4.register(spark)
    rows = [(f, i, 33_366_667 * i, frame(i % 4 == 0, i)) for f in ("a.mp4", "b.mp4") for i in range(10)] + [("c.mp4", 0, 0, frame(False, 1))]
    video = encoded(spark, rows)
    sound = spark.createDataFrame([("b.mp4", 100 + i, 1, 0, False, bytes([i, 0]) * 2 * n) for i, n in enumerate((4, 4, 3))], "output string, i long, track int, t_ns long, is_key boolean, data binary")
    sound = sound.withColumns({"rate": F.lit(16000), "channels": F.lit(2), "delay_ms": F.lit(250.0)})
    done = sink.write_mp4(video.unionByName(sound, allowMissingColumns=True), str(tmp_path), created=1_700_000_000, marker=b'{"group":"g1"}', manifest=f"{tmp_path}.jsonl").cache()
    made = {r.output: r for r in done.collect()}
    assert made["c.mp4"].error == "missing_parameter_sets" and sorted(p.name for p in tmp_path.iterdir()) == ["a.mp4", "b.mp4"]
    assert made["a.mp4"].frames == 10 and made["a.mp4"].keyframes == 3 and made["a.mp4"].file_bytes == (tmp_path / "a.mp4").stat().st_size
    (tmp_path / "d.mp4").write_bytes((tmp_path / "a.mp4").read_bytes()[:-5])
    tracks = spark.read.format("mp4_tracks").option("path", str(tmp_path)).load().withColumn("file", F.element_at(F.split("file", "/"), -1)).cache()
    a, b0, b1, d = tracks.orderBy("file", "track").collect()
    assert (a.kind, a.entry, a.width, a.height, a.samples, a.keyframes, a.pairing) == ("vide", "hev1", 64, 44, 10, 3, '{"group":"g1"}') and d.error
    assert [tuple(x) for x in a.stts] == [(10, 3003)]
    assert (b1.kind, b1.entry, b1.timescale, b1.channels, b1.bits, b1.samples, b1.sizes, b1.empty_edit_ms) == ("soun", "ipcm", 16000, 2, 16, 11, [16, 16, 12], 250) and b0.empty_edit_ms == 0
    expected = spark.createDataFrame([("a.mp4", "vide", 0, 10), ("b.mp4", "vide", 0, 9), ("b.mp4", "soun", 0, 11), ("b.mp4", "soun", 1, 5)], "file string, kind string, nth int, samples long")
    plain = {r.file: r for r in mp4_checks.quick(tracks).collect()}
    assert {f: (r.ok, r.failed) for f, r in plain.items()} == {"a.mp4": (True, []), "b.mp4": (True, []), "d.mp4": (False, ["structure"])} and abs(plain["a.mp4"].duration_s - 10 * 3003 / 90000) < 1e-9
    assert {r.file: r.failed for r in mp4_checks.quick(tracks, expected).collect() if not r.ok} == {"b.mp4": ["audio_missing", "frames_differ"], "d.mp4": ["structure"]}
    back = mp4.payload_digests(tracks.withColumn("file", F.concat(F.lit(f"{tmp_path}/"), "file"))).withColumn("file", F.element_at(F.split("file", "/"), -1))
    source = video.where("output = 'a.mp4'").orderBy("i").collect()
    digest = hashlib.sha256(b"".join(bytes(r.data) for r in source)).hexdigest()
    written = done.where("error is null").select(F.col("output").alias("file"), F.lit(0).alias("track"), "sha256")
    full = {r.file: (r.matches_written, r.matches_source) for r in mp4_checks.full(written, back, spark.createDataFrame([("a.mp4", 0, digest)], "file string, track int, sha256 string")).collect()}
    assert full == {"a.mp4": (True, True), "b.mp4": (True, False)}


def test_faults_of_tables(spark):
    one = dict(file="x", track=0, kind="vide", timescale=90000, samples=2, keyframes=1, co64=False, mdat_start=8, mdat_end=30, error=None)
    schema = "file string, track int, kind string, timescale long, samples long, keyframes long, co64 boolean, mdat_start long, mdat_end long, error string, offsets array<long>, sizes array<long>, stts array<struct<count:long,delta:long>>"
    rows = [
        {**one, "file": "gap", "offsets": [8, 20], "sizes": [10, 10], "stts": [(2, 3000)]}, {**one, "file": "early", "offsets": [4, 14], "sizes": [10, 16], "stts": [(2, 3000)]},
        {**one, "file": "tables", "offsets": [8], "sizes": [10, 12], "stts": [(1, 3000)]}, {**one, "file": "good", "offsets": [8, 18], "sizes": [10, 12], "stts": [(2, 3000)]},
        *({**one, "file": "mixed", "track": k, "kind": v, "offsets": [8 + 8 * k], "sizes": [10], "samples": 1, "stts": [(1, 1)]} for k, v in enumerate(("vide", "soun"))),
    ]
    got = {r.file: r.failed for r in mp4_checks.quick(spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in schema.replace("array<struct<count:long,delta:long>>", "s").split(", ")) for r in rows], schema)).collect()}
    assert got == {"gap": ["not_contiguous"], "early": ["before_media"], "tables": ["offsets_differ", "stts_differs"], "good": [], "mixed": ["overlap"]}


def test_streams_and_triage(spark):
    rows = [("x", i, i in (2, 4, 7), i <= 1, i == 3, True) for i in range(10)] + [("y", 0, True, True, False, True)]
    df = spark.createDataFrame(rows, "file string, i long, is_key boolean, has_vps boolean, has_sps boolean, has_pps boolean")
    got = {r.file: tuple(r)[1:] for r in channels.stream_stats(df, ["file"], ["i"]).collect()}
    assert got == {"x": (6, 2, 4, 3, 3), "y": (0, 0, 1, None, None)}
    t = spark.createDataFrame([("f", "/a", None, 5, True), ("f", "/b", "unsupported_codec", 0, False), ("g", "/a", None, 0, False), ("g", "/b", None, 3, False)], "file string, topic string, error string, frames long, ready boolean")
    out = channels.triage(t)
    assert {(r.file, r.topic): (r.code, r.file_error) for r in out.collect()} == {("f", "/a"): (None, None), ("f", "/b"): ("unsupported_codec", None), ("g", "/a"): ("no_video_samples", "no_video_samples"), ("g", "/b"): ("missing_parameter_sets", "no_video_samples")}
    assert [tuple(r) for r in channels.channel_warnings(out).collect()] == [("f", "/b", "unsupported_codec")]
    ch = spark.createDataFrame([("f", 1, "foxglove.CompressedVideo", "protobuf", "/a"), ("f", 2, "foxglove.CompressedVideo", "cdr", "/b"), ("f", 3, "foxglove.RawAudio", "protobuf", "/c"), ("g", 1, None, None, "/d")], "file string, channel_id int, schema_name string, message_encoding string, topic string")
    assert [r.topic for r in channels.video_channels(ch).collect()] == ["/a"] and [r.topic for r in channels.audio_channels(ch).collect()] == ["/c"]
    chosen, status = channels.select_topics(ch, channels.video_channels(ch), ["/a", "/z"])
    assert chosen.count() == 1 and {tuple(r) for r in status.collect()} == {("f", "pending"), ("g", "no_video_channel")}
    frames = spark.createDataFrame([("a", 0, "h265"), ("a", 1, "h264"), ("a", 2, "h265"), ("b", 0, "h265")], "k string, i long, format string")
    assert {(r.k, r.i, r.error) for r in channels.codec_flag(frames, ["k"], ["i"]).collect()} == {("a", 0, "unsupported_codec"), ("b", 0, None)}
    units = spark.createDataFrame([("a", 2, b"y"), ("a", 1, b"x"), ("a", 3, b"x")], "k string, i long, unit binary")
    assert {(bytes(r.unit), r.i) for r in channels.parameter_sets(units, ["k"], ["i"]).collect()} == {(b"x", 0), (b"y", 1)}


def test_held_back_audio(spark):
    sizes = [4, 5, 3, 1, 9, 1]
    held, kept = 0, []
    for n in sizes:
        kept.append(held + n <= 10)
        held += n if kept[-1] else 0
    df = spark.createDataFrame([("k", i, n) for i, n in enumerate(sizes)] + [("l", 0, 3)], "k string, i long, n long")
    assert {(r.k, r.i): r.kept for r in channels.held_back(df, ["k"], ["i"], "n", 10).collect()} == {**{("k", i): v for i, v in enumerate(kept)}, ("l", 0): True}


def batch(rows):
    """Sample rows (output, track, data, key, sets) as the sink gets them."""
    columns = [pa.array(c, t) for c, t in zip(zip(*[(o, i, t, i * 33_000_000, k, d, s, 16000 if t else None, 1 if t else None, None) for i, (o, t, d, k, s) in enumerate(rows)]), [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.binary()), pa.int32(), pa.int32(), pa.float64()])]
    return pa.RecordBatch.from_arrays(columns, sink.INPUT)


SETS = [VPS, sps_unit(), PPS]


def test_attempts_and_commit(tmp_path):
    rows = [("a.mp4", 0, bytes([i]) * (i + 1), i == 0, SETS if i == 0 else None) for i in range(9)] + [("b.mp4", 1, b"\1\2", False, None)]
    make = lambda **o: sink._Writer({"path": str(tmp_path), **o})
    writer = make()

    def broken():
        yield batch(rows[:4])
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(broken())
    other = writer.write(iter([batch(rows)]))
    message = writer.write(iter([batch(rows[:5]).slice(0, 2), batch(rows[2:])]))
    assert [t.get("error") for _, _, t in message.files] == [None, "no_video_samples"] and other.files[0][2]["sha256"] == message.files[0][2]["sha256"] == hashlib.sha256(b"".join(r[2] for r in rows[:9])).hexdigest()
    writer.commit([message])
    assert [p.name for p in tmp_path.iterdir()] == ["a.mp4"]
    size = (tmp_path / "a.mp4").stat().st_size
    with open(tmp_path / "a.mp4", "rb") as f:
        (t,) = mp4.tracks_of(f, size)
    assert t["sizes"] == list(range(1, 10)) and t["offsets"][0] == t["mdat_start"] and t["offsets"][-1] + 9 == t["mdat_end"] and not t["co64"]
    with pytest.raises(FileExistsError):
        writer = make()
        writer.commit([writer.write(iter([batch([("Z.mp4", *r[1:]) for r in rows[:9]]), batch(rows)]))])
    writer.abort([])
    assert [p.name for p in tmp_path.iterdir()] == ["a.mp4"] and (tmp_path / "a.mp4").stat().st_size == size
    writer = make(co64="always")
    writer.commit([writer.write(iter([batch([("c.mp4", *r[1:]) for r in rows[:9]])]))])
    with open(tmp_path / "c.mp4", "rb") as f:
        assert mp4.tracks_of(f, (tmp_path / "c.mp4").stat().st_size)[0]["co64"]
    with pytest.raises(ValueError):
        make(co64="sometimes")


def test_large_files(tmp_path, monkeypatch):
    """64-bit offsets and media headers, with a small limit in place of 4 GB."""
    monkeypatch.setattr(sink, "LARGEST", 60)
    rows = [("a.mp4", 0, bytes([i]) * 20, i == 0, SETS if i == 0 else None) for i in range(4)]
    writer = sink._Writer({"path": str(tmp_path)})
    message = writer.write(iter([batch(rows)]))
    monkeypatch.setattr(sink, "LARGEST", (1 << 32) - 1)
    writer.commit([message])
    with open(tmp_path / "a.mp4", "rb") as f:
        (t,) = mp4.tracks_of(f, (tmp_path / "a.mp4").stat().st_size)
    assert t["co64"] and t["offsets"][0] == t["mdat_start"] and t["mdat_end"] - t["mdat_start"] == 80
    monkeypatch.setattr(sink, "LARGEST", 60)
    off = sink._Writer({"path": str(tmp_path), "co64": "off"})
    assert off.write(iter([batch(rows)])).files[0][2]["error"] == "co64_needed"
    off.abort([])


def test_runs_of_samples():
    assert mp4.ranges(np.array([8, 18, 40, 50]), np.array([10, 12, 10, 1])) == [(8, 22), (40, 11)] and mp4.ranges(np.zeros(0, int), np.zeros(0, int)) == []
