"""The MCAP sources on small files made here, byte by byte."""

import struct

import pytest
import zstandard

from reelspan.sources import mcap


def rec(op, body):
    return struct.pack("<BQ", op, len(body)) + body


def text(s):
    return struct.pack("<I", len(s.encode())) + s.encode()


def make(path, rows, per_chunk=4, kind="", summary=True, cut=0):
    """rows: (channel, log_time, data). Channel 1 is /a, channel 2 is /b."""
    defs = rec(3, struct.pack("<H", 1) + text("S") + text("protobuf") + text("")) + b"".join(rec(4, struct.pack("<HH", c, 1) + text(t) + text("protobuf") + text("")) for c, t in ((1, "/a"), (2, "/b")))
    out, index = mcap.MAGIC + rec(1, text("") + text("t")), []
    for lo in range(0, len(rows), per_chunk):
        part = rows[lo : lo + per_chunk]
        inner = (defs if not lo else b"") + b"".join(rec(5, struct.pack("<HIQQ", c, i, t, t) + d) for i, (c, t, d) in enumerate(part))
        packed = zstandard.ZstdCompressor().compress(inner) if kind == "zstd" else inner
        times = [t for _, t, _ in part]
        chunk = rec(6, struct.pack("<QQQI", min(times), max(times), len(inner), 0) + text(kind) + struct.pack("<Q", len(packed)) + packed)
        index.append((min(times), max(times), len(out), len(chunk)))
        out += chunk
    out += rec(15, struct.pack("<I", 0))
    at = len(out)
    if summary:
        counts = b"".join(struct.pack("<HQ", c, sum(x[0] == c for x in rows)) for c in (1, 2))
        out += defs + rec(11, struct.pack("<QHIIIIQQ", len(rows), 1, 2, 0, 0, len(index), min(t for _, t, _ in rows), max(t for _, t, _ in rows)) + struct.pack("<I", len(counts)) + counts)
        out += b"".join(rec(8, struct.pack("<QQQQ", *x) + struct.pack("<I", 0) + struct.pack("<Q", 0) + text(kind) + struct.pack("<QQ", 0, 0)) for x in index)
    out += rec(2, struct.pack("<QQI", at if summary else 0, 0, 0)) + mcap.MAGIC
    path.write_bytes(out[: len(out) - cut] if cut else out)


ROWS = [(1 + i % 2, 1000 + 10 * i, bytes([i]) * (i + 1)) for i in range(10)]


@pytest.mark.parametrize("kind,summary", [("", True), ("zstd", True), ("", False), ("zstd", False)])
def test_messages(spark, tmp_path, kind, summary):
    mcap.register(spark)
    make(tmp_path / "x.MCAP", ROWS, kind=kind, summary=summary)
    read = lambda **o: sorted((r.topic, r.log_time_ns, bytes(r.data)) for r in spark.read.format("mcap_messages").options(path=str(tmp_path), **o).load().collect())
    every = sorted((f"/{'ab'[c - 1]}", t, d) for c, t, d in ROWS)
    assert read() == every
    assert read(topics="/b", from_ns="1030", to_ns="1070") == [x for x in every if x[0] == "/b" and 1030 <= x[1] <= 1070]


def test_index_prunes_chunks_and_answers_counts(spark, tmp_path):
    mcap.register(spark)
    make(tmp_path / "x.mcap", ROWS)
    load = lambda f, **o: spark.read.format(f).options(path=str(tmp_path), **o).load()
    assert load("mcap_chunks").count() == 3
    opened = []
    reader = mcap._Messages({"path": str(tmp_path), "to_ns": "1030"}, ["log_time_ns"])
    reader._unpacked = lambda f, at, n, k: opened.append(at) or mcap._Messages._unpacked(f, at, n, k)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 4 and len(opened) == 1
    assert sorted((r.topic, r.messages, r.start_ns, r.end_ns) for r in load("mcap_summary").collect()) == [("/a", 5, 1000, 1090), ("/b", 5, 1000, 1090)]


def test_faults_become_rows(spark, tmp_path):
    mcap.register(spark)
    make(tmp_path / "a.mcap", ROWS, summary=False, cut=60)
    (tmp_path / "b.mcap").write_bytes(b"nothing")
    rows = spark.read.format("mcap_messages").options(path=str(tmp_path)).load().collect()
    assert {r.error for r in rows if r.file.endswith("b.mcap")} == {"no MCAP file"}
    assert sum(r.error is None for r in rows) == 8 and any(r.error and r.file.endswith("a.mcap") for r in rows)


def loose(path, cut_chunk=False):
    """A message between two chunks, which the index doesn't name, and maybe a chunk that can't be unpacked."""
    make(path, ROWS, kind="zstd")
    raw = path.read_bytes()
    (a, z, at, length), extra = index_entries(raw)[0], rec(5, struct.pack("<HIQQ", 2, 99, 1035, 1035) + b"loose")
    moved = raw[: at + length] + extra + raw[at + length :]
    if cut_chunk:
        moved = moved[: at + length - 6] + b"\xff" * 6 + moved[at + length :]
    path.write_bytes(shift(moved, at + length, len(extra)))


def index_entries(raw):
    start = struct.unpack_from("<Q", raw, len(raw) - 8 - 20)[0]
    return [struct.unpack_from("<QQQQ", body) for op, body in mcap.records(raw[start : len(raw) - 8 - 29]) if op == 8]


def shift(raw, beyond, by):
    """Moves the offsets of the index and the footer past an insertion."""
    out = bytearray(raw)
    start = struct.unpack_from("<Q", raw, len(raw) - 28)[0] + by
    struct.pack_into("<Q", out, len(raw) - 28, start)
    at = start
    while at < len(raw) - 37:
        op, n = struct.unpack_from("<BQ", raw, at)
        if op == 8:
            place = struct.unpack_from("<Q", raw, at + 9 + 16)[0]
            struct.pack_into("<Q", out, at + 9 + 16, place + by if place >= beyond else place)
        at += 9 + n
    return bytes(out)


def test_records_between_chunks_are_read_and_bad_chunks_become_rows(spark, tmp_path):
    mcap.register(spark)
    (tmp_path / "good").mkdir()
    (tmp_path / "bad").mkdir()
    loose(tmp_path / "good" / "x.mcap")
    loose(tmp_path / "bad" / "x.mcap", cut_chunk=True)
    load = lambda f, **o: spark.read.format("mcap_messages").options(path=str(tmp_path / f), **o).load()
    good = load("good").collect()
    assert len(good) == 11 and [bytes(r.data) for r in good if r.sequence == 99] == [b"loose"] and not any(r.error for r in good)
    bad = load("bad").collect()
    assert sum(r.error is None for r in bad) == 7 and sum("unpacked" in (r.error or "") for r in bad) == 1
    times = spark.read.format("mcap_messages").schema("log_time_ns long, error string").option("path", str(tmp_path / "good")).load()
    assert times.count() == 11 and "data" not in times.columns
    assert load(".", flat="true").count() == 0


def test_filters_reach_the_reader_and_scans_stand_in_for_the_index(spark, tmp_path):
    mcap.register(spark)
    make(tmp_path / "x.mcap", ROWS)
    make(tmp_path / "y.mcap", ROWS, summary=False)
    df = spark.read.format("mcap_messages").option("path", str(tmp_path)).load()
    got = sorted((r.file[-6:], r.log_time_ns) for r in df.where("topic = '/b' and log_time_ns > 1030 and log_time_ns <= 1070").collect())
    assert got == [(f, t) for f in ("x.mcap", "y.mcap") for t in (1050, 1070)]
    reader = mcap._Messages({"path": str(tmp_path)}, ["log_time_ns"])
    from pyspark.sql.datasource import EqualTo, GreaterThan

    list(reader.pushFilters([EqualTo(("topic",), "/b"), GreaterThan(("log_time_ns",), 1070)]))
    opened = []
    reader._unpacked = lambda f, at, n, k: opened.append(at) or mcap._Messages._unpacked(f, at, n, k)
    assert reader.topics == {"/b"} and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2 and len(opened) == 1
    rows = spark.read.format("mcap_summary").option("path", str(tmp_path)).load().collect()
    assert {(r.file[-6:], r.topic, r.messages, r.start_ns, r.end_ns, r.library, r.from_index) for r in rows} == {(f, t, 5, 1000, 1090, "t", f == "x.mcap") for f in ("x.mcap", "y.mcap") for t in ("/a", "/b")}
    assert {(r.file[-6:], r.chunks) for r in rows} == {("x.mcap", 3), ("y.mcap", None)}
