"""Growing recordings as a stream."""

import pytest
from pyspark.sql import functions as F

from reelspan.sources import mcap, mcap_stream
from reelspan.streaming import sessions as streams
from tests.test_mcap import ROWS, make


@pytest.fixture
def runs(spark, tmp_path):
    """Runs the stream of tmp_path/in from one checkpoint until nothing is new; the rows so far."""
    mcap.register(spark)
    (tmp_path / "in").mkdir()

    def run():
        df = spark.readStream.format("mcap_messages").schema("file string, ordinal long, topic string, log_time_ns long, data binary, error string").option("path", str(tmp_path / "in")).load()
        q = df.writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/state").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/rows").collect()

    return run


@pytest.mark.parametrize("kind", ["", "zstd"])
def test_growing_files_are_read_once(runs, tmp_path, kind):
    make(tmp_path / "whole.mcap", ROWS, kind=kind)
    raw = (tmp_path / "whole.mcap").read_bytes()
    ends = [at + 9 + n for _, op, at, n in mcap_stream._heads(open(tmp_path / "whole.mcap", "rb"), len(raw)) if op == 6]
    grow = tmp_path / "in" / "x.mcap"
    seen = []
    for cut in (4, ends[0] - 1, ends[0], ends[1] + 5, len(raw) - 3, len(raw)):
        grow.write_bytes(raw[:cut])
        if cut == ends[1] + 5:
            make(tmp_path / "in" / "y.mcap", ROWS[:4], kind=kind, summary=False)
            (tmp_path / "in" / "bad.mcap").write_bytes(b"not a recording")
        rows = runs()
        seen.append(sorted(r.log_time_ns for r in rows if r.file.endswith("x.mcap")))
    times = [t for _, t, _ in ROWS]
    assert seen == [[], [], times[:4], times[:8], times, times]
    assert [r.error for r in rows if r.file.endswith("bad.mcap")] == ["no MCAP file"] and sum(r.file.endswith("y.mcap") for r in rows) == 4
    assert sorted((r.topic, bytes(r.data)) for r in rows if r.file.endswith("x.mcap")) == sorted((f"/{'ab'[c - 1]}", d) for c, _, d in ROWS)
    assert len({(r.file, r.ordinal) for r in rows if r.error is None}) == 14


def test_a_batch_unpacks_what_is_new(tmp_path, monkeypatch):
    make(tmp_path / "x.mcap", ROWS, kind="zstd")
    reader = mcap_stream.McapStream({"path": str(tmp_path)}, ["log_time_ns"])
    size = (tmp_path / "x.mcap").stat().st_size
    with open(tmp_path / "x.mcap", "rb") as f:
        ends = [at + 9 + n for _, op, at, n in mcap_stream._heads(f, size) if op == 6]
    name = reader.batch.files()[0][0]
    (part,) = reader.partitions({"sizes": {name: ends[1]}}, reader.latestOffset())
    assert (part.start, part.end) == (ends[1], size)
    opened, true_unpack = [], mcap.unpack_chunk
    monkeypatch.setattr(mcap, "unpack_chunk", lambda body: opened.append(len(body)) or true_unpack(body))
    got = [t for b in reader.read(part) for t in b.column("log_time_ns").to_pylist()]
    assert got == [t for _, t, _ in ROWS[8:]] and len(opened) <= 3  # its own chunk, and the earlier ones once for their channels' names
    assert reader.partitions(reader.latestOffset(), reader.latestOffset()) == [mcap_stream.Growth("", 0, 0)]


def test_growing_sessions_of_a_folder(spark, tmp_path):
    mcap.register(spark)
    (tmp_path / "in").mkdir()
    hour = 3_600_000_000_000
    rows = lambda t: [(1, t + k, b"") for k in range(3)]
    make(tmp_path / "in" / "a.mcap", rows(1), per_chunk=2)
    make(tmp_path / "in" / "b.mcap", rows(hour // 2), per_chunk=2)
    stream = spark.readStream.format("mcap_messages").schema("file string, log_time_ns long").option("path", str(tmp_path / "in")).load()
    files = stream.select(F.regexp_extract("file", "([^/]+)/[^/]+$", 1).alias("folder"), F.element_at(F.split("file", "/"), -1).alias("name"), F.timestamp_millis((F.col("log_time_ns") / 1_000_000).cast("long")).alias("at"))
    out = streams.growing_sessions(files, "0 seconds")
    found = []
    for more in (None, ("c.mcap", 5 * hour), ("d.mcap", 9 * hour)):
        if more:
            make(tmp_path / "in" / more[0], rows(more[1]), per_chunk=2)
        q = out.writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/state").start()
        q.processAllAvailable()
        q.stop()
        found.append(sorted(tuple(r.files) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/rows").collect()))
    assert found == [[], [("a.mcap", "b.mcap")], [("a.mcap", "b.mcap"), ("c.mcap",)]]
