"""The table of chunk indexes, what is read by way of it, lz4 chunks, and the MCAP sink."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from reelspan.sinks import mcap as sink
from reelspan.sinks.staging import OutputExists, Written
from reelspan.sources import mcap, mcap_index
from tests.test_mcap import ROWS, loose, make


def rows_of(seed=3, n=4700):
    """Three topics, one only late, one rare; times overlap between chunks."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        topic = "/late" if i > n * 0.8 and i % 3 == 0 else "/rare" if i % 1500 == 700 else "/often"
        out.append(("a.mcap", topic, 10_000 + 10 * i + r.randrange(-300, 300), i, bytes([i % 251]) * (i % 40)))
    return out


def written(spark, folder, rows, **options):
    df = spark.createDataFrame(rows, "output string, topic string, log_time_ns long, sequence long, data binary").withColumn("schema_name", F.lit("S"))
    df = df.repartition("output").sortWithinPartitions("output", "sequence")  # in the order of writing, not of time
    sink.register(spark)
    df.write.format("mcap").mode("append").options(path=folder, **options).save()


@pytest.mark.parametrize("compression", ["none", "zstd", "lz4"])
def test_round_trip(spark, tmp_path, compression):
    rows = rows_of(n=600) + [("sub/b.mcap", "/x", 5, 1, b""), ("sub/b.mcap", "/x", 5, 2, None)]
    written(spark, str(tmp_path), rows, compression=compression, chunk_bytes="2000", manifest=f"{tmp_path}/m/manifest.jsonl")
    mcap.register(spark)
    want = sorted((o.split("/")[-1], t, at, s, d or b"") for o, t, at, s, d in rows)
    got = spark.read.format("mcap_messages").option("path", str(tmp_path)).load()
    assert sorted((r.file.split("/")[-1], r.topic, r.log_time_ns, r.sequence, bytes(r.data)) for r in got.collect()) == want
    few = spark.read.format("mcap_messages").schema("topic string, log_time_ns long").option("path", str(tmp_path)).load()
    assert sorted(map(tuple, few.collect())) == sorted((t, at) for _, t, at, *_ in want)
    split = spark.read.format("mcap_messages").options(path=str(tmp_path), split_bytes="3000").load()
    assert split.rdd.getNumPartitions() > 3 and split.count() == len(rows) and split.select("file", "ordinal").distinct().count() == len(rows)
    told = [json.loads(x) for x in open(f"{tmp_path}/m/manifest.jsonl")]
    assert [t["output"] for t in told] == ["a.mcap", "sub/b.mcap"] and [t["messages"] for t in told] == [600, 2] and told[0]["chunks"] > 5
    assert os.path.getsize(told[0]["path"]) == told[0]["file_bytes"]
    table = mcap_index.current(spark, str(tmp_path), f"{tmp_path}/index")
    again = mcap_index.messages(table, task_bytes=3000)
    assert sorted((r.file.split("/")[-1], r.topic, r.log_time_ns, r.sequence, bytes(r.data)) for r in again.collect()) == want


def test_damaged_lz4_becomes_a_row(spark, tmp_path):
    written(spark, str(tmp_path), rows_of(n=300), compression="lz4", chunk_bytes="4000")
    mcap.register(spark)
    chunk = spark.read.format("mcap_chunks").option("path", str(tmp_path)).load().orderBy("offset").first()
    path = tmp_path / "a.mcap"
    raw = bytearray(path.read_bytes())
    raw[chunk.offset + chunk.length - 200 : chunk.offset + chunk.length - 150] = bytes(50)
    path.write_bytes(bytes(raw))
    got = spark.read.format("mcap_messages").options(path=str(tmp_path), split_bytes="1000").load().collect()
    assert sum("unpacked" in (r.error or "") for r in got) == 1 and 100 < sum(r.error is None for r in got) < 300


def test_table_is_refreshed_by_what_is_new(spark, tmp_path):
    folder, table = str(tmp_path / "in"), str(tmp_path / "index")
    os.mkdir(folder)
    make(tmp_path / "in" / "x.MCAP", ROWS)
    make(tmp_path / "in" / "whole.mcap", ROWS, summary=False)
    (tmp_path / "in" / "bad.mcap").write_bytes(b"nothing")
    first = mcap_index.current(spark, folder, table)
    assert {(r.kind, r["count"]) for r in first.groupBy("kind").count().collect()} == {("chunk", 3), ("rest", 2), ("whole", 1), ("bad", 1)}
    parts = set(os.listdir(table))
    assert mcap_index.current(spark, folder, table).count() == 7 and set(os.listdir(table)) == parts  # nothing is read again
    make(tmp_path / "in" / "y.mcap", ROWS[:4])
    os.remove(tmp_path / "in" / "whole.mcap")
    now = mcap_index.current(spark, folder, table)
    assert sorted((r.file[-6:], r.kind) for r in now.collect()) == [("d.mcap", "bad"), ("x.MCAP", "chunk"), ("x.MCAP", "chunk"), ("x.MCAP", "chunk"), ("x.MCAP", "rest"), ("x.MCAP", "rest"), ("y.mcap", "chunk"), ("y.mcap", "rest"), ("y.mcap", "rest")]
    make(tmp_path / "in" / "y.mcap", ROWS[:8])  # replaced
    now = mcap_index.current(spark, folder, table)
    assert now.where("file like '%y.mcap' and kind = 'chunk'").count() == 2
    got = mcap_index.messages(now, ["/b"], 1030, 1070, ["log_time_ns", "data"])
    assert got.columns == ["log_time_ns", "data"] and sorted(r.log_time_ns for r in got.collect()) == [1030, 1030, 1050, 1050, 1070, 1070]
    wanted = spark.createDataFrame([(r.file, 1000, 1010) for r in now.where("kind = 'chunk'").select("file").distinct().collect() if r.file.endswith("x.MCAP")], "file string, from_ns long, to_ns long")
    assert sorted(r.log_time_ns for r in mcap_index.messages(now, columns=["log_time_ns"], wanted=wanted).collect()) == [1000, 1010]


def test_loose_records_and_faults_by_way_of_the_table(spark, tmp_path):
    loose(tmp_path / "x.mcap", cut_chunk=True)
    make(tmp_path / "y.mcap", ROWS, summary=False, cut=60)
    table = mcap_index.current(spark, str(tmp_path), str(tmp_path / "index"))
    got = mcap_index.messages(table).collect()
    x = [r for r in got if r.file.endswith("x.mcap")]
    assert sum(r.error is None for r in x) == 7 and sum("unpacked" in (r.error or "") for r in x) == 1 and [bytes(r.data) for r in x if r.sequence == 99] == [b"loose"]
    y = [r for r in got if r.file.endswith("y.mcap")]
    assert sum(r.error is None for r in y) == 8 and sum(r.error is not None for r in y) == 1
    times = {(r.file[-6:], r.topic): (r.first_ns, r.last_ns, r.error is not None) for r in mcap_index.topic_times(table).collect()}
    assert times == {("x.mcap", "/a"): (1040, 1080, True), ("x.mcap", "/b"): (1035, 1090, True), ("y.mcap", "/a"): (1000, 1060, True), ("y.mcap", "/b"): (1010, 1070, True)}


def test_times_of_topics_open_few_chunks(spark, tmp_path):
    rows = rows_of()
    written(spark, str(tmp_path), rows, chunk_bytes="5000")
    table = mcap_index.current(spark, str(tmp_path), str(tmp_path / "index"))
    assert table.where("kind = 'chunk'").count() >= 40
    for topics in (None, ["/often"], ["/late"], ["/rare", "/late"], ["/none"]):
        got = mcap_index.topic_times(table, topics).collect()
        want = {}
        for _, t, at, *_ in rows:
            if not topics or t in topics:
                want[t] = (min(at, want.get(t, (at,))[0]), max(at, want.get(t, (at, at))[1]))
        assert {r.topic: (r.first_ns, r.last_ns) for r in got} == want
        assert all(r.opened <= (12 if topics is None else 6) for r in got)
    often = mcap_index.topic_times(table, ["/often"]).first()
    assert often.opened <= 6 and often.chunks >= 40


def test_ordered_recordings_open_four_chunks_at_most(spark, tmp_path):
    rows = [("a.mcap", f"/{'abc'[i % 3]}", 1000 + i, i, bytes(20)) for i in range(4700)]
    written(spark, str(tmp_path), rows, chunk_bytes="5000")
    table = mcap_index.current(spark, str(tmp_path), str(tmp_path / "index"))
    got = mcap_index.topic_times(table).collect()
    assert {r.topic: (r.first_ns, r.last_ns) for r in got} == {"/a": (1000, 5698), "/b": (1001, 5699), "/c": (1002, 5697)} and all(r.opened <= 4 and r.chunks > 30 for r in got)


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_first_messages_stop_early(spark, tmp_path, limit):
    rows = rows_of()
    written(spark, str(tmp_path), rows, chunk_bytes="5000")
    make(tmp_path / "whole.mcap", ROWS, summary=False)
    table = mcap_index.current(spark, str(tmp_path), str(tmp_path / "index"))
    got = mcap_index.first_messages(table, limit).collect()
    want = {}
    for _, t, at, s, d in rows:
        want.setdefault(t, []).append((at, s, d))
    a = [r for r in got if r.file.endswith("a.mcap")]
    for t, own in want.items():
        mine = sorted((r.n, r.log_time_ns, r.sequence, bytes(r.data)) for r in a if r.topic == t)
        assert mine == [(n + 1, *x) for n, x in enumerate(sorted(own, key=lambda x: x[:2])[:limit])]
    assert max(r.opened for r in mcap_index.first_messages(table, limit, ["/often"]).where("chunks > 0").collect()) <= 10
    assert sorted(r.log_time_ns for r in got if r.file.endswith("whole.mcap")) == [t for _, t, _ in ROWS][: 2 * limit] if limit == 1 else True


def test_sink_commits_once(spark, tmp_path):
    folder = str(tmp_path / "out")
    written(spark, folder, rows_of(n=50))
    assert sorted(os.listdir(folder)) == ["a.mcap"]
    before = (tmp_path / "out" / "a.mcap").read_bytes()
    with pytest.raises(Exception, match="output exists"):  # and the other file isn't published either
        written(spark, folder, [("Z.mcap", "/x", 1, 1, b""), *rows_of(n=50)])
    assert sorted(os.listdir(folder)) == ["a.mcap"] and (tmp_path / "out" / "a.mcap").read_bytes() == before
    with pytest.raises(Exception, match="log_time_ns|TypeError|'<' not supported"):  # a failing task
        written(spark, folder, [("b.mcap", "/x", 1, 1, b""), ("b.mcap", "/x", None, 2, b"")])
    assert sorted(os.listdir(folder)) == ["a.mcap"]


def test_repeated_attempts_leave_one_file(tmp_path):
    writer = sink._Writer({"path": str(tmp_path), "compression": "none"})
    from pyspark.sql import Row

    rows = [Row(output="a.mcap", topic="/t", log_time_ns=k, sequence=k, data=b"x") for k in range(5)]

    def broken():
        yield from rows[:3]
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(broken())
    writer.write(iter(rows))  # speculative: not the one that is committed
    message = writer.write(iter(rows))
    writer.commit([message, None, Written()])
    assert sorted(os.listdir(tmp_path)) == ["a.mcap"]
    with open(tmp_path / "a.mcap", "rb") as f:
        assert mcap.read_index(f, os.path.getsize(tmp_path / "a.mcap")).counts == {1: 5}
    other = sink._Writer({"path": str(tmp_path), "compression": "none"})
    message = other.write(iter(rows))
    with pytest.raises(OutputExists):
        other.commit([message])
    other.abort([])
    assert sorted(os.listdir(tmp_path)) == ["a.mcap"]
