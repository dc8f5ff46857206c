"""Documents, playlists, reports, and the operators on recordings' parts and listings."""

import json

import pytest

from pyspark.sql import functions as F

from reelspan.functions import timing
from reelspan.operators import align, continuity, integrity, islands, library, playlist, profile, report, sessions
from reelspan.sources import documents
from reelspan.streaming import sessions as streams


def test_manifest_lines(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    documents.append_manifest(str(path), [{"source": "a", "status": "running"}, {"source": "b", "status": "failed", "error_code": "x"}])
    documents.append_manifest(str(path), [{"source": "a", "status": "success", "outputs": [{"path": "p", "bytes": 5}]}, {"status": "no source"}])
    path.write_text(path.read_text() + '\n{"source": "a", "sta')
    rows = documents.read_manifest(spark, str(path))
    assert rows.count() == 3
    last = {r.source: r.r.status for r in rows.groupBy("source").agg(F.max_by(F.struct("status"), "line").alias("r")).collect()}
    assert last == {"a": "success", "b": "failed"}


def test_folder_documents(spark, tmp_path):
    for name, text in (("a", '{"fps": 29.97}'), ("b", '{"fps": "30000/1001"}'), ("c", '{"fps": 0}'), ("d", "no json"), ("e", '{"fps": "1/0"}'), ("f", '{"fps": 90001}')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "session.json").write_text(text)
    got = {r.folder[-1]: round(r.fps, 4) for r in documents.folder_fps(spark, str(tmp_path)).collect()}
    assert got == {"a": 29.97, "b": 29.97}
    folder = str(tmp_path / "a")
    documents.set_override(folder, "x", "y", "join")
    documents.set_override(folder, "x", "y", "split")
    documents.set_override(folder, "y", "z", "join")
    documents.set_override(folder, "q", "r", "join")
    documents.set_override(folder, "q", "r", "clear")
    assert sorted((r.a, r.b, r.kind) for r in documents.read_overrides(spark, str(tmp_path)).collect()) == [("x", "y", "split"), ("y", "z", "join")]
    (tmp_path / "b" / "sessions.json").write_text("[")
    assert documents.read_overrides(spark, str(tmp_path)).count() == 2
    parts = spark.createDataFrame([(folder, "x", 0, [("/c", 0, 10, 10, "h")]), (folder, "y", 20, [("/c", 20, 30, 10, "h")])], "folder string, name string, first_ns long, tracks array<struct<topic:string,first_ns:long,last_ns:long,period_ns:long,codec:string>>")
    documents.save_sessions(sessions.detect(parts, documents.read_overrides(spark, str(tmp_path)).where("false")), {folder: {"join": [["y", "z"]], "split": []}})
    saved = json.loads((tmp_path / "a" / "sessions.json").read_text())
    assert saved["sessions"] == [{"id": "x~y", "origin": "auto", "files": ["x", "y"], "joins": [{"from": "x", "to": "y", "gap_frames": 1.0, "reason": "continuous"}]}] and saved["overrides"]["join"] == [["y", "z"]]


def test_sidecars_are_never_replaced(spark, tmp_path):
    docs = [(f"{tmp_path}/a.metadata.json", json.dumps({"source": "a.mcap", "video": [{"topic": "/c", "output": "a.mp4", "mp4": {"duration_s": 2.5}}], "audio": [{"x": 1}]})), (f"{tmp_path}/b.metadata.json", '{"source": ["x"]}')]
    df = spark.createDataFrame(docs, "path string, document string")
    assert all(r.written for r in documents.write_sidecars(df).collect())
    assert not any(r.written for r in documents.write_sidecars(df).collect())
    (tmp_path / "c.metadata.json").write_text("{")
    (row,) = documents.read_sidecars(spark, str(tmp_path)).collect()
    assert (row.name, row.source, row.video[0].mp4.duration_s, row.has_audio) == ("a.metadata.json", ["a.mcap"], 2.5, True)


def test_playlist_documents(spark, tmp_path):
    item = {"title": "t", "parts": [{"cameras": {"/c": "x.mp4"}, "duration_s": 1.5, "has_audio": False}], "kind": "single", "source_files": []}
    (tmp_path / "p.m2playlist").write_text(json.dumps({"version": 1, "play_mode": "odd", "items": [item], "state": {"index": 7, "position_s": 2.0}}))
    got = documents.read_playlists(spark, str(tmp_path))
    r = got.first()
    assert (r.play_mode, r.state["index"], r.state.position_s, r.state.speed, r["items"][0].parts[0].cameras) == ("sequential", -1, 2.0, 1.0, {"/c": "x.mp4"})
    again = json.loads(documents.playlist_documents(got).first().document)
    assert again["items"] == [item] and again["state"]["index"] == 0


def test_playlist_steps_and_places(spark):
    df = spark.range(4).withColumn("n", F.lit(4))
    pick = lambda *a, **k: [r[0] for r in df.orderBy("id").select(playlist.step(F.col("id"), F.col("n"), *a, **k)).collect()]
    assert pick("sequential") == [1, 2, 3, None] and pick("repeat") == [1, 2, 3, 0] and pick("repeat", False) == [0, 0, 1, 2]
    assert all(0 <= x < 4 and x != i for i, x in enumerate(pick("shuffle", seed=3)))
    items = spark.createDataFrame([("l", i, c) for i, c in enumerate("abcd")], "k string, pos long, item string")
    order = lambda d: "".join(r.item for r in d.where("k = 'l'").orderBy("pos").collect())
    assert order(playlist.insert(items, spark.createDataFrame([("l", "x", 1), ("l", "y", None), ("l", "z", -5)], "k string, item string, at long"), ["k"])) == "zaxbcdy"
    assert order(playlist.remove(items, spark.createDataFrame([("l", 1), ("l", 9)], "k string, pos long"), ["k"])) == "acd"
    for src, dst in ((0, 2), (3, 1), (1, 1), (0, 9)):
        expected = list("abcd")
        if 0 <= dst < 4 and src != dst:
            expected.insert(dst, expected.pop(src))
        assert order(playlist.move(items, spark.createDataFrame([("l", src, dst)], "k string, src long, dst long"), ["k"])) == "".join(expected)
    assert [tuple(r) for r in df.orderBy("id").select(playlist.index_after_insert(F.col("id"), F.lit(2)), playlist.index_after_remove(F.col("id"), F.lit(2))).collect()] == [(0, 0), (1, 1), (3, -1), (4, 2)]
    plays = spark.createDataFrame([("l", 1, 5), ("l", 2, 3)], "k string, t long, i long")
    assert {r.t: r.back for r in playlist.previous_played(plays, ["k"], ["t"], "i").collect()} == {1: None, 2: 5}


def results(spark):
    out = {"topic": "/c", "path": "/o/a,1.mp4", "bytes": 1, "frames": 10, "duration_s": 1.5, "width": 64, "height": 48, "co64": False, "audio": [{"samples": 9, "gaps": None, "offset_to_video_ms": 1.23456}]}
    lines = [
        {"source": "a", "status": "success", "outputs": [out, {**out, "path": "/o/b.mp4", "frames": None, "width": None, "audio": None}], "warnings": [{"code": "w"}], "verify": {"/c": {"quick": True}}, "source_bytes": 2_000_000},
        {"source": "b<", "status": "failed", "error_code": "mcap_error", "error": "it's \"bad\"", "source_bytes": None, "verify": {"/c": {"quick": False}}},
    ]
    text = spark.createDataFrame([(json.dumps(x),) for x in lines], "v string")
    return text.select(F.from_json("v", documents.MANIFEST).alias("r")).select("r.*")


def test_reports(spark, tmp_path):
    labels = spark.createDataFrame([("en", "status.success", "Done"), ("id", "status.failed", "Gagal"), ("en", "status.failed", ""), ("id", "err.mcap_error", "E")], "language string, key string, text string")
    table = report.rows(results(spark), labels, "en").cache()
    a, b = table.orderBy("source").collect()
    assert a.asDict() == {
        "source": "a", "status": "Done", "error": "", "message": "", "source_bytes": 2_000_000, "elapsed_s": None, "mb_per_s": None, "outputs": "a,1.mp4; b.mp4", "frames": "/c=10", "fps": None, "time_source": None,
        "duration_s": "1.5; 1.5", "resolution": "64x48", "co64": "False; False", "audio": "9; 0; 1.235", "verify": "ok", "warnings": 1, "sidecar": "",
    }
    assert (b.status, b.error, b.message, b.verify, b.outputs) == ("Gagal", "E", "it's \"bad\"", "failed", "")
    whole = report.summary(results(spark), 4.0)
    s = whole.first()
    assert (s.counts, s.files, s.total_source_bytes, s.throughput_mb_s, s.exit_code) == ({"success": 1, "failed": 1, "skipped": 0, "incomplete": 0, "out_of_sync": 0}, 2, 2_000_000, 0.5, 1)
    report.export_csv(table, str(tmp_path / "r.csv"), ";")
    import csv

    rows = list(csv.reader((tmp_path / "r.csv").open(encoding="utf-8-sig", newline=""), delimiter=";"))
    assert rows[0] == list(report.COLUMNS) and rows[2][:4] == ["b<", "Gagal", "E", "it's \"bad\""] and rows[1][7] == "a,1.mp4; b.mp4"
    report.export_html(table, [("files", 2)], str(tmp_path / "r.html"))
    assert "<td>b&lt;</td>" in (tmp_path / "r.html").read_text() and "it&#x27;s &quot;bad&quot;" in (tmp_path / "r.html").read_text()
    report.write_csv(table, str(tmp_path / "csv"))
    report.export_json(table, whole, str(tmp_path / "r.json"))
    document = json.loads((tmp_path / "r.json").read_text())
    assert list(document) == ["summary", "files"] and [f["source"] for f in document["files"]] == sorted(r[0] for r in table.select("source").collect()) and document["summary"]["files"] == 2
    report.write_json(table, whole, str(tmp_path / "json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2 and spark.read.json(str(tmp_path / "json" / "files")).count() == 2


def test_codes_and_lines(spark):
    df = spark.createDataFrame([("McapError", None), ("Other", None), (None, "no_video_channel"), (None, None)], "k string, c string")
    assert [r[0] for r in df.select(report.error_code(F.col("k"), F.col("c"))).collect()] == ["mcap_error", "internal_error", "no_video_channel", None]
    sync = "struct<reason:string,index:long>"
    df = spark.createDataFrame([("success", [3, 4], 1.5, 2.0, None, None, None), ("skipped", None, None, None, None, None, None), ("out_of_sync", None, None, None, "out_of_sync", ("tolerance", 7), "e"), ("failed", None, None, None, "x", None, "why")], f"s string, f array<long>, t double, v double, c string, y {sync}, e string")
    assert [r[0] for r in df.select(report.describe(*map(F.col, df.columns), verbose=True)).collect()] == ["2 MP4, 3+4 frames, 1.5 s, 2.0 MB/s", "", ": out_of_sync (tolerance at 7)\n    e", ": x\n    why"]
    assert [r[0] for r in df.select(report.failure_status(F.col("c"))).collect()][2] == "out_of_sync"


def test_sets_and_listings(spark):
    ref = spark.createDataFrame([("r", "/a", "x"), ("r", "/b", "x")], "rec string, topic string, adapter string")
    parts = spark.createDataFrame([("r", "p", "/a", "x", 3), ("r", "p", "/b", "y", 4), ("r", "q", "/a", "x", 5), ("r", "q", "/b", "x", 6), ("r", "q", "/z", "x", 7)], "rec string, part string, topic string, adapter string, messages long")
    assert [tuple(r) for r in library.mismatched_topics(ref, parts, ["rec"]).collect()] == [("r", "p", "/b")]
    assert {(r.topic, r.messages) for r in library.extra_counts(ref, parts, ["rec"]).collect()} == {("/b", 4), ("/z", 7)}
    left = spark.createDataFrame([("l1", "a"), ("l1", "b"), ("l2", "a")], "l string, m string")
    right = spark.createDataFrame([("r1", "b"), ("r1", "a"), ("r1", "a"), ("r2", "c")], "r string, m string")
    assert [tuple(r) for r in library.same_sets(left, right, "l", "r", "m").collect()] == [("l1", "r1")]
    df = spark.createDataFrame([("B", 1, True), ("a", 2, False), ("B", 5, True)], "f string, t long, c boolean")
    assert [tuple(r) for r in library.recent(df, "f", "t", 1).collect()] == [("B", 5)]
    assert [r.f for r in library.by_path(df, "f").collect()] == ["a", "B", "B"] and [r.f for r in library.listing(df, "c", "f").collect()] == ["B", "B", "a"]
    assert [tuple(r) for r in library.distinct_in_order(df, "f", "t").collect()] == [("B", 1), ("a", 2)]
    chunks = spark.createDataFrame([(5, 9, 0), (1, 20, 1)], "start_ns long, end_ns long, offset long")
    assert [r.offset for r in library.chunk_order(chunks).collect()] == [1, 0] and [r.offset for r in library.chunk_order(chunks, False).collect()] == [1, 0]
    rel = lambda *n: spark.createDataFrame([(x,) for x in n], "rel string")
    assert [r.rel for r in library.outputs(rel("b", "C"), rel("A")).collect()] == ["A", "b", "C"]
    rec = spark.createDataFrame([("x", 2, 1.5, False, ["/a"]), ("x", 1, 2.0, True, ["/a", "/b"])], "k string, part_index int, duration_s double, has_audio boolean, cameras array<string>")
    assert tuple(sessions.recordings(rec, ["k"]).first()) == ("x", 2, 3.5, True, 2)
    assert sessions.probe_limit(df, "c", ["t"], 1).count() == 2


def test_small_expressions(spark):
    df = spark.createDataFrame([("k", 1, 5, None), ("k", 2, 5, 7), ("k", 3, 6, None)], "k string, i long, v long, f long")
    assert [r.i for r in islands.run_starts(df, ["k"], ["i"], "v").orderBy("i").collect()] == [1, 3]
    assert [r.f for r in islands.fill_forward(df, ["k"], ["i"], "f").orderBy("i").collect()] == [None, 7, 7]
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    assert one(align.extrapolate(F.lit(10.0), F.lit(9.0), F.lit(2.0)), align.extrapolate(F.lit(10.0), F.lit(-1.0), F.lit(2.0)), align.extrapolate(F.lit(10.0), F.lit(0.25), F.lit(2.0))) == (11.2, 10.0, 10.5)
    assert one(continuity.usable_stamp(F.lit(0), F.lit(7)), continuity.usable_stamp(F.lit(None).cast("long"), F.lit(7)), continuity.usable_stamp(F.lit(3), F.lit(7)), continuity.whole_samples(F.lit(11), F.lit(4))) == (7, 7, 3, 2)
    assert one(*continuity.delays(F.lit(-40))) == (0, 40) and one(*continuity.delays(F.lit(7))) == (7, 0)
    both = [F.lit(x) for x in (32, 0, 50, 10)]
    assert one(continuity.offset(*both, F.lit("payload_timestamp"), F.lit(0)), continuity.offset(*both, F.lit("log_time"), F.lit(5))) == (32, 45)
    topics = spark.createDataFrame([("x", "/a", "continuous", 1.0), ("x", "/b", "overlap", 0.2), ("y", "/a", "continuous", 1.0)], "k string, topic string, reason string, gap double")
    assert {r.k: (r.reason, r.gap) for r in sessions.worst_topic(topics, ["k"]).collect()} == {"x": ("overlap", 1.0), "y": ("continuous", 1.0)}


def test_drift_controller_settles_after_the_users_actions_only(spark):
    rows = [(1, 0, None, 500.0, False), (1, 200, None, 500.0, False), (1, 700, None, 500.0, False), (2, 0, "play", 0.0, False), (2, 500, None, 900.0, False), (2, 600, None, 100.0, False), (2, 700, None, 15.0, False), (2, 800, None, -60.0, True), (2, 900, None, 60.0, False)]
    df = spark.createDataFrame(rows, "key long, at long, event string, drift double, paused boolean")
    got = {(r.key, r.at): (r.action, r.trim) for r in streams.drift_actions(df).collect()}
    assert got == {(1, 0): ("seek", 0), (1, 200): ("seek", 0), (1, 700): ("seek", 0), (2, 0): ("hold", 0), (2, 500): ("hold", 0), (2, 600): ("trim", -0.1), (2, 700): ("restore", 0), (2, 800): ("seek", 0), (2, 900): ("trim", -0.06)}


def test_streams(spark, tmp_path):
    rows = [("f", "b", "2024-01-01 00:00:00"), ("f", "a", "2024-01-01 00:30:00"), ("f", "c", "2024-01-01 09:00:00"), ("f", "z", "2024-01-03 00:00:00")]
    spark.createDataFrame(rows, "folder string, name string, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("folder string, name string, at timestamp").parquet(str(tmp_path / "in"))
    listener = streams.Progress()
    spark.streams.addListener(listener)

    def run(df, name):
        out = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        out.awaitTermination()
        return spark.read.parquet(str(tmp_path / name)).collect()

    assert sorted(tuple(r.files) for r in run(streams.growing_sessions(stream()), "s")) == [("a", "b"), ("c",)]
    assert sorted(r.n for r in run(streams.windows(stream(), ["folder"], "at", "1 day"), "w")) == [3]
    assert len(run(streams.distinct(stream(), ["folder"], "at"), "d")) == 1
    spark.streams.removeListener(listener)
    assert {"started", "progress", "terminated"} <= {e[0] for e in listener.events}


def test_rules(spark):
    df = spark.createDataFrame([("good", 3, 3), ("bad", 2, -1), ("nulls", None, None)], "f string, n long, m long")
    rules = {"differ": F.col("n") != F.col("m"), "negative": F.col("m") < 0, "many": F.col("n") > 5}
    got = {r.f: r.c for r in df.select("f", integrity.failed_rules(rules).alias("c")).collect()}
    assert got == {"good": [], "bad": ["differ", "negative"], "nulls": []}
    assert {tuple(r) for r in integrity.violations(df, rules).collect()} == {("differ", 1), ("negative", 1), ("many", 0)}


def test_sizes_round_ties_as_c_does(spark):
    for n, one_place, two in ((1280, "1.2 KB", "1.25 KB"), (1792, "1.8 KB", "1.75 KB"), (1 << 20, "1.0 MB", "1.00 MB"), (1023, "1023 B", "1023 B"), (1029, "1.0 KB", "1.00 KB"), (5 << 40, "5.0 TB", "5.00 TB"), (1 << 53, "8192.0 TB", "8192.00 TB"), (0, "0 B", "0 B")):
        assert one(spark, n, one_place, two)


def test_sizes_up_to_a_unit(spark):
    c = F.lit(3 << 20).cast("long")
    got = spark.range(1).select(timing.human_size(c, last="KB"), timing.human_size(c, last="MB"), timing.human_size(c * 1024, 2, "MB"), timing.human_size(F.lit(7), last="KB")).first()
    assert tuple(got) == ("3072.0 KB", "3.0 MB", "3072.00 MB", "7 B")


def one(spark, n, *texts):
    c = F.lit(n).cast("long")
    return tuple(spark.range(1).select(timing.human_size(c), timing.human_size(c, 2)).first()) == texts


def test_racing_sidecars(spark, tmp_path, monkeypatch):
    """Another writer comes between a task's document and its publishing: it wins, and this one says so."""
    df = spark.createDataFrame([(f"{tmp_path}/a.json", "mine"), (f"{tmp_path}/b.json", "mine")], "path string, document string")
    true_publish = documents.publish

    def late(store, part, name):
        if name.endswith("a.json"):
            (tmp_path / "a.json").write_text("theirs")
        true_publish(store, part, name)

    monkeypatch.setattr(documents, "publish", late)
    assert {r.path[-6:]: r.written for r in documents.write_sidecars(df).collect()} == {"a.json": False, "b.json": True}
    assert (tmp_path / "a.json").read_text() == "theirs" and (tmp_path / "b.json").read_text() == "mine" and sorted(p.name for p in tmp_path.iterdir()) == ["a.json", "b.json"]


def test_manifest_in_segments(spark, tmp_path):
    path = f"{tmp_path}/m.jsonl"
    documents.append_manifest(path, [{"source": "a", "status": "old"}])
    for k in range(12):
        documents.append_manifest(path, [{"source": "a", "status": f"s{k}"}, {"source": f"b{k}", "status": "x"}], segmented=True)
    first = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "m.jsonl.segments").iterdir()}
    documents.append_manifest(path, [{"source": "a", "status": "last"}], segmented=True)
    now = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "m.jsonl.segments").iterdir() if p.name.endswith(".jsonl")}
    assert len(now) == 13 and all(now[k] == v for k, v in first.items() if k.endswith(".jsonl"))  # nothing is written again
    (tmp_path / "m.jsonl.segments" / ".14.part").write_text('{"source": "a", "status": "half')
    rows = documents.read_manifest(spark, path)
    assert rows.count() == 26 and rows.where("source = 'a'").agg(F.max_by("status", "line")).first()[0] == "last"
    with pytest.raises(FileNotFoundError):
        documents.read_manifest(spark, f"{tmp_path}/none")


def test_audio_summary(spark):
    rows = [("a", 1, 0, 1000), ("a", 2, 1_000_000_000, 0), ("a", 3, 3_000_000_000, 1000), ("a", 4, 3_500_000_000, 800), ("b", 1, 7, 500), ("c", 1, 9, 0)]
    df = spark.createDataFrame(rows, "k string, i long, t long, n long")
    for hot in (0, None):
        got = {r.k: r.asDict(True) for r in continuity.summary(df, ["k"], ["t", "i"], "t", "n", 1000, hot=hot).collect()}
        a = got["a"]
        assert (a["messages"], a["samples"], a["source_samples"], a["first"], a["end"], a["duration_s"]) == (4, 4300, 2300, 0, 4_300_000_000, 4.3)
        assert a["gap_list"] == [{"position_s": 1.0, "duration_ms": 2000.0, "filled": True}] and a["overlap_list"] == [{"position_s": 4.0, "duration_ms": 500.0}]
        assert (a["gaps"], a["overlaps"], a["silence_samples"], a["trimmed_samples"], a["source_exact"]) == (1, 1, 2000, 500, False)
        assert got["b"]["source_exact"] and got["b"]["gap_list"] == [] and (got["c"]["messages"], got["c"]["samples"], got["c"]["first"], got["c"]["end"]) == (1, 0, None, None)


def test_diagnosis(spark):
    rows = [("t", i, i * 100, b"x" * (i % 7) + b"yz", f"f{i % 3 if i < 90 else 0}") for i in range(100)] + [("u", 0, 5, None, None)]
    got = {r.k: r for r in profile.diagnose(spark.createDataFrame(rows, "k string, i long, t long, d binary, f string"), ["k"], ["i"], "t", "d", "f", 1000).collect()}
    t = got["t"]
    assert (t.messages, t.smallest, t.largest, t.median_size, bytes(t.first_bytes), t.rate_hz) == (100, 2, 8, 5, b"yz", 10.0) and [tuple(x) for x in t.formats][0] == ("f0", 40)
    assert got["u"].messages == 1 and got["u"].rate_hz is None and got["u"].smallest is None
