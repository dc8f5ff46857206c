"""Operators against hand-made truth and against the plain loop they stand for."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from reelspan.functions import text, timing
from reelspan.operators import align, continuity, integrity, islands, library, ordered, profile, report, sessions


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_gaps_and_overlaps_equal_the_loop(spark):
    r, t, rows = random.Random(1), 0, []
    for i in range(800):
        n = r.choice([0, 1, 7, 256, 256, 300])
        rows.append((i % 2, i, t, n))
        t += r.choice([1_000_000, 16_000_000, 16_000_000, 80_000_000, 9_999_999])
    expected = {}
    for key in (0, 1):
        due, pos = None, 0
        for k, i, stamp, n in rows:
            if k != key or not n:
                continue
            delta = 0 if due is None else stamp - due
            fill = round(delta * 16000 / 1e9) if delta > 1_000_000 else 0
            trim = min(n, round(-delta * 16000 / 1e9)) if delta < -1_000_000 else 0
            expected[i] = (fill, trim, pos)
            pos += fill + n - trim
            due = stamp + round(n * 1e9 / 16000)
    df = spark.createDataFrame(rows, "k int, i long, stamp long, n int")
    got = continuity.blocks(df, ["k"], ["stamp", "i"], "stamp", "n", 16000, width=1_000_000_000)
    assert {x.i: (x.fill, x.trim, x.position) for x in got.collect()} == expected
    ignored = continuity.blocks(df, ["k"], ["stamp", "i"], "stamp", "n", 16000, policy="ignore")
    assert ignored.agg(F.sum("fill")).first()[0] == 0


def test_sessions_cut_after_the_gap_and_leave_null_times_out(spark):
    df = spark.createDataFrame([("a", 0), ("a", 10), ("a", 21), (None, 5), ("a", None)], "k string, t long")
    got = {(x.k, x.t): x.session for x in sessions.sessionize(df, ["k"], "t", 10, width=7).collect()}
    assert got == {("a", 0): 1, ("a", 10): 1, ("a", 21): 2, (None, 5): 1, ("a", None): None}
    assert sessions.sessionize(df.limit(0), ["k"], "t", 10).count() == 0


def test_every_join_reason(spark):
    ns, p = 1_000_000_000, 33_333_333
    cases = {
        "different_folder": (False, True, True, True, p, p), "no_video": (True, False, True, True, p, p), "topics_differ": (True, True, False, True, p, p), "codec_differs": (True, True, True, False, p, p),
        "period_unknown": (True, True, True, True, p, None), "time_backwards": (True, True, True, True, -5, p), "overlap": (True, True, True, True, p // 5, p), "gap_too_large": (True, True, True, True, 3 * ns, p), "continuous": (True, True, True, True, p, p),
    }
    df = spark.createDataFrame(list(cases.values()), "f boolean, v boolean, t boolean, c boolean, gap long, period long")
    assert [x[0] for x in df.select(sessions.join_reason(*map(F.col, df.columns))).collect()] == list(cases)


def test_detect_joins_parts_and_obeys_overrides(spark):
    ns, p = 1_000_000_000, 33_333_333
    track = lambda a, z, period=p, codec="x", topic="/c": (topic, a, z, period, codec)
    parts = [("f", "a.mcap", 0, [track(0, ns)]), ("f", "b.mcap", ns + p, [track(ns + p, 2 * ns)]), ("f", "c.mcap", 9 * ns, [track(9 * ns, 10 * ns)]), ("f", "d.mcap", None, [])]
    parts += [("g", "a", 0, [track(0, ns, None)]), ("g", "b", 2 * ns, [track(2 * ns, 3 * ns, ns)]), ("g", "c", 4 * ns, [track(4 * ns, 5 * ns, ns, "y")])]  # the later part's period stands in
    two = lambda a, z, d=0: [track(a, z, topic="/a"), track(a + d, z + d, topic="/b")]
    parts += [("h", "a", 0, two(0, ns)), ("h", "b", ns + p, two(ns + p, 2 * ns, -p)), ("h", "c", 2 * ns + p, [track(2 * ns + p, 3 * ns, topic="/a")]), ("h", "d", 3 * ns + p, [track(3 * ns + p, 4 * ns, topic="/a")])]
    df = spark.createDataFrame(parts, "folder string, name string, first_ns long, tracks array<struct<topic:string,first_ns:long,last_ns:long,period_ns:long,codec:string>>")
    none = spark.createDataFrame([], "folder string, a string, b string, kind string")
    rows = sessions.detect(df, none)
    got = {(x.folder, x.name): (x.session, x.reason, x.gap_frames, x.title, x.origin) for x in rows.collect()}
    assert got == {
        ("f", "a.mcap"): (1, None, None, "a~b", "auto"), ("f", "b.mcap"): (1, "continuous", 1.0, "a~b", "auto"), ("f", "c.mcap"): (2, "gap_too_large", 210.0, "c", "auto"), ("f", "d.mcap"): (3, "no_video", None, "d", "auto"),
        ("g", "a"): (1, None, None, "a~b", "auto"), ("g", "b"): (1, "continuous", 1.0, "a~b", "auto"), ("g", "c"): (2, "codec_differs", None, "c", "auto"),
        ("h", "a"): (1, None, None, "a", "auto"), ("h", "b"): (2, "overlap", 0.0, "b", "auto"), ("h", "c"): (3, "topics_differ", None, "c~d", "auto"), ("h", "d"): (3, "continuous", 1.0, "c~d", "auto"),
    }
    some = spark.createDataFrame([("f", "a.mcap", "b.mcap", "split"), ("f", "a.mcap", "b.mcap", "join"), ("f", "b.mcap", "c.mcap", "join")], "folder string, a string, b string, kind string")
    got = {x.name: (x.session, x.reason, x.origin) for x in sessions.detect(df.where("folder = 'f'"), some).collect()}
    assert got["a.mcap"] == (1, None, "auto") and got["b.mcap"] == (2, "manual_split", "manual") and got["c.mcap"] == (2, "manual_join", "manual")
    lengths = {(x.folder, x.session): (x.parts, x.duration_s) for x in sessions.session_durations(rows).collect()}
    assert lengths["f", 1] == (2, (2 * ns + p) / 1e9) and lengths["g", 1] == (2, 4.0)


def test_mismatch_reasons_and_policy(spark):
    rows = [("u", c, 100 * i + (d if i == at else 0)) for c, n, d, at in (("a", 5, 0, 0), ("b", 4, 0, 0)) for i in range(n)]
    rows += [("w", "a", 0), ("w", "b", 5000), ("v", "a", 0), ("v", "a", 100), ("v", "b", 0), ("v", "b", 160)]
    df = spark.createDataFrame(rows, "k string, c string, t long")
    got = align.first_mismatch(align.pair_by_position(df, ["k"], "c", "t", "a", ["b"]), ["k"], F.lit(50), F.lit(100))
    assert {x.k: (x.reason, x.i, x.delta) for x in got.collect()} == {"u": ("frame_count", None, None), "w": ("time_base", 0, 5000), "v": ("tolerance", 1, 60)}
    states = got.select("k", *[align.apply_policy(F.col("reason"), p).alias(p) for p in ("strict", "warn", "trim")])
    assert {tuple(x)[0]: tuple(x)[1:] for x in states.collect()} == {"u": ("out_of_sync", "warned", "trimmed"), "w": ("out_of_sync", "warned", "out_of_sync"), "v": ("out_of_sync", "warned", "out_of_sync")}


def test_locate_clamps(spark):
    parts = islands.starts(spark.createDataFrame([("r", 0, 3000), ("r", 1, 4000), ("r", 2, 5000)], "k string, part int, d long"), ["k"], ["part"], F.col("d"))
    probes = spark.createDataFrame([("r", p) for p in (-1, 0, 2999, 3000, 6999, 7000, 11999, 99999)], "k string, p long")
    got = {x.p: (x.part, x.offset) for x in align.locate(probes, parts, ["k"], "p", "start", "d", "part").collect()}
    assert got == {-1: (0, 0), 0: (0, 0), 2999: (0, 2999), 3000: (1, 0), 6999: (1, 3999), 7000: (2, 0), 11999: (2, 4999), 99999: (2, 5000)}


def test_leading_rows_need_a_key_and_parameter_sets(spark):
    rows = [(0, True, False), (1, False, True), (2, False, False), (3, True, False), (4, False, False)]
    df = spark.createDataFrame([("x", *r) for r in rows], "k string, i int, is_key boolean, sets boolean")
    assert sorted(x.i for x in islands.drop_leading(df, ["k"], ["i"], F.col("is_key"), F.col("sets")).collect()) == [3, 4]


def test_digest_of_large_and_null_groups(spark):
    rows = [(i % 3 or None, i, f"v{i}" if i % 5 else None) for i in range(1000)]
    got = {x.k: (x.rows, x.sha256) for x in profile.ordered_digest(spark.createDataFrame(rows, "k int, i int, v string"), ["k"], ["i"], "v").collect()}
    for key in (1, 2, None):
        own = [v or "" for k, _, v in rows if k == key]
        assert got[key] == (len(own), hashlib.sha256("".join(own).encode()).hexdigest())


def test_format_lock_ends_a_channel(spark):
    df = spark.createDataFrame([("a", 1, "s16"), ("a", 2, "s16"), ("a", 3, "f32"), ("a", 4, "s16"), ("b", 1, "f32"), ("c", 1, "s16")], "k string, i long, f string")
    got = sorted((x.k, x.i, x.error) for x in continuity.format_lock(df, ["k"], ["i"], "f", ["s16"]).collect())
    assert got == [("a", 1, "audio_format_changed"), ("a", 2, "audio_format_changed"), ("c", 1, None)]
    df = spark.createDataFrame([("a", 1, "s16", 8), ("a", 2, "s16", 8), ("a", 3, "s16", 16), ("b", 1, "s16", None), ("b", 2, "s16", None), ("b", 3, None, None)], "k string, i long, f string, rate int")
    got = sorted((x.k, x.i, x.error) for x in continuity.format_lock(df, ["k"], ["i"], "f", ["s16"], ("rate",)).collect())
    assert got == [(k, i, "audio_format_changed") for k in "ab" for i in (1, 2)]


def test_manifest_is_done_only_with_its_files(spark):
    out = "array<struct<path:string,bytes:long>>"
    m = spark.createDataFrame([("a", 1, "running", []), ("a", 2, "success", [("p", 5)]), ("b", 1, "success", [("q", 5)]), ("c", 1, "success", []), ("d", 1, "failed", [("p", 5)])], f"source string, line int, status string, outputs {out}")
    files = spark.createDataFrame([("p", 5), ("q", 6)], "path string, size long")
    assert {x.source: x.done for x in integrity.done(m, files).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_report(spark):
    df = spark.createDataFrame([("success",), ("odd",), ("out_of_sync",)], "status string")
    assert {tuple(x) for x in report.status_counts(df).collect()} == {("success", 1), ("odd", 1), ("out_of_sync", 1), ("failed", 0), ("skipped", 0), ("incomplete", 0)}
    assert report.exit_code(df).first()[0] == 2 and report.exit_code(df.limit(0)).first()[0] == 0
    assert one(spark, report.eta(F.lit(100), F.lit(50), F.lit(5)), report.eta(F.lit(100), F.lit(1), F.lit(5)), report.throughput(F.lit(5e6), F.lit(0))) == (5.0, None, None)


def test_names(spark):
    cases = {"a/b:c": "a_b_c", " .x. ": "x", "CON": "_CON", "": "channel", "lpt1": "_lpt1"}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert [x[0] for x in df.select(text.sanitize(F.col("n"))).collect()] == list(cases.values())
    assert one(spark, text.topic_label(F.lit("/a/cam/0")), text.codec(F.lit("HEVC")), text.codec(F.lit("")), text.fill("{a}_{b}", a=F.lit("x"), b=F.lit(3))) == ("a_cam_0", "h265", "unknown", "x_3")
    assert one(spark, text.topic_label(F.lit("/a:b/c?")), text.topic_label(F.lit("//")), text.fill("{a}", a=F.lit("x" * 199 + ". y")), text.fill("{a}", a=F.lit("...")), text.fill("a/{a}", a=F.lit("b"))) == ("a_b_c_", "channel", "x" * 199, "rekaman", "a_b")
    assert one(spark, text.output_name(F.lit("r?"), F.lit("/c/0"), F.lit(3), F.lit("2024-05-06").cast("date"), "{nama}_{topik}_{indeks}_{tanggal}"), text.session_name(F.lit("a"), F.lit("z"), F.lit(3), "{pertama}-{terakhir} x{jumlah}")) == ("r__c_0_3_20240506", "a-z x3")
    assert [one(spark, text.common_title(F.array(*map(F.lit, s))))[0] for s in (("trip_camera_0", "trip_camera_1"), ("a1", "b1"), ("Cam_1", "Cam_12"), ("run 7_cam0",))] == ["trip", "", "", "run 7"]
    assert one(spark, text.group_id(F.lit("s"), F.array(F.lit("/b"), F.lit("/a")), F.array(F.lit("x"), F.lit("y"))))[0] == hashlib.sha1(b"s\0/a\0/b\0x\0y").hexdigest()[:16]
    where = spark.createDataFrame([("beside", "/p/q", "/out", "q", True), ("folder", "/p/q", "/out", "q", True), ("folder", "/p/q", "/out", "q", False), ("folder", "/p", "/out", ".", None)], "m string, p string, o string, r string, f boolean")
    assert [x[0] for x in where.select(text.output_folder(*map(F.col, where.columns))).collect()] == ["/p/q", "/out/q", "/out", "/out"]
    assert one(spark, text.reports_folder(F.lit("/r"), F.lit("beside"), F.lit("/o"), F.lit("/s")), text.reports_folder(F.lit(""), F.lit("x"), F.lit("/o"), F.lit("/s")), text.reports_folder(F.lit(None), F.lit("beside"), F.lit("/o"), F.lit("/s"))) == ("/r", "/o", "/s/_reports")
    r = random.Random(9)
    for names in (["x", "x", "x_2", "X", "y"], [r.choice(["x", "X", "x_2", "x_2_2", "x_3", "y", "y_1_1"]) for _ in range(60)]):
        taken, expected = set(), []
        for n in names:
            k, now = 1, n
            while now.lower() in taken:
                k += 1
                now = f"{n}_{k}"
            taken.add(now.lower())
            expected.append(now)
        rows = spark.createDataFrame([("f", i, n) for i, n in enumerate(names)], "f string, i int, n string")
        assert [x.unique for x in library.unique_names(rows, "f", "i", "n").orderBy("i").collect()] == expected
    files = [("f", "ego_0014", None), ("f", "ego_0015", None), ("f", "a_cam_0", None), ("f", "a_cam_1", None), ("f", "solo_cam_0", None), ("f", "p", "m1"), ("f", "q", "m1")]
    got = {x.stem: x.pairing for x in library.pair_outputs(spark.createDataFrame(files, "folder string, stem string, marker string")).collect()}
    assert got == {"ego_0014": "s:ego_0014", "ego_0015": "s:ego_0015", "a_cam_0": "n:a_cam_", "a_cam_1": "n:a_cam_", "solo_cam_0": "s:solo_cam_0", "p": "m:m1", "q": "m:m1"}


def test_timing(spark):
    day = 1_700_000_000_123_000_000
    assert one(spark, timing.iso_utc(F.lit(day)), timing.iso_utc(F.lit(5)), timing.clock(F.lit(3725.9)), timing.human_size(F.lit(1536)), timing.human_size(F.lit(7))) == ("2023-11-14T22:13:20.123Z", None, "1:02:05", "1.5 KB", "7 B")
    assert one(spark, timing.clock(F.lit(None).cast("double")), timing.clock(F.lit(-1)), timing.clock(F.lit(2e7)), timing.clock(F.lit(float("nan")))) == ("\u2014",) * 4
    assert one(spark, timing.position(F.lit(61_007), True), timing.position(F.lit(3_600_000)), timing.position(F.lit(-5)), timing.position(F.lit(None).cast("long"))) == ("01:01.007", "1:00:00", "00:00", "00:00")
    assert one(spark, timing.clamp_rate(F.lit(1.000049)), *timing.fit_width(F.lit(1921), F.lit(1081), 0)) == (1.0, 1920, 1080)
    assert one(spark, timing.clamp_rate(F.lit(9.0)), timing.next_rate(F.lit(1.0)), timing.next_rate(F.lit(0.25), False)) == (4.0, 1.25, 0.25)
    none, false = F.lit(None).cast("double"), F.lit(False)
    assert one(spark, *timing.choose_timing(F.lit(25.0), false, false, none)) == (25.0, "manual_integer")
    assert one(spark, *timing.choose_timing(none, F.lit(True), false, none)) == (None, "payload_timestamp")
    assert one(spark, *timing.choose_timing(none, false, false, F.lit(24.0))) == (24.0, "session_json")
    assert one(spark, *timing.choose_timing(none, false, false, F.lit(-1.0))) == (30.0, "default_30")
    assert one(spark, *timing.fit_width(F.lit(1920), F.lit(1080), 641)) == (640, 360)


def test_filtered_tree_keeps_ancestors(spark):
    nodes = spark.createDataFrame([("a", None), ("a/b", "Codec h265"), ("a/c", "x"), ("d", "y")], "path string, value string")
    assert sorted(x.path for x in library.keep_with_ancestors(nodes, "H265").collect()) == ["a", "a/b"]
