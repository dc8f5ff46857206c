"""The segmented scan and the selected median: cut into blocks, they give what plain windows give, with one key that holds all rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from reelspan.operators import align, channels, islands, ordered, playlist, profile


@pytest.fixture
def blocks(spark):
    """Five blocks, however small the rows are."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_of(keys, n=500, seed=1):
    r = random.Random(seed)
    t, out = 0, []
    for i in range(n):
        t += r.choice([0, 1, 1, 2, 9, 40])
        out.append((r.choice(keys), t, i, r.choice([None, 1, 1, 2, 3]), r.random() < 0.2, r.random() < 0.02, r.randrange(4)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, t long, i long, v int, key boolean, late boolean, part int").repartition(5)


ONE, MANY = [7], [1, 1, 1, 1, 2, 3, None]


def same(a, b):
    names = sorted(a.columns)
    assert names == sorted(b.columns)
    got, want = (sorted(map(tuple, x.select(*names).collect()), key=str) for x in (a, b))
    assert got == want and (got or not a.columns)


@pytest.mark.parametrize("keys", [ONE, MANY])
def test_scan_equals_plain_lists(blocks, keys):
    rows = rows_of(keys)
    scan = ordered.Ordered(frame(blocks, rows), ["k"], ["t", "i"], 0)
    assert scan.df.select("__block").distinct().count() > 3
    scan.neighbour("v", "before", -1, "first").neighbour("v", "after", 1, "last")
    scan.running(total=("sum", F.col("v")), any=("any", F.col("late")), high=("max", F.col("v")), low=("min", F.col("v")), filled=("last", F.col("v")))
    got = {r.i: r for r in scan.running(before=True, ahead=("sum", F.lit(1)), was=("last", F.col("v"))).rows().collect()}
    assert len(got) == len(rows)
    for key in set(keys):
        own = sorted((x for x in rows if x[0] == key), key=lambda x: x[1:3])
        for n, (_, _, i, v, _, _, _) in enumerate(own):
            r, upto = got[i], [x[3] for x in own[: n + 1] if x[3] is not None]
            assert (r.before, r.first) == (own[n - 1][3] if n else None, n == 0) and (r.after, r.last) == (own[n + 1][3] if n + 1 < len(own) else None, n + 1 == len(own))
            assert (r.total, r.any, r.ahead) == (sum(upto), any(x[5] for x in own[: n + 1]), n)
            assert (r.high, r.low, r.filled) == ((max(upto), min(upto), upto[-1]) if upto else (None,) * 3)
            assert r.was == next((x[3] for x in reversed(own[:n]) if x[3] is not None), None)


def test_operators_over_blocks(blocks):
    df, by = frame(blocks, rows_of([7, 7, 7, 7, 7, None], 250, seed=2)).cache(), (["k"], ["t", "i"])
    for f in (
        lambda h: islands.runs(df, *by, "v", hot=h), lambda h: islands.run_starts(df, *by, "v", hot=h), lambda h: islands.fill_forward(df, *by, "v", hot=h),
        lambda h: islands.groups_of_pictures(df, *by, F.col("key"), hot=h), lambda h: islands.drop_leading(df, *by, F.col("key"), F.col("late"), hot=h),
        lambda h: islands.drop_leading(df, *by, F.col("late"), hot=h), lambda h: islands.drop_at_seams(df, ["k"], "part", ["t", "i"], F.col("key"), hot=h),
        lambda h: islands.sample_durations(df, *by, "t", 1000, hot=h), lambda h: islands.starts(df, *by, F.col("t"), hot=h), lambda h: islands.neighbours(df, *by, "i", hot=h),
        lambda h: islands.neighbours(df, *by, "i", wrap=False, hot=h), lambda h: islands.increasing(df, *by, "v", hot=h), lambda h: align.numbered(df, *by, hot=h),
        lambda h: align.as_of(df.where("not key").select("k", "t", "i"), df.where("key").select("k", "t", "i", "v"), ["k"], "t", "v", ["i"], hot=h),
        lambda h: align.locate(df.select("k", "i", (F.col("t") * 3 - 100).alias("p")), df.groupBy("k", "part").agg((F.max("part") * 1000).alias("s"), F.lit(1000).alias("d")), ["k"], "p", "s", "d", "part", hot=h),
    ):
        same(f(0), f(None))


def test_runs_and_groups_against_lists(blocks):
    rows = sorted(rows_of(ONE, seed=3), key=lambda x: x[1:3])
    df = frame(blocks, rows)
    want, gops, size = [], [], None
    for x in rows:
        if want and want[-1][0] == x[3]:
            want[-1][1] += 1
        else:
            want.append([x[3], 1])
        if x[4]:
            gops += [size] if size else []
            size = 1
        elif size:
            size += 1
    assert [[r.v, r.n] for r in islands.runs(df, ["k"], ["t", "i"], "v", hot=0).orderBy("run").collect()] == want
    assert [r.n for r in islands.groups_of_pictures(df, ["k"], ["t", "i"], F.col("key"), hot=0).orderBy("gop").collect()] == gops


@pytest.mark.parametrize("scale", [1, 1 << 44])
def test_selected_medians(blocks, scale):
    r = random.Random(scale)
    values = {1: [r.randrange(-(5**9), 5**9) * scale // 7 for _ in range(501)], 2: [3] * 400, None: [r.choice([1, 2, 70_000]) * scale for _ in range(400)], 4: [1, 2], 5: [None, None]}
    df = blocks.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k int, v long").repartition(7)
    want = {k: statistics.median(vs) for k, vs in values.items() if vs[0] is not None}
    for hot in (0, 100, None):
        assert {x.k: x.median for x in ordered.median(df, ["k"], "v", hot).collect()} == pytest.approx(want, rel=1e-15)
    one = ordered.median(df, [], "v", 0).collect()
    every = [v for vs in values.values() for v in vs if v is not None]
    assert len(one) == 1 and one[0].median == pytest.approx(statistics.median(every), rel=1e-15)


def test_median_period_of_a_hot_key(blocks):
    rows = rows_of(MANY, seed=5) + [(9, 5, 1000, None, False, False, 0), (8, 5, 1001, None, False, False, 0), (8, 5, 1002, None, False, False, 0)]
    df = frame(blocks, rows)
    want = {}
    for key in {x[0] for x in rows}:
        own = sorted(x[1] for x in rows if x[0] == key)
        want[key] = float(statistics.median([b - a for a, b in zip(own, own[1:]) if b > a] or [0]))
    for hot in (0, None):
        assert {x.k: x.period for x in profile.median_period(df, ["k"], ["t", "i"], "t", hot).collect()} == want
    assert profile.median_period(df.limit(0), ["k"], ["t", "i"], "t").count() == 0


def test_stream_stats_in_blocks(blocks):
    """One channel of 600 frames over five blocks, one whose sets never come, one of null flags; against a walk."""
    r = random.Random(5)
    rows = [("hot", i, *(r.random() < p for p in (0.2, 0.05, 0.05, 0.05))) for i in range(600)] + [("none", i, True, True, False, True) for i in range(9)] + [(None, i, None, True, True, None) for i in range(3)]
    df = blocks.createDataFrame(rows, "k string, t long, is_key boolean, has_vps boolean, has_sps boolean, has_pps boolean")
    expected = {}
    for k in ("hot", "none", None):
        seen, groups, dropped = [False] * 3, [], 0
        for _, _, key, *sets in [x for x in rows if x[0] == k]:
            seen = [a or bool(b) for a, b in zip(seen, sets)]
            if key and all(seen):
                groups.append(0)
            if groups:
                groups[-1] += 1
            else:
                dropped += 1
        closed = groups[:-1]
        expected[k] = (sum(groups), len(groups), dropped, min(closed, default=None), max(closed, default=None))
    for hot in (0, None):
        got = {x.k: tuple(x)[1:] for x in channels.stream_stats(df, ["k"], ["t"], hot).collect()}
        assert got == expected and got["hot"][1] > 50


def test_playlists_in_blocks(blocks):
    """A list of 300 entries over five blocks: inserted into, removed from, and what was played before."""
    items = [f"i{n}" for n in range(300)]
    df = blocks.createDataFrame([("l", n, x) for n, x in enumerate(items)], "k string, pos long, item string")
    new = blocks.createDataFrame([("l", f"n{n}", n * 7) for n in range(60)], "k string, item string, at long")
    gone = blocks.createDataFrame([("l", n * 3) for n in range(200)], "k string, pos long")
    order = lambda d: [x.item for x in d.orderBy("pos").collect()]
    places = sorted([(n, 1, x) for n, x in enumerate(items)] + [(n * 7, 0, f"n{n}") for n in range(60)])
    for hot in (0, None):
        put = playlist.insert(df, new, ["k"], hot=hot)
        assert order(put) == [x for _, _, x in places] and sorted(x.pos for x in put.collect()) == list(range(360))
        assert order(playlist.remove(df, gone, ["k"], hot)) == [x for n, x in enumerate(items) if n % 3]
        back = {x.pos: x.back for x in playlist.previous_played(df, ["k"], ["pos"], "item", hot).collect()}
        assert back == {n: items[n - 1] if n else None for n in range(300)}
