import random
import re

import pytest
from pyspark.sql import functions as F

from reelspan.llm import jaccard_join


def sets_of(texts, words):
    fold = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").translate(fold).encode())
        out.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    return out


def brute(rows, words, percent):
    sets = sets_of([t for _, t in rows], words)
    up = list(range(len(rows)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) > 0:
                up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), least.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefé") for _ in range(r.randint(1, 5)))
    shared = [word() for _ in range(30)]
    base = [[word() for _ in range(r.randint(3, 90))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.3:
            at = r.randrange(len(w) + 1)
            w[at:at] = shared
        if r.random() < 0.2:
            w = w[: r.randint(1, len(w))]
        text = r.choice([" ", "\n", "  "]).join(w)
        rows.append((1000 - i, text.upper() if r.random() < 0.1 else text))
    return [*rows, (5000, None), (5001, ""), (5002, "One"), (5003, "oNE \n"), (5004, "one two"), (None, rows[0][1]), (3, rows[4][1]), (3, rows[4][1])]


@pytest.mark.parametrize("words,percent,hot,few", [(5, 80, 50_000, 4), (5, 80, 8, 0), (2, 60, 20, 0)])
def test_against_brute_force(spark, monkeypatch, words, percent, hot, few):
    monkeypatch.setattr(jaccard_join, "FEW", few)
    if few == 0:  # several chunks and shards, slots, no broadcast
        monkeypatch.setattr(jaccard_join, "BRING", 0)
        monkeypatch.setattr(jaccard_join, "GATHER", 20)
        monkeypatch.setattr(jaccard_join, "CHUNK", 4_000)
        monkeypatch.setattr(jaccard_join, "SHARD", 9_000)
    rows = corpus(words)
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, k string").repartition(3)
    got = sorted(map(tuple, jaccard_join.similar(df, words=words, percent=percent, hot=hot, members=3).collect()), key=str)
    assert got == sorted(brute(rows, words, percent), key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.similar(df).collect() == []


@pytest.mark.parametrize("cuts", [(), ((9, 0),), ((8, 0.25), (8, 0.5), (12, 0), (17, 0), (25, 0.5))])
def test_any_cuts_of_the_global_order(spark, monkeypatch, cuts):
    """Few rounds, so that most links are found when all pairs left are compared."""
    for name, value in (("CUTS", cuts), ("ROUNDS", 1), ("CHUNK", 3_000), ("SHARD", 5_000)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = corpus(11)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, jaccard_join.similar(df, hot=6).collect()), key=str)
    assert got == sorted(brute(rows, 5, 80), key=str)


def test_components(spark):
    r = random.Random(4)
    path = r.sample(range(60), 60)
    edges = [*zip(path, path[1:]), (98, 99), (97, 98), (96, 97), (95, 96)] + [(100, x) for x in range(101, 130)] + [tuple(r.sample(range(200, 260), 2)) for _ in range(45)]
    up = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = jaccard_join.components(spark.createDataFrame(edges, "a long, b long").repartition(3), 200).collect()
    assert sorted(map(tuple, got)) == sorted(up.items())
    assert jaccard_join.components(spark.createDataFrame([], "a long, b long"), 0).collect() == []


def test_meeting_rows_across_batches():
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(3)
    n = 400
    s, k = np.sort(r.integers(0, 120, n)), r.integers(0, 50, n)
    order = np.lexsort((k, s))
    cols = {"s": s[order], "slot": np.zeros(n, np.int32), "k": k[order], "n": np.full(n, 10, np.int32), "label": k[order], "slots": np.ones(n, np.int32)}
    want = {(a, b) for a, b in zip(cols["s"].tolist(), cols["k"].tolist()) if len(set(cols["k"][cols["s"] == a])) > 1}
    for step in (1, 2, 7, 400):
        batches = [pa.RecordBatch.from_pydict({f: pa.array(v[i : i + step]) for f, v in cols.items()}) for i in range(0, n, step)]
        rows = [x for b in jaccard_join._meet(80, True)(iter(batches)) for x in b.to_pylist()]
        kept = [(x["s"], x["k"]) for x in rows if x["y"] is None]
        assert len(kept) == len(set(kept)) and set(kept) == want
        assert {x["k"] for x in rows if x["y"] is not None} <= set(k.tolist())


def test_large_classes_in_different_slots(spark, monkeypatch):
    """Near copies that each have many exact copies over the chunks, so that all their shared shingles are dealt into slots."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 2_000)
    rows = []
    for g in range(3):
        for v in range(2):
            w = [f"w{g}x{k}" for k in range(90)]
            w[40] += "y" * v
            rows += [(1000 * g + 100 * v + i, " ".join(w)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, jaccard_join.similar(df, hot=2).collect()))
    assert got == sorted(brute(rows, 5, 80)) and len({c for _, _, c in got}) == 3


def test_repeated_long_rows(spark):
    """Repeated rows, by id or by null ids in several tasks, beside a text of similarity 0.7 count once in an intersection."""
    rows = []
    for g in range(2):
        w = [f"w{g}x{k}" for k in range(3_530)]
        a, b = " ".join(w[:3_000]), " ".join(w[530:])
        rows += [(i, t) for i, t in ((1 + 2 * g, a), (2 + 2 * g, b)) for _ in range(3)] + [(None, a), (None, b)] * 3 * g
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, jaccard_join.similar(df).collect()), key=str)
    assert got == sorted(brute(rows, 5, 80), key=str) and {c for _, _, c in got} == {1, 2, 3, 4}


def test_overlaps_count_a_repeated_segment_once():
    import numpy as np
    import pyarrow as pa

    seg = np.arange(10, dtype=np.uint64).tobytes()
    rows = [(1, 0, f, x, seg) for f in (0, 1) for x in (None, None, 5, 5, 5, 6)]
    table = pa.table([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["y", "slot", "f", "x", "segment"])
    for step in (1, 2, 3, 12):
        got = [tuple(r.values()) for b in jaccard_join._overlaps(iter(table.to_batches(step))) for r in b.to_pylist()]
        assert got == [(5, 1, 10), (6, 1, 10)] * 2


@pytest.mark.parametrize("leading", [1, 3, 1_000])
def test_pairs_leave_their_smallest_common_bucket(spark, monkeypatch, leading):
    """All pairs that sizes and bitmaps allow, whatever the number of carried buckets; each once where all are carried."""
    monkeypatch.setattr(jaccard_join, "LEADING", leading)
    df = spark.createDataFrame(corpus(6), "doc_id long, text string")
    j = jaccard_join.Join(df, "doc_id", "text", 5, 80, 6, 3)
    rows = j.prefixes.withColumn("label", F.col("k"))
    of, bits, want = {}, {x.k: (x.n, int.from_bytes(x.bits)) for x in j.classes.collect()}, set()
    for x in rows.collect():
        of.setdefault(x.s, set()).add(x.k)
    for ks in of.values():
        for a in ks:
            for b in ks:
                (na, ba), (nb, bb) = bits[a], bits[b]
                if a < b and 100 * min(na, nb) >= 80 * max(na, nb) and (ba ^ bb).bit_count() * 180 <= (na + nb) * 20:
                    want.add((a, b))
    got = [(x.x, x.y) for x in j.cross(rows).collect()]
    assert set(got) == want and want
    assert len(got) == len(want) or leading < 1_000


def test_each_labels_closest_pair_of_a_block():
    """Of all pairs of the blocks, the closest of each label; several batches, two labels of several classes."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(5)
    names = ["s", "lo", "hi", "k", "n", "label", "side", "two", "bits", "leading"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.int64())]
    base = r.integers(0, 256, 256, np.uint8)
    rows = []
    for s in (1, 2, 3):
        for k in r.permutation(40)[:25].tolist():
            own = base.copy()
            own[r.integers(0, 256, 8)] ^= np.uint8(k + 1)
            rows.append((s, 0, 0, k, 1_000, k // 3, 0, False, own.tobytes(), [s] * 2))
    table = pa.table([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)
    for step in (7, 100):
        both = [[tuple(x.values()) for b in jaccard_join._cross(80, closest)(iter(table.to_batches(step))) for x in b.to_pylist()] for closest in (False, True)]
        every, some = map(set, both)
        assert some < every and len(some) <= len({(s, label) for s, _, _, _, _, label, *_ in rows})
        near = {label: min(p[4] for p in every if label in p[2:4]) for label in {x for p in every for x in p[2:4]}}
        assert near == {label: min(p[4] for p in some if label in p[2:4]) for label in near}
