"""Operators 11 to 13 against brute force, on rows with nulls, ties, repeats and clashing column names."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspan.llm import centroids, lattice_dedup, periodic, queries

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def vectors(seed=1, groups=12, dims=64):
    """Groups of near copies around random vectors, some loose, some tight, two of them joined by a chain."""
    r, rows = np.random.default_rng(seed), []
    for g in range(groups):
        centre = r.standard_normal(dims)
        centre /= np.linalg.norm(centre)
        for _ in range([1, 2, 3, 40, 90][g % 5]):
            noise = r.standard_normal(dims) / math.sqrt(dims)
            rows.append((centre + noise * [0.1, 0.2, 0.3][g % 3]) * r.choice([1.0, 7.5, 1e-3]))
    chain = [r.standard_normal(dims)]
    for _ in range(15):
        chain.append(chain[-1] + 0.25 * r.standard_normal(dims))
    return [v.tolist() for v in rows + chain]


def odd_rows(x):
    return [
        (900, None, 1), (901, [0.0] * 64, 1), (902, [NAN] + [1.0] * 63, 1), (903, [INF] + [1.0] * 63, 1), (904, [None] + [1.0] * 63, 1), (905, [], 1), (906, x[0], None), (907, x[0], 7),
        (908, x[0], 1), (908, x[0], 1), (None, x[0], 1), (None, x[3], None), (909, x[0][:8], 1), (910, [1e200] * 64, 1), (911, [1e-200] * 64, 1), (912, [-1e200] * 64, 1),
    ]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, label int, x string, n int, c int, cell int").repartition(parts)


def brute_links(rows, cosine=0.93):
    def unit(v):
        if not v or any(y is None or not math.isfinite(y) for y in v) or not any(v):
            return None
        v = np.array(v) / max(map(abs, v))
        return v / np.linalg.norm(v)

    u = [unit(v) if label is not None else None for _, v, label in rows]
    near = [[j for j in range(len(rows)) if i != j and u[i] is not None and u[j] is not None and rows[i][2] == rows[j][2] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= cosine] for i in range(len(rows))]
    comp = [-1] * len(rows)
    for i in range(len(rows)):
        todo = [i] if comp[i] < 0 else []
        while todo:
            k = todo.pop()
            if comp[k] < 0:
                comp[k] = i
                todo += near[k]
    least = {}
    for i, k in enumerate(comp):
        least[k] = min([x for x in (least.get(k), rows[i][0]) if x is not None], default=None)
    return sorted(((rows[i][0], len(near[i]), least[comp[i]], rows[i][0] == least[comp[i]]) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("slot", [8, 64, 1024])
def test_links(spark, slot):
    x = vectors()
    rows = [(1000 - i, v, 1 + i % 2 * (i % 5 == 0)) for i, v in enumerate(x)] + odd_rows(x)
    got = lattice_dedup.links(frame(spark, rows), slot=slot)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_links(rows)
    assert lattice_dedup.links(frame(spark, rows).limit(0)).count() == 0


def test_lattice_points():
    steps = lattice_dedup.shortest()
    assert steps.shape == (240, 8) and np.allclose((steps**2).sum(1), 2) and len(np.unique(steps, axis=0)) == 240
    y = np.random.default_rng(2).standard_normal((500, 8)) * 3
    p = lattice_dedup.nearest(y)
    own = ((y - p) ** 2).sum(1)
    assert (own <= 1 + 1e-9).all()  # the covering radius
    assert all((((y - p - s) ** 2).sum(1) >= own - 1e-9).all() for s in steps)
    assert ((2 * p) % 2).std(1).max() == 0 and (p.sum(1) % 2 == 0).all()


def test_recall(spark):
    """Pairs at a cosine just above the threshold, alone in their components."""
    r, rows = np.random.default_rng(5), []
    for i in range(1500):
        a, b = r.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        c = r.uniform(0.931, 1)
        rows += [(2 * i, a.tolist(), 1), (2 * i + 1, (c * a + math.sqrt(1 - c * c) * b / np.linalg.norm(b)).tolist(), 1)]
    got = lattice_dedup.links(frame(spark, rows))
    assert got.where("n_links > 1").count() == 0
    assert got.where("n_links = 1").count() >= 0.98 * len(rows)


def brute_clusters(rows, clusters=8, rounds=10):
    kept = [(i, [math.floor(1024 * y) for y in v]) for i, v, _ in rows if v and len(v) == 64 and all(y is not None and math.isfinite(y) for y in v)]
    cs = [q for _, q in sorted(kept, key=lambda t: (hashlib.sha256(f"3:{'' if t[0] is None else t[0]}".encode()).hexdigest(), t[1]))[:clusters]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), k) for k, c in enumerate(cs))
    for _ in range(rounds):
        at = [near(q)[1] for _, q in kept]
        for k in range(len(cs)):
            own = [q for (_, q), a in zip(kept, at) if a == k]
            cs[k] = [sum(col) // len(own) for col in zip(*own)] if own else cs[k]
    found = [(i, *near(q)) for i, q in kept]
    most = (1 << 63) - 1
    found = [(i, min(d, most), k) for i, d, k in found]
    per = {k: min(most, sum(d for _, d, j in found if j == k)) for _, _, k in found}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i, k, d, per[k], min(most, sum(x for _, x, _ in found)), sha[k]) for i, d, k in found), key=str)


@pytest.mark.parametrize("large", [False, True])
def test_clusters(spark, large):
    x = vectors(3)
    rows = [(3 * i, v, 1) for i, v in enumerate(x)] + [r for r in odd_rows(x) if r[0] not in (910, 912)] + [(5000, x[0], 1), (5001, x[0], None)]
    if large:
        rows += [(6000, [3e9] * 64, 1), (6001, [-3e9] * 63 + [2e5], 1), (6002, [4e15] * 64, 1)]
    got = centroids.cluster(frame(spark, rows))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"]
    assert sorted((tuple(r) for r in got.drop("centroid").collect()), key=str) == brute_clusters(rows)
    assert all(hashlib.sha256(",".join(map(str, r.centroid)).encode()).hexdigest() == r.centroid_sha256 for r in got.limit(5).collect())


def test_few_clusters(spark):
    x = vectors(4)
    assert centroids.cluster(frame(spark, [(1, x[0], 1)]).limit(0)).count() == 0
    rows = [(1, x[0], 1), (2, x[0], 1), (3, [1e300] * 64, 1), (4, [-1e300] * 64, 1)]
    got = {r.vec_id: r for r in centroids.cluster(frame(spark, rows)).collect()}
    assert len(got) == 4 and got[3].distance == 0 and got[3].centroid == [1 << 62] * 64 and got[4].centroid == [-(1 << 62)] * 64
    assert got[1].cluster == got[2].cluster


def test_partial_distances():
    r = np.random.default_rng(6)
    q, c = r.integers(-3, 4, (2000, 64)), r.integers(-1, 2, (8, 64))
    c[5] = c[2]
    d = ((q[:, None] - c[None]) ** 2).sum(2)
    cluster, best = centroids.assign(q, c, r.permutation(64))
    assert (cluster == d.argmin(1)).all() and (best == d.min(1)).all()


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            k = i
            while k + q < len(w) and w[k] == w[k + q]:
                k += 1
            if k + q - i >= max(6, 4 * q):
                found.setdefault((i, k + q), q)
            i = max(k, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def word_lists():
    r = random.Random(8)
    lists = [[], [1], [1] * 5, [1] * 6, [1] * 7 + [2], [1, 2] * 4, [1, 2] * 4 + [1], [1, 2, 1, 2, 1, 2, 1], [1] * 1000, ([1] * 50 + [2]) * 6, [1, 1, 2] * 40 + [1, 2] * 30 + [2] * 9]
    for _ in range(300):
        w = []
        while len(w) < r.choice([5, 30, 120]):
            part = [r.randrange(r.choice([1, 2, 3, 50])) for _ in range(r.randrange(1, 9))]
            w += part * r.choice([1, 1, 2, 4, 5, 9])
        lists.append(w)
    return lists


def test_runs_of_words(monkeypatch):
    lists = word_lists()
    want = [brute_runs(w) for w in lists]
    assert sum(map(len, want)) > 300
    assert periodic.runs_of([np.array(w, np.int64) for w in lists]) == want
    monkeypatch.setattr(periodic, "SINGLE", 1)  # all by Z-functions
    monkeypatch.setattr(periodic, "CELLS", 7)
    assert periodic.runs_of([np.array(w, np.int64) for w in lists]) == want


def test_z_function():
    for w in itertools.product((0, 1), repeat=9):
        assert periodic.z_function(list(w), 8) == [next((k for k in range(9 - i) if w[k] != w[i + k]), 9 - i) for i in range(9)]


def test_long_runs():
    """One word, and long periods, in time that doesn't grow with the square."""
    assert periodic.runs_of([np.zeros(300_000, np.int64)]) == [[(0, 300_000, 1)]]
    w = np.tile(np.concatenate([np.zeros(20_000, np.int64), [1]]), 6)
    assert (0, 120_006, 20_001) in periodic.runs_of([w])[0]


def digests(i, w):
    """What op13 asks for, of the words w."""
    h = zlib.crc32(b"" if i is None else str(i).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = brute_runs(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (i, len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_periodic_query(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, r.choice([" ", "\n", "\t "]).join(f"w{x}" for x in w)) for i, w in enumerate(word_lists())]
    rows += [(9000, None), (9001, ""), (9002, " \n\x0b"), (9003, "wör d " * 4000), (None, "a b " * 9), (None, None), rows[-1], rows[-1], (9004, "\x85a\x1f \x85a\x1f " * 6)]
    docs = spark.createDataFrame([(*x, 1, "r") for x in rows], "doc_id long, text string, id int, runs string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    words = lambda t: [x.decode() for x in (t or "").encode().split()]
    assert sorted((tuple(x) for x in got.collect()), key=str) == sorted((digests(i, words(t)) for i, t in rows), key=str)
    spans = periodic.find_runs(docs).where("doc_id = 9003").first()
    assert spans.n_words == 4000 and [tuple(x) for x in spans.runs] == [(0, 4000, 1)] and spans.collapsed == "wör d"
    assert periodic.find_runs(docs.limit(0)).count() == 0


def test_periodic_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") < 20_000)
    want = sorted((digests(r.doc_id, [x.decode() for x in (r.text or "").encode().split()]) for r in docs.collect()), key=str)
    got = queries.op13_periodic_runs(spark, SF).join(docs.select("doc_id"), "doc_id")
    assert sorted((tuple(x) for x in got.collect()), key=str) == want
