import hashlib
import random
import re

import pytest

from reelspan.llm import window_dedup


def brute(rows, width):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    first = {}
    key = lambda i: window_dedup.LAST if i is None else i
    for (i, _), w in zip(rows, words):
        for p in range(len(w) - width + 1):
            g = tuple(w[p : p + width])
            first[g] = min(first.get(g, window_dedup.LAST), key(i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < key(i):
                gone.update(range(p, p + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("width,chunk,shard,cells", [(13, 1 << 20, 1 << 20, 1 << 16), (13, 2000, 5000, 1 << 4), (3, 3000, 3000, 1 << 12), (6, 900, 100, 1 << 8)])
def test_against_brute_force(spark, monkeypatch, width, chunk, shard, cells):
    monkeypatch.setattr(window_dedup, "SCAN", 64)
    r = random.Random(width)
    word = lambda: "".join(r.choice("aé") for _ in range(r.randint(1, 4))) + r.choice(["", "\x1f", "\xa0"])
    passages = [[word() for _ in range(r.randint(5, 60))] for _ in range(8)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(r.randint(0, 30))]
        for p in r.sample(passages, r.randint(0, 3)):
            w += p[r.randint(0, 9) :]
        rows.append((i * 7 % 60, "".join(x + r.choice([" ", "\n", "\t ", "\r\n"]) for x in w)))
    rows += [(500, rows[0][1]), (501, None), (502, ""), (503, "one"), (None, rows[1][1]), (None, rows[1][1]), (2, rows[2][1]), (2, rows[2][1])]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, chunk int")
    got = window_dedup.remove_windows(df, width=width, chunk_bytes=chunk, shard_bytes=shard, cells=cells).drop("kept").collect()
    want = brute(rows, width)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(x[2] for x in want) > 100


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert window_dedup.remove_windows(df).collect() == []
