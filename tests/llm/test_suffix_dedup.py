import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspan.llm import suffix_dedup


def brute(texts, least):
    seen = Counter(t[p : p + least] for t in texts for p in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - least + 1):
            if seen[t[p : p + least]] > 1:
                gone[p : p + least] = b"\1" * least
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(2, 9)))
    passage = [" ".join(word() for _ in range(r.randint(10, 120))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(r.randint(0, 60))) for _ in range(3)]
        for p in r.sample(passage, r.randint(0, 3)):
            cut = r.randint(0, 40)
            parts.insert(r.randint(0, len(parts)), p[cut:] if r.random() < 0.5 else p[: len(p) - cut])
        texts.append("".join(parts))
    near = texts[3][:50] + "x" + texts[3][50:]
    return [*texts, texts[0], texts[1], near, None, "", "a" * 900, "ab" * 700, "y" * 399]


@pytest.mark.parametrize("least,hot", [(400, 50_000), (100, 50_000), (100, 1)])
def test_against_brute_force(spark, least, hot):
    texts = corpus(least)
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_bytes string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, least=least, hot=hot).collect()}
    want = brute([(t or "").encode() for t in texts], least)
    assert [got[k] for k in range(len(texts))] == want
    assert sum(w[1] for w in want) > 1000


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SCAN", 700)
    texts = corpus(9, 12)
    data = [(t or "").encode() for t in texts]
    shape = suffix_dedup.Shape(100)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(data))), pa.array([0] * len(data), pa.int32()), pa.array(data)], ["id", "t", "text"])
    rows = [r for b in suffix_dedup._scan(shape)([batch]) for r in b.to_pylist()]
    starts = Counter((r["id"], p) for r in rows for p in range(r["lo"], r["hi"] + 1))
    assert starts == Counter((i, p) for i, t in enumerate(data) for p in range(len(t) - 99))


def test_refine():
    r = np.random.default_rng(1)
    text = r.integers(0, 3, 500)
    room = np.arange(500, 0, -1)
    for depth in (1, 2, 3, 7, 8):
        grams = Counter(tuple(text[p : p + depth]) for p in range(501 - depth))
        assert set(suffix_dedup.refine(text, room, depth)) == {p for p in range(501 - depth) if grams[tuple(text[p : p + depth])] > 1}


def test_repeated_rows_nulls_and_empty(spark):
    text = "".join(chr(97 + k % 26) for k in range(7, 500))
    text = "".join(random.Random(5).choice("abcdefgh") for _ in range(600))
    df = spark.createDataFrame([(None, text), (None, text), (1, None)], "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df).select("doc_id", "n_removed", "n_spans").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 0, 0), (None, 600, 1), (None, 600, 1)]
    assert suffix_dedup.remove_repeats(df.limit(0)).collect() == []


def test_rows_of_one_context_are_dealt_to_many_tasks(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    passage = "".join(random.Random(7).choice("abcdefgh ") for _ in range(1000))
    texts = [(k if k % 9 else None, passage + f"{k % 5}" * 3) for k in range(300)] + [(k, passage[:700] + f"{k}") for k in range(300, 310)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    try:
        for k, v in zip(kept, ("false", "-1")):
            spark.conf.set(k, v)
        got = suffix_dedup.remove_repeats(df)
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = [(k, 5, k % 7, 0, 9, 1, 2) for k in range(3000)] + [(None, 5, 1, 0, 9, 1, 2)] * 40 + [(k, 5, 3, 0, 9, 1, k) for k in range(3, 60)]
        rows = spark.createDataFrame(rows, "id long, t int, a int, lo int, hi int, key long, context long")
        contexts = rows.groupBy("key", "context").agg(F.count("*").alias("n"), F.min(F.struct("id", "t", "a", "lo", "hi")).alias("r"))
        each = [r["count"] for r in suffix_dedup._twice(rows, contexts).groupBy(F.spark_partition_id()).count().collect()]
        want = brute([t.encode() for _, t in texts], 400)
        assert sorted(tuple(r)[1:5] for r in got.collect()) == sorted(want)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert not re.search(r"hashpartitioning\(key#\d+L, context#\d+L, \d+\)", plan)
    assert sum(each) == 3040 and max(each) < 3040 / 2
