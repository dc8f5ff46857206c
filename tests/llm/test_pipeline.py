"""The corpus pipeline, stage by stage, against plain versions."""

import base64
import hashlib
import re

from pyspark.sql import functions as F

import corpus_pipeline
from reelspan.llm import quality
from reelspan.llm.queries import VOCABULARY

from .test_jaccard_join import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import public_tokenizers
    import tiktoken

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = {x.doc_id: x.text for x in docs.collect()}
    names, stages = zip(*corpus_pipeline.STAGES)
    assert len(names) == 5

    good = stages[0](spark, docs, SF)
    predicted = {x.doc_id for x in quality.classify(docs, labels).where("predicted = 1").collect()}
    assert good.schema == docs.schema and {x.doc_id for x in good.collect()} == predicted
    of = {x.doc_id: x.quality for x in labels.collect()}
    clean = [i for i in of if of[i] == 1 and i in texts]
    assert sum(i in predicted for i in clean) >= 0.95 * len(clean)

    single = stages[1](spark, good, SF)
    groups = {}
    for i in predicted:
        key = re.sub(r"[\x20\x09-\x0D]", "", texts[i] or "")
        groups[key] = min(groups.get(key, (0, i)), (-len(texts[i] or ""), i))
    kept = {i for _, i in groups.values()}
    assert single.schema == docs.schema and {x.doc_id for x in single.collect()} == kept and single.count() == len(kept)

    apart = stages[2](spark, single, SF)
    least = {i for i, _, c in brute([(i, texts[i]) for i in sorted(kept)], 5, 80) if i == c}
    assert apart.schema == docs.schema and {x.doc_id for x in apart.collect()} == least and apart.count() == len(least)

    mix = stages[3](spark, apart, SF)
    copies = {x.doc_id: x["count"] for x in mix.groupBy("doc_id").count().collect()}
    assert mix.schema == docs.schema and copies.keys() <= least and max(copies.values()) <= 3
    size = lambda i: len(re.findall(r"[^\x20\x09-\x0D]+", texts[i] or ""))
    taken, all_words = sum(size(i) * n for i, n in copies.items()), sum(map(size, least))
    assert abs(taken - all_words) <= 4 * max(map(size, least))

    with open(public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines()) if a}
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = corpus_pipeline.run(spark, SF)
    want = []
    for i, n in copies.items():
        ids = library.encode_ordinary(texts[i] or "")
        want += [(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((texts[i] or "").encode()).hexdigest())] * n
    assert sorted(tuple(x) for x in out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == sorted(want)


def test_nulls_repeats_and_empty_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, None, None, "web", 1), (9002, "", "en", None, 0), (9003, "one two", "en", "web", 7), (9003, "one two", "en", "web", 7)], docs.schema)
    for docs_in in (odd, docs.limit(0)):
        now = docs_in
        for _, stage in corpus_pipeline.STAGES[1:4]:
            now = stage(spark, now, SF)
            assert now.columns == docs.columns and now.where(F.lit(True)).count() <= 3 * docs_in.count()


def test_stages_decide_by_row(spark):
    """Rows with one id, or none, are each kept, dropped or repeated for themselves."""
    of = spark.read.parquet(f"{SF}/documents.parquet").schema
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "web", k) for k, (i, t) in enumerate(rows)], of)
    texts = lambda df: sorted([(x.doc_id, x.text) for x in df.collect()], key=str)
    rows = [(1, "a b"), (1, "a b"), (2, "a  b c"), (2, "ab"), (None, "ab"), (None, "x y"), (None, "x y"), (None, "z"), (3, "z"), (4, None), (4, None)]
    got = texts(corpus_pipeline.distinct_texts(spark, frame(rows), SF))
    assert got == sorted([(1, "a b"), (2, "a  b c"), (None, "x y"), (None, "z"), (4, None)], key=str)
    rows = [(1, "a b"), (1, "a b"), (1, "A B"), (2, "a b"), (2, "c d"), (None, "x y"), (None, "x y"), (None, "c d"), (None, "v w"), (4, None), (4, "")]
    got = texts(corpus_pipeline.dissimilar_texts(spark, frame(rows), SF))
    assert [(i, (t or "").lower()) for i, t in got] == sorted([(1, "a b"), (2, "c d"), (None, "v w"), (None, "x y"), (4, ""), (4, "")], key=str)

    words = " ".join(f"w{k}" for k in range(20))
    mix = texts(corpus_pipeline.mixed(spark, frame([(7, words)] * 5 + [(None, words)] * 4), SF))
    assert mix == sorted([(7, words)] * 5 + [(None, words)] * 4, key=str)

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    told = docs.join(quality.classify(docs, labels).select("doc_id", "predicted"), "doc_id").select(*docs.columns, "predicted")
    good, bad = told.where("predicted = 1").first(), told.where("predicted = 0").first()
    twins = docs.where(F.col("doc_id") != bad.doc_id).union(spark.createDataFrame([(good.doc_id, bad.text, bad.lang, bad.source, bad[4])], docs.schema))
    scores = quality.classify(twins, labels).where("predicted = 1").count()
    assert corpus_pipeline.good_texts(spark, twins, SF).count() == scores
