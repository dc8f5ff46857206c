"""Operators 3 to 7, 9 and 10 against plain versions, on rows with nulls, ties, repeats and clashing column names."""

import base64
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from reelspan.llm import bpe, exact_dedup, mixing, quality, rules, url_filter, warc
from reelspan.llm.queries import VOCABULARY

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, id string, n int, h long, k string, size string, score string, copies string, label string, words string"
EXTRA = (None, 1, None, "k", "s", "0", "c", "l", "w")


def rows_of(seed=1, n=120):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "der", "Ünï", "a#b", "12", "le", "x", "\u3000", "of", "los", "e\u0301", "\x1f"])
    rows = []
    for i in range(n):
        w = [word() for _ in range(r.choice([0, 1, 4, 25, 60, 300]))]
        text = "".join(x + r.choice([" ", "\n", "\t", "  ", "\x0b", "\r\n"]) for x in w)
        rows.append((7 * i % 1009, text, r.choice(["en", "de", "fr", "es", "xx", None]), r.choice(["web", "web", "a", "ß", "z", None])))
    rows += [(2000, None, "en", "web"), (2001, "", None, None), (2002, " \n", "de", "a"), (2003, "word " * 30_000, "en", "long"), (2004, rows[4][1].replace(" ", "\t "), "en", "web")]
    rows += [rows[3], rows[3], (2005, rows[3][1], "fr", "b"), (None, rows[5][1], "en", "web"), (None, None, None, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, *EXTRA) for x in rows], SCHEMA).repartition(3)


def plain(df, *names):
    return sorted((tuple(x[c] for c in names) for x in df.collect()), key=str)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_exact_dedup(spark):
    rows = rows_of()
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), i is not None, i or 0))
    got = exact_dedup.exact_dedup(frame(spark, rows))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = []
    for i, text, *_ in rows:
        g = groups[t := re.sub(r"[\x20\x09-\x0D]", "", text or "")]
        best = min(g)
        want.append((i, best[2] if best[1] else None, len(g), hashlib.sha256(t.encode()).hexdigest()))
    assert plain(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(want, key=str)
    assert got.where("kept").count() == len(groups)
    assert all(x.doc_id == x.keep_id for x in got.where("kept").collect())
    kept = exact_dedup.drop_copies(frame(spark, [x for x in dict.fromkeys(rows) if x[0] is not None]))
    assert "words" in kept.columns and kept.count() == kept.select("doc_id").distinct().count()


def test_tilts_meet_their_targets_within_the_bound(spark):
    """Newton's solution against bisection over plain Python sums; source a needs the bound of three copies."""
    import math

    r = random.Random(8)
    sizes = {"a": [r.randrange(1, 400) for _ in range(80)], "b": [r.randrange(1, 3000) for _ in range(300)], None: [7] * 50}
    target = {"a": 2.6 * sum(sizes["a"]), "b": 0.3 * sum(sizes["b"]), None: 1.0 * 350}
    rate = lambda x, t: min(3.0, math.exp(min(2.0, t * x)))
    hist = spark.createDataFrame([(s, x, v.count(x)) for s, v in sizes.items() for x in sorted(set(v))], "source string, size long, n long")
    rows = spark.createDataFrame([(s, sum(v), float(target[s]), sum(v) / len(v)) for s, v in sizes.items()], "source string, source_size long, target double, mean double")
    for x in mixing.solve(hist, rows).collect():
        lo, hi = -50.0, 50.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if sum(v * rate(v, mid / x.mean) for v in sizes[x.source]) > target[x.source] else (mid, hi)
        assert x.done and x.tilt == pytest.approx(mid, abs=2e-3)
        assert sum(v * rate(v, x.tilt / x.mean) for v in sizes[x.source]) == pytest.approx(target[x.source], rel=3e-4)
    assert any(rate(v, 9) == 3.0 for v in sizes["a"])


def test_mix(spark):
    rows = rows_of(2, 400)
    got = mixing.mix(frame(spark, rows))
    assert plain(got, "doc_id", "size") == sorted([(i, len(words_of(t))) for i, t, *_ in rows], key=str)
    total = {}
    for _, t, _, s in rows:
        total[s] = total.get(s, 0) + len(words_of(t))
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, rest = {}, set(order), float(sum(total.values()))
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 3 * total[s]}
        target.update({s: 3.0 * total[s] for s in full} or share)
        free, rest = (free - full, rest - sum(3 * total[s] for s in full)) if full else (set(), 0)
    of = frame(spark, rows).select(F.col("doc_id").alias("d"), "source").distinct()
    for x in got.join(of, F.col("doc_id") == F.col("d")).collect():
        assert x.target == pytest.approx(target[x.source]) and x.source_size == total[x.source]
        assert 0 <= x.taken <= 3 * x.size and x.taken == x.copies * x.size
        assert x.copies in (math.floor(x.rate), math.ceil(x.rate))
    taken = {x.target: x.t for x in got.groupBy("target").agg(F.sum("taken").alias("t")).collect()}
    for s in order:
        words = taken[min(taken, key=lambda v: abs(v - target[s]))]
        assert abs(words - target[s]) <= max(0.02 * target[s], min(len(words_of(t)) for _, t, _, x in rows if x == s and words_of(t)))
    assert plain(got, "doc_id", "taken") == plain(mixing.mix(frame(spark, rows).repartition(7)), "doc_id", "taken")


def test_mix_of_a_table(spark):
    """Copies stay beside their rates, and words beside their targets."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    assert all(x.copies in (math.floor(x.rate), math.ceil(x.rate)) for x in rows)
    words = {}
    for x in rows:
        words[x.source] = words.get(x.source, 0) + x.taken
    off = {x.source: abs(words[x.source] - x.target) / x.target for x in rows}
    assert len(off) > 10 and max(off.values()) <= 0.02, off


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels)
    of = {x.doc_id: x.quality for x in labels.collect()}
    held = [(x.predicted, of[x.doc_id]) for x in got.collect() if x.held_out and x.doc_id in of]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) >= 0.9
    rows = frame(spark, rows_of())
    scores = quality.classify(rows, labels).collect()
    assert len(scores) == rows.count() and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in scores)
    assert all(x.held_out == (zlib.crc32(("" if x.doc_id is None else str(x.doc_id)).encode()) % 4 == 2) for x in scores)
    assert {x.score for x in quality.classify(rows, labels.limit(0)).collect()} == {0.5}


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert plain(quality.classify(docs, labels), "doc_id", "score") == plain(quality.classify(docs, turned), "doc_id", "score")


URLS = [
    "https://a.net/x?y", "http://EXAMPLE.net/en/a", "http://www.example.net/en", "http://example.com/de/", "http://x.example.com/de/a#b", "http://badexample.com/de/a", "http://a.org/fr/", "org://org/fr/?q",
    "http://net", "no scheme", "", None, "a://b://c.net/d", "http://casino-win.com/a/", "http://www.casino-win.com/a", "http://casino-win.com", "http://good.com/a", "http://good.com/a", "x://?q", "http://ÄB.com/\nz", "HTTP://Example.COM/DE/", "//no", "http://a.com#frag://b.net/",
]


def judged(url, listed):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    key = (host.removeprefix("www.") + path.rstrip("/")) if host else None
    return host, path, None, "block" if key in listed else "allow"


@pytest.mark.parametrize("blocks,largest", [(5, 1 << 20), (10_000, 0)])
def test_url_filter(spark, monkeypatch, blocks, largest):
    monkeypatch.setattr(url_filter, "KEYS_PER_BLOCK", blocks)  # so many keys in a block let false positives through
    monkeypatch.setattr(url_filter, "BROADCAST_BLOCKS", largest)
    urls = URLS + [f"http://h{i}.com/p{i % 7}" for i in range(300)]
    listed = ["casino-win.com/a", "casino-win.com", None, "casino-win.com", "a.net/x", *[f"h{i}.com/p{i % 7}" for i in range(0, 300, 3)]]
    pages = spark.createDataFrame([(i, u, "k", "h", 1, True) for i, u in enumerate(urls)], "page_id long, url string, key string, host string, block int, hit boolean")
    got = url_filter.filter_urls(pages, spark.createDataFrame([(x,) for x in listed], "key string"))
    assert plain(got, "page_id", "host", "path", "rule", "verdict") == sorted([(i, *judged(u, set(listed) - {None})) for i, u in enumerate(urls)], key=str)
    none = url_filter.filter_urls(pages, spark.createDataFrame([], "key string"))
    assert plain(none, "page_id", "verdict") == sorted([(i, judged(u, ())[3]) for i, u in enumerate(urls)], key=str)


def measured(text, lang):
    w = words_of(text)
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    count = {}
    for x in windows:
        count[x] = count.get(x, 0) + 1
    repeat = {j for k, x in enumerate(windows) if count[x] > 1 for j in range(k, k + 8)}
    lines = [x for x in text.split("\n") if words_of(x)]
    of = [sum(c in s for c in text) for s in ("abcdefghijklmnopqrstuvwxyz", " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", rules.DIGITS, rules.SYMBOLS, rules.MARKS)]
    common = [w.count(x) for x in rules.COMMON.get(lang, [])] or [0] * 8
    return len(w), sum(map(len, w)), of[4], len(lines) - len(set(lines)), len(repeat), [*of, len(text) - sum(of)], [*common, len(w) - sum(common)]


def distance(a, b):
    if not sum(a) or not sum(b):
        return 0.0
    p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
    return math.sqrt(max(0.0, sum((x * math.log2(2 * x / (x + y)) if x else 0) + (y * math.log2(2 * y / (x + y)) if y else 0) for x, y in zip(p, q)) / 2))


def test_quality_rules(spark):
    rows = rows_of(3, 200) + [(3000 + i, x, "en", "a") for i, x in enumerate(["ab " * 200, "#" * 700 + " x" * 25, " ".join(f"w{k}" for k in range(200)), " ".join(f"w{k}" for k in range(19))])]
    got = rules.judge(frame(spark, rows))
    stats = [measured(t or "", lang) for _, t, lang, _ in rows]
    sums = {}
    for s, (_, _, lang, _) in zip(stats, rows):
        a, b = sums.setdefault(lang, ([0] * 7, [0] * 9))
        a[:], b[:] = map(sum, zip(a, s[5])), map(sum, zip(b, s[6]))
    want = []
    for s, (i, t, lang, _) in zip(stats, rows):
        failed = s[0] < 20 or 100 * s[4] > 30 * s[0]
        far = len(t or "") >= 500 and distance(s[5], sums[lang][0]) > 0.3 or s[0] >= 100 and distance(s[6], sums[lang][1]) > 0.45
        want.append((i, *s[:5], failed, not failed and not far))
    assert plain(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == sorted(want, key=str)


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines()) if a}
    return path, public_tokenizers.PATTERN, tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, tokenizer):
    path, pattern, library = tokenizer
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    r = random.Random(5)
    odd = ["", None, "a" * 400, "ab" * 300, " " * 300, "\u4e2d\u6587" * 100, "🙂🙂\u200d", "<|endoftext|> x", "don't DON'T", "\n\n  \t x", "".join(chr(r.choice([r.randrange(32, 0xD800), r.randrange(0xE000, 0x11000)])) for _ in range(3000))]
    rows = docs + [(10_000 + i, t) for i, t in enumerate(odd)] + [(None, "null"), (None, "null")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, id string, ids string")
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert plain(bpe.round_trip(df, path, pattern), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    back = bpe.decode(bpe.encode(df, path, pattern), path)
    assert sorted((x.doc_id or 0, bytes(x.bytes)) for x in back.collect()) == sorted((i or 0, (t or "").encode()) for i, t in rows)


@pytest.mark.parametrize("least,size", [(0, 16 << 20), (20, 300), (0, 1000)])
def test_warc(spark, least, size):
    html = ["<p>a</p>", None, "", "<p>a</p>", "x" * 50, "x" * 50, "é" * 40, "\x1f\u008b\x08 gzip?\r\n\r\nWARC/1.1", "".join(map(chr, range(32, 900))), "<p>a</p>", "long " * 200_000]
    rows = [(20 - i, None if i == 3 else f"http://é.com/ %{i}\nx", h) for i, h in enumerate(html)] + [(None, "u", "x" * 50), (30, None, "x" * 50)]
    pages = spark.createDataFrame([(*x, "d", 1) for x in rows], "page_id long, url string, html string, digest string, first int").repartition(2)
    manifest = warc.write_warc(pages, warc.archive_folder(spark), least=least)
    got = warc.read_warc(manifest, size)
    first, want = {}, []
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= least:
            first[h or ""] = min(first.get(h or "", i), i)
    for i, url, h in rows:
        p = (h or "").encode()
        again = (h or "") in first and first[h or ""] != i
        want.append((i, url, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    assert plain(got, "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=str)
    texts = {(h or "").encode() for _, _, h in rows}
    assert all(bytes(x.payload) in texts for x in got.where("record_type = 'response'").collect())


@pytest.mark.parametrize("read,size", [(1, 100), (7, 333), (40, 10_000), (64, 1 << 20)])
def test_warc_members_across_reads(tmp_path, monkeypatch, read, size):
    """Members whose first bytes lie in two reads, or whose record crosses ranges, are each read once."""
    import pyarrow as pa

    payloads = [f"page {i} ".encode() * (i % 9) for i in range(60)]
    members = [warc.record(i, "u", p, None, False, warc.base32_sha1(p)) for i, p in enumerate(payloads)]
    file = tmp_path / "a.warc.gz"
    file.write_bytes(b"".join(members))
    monkeypatch.setattr(warc, "READ", read)
    starts = list(range(0, file.stat().st_size, size))
    ranges = pa.RecordBatch.from_pydict({"path": [f"file://{file}"] * len(starts), "start": starts, "end": [x + size for x in starts]})
    got = [(x["page_id"], x["payload"]) for b in warc._read(iter([ranges])) for x in b.to_pylist()]
    assert got == list(enumerate(payloads))


@pytest.mark.parametrize("run", [exact_dedup.exact_dedup, mixing.mix, rules.judge, lambda d: quality.classify(d, d.selectExpr("doc_id", "1 AS quality"))])
def test_empty_tables(spark, run):
    assert run(frame(spark, [])).collect() == []


def test_empty_pages(spark, tokenizer):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(warc.write_warc(pages, warc.archive_folder(spark))).collect() == []
    assert url_filter.filter_urls(pages, pages.selectExpr("url AS key")).collect() == []
    assert bpe.round_trip(frame(spark, []), *tokenizer[:2]).collect() == []


def test_copies_over_many_partitions(spark):
    """A group that lies in all partitions, ids repeated across their edges, and runs that end at them."""
    rows = [(i % 700, "a b" + " " * (i % 3), "en", "web") for i in range(1500)] + [(i, f"t{i // 2}", "en", "web") for i in range(3000, 3400)] + [(None, "ab", "en", "web"), (5, None, "en", "web")]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    groups = {}
    for x in got:
        groups.setdefault(x.text_sha256, []).append(x)
    assert len(got) == len(rows) and len(groups) == 202
    for sha, g in groups.items():
        assert {x.group_size for x in g} == {len(g)} and sum(x.kept for x in g) == 1 and len({x.keep_id for x in g}) == 1
        assert all(x.doc_id == x.keep_id for x in g if x.kept)
    large = groups[hashlib.sha256(b"ab").hexdigest()]
    assert len(large) == 1501 and large[0].keep_id == min(i for i, t, *_ in rows if t and len(t) == 5)
