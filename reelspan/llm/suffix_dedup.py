"""Suffix-array dedup of repeated byte strings by bucket-pointer refinement.

A byte goes when a string of LEAST bytes that covers it also starts anywhere else. Suffixes are sorted where it matters only:

1. Anchors. The smallest hash of q-grams in the first WINDOW places after a start is the start's anchor. It depends on the
   string alone, so equal strings have their anchors at the same place, and the CORE bytes from there on are equal too.
   Starts that share an anchor make one row, keyed by a hash of the core: the initial bucket.
2. Buckets of one row are unique and end here. A bucket whose rows all have one context (all bytes of all their strings) needs no
   sorting: all its starts repeat. The same holds for rows of a mixed bucket whose context occurs twice.
3. Of a mixed bucket, one row for each context brings its bytes around the core, the core being a single symbol, and
   the bucket's suffixes are refined: first by q-grams, then by sorting on the bucket pointers of later offsets, which doubles
   the depth each time and reuses what earlier rounds found, until LEAST bytes are compared. Buckets still shared hold repeats.
   Spark deals out whole buckets to tasks; larger ones than HOT contexts aren't given to a task but counted by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

LEAST, GRAM, WINDOW = 400, 16, 192
#: Bytes that a task scans at a time, symbols that it sorts at a time, and contexts of a bucket that one task may sort.
SCAN, SORT, HOT = 1 << 20, 2 << 20, 50_000
#: Odd multipliers that mix well.
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _B
    return x ^ (x >> _U(29))


_TABLE = _mix(_mix((np.arange(256, dtype=np.uint64) + _U(1)) * _A))


class Shape:
    """Lengths that follow from the least length: window, core and depth in symbols."""

    def __init__(self, least: int = LEAST, window: int = WINDOW):
        self.least, self.window = least, min(window, (least - GRAM) // 2)
        self.core = least - self.window + 1
        if self.window < 1 or self.core < GRAM:
            raise ValueError(f"least must be {2 * GRAM + 2} or more")


def _anchors(shape: Shape, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """anchor, first start, last start, core hash and context hash of each run of starts, for pieces of data."""
    h = _TABLE[data]
    for k in (1, 2, 4, 8):
        h = h[:-k] * _A + h[k:]
        h ^= h >> _U(32)
    low = _U((1 << 24) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width < shape.window:
        k = min(width, shape.window - width)
        m = np.minimum(m[:-k], m[k:])
        width += k
    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends - shape.least + 1, -1)
    at = np.flatnonzero(np.cumsum(inside)[:-1])
    anchor = (m[at] & low).astype(np.int64)
    new = np.flatnonzero(np.diff(anchor)) + 1
    first, last = np.concatenate([[0], new]), np.concatenate([new - 1, [len(at) - 1]])
    a, lo, hi = anchor[first], at[first], at[last]

    def fold(start: np.ndarray, length: np.ndarray | int, seed: np.ndarray) -> np.ndarray:
        out, most = seed, int(np.max(length))
        for off in range(0, most - GRAM, GRAM):
            on = off < length - GRAM
            if np.ndim(length) and not on.all():
                out = out.copy()
                out[on] = _mix(out[on] * _A + h[start[on] + off])
            else:
                out = _mix(out * _A + h[start + off])
        return _mix(out * _A + h[start + length - GRAM])

    core = fold(a, shape.core, np.full(len(a), _A))
    context = fold(lo, hi - lo + shape.least, (a - lo).astype(np.uint64) << _U(32) | (hi - lo).astype(np.uint64))
    return a, lo, hi, core.view(np.int64), context.view(np.int64)


ANCHOR = "id long, t int, a int, lo int, hi int, key long, context long"


def _scan(shape: Shape):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            sizes = np.array([len(p[3]) for p in pieces])
            ends = np.cumsum(sizes)
            starts = ends - sizes
            data = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
            a, lo, hi, key, context = _anchors(shape, data, starts, ends)
            of = np.searchsorted(ends, lo, side="right")
            shift = np.array([p[2] for p in pieces])[of] - starts[of]
            ids = pa.array([p[0] for p in pieces], pa.int64()).take(pa.array(of))
            hashes = pa.array(np.array([p[1] for p in pieces], np.int32)[of])
            return pa.RecordBatch.from_arrays([ids, hashes, *(pa.array((x + shift).astype(np.int32)) for x in (a, lo, hi)), pa.array(key), pa.array(context)], ["id", "t", "a", "lo", "hi", "key", "context"])

        for b in batches:
            pieces, size = [], 0
            for i, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = text.as_py()
                for off in range(0, len(text) - shape.least + 1, SCAN):  # each start in one piece
                    pieces.append((i, t, off, text[off : off + SCAN + shape.least - 1]))
                    size += len(pieces[-1][3])
                    if size >= SCAN:
                        yield rows()
                        pieces, size = [], 0
            if pieces:
                yield rows()

    return task


def refine(symbols: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """Places whose next `depth` symbols also start at another place. room: symbols from a place to the end of its string."""
    sa, width = np.flatnonzero(room >= min(2, depth)), min(2, depth)
    key = symbols[sa] << 32 | symbols[sa + 1] if width == 2 else symbols[sa]
    pointer, slots = np.zeros(len(symbols), np.int64), np.arange(len(sa))
    while True:
        order = np.argsort(key, kind="stable")
        sa, key = sa[order], key[order]
        head = np.ones(len(sa), bool)
        head[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, len(sa)))
        pointer[sa] = np.repeat(slots[first], size)  # a bucket's pointer is its first slot
        shared = np.repeat(size > 1, size)
        sa, slots = sa[shared], slots[shared]
        if width >= depth or not len(sa):
            return sa
        step = min(width, depth - width)
        width += step
        fits = room[sa] >= width
        sa, slots = sa[fits], slots[fits]
        key = pointer[sa] << 32 | pointer[sa + step]


SPAN = "id long, t int, lo int, hi int"


def _spans(rows: list[tuple[int | None, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[1:])], ["id", "t", "lo", "hi"])


def _sort(shape: Shape):
    """Over rows sorted by key: starts of rows of a single context that repeat in their bucket."""

    def resolve(rows: list[tuple]) -> pa.RecordBatch:
        parts, core = [], 255
        for k, (key, *_, left, right) in enumerate(rows):
            core += not k or key != rows[k - 1][0]
            parts += [np.frombuffer(left, np.uint8).astype(np.int64), np.array([core + 1]), np.frombuffer(right, np.uint8).astype(np.int64)]
        sizes = np.array([len(r[-2]) + 1 + len(r[-1]) for r in rows])
        ends = np.cumsum(sizes)
        found = np.sort(refine(np.concatenate(parts), np.repeat(ends, sizes) - np.arange(ends[-1]), shape.window))
        of = np.searchsorted(ends, found, side="right")
        start = found - (ends - sizes)[of]
        cuts = np.flatnonzero((np.diff(of) != 0) | (np.diff(start) != 1)) + 1
        out = []
        for lo, hi in zip(np.concatenate([[0], cuts]).astype(int), np.concatenate([cuts, [len(found)]]).astype(int)):
            if hi > lo and rows[of[lo]][5] == 1:
                _, i, t, first, *_ = rows[of[lo]]
                out.append((i, t, first + int(start[lo]), first + int(start[hi - 1])))
        return _spans(out)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if size > SORT and row[0] != rows[-1][0]:
                    yield resolve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[-2]) + len(row[-1])
        if rows:
            yield resolve(rows)

    return task


def _digests(shape: Shape):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, i, t, lo, hi, n, left, right in zip(*(c.to_pylist() for c in b.columns)):
                for p in range(hi - lo + 1):  # len(left) is the first start's distance to the anchor
                    text = b"%d,%d,%s,%s" % (key, len(left) - p, left[p:], right[: shape.window - 1 - (len(left) - p)])
                    rows.append((hashlib.blake2b(text, digest_size=16).digest(), n, i, t, lo + p, lo + p))
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["digest", "n", "id", "t", "lo", "hi"])

    return task


def _around(shape: Shape):
    """Bytes around the core of each row that a document has to bring."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "id", "t", "lo", "hi", "n", "left", "right"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        for b in batches:
            rows = []
            for i, t, text, wanted in zip(*(b.column(k) for k in range(4))):
                i, t, text = i.as_py(), t.as_py(), text.as_py()
                for w in wanted.as_py():
                    a, lo, hi = w["a"], w["lo"], w["hi"]
                    rows.append((w["key"], i, t, lo, hi, w["n"], text[lo:a], text[a + shape.core : hi + shape.least]))
            for k in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*rows[k : k + 4096]), types)], names)

    return task


def _remove(least: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text, spans in zip(*b.columns):
                text, merged = text.as_py(), []
                for s in sorted((s["lo"], s["hi"] + least) for s in spans.as_py() or []):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                kept, at = [], 0
                for lo, hi in merged:
                    kept.append(text[at:lo])
                    at = hi
                kept = b"".join([*kept, text[at:]])
                rows.append((len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept, [{"lo": lo, "hi": hi} for lo, hi in merged]))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))]
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    return task


def _same(left: DataFrame, right: DataFrame, how: str, *names: str) -> DataFrame:
    """Join on equal names, nulls equal; the right side's are dropped."""
    right = right.select([F.col(c).alias(f"__{c}") if c in names else F.col(c) for c in right.columns])
    on: Column = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"__{n}"))
    return left.join(right, on, how).drop(*(f"__{n}" for n in names))


def _twice(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """Rows whose context occurs twice, as spans: all but the only row of each context found once.

    That row's place is known and goes into the join, so that the rows of one very common context don't meet in one task.
    """
    place = lambda i, a: F.xxhash64(i, a).alias("place")
    once = contexts.where("n = 1").select("key", "context", place("r.id", "r.a"))
    return rows.select("*", place("id", "a")).join(once, ["key", "context", "place"], "left_anti").select("id", "t", "lo", "hi")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, hot: int = HOT) -> DataFrame:
    """One row per row of df: id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes), spans (lo, hi exclusive).

    Strings are judged on the input and never cross rows; overlapping occurrences in one text count. Null texts count as
    empty; texts under `least` bytes lose nothing. Of repeated rows each loses all its strings. Null ids are allowed. Other columns are
    ignored; an empty table gives an empty result. Equality rests on 64-bit hashes of the core and of the whole context together.
    """
    shape = Shape(least)
    text = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.hash(F.col(text_col)).alias("t"), text.alias("text"))
    anchors = docs.where(F.octet_length("text") >= least).mapInArrow(_scan(shape), ANCHOR)
    keys = anchors.groupBy("key").agg(F.count("*").alias("n"), (F.min("context") != F.max("context")).alias("mixed")).where("n > 1").drop("n")
    # written before the join, whose sides then both come straight from a shuffle, so that adaptive execution splits hot keys
    shared = stash(anchors.join(stash(keys), "key"))
    contexts = shared.where("mixed").groupBy("key", "context").agg(F.count("*").alias("n"), F.min(F.struct("id", "t", "a", "lo", "hi")).alias("r"))
    contexts = stash(contexts)
    whole = shared.where("not mixed").select("id", "t", "lo", "hi").unionByName(_twice(shared.where("mixed"), contexts))
    wanted = contexts.select(F.col("r.id").alias("id"), F.col("r.t").alias("t"), F.struct("key", "r.a", "r.lo", "r.hi", "n").alias("w"))
    wanted = wanted.groupBy("id", "t").agg(F.collect_list("w").alias("wanted"))
    around = _same(docs, wanted, "inner", "id", "t").select("id", "t", "text", "wanted").mapInArrow(_around(shape), "key long, id long, t int, lo int, hi int, n long, left binary, right binary")
    large = contexts.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > hot).select("key")
    spans = [whole]
    if large.isEmpty():
        spans.append(around.repartition("key").sortWithinPartitions("key").mapInArrow(_sort(shape), SPAN))
    else:
        around = stash(around)
        rest = around.join(large, "key", "left_anti").select(around.columns)
        spans.append(rest.repartition("key").sortWithinPartitions("key").mapInArrow(_sort(shape), SPAN))
        starts = stash(around.join(large, "key", "left_semi").select(around.columns).mapInArrow(_digests(shape), "digest binary, n long, id long, t int, lo int, hi int"))
        again = starts.groupBy("digest").agg(F.count("*").alias("c")).where("c > 1").select("digest")
        spans.append(starts.where("n = 1").join(again, "digest", "left_semi").select("id", "t", "lo", "hi"))
    found = spans[0]
    for s in spans[1:]:
        found = found.unionByName(s)
    found = found.groupBy("id", "t").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    rows = _same(docs, found, "left", "id", "t").select("id", "text", "spans")
    return rows.mapInArrow(_remove(least), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<lo:int,hi:int>>").withColumnRenamed("id", id_col)
