"""N-gram Jaccard join by vertical partitioning, and the components of its links.

Documents with equal sets of shingles form one class; classes are joined. The global order of shingles is by the number of
sets that hold them, then by hash. Documents are dealt into chunks of some megabytes; each chunk asks the shards of its shingles'
hashes for these counts. Shards tell shingles apart by 32 bits, which may raise a count, alike for all chunks.
CUTS divides this order into fragments, and each class's set into segments, one for each fragment; shingles of one set only meet
nothing and are left out. Two classes that are similar enough share a shingle among the first of both (a fifth of each
set), so candidates meet in the buckets of these; two bitmaps of the parity of hashed shingles bound a pair's difference from
below and drop what cannot be similar. Then each fragment's segments meet in tasks of their own that count the
partial overlap, and the counts are summed per pair.
Links are sought only between classes that aren't connected yet: first each class meets its neighbours in its buckets, in an
order that changes each round, and the links found are contracted at once; once few pairs of differently labelled classes are left,
each component's closest pair of each bucket is compared, and the links found are contracted again; then all pairs that are still apart
are, first the closest of any two components. So large
groups of near copies never turn into all their pairs, and no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stash, tagged, unstash
from .window_dedup import _joined, _mix, _parts, _runs, _shard, word_spans

WORDS, PERCENT = 5, 80
BITMAP = 2048
#: Where the global order is cut: a level (8 times the binary logarithm of a count, rounded up) and the share of its hashes before the cut.
CUTS = ((8, 0.5), (9, 0), (17, 0), (33, 0))
#: Bytes of text for each chunk and for each shard.
CHUNK, SHARD = 4 << 20, 12 << 20
#: Rows of a bucket's slot; rows (40 bytes each) that are broadcast to bring segments; members per pivot's slot.
HOT, BRING, MEMBERS = 50_000, 200_000, 2_000
#: Rows of a small table (pairs, labels) for each of its partitions.
GATHER = 200_000
#: Of each class's buckets, the smallest that its rows carry, to put a pair out in the first that both are in.
LEADING = 16
#: Neighbour rounds at most, and pairs to compare for each class after which no further round is made.
ROUNDS, FEW = 4, 100
_U, _A = np.uint64, np.uint64(0x9E3779B97F4A7C15)
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles; of the whole sequence for fewer words, none for none."""
    _, _, h = word_spans(text.translate(_FOLD))
    if not len(h):
        return h
    n = min(words, len(h))
    return np.unique(_joined(h, _parts(n), _U(n)))


def _keys(items: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Keys of sets of n shingles each that lie one after the other."""
    sums, ends = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(items ^ _A))]), np.cumsum(n)
    return _mix(sums[ends] - sums[ends - n] + n.astype(np.uint64) * _A).view(np.int64)


class Part:
    """Sets of a chunk's documents, one after the other, each set once; of: the set of each document."""

    def __init__(self, texts: list[bytes], words: int):
        sets, places, self.of = [], {}, np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            s = shingles(t, words)
            self.of[i] = places.setdefault(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), len(sets))
            if self.of[i] == len(sets):
                sets.append(s)
        self.n = np.array([len(s) for s in sets], np.int64)
        self.all = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(sets)), self.n)
        self.ends = np.cumsum(self.n)
        self.key = _keys(self.all, self.n)

    def bitmaps(self) -> np.ndarray:
        """Whether an odd number of a set's shingles falls on each bit. What two sets share cancels out, however large they are."""
        places = self.doc * BITMAP + (_mix(self.all) % _U(BITMAP)).astype(np.int64)
        odd = np.zeros(len(self.n) * BITMAP, bool)
        hit, count = np.unique(places, return_counts=True)
        odd[hit[count % 2 == 1]] = True
        return np.packbits(odd.reshape(-1, BITMAP), axis=1)

    def segments(self, level: np.ndarray, wanted: np.ndarray) -> list[list[bytes] | None]:
        """Each wanted set's shingles that other sets hold, too, by fragment of the global order; None for other sets."""
        cuts = np.array([(k << 56) + int(share * (1 << 56)) for k, share in CUTS], np.uint64)
        fragment = np.searchsorted(cuts, level.astype(np.uint64) << _U(56) | self.all >> _U(8), side="right")
        pick = np.flatnonzero((level > 0) & wanted[self.doc])
        pick = pick[np.lexsort((fragment[pick], self.doc[pick]))]  # stable: hashes stay in order
        many = len(CUTS) + 1
        ends = np.searchsorted(self.doc[pick] * many + fragment[pick], np.arange(len(self.n) * many + 1)).tolist()
        items = self.all[pick]
        return [[items[lo:hi].tobytes() for lo, hi in zip(ends[i * many : (i + 1) * many], ends[i * many + 1 :])] if ok else None for i, ok in enumerate(wanted)]

    def items(self, shards: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Distinct shingles in order, how many of the sets hold each, and the shards' runs."""
        values, counts = np.unique(self.all, return_counts=True)
        of = _shard(values, shards)
        return values, counts, [(int(of[lo]), lo, hi) for lo, hi in _runs(of)]


def _marks(values: np.ndarray) -> np.ndarray:
    """What a shard tells shingles apart by: 32 bits that its own number doesn't depend on."""
    return (_mix(values * _A) >> _U(32)).astype(np.uint32)


CHUNK_ROW = "chunk long, shard long, items binary, counts binary"
_CHUNK_ROW = pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), ("items", pa.binary()), ("counts", pa.binary())])
#: Rows of documents (id, t, k, n, row), of a chunk's classes (id: the least; k, n, chunk, bits, segments), and of shingles in prefixes (k, n, s, slots).
FIRST = "id long, t int, k long, n int, row string, chunk long, bits binary, segments array<binary>, s long, slots int"
_FIRST = pa.schema(
    [("id", pa.int64()), ("t", pa.int32()), ("k", pa.int64()), ("n", pa.int32()), ("row", pa.string()), ("chunk", pa.int64())]
    + [("bits", pa.binary()), ("segments", pa.list_(pa.binary())), ("s", pa.int64()), ("slots", pa.int32())]
)


def _first(rows: int, **columns: pa.Array) -> pa.Table:
    return pa.Table.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _FIRST], schema=_FIRST)


def _counting(words: int, shards: int):
    """A chunk's shingles to the shards that count them."""

    def group(table: pa.Table) -> pa.Table:
        values, counts, runs = Part([t.as_py() for t in table.column("text")], words).items(shards)
        marks, counts, chunk = _marks(values), np.minimum(counts, 255).astype(np.uint8), table.column("chunk")[0].as_py()
        rows = [(chunk, of, marks[lo:hi].tobytes(), counts[lo:hi].tobytes()) for of, lo, hi in runs]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 4, _CHUNK_ROW.types)], schema=_CHUNK_ROW)

    return group


def _counted(table: pa.Table) -> pa.Table:
    """A shard's reply to each chunk: eight times the binary logarithm of each shingle's count, 0 for a single one."""
    items = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("items")]
    counts = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("counts")])
    _, at = np.unique(np.concatenate(items), return_inverse=True)
    level = np.minimum(np.ceil(8 * np.log2(np.bincount(at, counts))), 255).astype(np.uint8)[at]
    ends = np.cumsum([len(x) for x in items])
    replies = pa.array([level[e - len(x) : e].tobytes() for x, e in zip(items, ends)], pa.binary())
    return pa.Table.from_arrays([table.column("chunk"), table.column("shard"), replies, pa.nulls(len(items), pa.binary())], schema=_CHUNK_ROW)


def _prefixes(words: int, percent: int, shards: int, hot: int):
    """A row for each document, one for each class, and one for each shingle among the first of a set that other sets hold, too."""

    def group(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _FIRST.empty_table()
        p = Part([t.as_py() for t in table.column("text")], words)
        told = dict(zip(replies.column("shard").to_pylist(), replies.column("items")))
        values, _, runs = p.items(shards)
        levels = np.concatenate([np.frombuffer(told[of].as_py(), np.uint8) for of, _, _ in runs]) if runs else np.zeros(0, np.uint8)
        level = levels[np.searchsorted(values, p.all)]
        order = np.lexsort((p.all, level, p.doc))
        place = np.arange(len(order)) - np.repeat(p.ends - p.n, p.n)
        few = p.n - (percent * p.n + 99) // 100 + 1
        pick = order[place < np.repeat(few, p.n)]
        pick = pick[level[pick] > 0]
        slots = (1 + 2 ** (level[pick] / 8) // hot).astype(np.int32)
        n, ids = p.n.astype(np.int32), table.column("id").to_pylist()
        least = [None] * len(n)
        for i, of in zip(ids, p.of.tolist()):
            if i is not None and (least[of] is None or i < least[of]):
                least[of] = i
        some = np.flatnonzero(p.n > 0)
        met = np.zeros(len(n), bool)
        met[p.doc[pick]] = True
        bits, segments, chunk = p.bitmaps(), p.segments(level, met), table.column("chunk")[0].as_py()
        docs = _first(table.num_rows, id=table.column("id"), t=table.column("t"), k=pa.array(p.key[p.of]), n=pa.array(n[p.of]), row=table.column("row"))
        found = _first(len(pick), k=pa.array(p.key[p.doc[pick]]), n=pa.array(n[p.doc[pick]]), s=pa.array(p.all[pick].view(np.int64)), slots=pa.array(slots))
        of = {"id": pa.array([least[i] for i in some], pa.int64()), "k": pa.array(p.key[some]), "n": pa.array(n[some]), "chunk": pa.array([chunk] * len(some), pa.int64())}
        classes = _first(len(some), **of, bits=pa.array([bits[i].tobytes() for i in some], pa.binary()), segments=pa.array([segments[i] for i in some], pa.list_(pa.binary())))
        return pa.concat_tables([docs, classes, found])

    return group


def _near(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b).astype(np.int64) >= percent * np.maximum(a, b).astype(np.int64)


def _meet(percent: int, keep: bool):
    """Over rows (s, slot, k, n, label, slots) sorted by bucket: pairs of a row with the one before and the bucket's first, where
    labels differ and sizes allow. keep: also rows of buckets with two classes, with s set and y null; where s is dealt into slots,
    those of all buckets, as other slots may hold a further class: open() then decides by s."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["s", "k", "n", "slots", "y"]
        carry = None  # the row before, the bucket's first row, and whether the row before is put out
        for b in batches:
            if not b.num_rows:
                continue
            c = {f: b.column(f).to_numpy() for f in ("s", "slot", "k", "n", "label", "slots")}
            if carry:
                c = {f: np.concatenate([[carry[0][f], carry[1][f]], v]) for f, v in c.items()}  # first, before
            m = len(c["s"])
            same = np.zeros(m, bool)
            same[1:] = (c["s"][1:] == c["s"][:-1]) & (c["slot"][1:] == c["slot"][:-1])
            first = np.maximum.accumulate(np.where(same, 0, np.arange(m)))
            rows = np.arange(2 if carry else 0, m)
            rows = rows[same[rows]]
            out = []
            for other in (rows - 1, first[rows]):
                ok = (c["label"][rows] != c["label"][other]) & _near(c["n"][rows], c["n"][other], percent)
                out.append(np.stack([c["k"][rows[ok]], c["k"][other[ok]]], 1))
            pairs = np.unique(np.sort(np.concatenate(out), 1), axis=0)
            null = lambda t, n: pa.nulls(n, t)
            n = len(pairs)
            yield pa.RecordBatch.from_arrays([null(pa.int64(), n), pa.array(pairs[:, 0]), null(pa.int32(), n), null(pa.int32(), n), pa.array(pairs[:, 1])], names)
            if keep:
                new = same & (c["k"] != c["k"][np.arange(m) - 1])  # a further class of the bucket
                firsts = np.flatnonzero(~same)
                bucket = np.cumsum(~same) - 1
                shared = (np.bincount(bucket[new], minlength=len(firsts)) > 0) | (c["slots"][firsts] > 1)
                done = bool(carry) and carry[2]  # the carried bucket was found shared before, and its first row was put out
                fresh = new.copy()
                if carry:
                    fresh[:2] = False
                starts = firsts[shared]
                if done and len(starts) and starts[0] == 0:
                    starts = starts[1:]
                pick = np.sort(np.concatenate([starts, np.flatnonzero(fresh)]))
                yield pa.RecordBatch.from_arrays([pa.array(c["s"][pick]), pa.array(c["k"][pick]), pa.array(c["n"][pick]), pa.array(c["slots"][pick]), null(pa.int64(), len(pick))], names)
                last_first = first[m - 1]
                out_already = bool(shared[bucket[m - 1]]) or (done and last_first == 0)
            else:
                last_first, out_already = first[m - 1], False
            row = lambda i: {f: v[i] for f, v in c.items()}
            carry = (row(last_first), row(m - 1), out_already)

    return task


def _cross(percent: int, closest: bool):
    """Over rows sorted by block: the pairs of a block with different labels whose sizes and bitmaps allow a link; closest: of each label's
    pairs only the closest, so at most one for each label. A pair that meets in several buckets is put out in the smallest alone, if that is
    among the leading ones of both classes, and else in some of them."""

    def pairs(c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        _, at = np.unique(c["k"], return_index=True)
        at = at[np.argsort(c["n"][at], kind="stable")]
        k, n, label, side, leading = (c[f][at] for f in ("k", "n", "label", "side", "leading"))
        s = c["s"][0]
        bits = np.frombuffer(b"".join(c["bits"][at]), np.uint64).reshape(len(at), -1)

        def rows(i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> np.ndarray:
            x, y = np.where(label[j] < label[i], j, i), np.where(label[j] < label[i], i, j)  # the smaller label first
            return np.stack([k[x], k[y], label[x], label[y], apart])

        upto = np.searchsorted(n, n.astype(np.int64) * 100 // percent, side="right")
        held, size, names = [], 0, ["x", "y", "lx", "ly", "apart"]
        two, m = c["two"][0], len(k)
        names_of, of = np.unique(label, return_inverse=True)
        best = np.full(len(names_of), np.iinfo(np.int64).max)  # each label's closest pair: bits apart, then places of both in the block
        for i in range(m):
            j = np.arange(i + 1, upto[i])
            j = j[(label[j] != label[i]) & (not two or side[j] != side[i])]
            if len(j):
                apart = np.bitwise_count(bits[j] ^ bits[i]).sum(1).astype(np.int64)
                ok = apart * (100 + percent) <= (n[j].astype(np.int64) + n[i]) * (100 - percent)
                j, apart = j[ok], apart[ok]
            before = leading[i][leading[i] < s]
            if len(j) and len(before):
                ok = ~np.isin(leading[j], before).any(1)
                j, apart = j[ok], apart[ok]
            if len(j) and closest:
                code = (apart * m + i) * m + j
                np.minimum.at(best, of[j], code)
                best[of[i]] = min(best[of[i]], code.min())
            elif len(j):
                held.append(rows(np.full(len(j), i), j, apart))
                size += len(j)
            if size > 100_000:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, np.concatenate(held, 1))), names)
                held, size = [], 0
        code = np.unique(best[best < np.iinfo(np.int64).max])
        if len(code):
            held.append(rows(code // m % m, code % m, code // (m * m)))
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, np.concatenate(held, 1))), names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names = None, ("s", "lo", "hi", "k", "n", "label", "side", "two", "bits")
        for b in batches:
            if not b.num_rows:
                continue
            c = {f: b.column(f).to_numpy(zero_copy_only=False) for f in names}
            c["leading"] = b.column("leading").flatten().to_numpy().reshape(b.num_rows, -1)
            if held is not None:
                c = {f: np.concatenate([held[f], v]) for f, v in c.items()}
            new = np.flatnonzero((np.diff(c["s"]) != 0) | (np.diff(c["lo"]) != 0) | (np.diff(c["hi"]) != 0)) + 1
            cuts = [0, *new.tolist()]
            for lo, hi in zip(cuts, cuts[1:]):
                yield from pairs({f: v[lo:hi] for f, v in c.items()})
            held = {f: v[cuts[-1] :] for f, v in c.items()}
        if held is not None and len(held["s"]):
            yield from pairs(held)

    return task


def _possible(percent: int):
    """Pairs whose bitmaps allow a link: the difference is at least the bits that differ, and at most a share of both sizes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bits = [np.frombuffer(b"".join(b.column(f).to_pylist()), np.uint64).reshape(b.num_rows, -1) for f in ("bx", "by")]
                apart = np.bitwise_count(bits[0] ^ bits[1]).sum(1).astype(np.int64)
                n = b.column("nx").to_numpy().astype(np.int64) + b.column("ny").to_numpy()
                ok = apart * (100 + percent) <= n * (100 - percent)
                yield pa.RecordBatch.from_arrays([b.column(f) for f in ("x", "y", "nx", "ny")], ["x", "y", "nx", "ny"]).filter(pa.array(ok))

    return task


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over segments sorted by pivot, slot and fragment, the pivot's first, then by member: partial overlaps of its members, each
    once. A pivot without shingles in a fragment has no segment there."""
    pivot, segment, member = None, None, None
    for b in batches:
        out = []
        for y, slot, f, x, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4)):
            if x is None:
                pivot, segment, member = (y, slot, f), np.frombuffer(own.as_py(), np.uint64), None
            elif pivot == (y, slot, f) and x != member:
                member = x
                out.append((x, y, len(np.intersect1d(np.frombuffer(own.as_py(), np.uint64), segment, assume_unique=True))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out)], ["x", "y", "o"])


def gathered(df: DataFrame, rows: int | None = None, light: bool = False) -> DataFrame:
    """df, of at most about `rows` rows (None: counted), written in no more partitions than these need; a table of one partition needs no
    shuffle later. light: df is computed in few partitions already, or by next to no work."""
    if rows is None:
        table = stash(df)
        parts = table.count() // GATHER + 1
    else:
        parts = rows // GATHER + 1
        table = stash(df.coalesce(parts) if light else df.repartition(parts))
    found = table.coalesce(1) if parts == 1 else table
    found._stashed = table._stashed
    return found


def components(edges: DataFrame, rows: int) -> DataFrame:
    """k, label: the smallest key reachable over at most `rows` edges (a, b). Each end goes to its smallest neighbour and jumps on to where
    that one went; then the edges are contracted, so that each turn has fewer of them. Keys are hashes, so paths to smaller ones are short."""
    pairs = lambda df: gathered(df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), rows, True)
    edges, labels = pairs(edges), None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("k"), F.col("b").alias("up")).union(edges.select("b", "a"))
        up = gathered(both.groupBy("k").agg(F.least(F.min("up"), F.col("k")).alias("up")), 2 * rows, True)
        for _ in range(3):
            up = up.join(up.select(F.col("k").alias("via"), F.col("up").alias("far")), F.col("up") == F.col("via")).select("k", F.col("far").alias("up"))
        up = gathered(up, 2 * rows, True)
        labels = up.withColumnRenamed("up", "label") if labels is None else relabelled(labels, up, 2 * rows)
        was = edges
        for end in ("a", "b"):
            edges = edges.join(up.withColumnRenamed("up", "to"), F.col(end) == F.col("k")).withColumn(end, F.col("to")).select("a", "b")
        edges = pairs(edges)
        unstash(was)
    return labels if labels is not None else edges.select(F.col("a").alias("k"), F.col("b").alias("label"))


def relabelled(labels: DataFrame, up: DataFrame, rows: int) -> DataFrame:
    """Labels (k, label) after labels k of up have gone to up."""
    up = up.select(F.col("k").alias("was"), "up")
    return gathered(labels.join(up, F.col("label") == F.col("was"), "left").select("k", F.coalesce("up", "label").alias("label")), rows, True)


class Join:
    """State of a join: the documents, their classes, and the links found."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, words: int, percent: int, hot: int, members: int, row_col: str | None = None):
        self.words, self.percent, self.hot, self.members = words, percent, hot, members
        text = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
        self.docs = df.select(F.col(id_col).cast("long").alias("id"), F.hash(F.col(text_col)).alias("t"), text.alias("text"), (F.col(row_col) if row_col else F.lit(None)).cast("string").alias("row"))
        total = self.docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        chunks, shards = int(total // CHUNK + 1), int(total // SHARD + 1)
        by_chunk = self.docs.withColumn("chunk", F.pmod(F.xxhash64("id", "t"), F.lit(chunks)).cast("long")).groupBy("chunk")
        counted = by_chunk.applyInArrow(_counting(words, shards), CHUNK_ROW).groupBy("shard").applyInArrow(_counted, CHUNK_ROW)
        first = stash(by_chunk.cogroup(counted.groupBy("chunk")).applyInArrow(_prefixes(words, percent, shards, hot), FIRST))
        self.rows = first.where("s is null and chunk is null").select("id", "t", "k", "n", "row")
        parts = first.where("chunk is not null")
        self.classes = stash(parts.groupBy("k").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("chunk").alias("home")))
        self.sets = parts.where("segments is not null").select("k", "chunk", "segments")
        self.prefixes = first.where("s is not null").select("s", "k", "n", "slots")
        self.many = self.classes.count()
        self.labels = gathered(df.sparkSession.createDataFrame([], "k long, label long"), 0, True)

    def meet(self, rows: DataFrame, turn: int, keep: bool) -> DataFrame:
        order = F.xxhash64("k", F.lit(turn))
        rows = rows.select("s", F.pmod(order, F.col("slots")).cast("int").alias("slot"), "k", "n", "label", "slots", order.alias("o"))
        rows = rows.repartition("s", "slot").sortWithinPartitions("s", "slot", "o", "k").drop("o")
        return rows.mapInArrow(_meet(self.percent, keep), "s long, k long, n int, slots int, y long")

    def best(self, pairs: DataFrame) -> DataFrame:
        """Of each class's pairs (k, y) the one that meets most often, by either side, as (x, y): y was chosen by x."""
        pairs = gathered(pairs.select(F.col("k").alias("x"), "y").groupBy("x", "y").agg(F.count("*").alias("c")))
        ends = pairs.select("x", "y", "c").union(pairs.select("y", "x", "c"))
        ends = ends.groupBy("x").agg(F.max(F.struct("c", F.xxhash64(F.least("x", "y"), F.greatest("x", "y")).alias("h"), "y")).alias("b"))
        chosen = ends.select(F.least("x", "b.y").alias("a"), F.greatest("x", "b.y").alias("z"), F.struct("x", "b.y").alias("p"))
        return chosen.groupBy("a", "z").agg(F.min("p").alias("p")).select("p.x", "p.y")

    def verified(self, pairs: DataFrame, rows: int) -> DataFrame:
        """Links (x, y) among at most `rows` distinct pairs (x, y). Of many pairs with one class it should be y, the pivot: its segments go to each of its
        slots once, and the members' to theirs."""
        percent = self.percent
        side = lambda v: self.classes.select(F.col("k").alias(v), F.col("n").alias(f"n{v}"), F.col("bits").alias(f"b{v}"))
        pairs = pairs.join(side("x"), "x").join(side("y"), "y").mapInArrow(_possible(percent), "x long, y long, nx int, ny int")
        pairs = gathered(pairs, rows)
        pivots = pairs.groupBy("y").agg(F.ceil(F.count("*") / self.members).cast("int").alias("slots"))
        members = pairs.join(pivots, "y").select(F.col("x").alias("k"), "y", F.pmod(F.xxhash64("x"), "slots").cast("int").alias("slot"), "x")
        own = pivots.select(F.col("y").alias("k"), "y", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.lit(None).cast("long").alias("x"))
        need = gathered(members.union(own).join(self.classes.select("k", "home"), "k"), 2 * rows)
        if need.count() <= BRING:
            need = F.broadcast(need)
        sets = self.sets.join(need.withColumnRenamed("k", "key"), (F.col("k") == F.col("key")) & (F.col("chunk") == F.col("home")))
        segments = sets.select("y", "slot", "x", F.posexplode("segments").alias("f", "segment")).where(F.octet_length("segment") > 0).select("y", "slot", "f", "x", "segment")
        segments = segments.repartition("y", "slot", "f").sortWithinPartitions("y", "slot", "f", F.asc_nulls_first("x"))
        overlap = segments.mapInArrow(_overlaps, "x long, y long, o long").groupBy("x", "y").agg(F.sum("o").alias("o"))
        linked = overlap.join(pairs, ["x", "y"]).where((100 + percent) * F.col("o") >= percent * (F.col("nx") + F.col("ny")))
        return linked.select("x", "y")

    def join(self, pairs: DataFrame, rows: int) -> None:
        """Joins the components of the linked ones of at most `rows` distinct pairs (x, y)."""
        edges = gathered(self.verified(pairs, rows).select(F.col("x").alias("a"), F.col("y").alias("b")), rows)
        for end in ("a", "b"):
            edges = edges.join(self.labels, F.col(end) == F.col("k"), "left").withColumn(end, F.coalesce("label", end)).select("a", "b")
        up = components(edges, rows).withColumnRenamed("label", "up")
        fresh = up.join(self.labels.select(F.col("k").alias("known")), F.col("k") == F.col("known"), "left_anti").select("k", F.col("up").alias("label"))
        was = self.labels
        self.labels = gathered(relabelled(was, up, self.many).union(fresh), self.many, True)
        unstash(was)

    def label(self, rows: DataFrame, key: str, label: str) -> DataFrame:
        """rows with the label of their class."""
        labels = self.labels.select(F.col("k").alias("l"), F.col("label").alias("found"))
        return rows.drop(label).join(labels, F.col(key) == F.col("l"), "left").withColumn(label, F.coalesce("found", key)).drop("l", "found")

    def open(self, rows: DataFrame) -> DataFrame:
        """Rows of buckets that still hold two labels; of buckets with the same classes, which shared passages make, one is enough."""
        was, rows = rows, stash(self.label(rows, "k", "label"))
        unstash(was)
        held = [F.bit_xor(F.xxhash64("k", F.lit(seed))).alias(f"h{seed}") for seed in (1, 2)]
        several = rows.groupBy("s").agg(F.min("label").alias("a"), F.max("label").alias("z"), F.count("*").alias("c"), *held).where("a <> z")
        several = several.groupBy("c", "h1", "h2").agg(F.min("s").alias("s")).select("s")
        left = stash(rows.join(several, "s", "left_semi"))
        unstash(rows)
        return left

    def cross(self, rows: DataFrame, closest: bool = False) -> DataFrame:
        """Pairs of a bucket with different labels that may link, or each label's closest of them, and how many bits they are apart; the rows of a
        bucket are dealt into slots of at most about `hot`, which meet two by two."""
        slots = rows.groupBy("s").agg(F.ceil(F.count("*") / self.hot).cast("int").alias("slots"))
        rows = rows.drop("slots").join(slots, "s")
        own = F.pmod(F.xxhash64("k"), F.col("slots")).cast("int")
        rows = rows.withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
        rows = rows.select("s", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "k", "n", "label", "side", (F.col("side") != F.col("other")).alias("two"))
        smallest = F.slice(F.concat(F.array_sort(F.collect_set("s")), F.array_repeat(F.lit((1 << 63) - 1), LEADING)), 1, LEADING)
        leading = rows.groupBy("k").agg(smallest.alias("leading"))
        rows = rows.join(self.classes.select("k", "bits"), "k").join(leading, "k").select(*rows.columns, "bits", "leading")
        # a block of two slots also gets, from either, the rows that meet the other slot's
        rows = rows.repartition("s", "lo", "hi").sortWithinPartitions("s", "lo", "hi")
        return rows.mapInArrow(_cross(self.percent, closest), "x long, y long, lx long, ly long, apart long")

    def links(self) -> DataFrame:
        """Labels (k, label) of all classes that link with another one."""
        met = self.prefixes.withColumn("label", F.col("k"))
        met = stash(self.meet(met, 0, True))
        self.join(self.best(met.where("y is not null")), self.many)
        rows = self.open(met.where("y is null").select("s", "k", "n", "slots"))
        unstash(met)
        for turn in range(1, ROUNDS):
            each = rows.groupBy("s", "label").agg(F.count("*").cast("double").alias("c")).groupBy("s").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("q"))
            if (each.agg(F.sum(F.col("c") * F.col("c") - F.col("q")) / 2).first()[0] or 0) <= FEW * self.many:
                break
            self.join(self.best(self.meet(rows, turn, False)), self.many)
            rows = self.open(rows)
        if not rows.isEmpty():
            found, done = self.compare(rows, True)
            rows = self.open(rows)
            if not rows.isEmpty():
                self.compare(rows, False, done)
            unstash(found)
        return self.labels

    def compare(self, rows: DataFrame, closest: bool, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Joins what links of the pairs of cross() but those done (a, b: in order): first the closest pair of any two labels and, unless only
        each label's closest are asked for, the others that are still apart. Gives the written pairs, and those compared first."""
        pairs = self.cross(rows, closest)
        if done is not None:
            pairs = pairs.join(done, (F.least("x", "y") == F.col("a")) & (F.greatest("x", "y") == F.col("b")), "left_anti")
        close = stash(pairs.distinct())
        left = close.count()
        chosen = gathered(close.groupBy("lx", "ly").agg(F.min_by(F.struct("x", "y"), F.struct("apart", "x", "y")).alias("p")).select("p.x", "p.y"), left)
        self.join(chosen, left)
        if not closest:
            rest = close.select("x", "y").join(chosen, ["x", "y"], "left_anti")
            rest = gathered(self.label(self.label(rest, "x", "lx"), "y", "ly").where("lx <> ly").select("x", "y"), left)
            if not rest.isEmpty():
                self.join(rest, left)
        return close, chosen.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, hot: int = HOT, members: int = MEMBERS) -> DataFrame:
    """One row per row of df: id, n_shingles, component_id.

    Rows link when 100 * intersection >= percent * union of their sets; component_id is the smallest id reachable. A row with
    fewer words than a shingle has its whole sequence as the one shingle; null and empty texts have none and link with nothing.
    Repeated rows are in one component. A null id is never the smallest; a component of null ids alone has none. Other columns
    are ignored; an empty table gives an empty result. Shingles are 64-bit hashes, as are the keys of equal sets.
    """
    rows = labelled(Join(df, id_col, text_col, words, percent, hot, members))
    return rows.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))


def labelled(j: Join) -> DataFrame:
    """Rows (id, t, k, n, row) with their component's label and smallest id; neither for rows without shingles."""
    labels = j.links()
    marked = j.classes.select("k", "least").join(labels.withColumnRenamed("k", "l"), F.col("k") == F.col("l"), "left").select("k", "least", F.coalesce("label", "k").alias("label"))
    marked = stash(marked)
    smallest = marked.groupBy("label").agg(F.min("least").alias("component"))
    of = marked.join(smallest, "label").select(F.col("k").alias("c"), "label", "component")
    return j.rows.join(of, (F.col("k") == F.col("c")) & (F.col("n") > 0), "left")


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that with its smallest id, null last; of several, that with the smallest hash of its text, and of
    rows alike in both any one. Rows without shingles link with nothing and all stay."""
    docs, key = tagged(df)
    rows = stash(labelled(Join(docs, id_col, text_col, WORDS, PERCENT, HOT, MEMBERS, key)).select("id", "t", "n", "row", "label"))
    best = rows.where("n > 0").groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t", "row")).alias("b")).select(F.col("b.row").alias(key))
    kept = best.union(rows.where("n = 0").select("row"))
    return docs.join(kept, key, "left_semi").select(*df.columns)
