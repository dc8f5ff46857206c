"""Substring dedup of word windows behind a count-min prefilter.

A word goes when a window of WIDTH words that covers it also starts in a document with a smaller id. Documents are dealt into
chunks of some megabytes, which Spark shuffles once and reads in three passes:

1. Every chunk sketches how many of its documents hold each window: ROWS rows of counters, kept as lists of the cells that
   are hit. A window is counted under the smallest hash of its GRAM-word grams, so that neighbouring windows share a count; that
   can only raise an estimate. The sketch is cut into shards, whose tasks merge the chunks' counters and tell each chunk
   which of its cells reached two.
2. Windows whose estimate (the smallest of their rows) is two or more, which are all repeated ones and some others, go to the
   shard of their 96-bit hash with the chunk's smallest id; its task groups them exactly and tells each chunk where a smaller id is.
3. Every chunk marks and removes words.

Shards hold a fixed amount of text, so a task's memory doesn't follow the input, and a window that a third of all
documents hold reaches its shard once for each chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE

WIDTH, GRAM = 13, 6
#: Bytes of text for each chunk and for each shard; rows of the sketch and cells of a shard's row.
CHUNK, SHARD, ROWS, CELLS = 4 << 20, 12 << 20, 2, 1 << 21
#: Bytes that are cut into words at a time.
SCAN = 1 << 20
_U = np.uint64
_A, _B, _K = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xD6E8FEB86659FD93)
LAST = np.iinfo(np.int64).max


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _B
    return x ^ (x >> _U(29))


_TABLE = _mix(_mix((np.arange(256, dtype=np.uint64) + _U(1)) * _A))
_WHITE = np.zeros(256, bool)
_WHITE[list(WHITE.encode())] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _K and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_K, _U(pow(int(_K), -1, 1 << 64)))):
            p = np.full(max(n, SCAN + SCAN // 8), base)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and hash of each word; some text at a time, cut at white space."""
    starts, ends, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    data = np.frombuffer(text, np.uint8)
    while at < len(data):
        stop = at + SCAN
        while stop < len(data) and not _WHITE[data[stop]]:
            stop += 1
        part = data[at:stop]
        edge = np.diff(np.concatenate([[True], _WHITE[part], [True]]).astype(np.int8))
        s, e = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = _power(len(part) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[part] * up[: len(part)])])
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(_mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)))
        at = stop
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def _joined(h: np.ndarray, parts: tuple[int, ...], seed: np.uint64) -> np.ndarray:
    """Hashes of runs of sum(parts) values of h; parts are falling powers of two."""
    powers, width = {1: _mix(h ^ seed)}, 1
    while width < parts[0]:
        x = powers[width]
        powers[2 * width] = _mix(x[:-width] * _A + x[width:])
        width *= 2
    n, out, at = len(h) - sum(parts) + 1, _U(0), 0
    for p in parts:
        out = _mix(out * _A + powers[p][at : at + n])
        at += p
    return out


def _parts(n: int) -> tuple[int, ...]:
    return tuple(1 << k for k in reversed(range(n.bit_length())) if n >> k & 1)


class Chunk:
    """Windows of a chunk's documents: document and first word of each, its 96-bit hash and the hash it is counted under."""

    def __init__(self, table: pa.Table, width: int):
        self.ids = table.column("id").to_numpy(zero_copy_only=False) if not table.column("id").null_count else np.array([LAST if x is None else x for x in table.column("id").to_pylist()])
        self.ids = self.ids.astype(np.int64)
        self.texts = [t.as_py() for t in table.column("text")]
        cut = [word_spans(t) for t in self.texts]
        self.words = [(s, e) for s, e, _ in cut]
        sizes = np.array([len(s) for s, _, _ in cut], np.int64)
        self.ends = np.cumsum(sizes)
        h = np.concatenate([x[2] for x in cut]) if cut else np.zeros(0, np.uint64)
        gram = min(GRAM, width)
        if len(h) < width:
            self.at = self.doc = np.zeros(0, np.int64)
            self.h1 = self.counted = np.zeros(0, np.uint64)
            self.h2 = np.zeros(0, np.uint32)
            return
        doc = np.repeat(np.arange(len(sizes)), sizes)
        at = np.flatnonzero(doc[: len(h) - width + 1] == doc[width - 1 :])
        counted = _joined(h, _parts(gram), _U(1))
        for k in (1 << k for k in range(20)):
            k = min(k, len(counted) - (len(h) - width + 1))
            if k <= 0:
                break
            counted = np.minimum(counted[:-k], counted[k:])
        self.at, self.doc, self.counted = at, doc[at], counted[at]
        self.h1, self.h2 = _joined(h, _parts(width), _U(2))[at], (_joined(h, _parts(width), _U(3))[at] >> _U(32)).astype(np.uint32)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct counted hashes, and how many of the documents hold each, up to two."""
        pairs = np.stack([self.counted, self.doc.astype(np.uint64)], 1)
        change = np.flatnonzero(np.concatenate([[True], np.any(pairs[1:] != pairs[:-1], 1)])) if len(pairs) else []
        pairs = pairs[change]  # neighbouring windows mostly share theirs
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        new = np.concatenate([[True], np.any(pairs[1:] != pairs[:-1], 1)]) if len(pairs) else np.zeros(0, bool)
        items, counts = np.unique(pairs[new, 0], return_counts=True)
        return items, np.minimum(counts, 2).astype(np.uint8)

    def cells(self, items: np.ndarray, counts: np.ndarray, shards: int, cells: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """shard, row, cells and counts of the chunk's sketch; equal cells are added up."""
        shard = _shard(items, shards)
        for row in range(ROWS):
            key = shard.astype(np.uint64) * _U(cells) + _cell(items, row, cells)
            key, at = np.unique(key, return_inverse=True)
            sums = np.minimum(np.bincount(at, counts), 2).astype(np.uint8)
            of = (key // _U(cells)).astype(np.int64)
            for lo, hi in _runs(of):
                yield int(of[lo]), row, (key[lo:hi] % _U(cells)).astype(np.uint32), sums[lo:hi]

    def repeated(self, items: np.ndarray, counts: np.ndarray, replies: dict, shards: int, cells: int) -> np.ndarray:
        """Windows whose estimate is two or more."""
        ok = np.ones(len(items), bool)
        for row in range(ROWS):
            hit = [np.zeros(0, np.uint64)]
            for shard, r, at, _ in self.cells(items, counts, shards, cells):
                if r == row:
                    bits = np.unpackbits(np.frombuffer(replies[0, shard, row], np.uint8), count=len(at)).astype(bool)
                    hit.append(_U(shard * cells) + at[bits])
            hit = np.concatenate(hit)
            key = _shard(items, shards).astype(np.uint64) * _U(cells) + _cell(items, row, cells)
            ok &= np.isin(key, hit)
        return np.flatnonzero(np.isin(self.counted, items[ok]))

    def groups(self, windows: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """The windows' distinct hashes in order, the chunk's smallest id of each, each window's place among them, and the shards' runs."""
        h1, h2, ids = self.h1[windows], self.h2[windows], self.ids[self.doc[windows]]
        order = np.lexsort((ids, h2, h1))
        a, b = h1[order], h2[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        place = np.empty(len(a), np.int64)
        place[order] = np.cumsum(new) - 1
        of = _shard(a[new], shards)
        return a[new], b[new], ids[order][new], place, [(int(of[lo]), lo, hi) for lo, hi in _runs(of)]


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def _cell(h: np.ndarray, row: int, cells: int) -> np.ndarray:
    return _mix(h * _A + _U(row + 1)) & _U(cells - 1)


def _runs(of: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]]).astype(int).tolist()
    return [(lo, hi) for lo, hi in zip(cuts, cuts[1:]) if hi > lo]


MESSAGE = "chunk long, shard long, row int, kind int, a binary, b binary, c binary"
_FIELDS = pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), ("row", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _messages(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * 7
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _FIELDS.types)], schema=_FIELDS)


def _delta(x: np.ndarray) -> bytes:
    return np.diff(x, prepend=x.dtype.type(0)).tobytes()


def _undelta(b: bytes, dtype) -> np.ndarray:
    return np.cumsum(np.frombuffer(b, dtype), dtype=dtype)


def _replies(table: pa.Table) -> dict[tuple[int, int, int], bytes]:
    return {(r["kind"], r["shard"], r["row"]): r["a"] for r in table.to_pylist()}


def remove_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, chunk_bytes: int = CHUNK, shard_bytes: int = SHARD, cells: int = CELLS) -> DataFrame:
    """One row per row of df: id, n_words, n_removed, kept_sha256, kept (kept words joined by a space).

    Windows are judged on the input and never cross rows. Null and empty texts have no words; texts under `width` words lose
    nothing. A null id is larger than any other and rows with the same id, repeated ones too, remove nothing from each other.
    Other columns are ignored; an empty table gives an empty result. Equality of windows rests on a 96-bit hash.
    """
    text = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
    docs = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, shards = int(total // chunk_bytes + 1), int(total // shard_bytes + 1)
    docs = docs.select(F.pmod(F.xxhash64("id", F.octet_length("text")), F.lit(chunks)).cast("long").alias("chunk"), "id", "text")

    def sketch(table: pa.Table) -> pa.Table:
        c = Chunk(table, width)
        chunk = table.column("chunk")[0].as_py()
        return _messages([(chunk, s, row, 0, _delta(at), n.tobytes(), None) for s, row, at, n in c.cells(*c.items(), shards, cells)])

    def merge(table: pa.Table) -> pa.Table:
        rows, sums = table.to_pylist(), np.zeros((ROWS, cells), np.uint8)
        for r in rows:
            at = _undelta(r["a"], np.uint32)
            sums[r["row"], at] = np.minimum(sums[r["row"], at] + np.frombuffer(r["b"], np.uint8), 2)  # a chunk's cells are distinct
        return _messages([(r["chunk"], r["shard"], r["row"], 0, np.packbits(sums[r["row"], _undelta(r["a"], np.uint32)] > 1).tobytes(), None, None) for r in rows])

    def candidates(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return _messages([])
        c, chunk = Chunk(table, width), table.column("chunk")[0].as_py()
        h1, h2, ids, _, runs = c.groups(c.repeated(*c.items(), _replies(replies), shards, cells), shards)
        # what the sketch said travels on to the last pass
        out = [(chunk, r["shard"], r["row"], 0, r["a"], None, None) for r in replies.to_pylist()]
        return _messages(out + [(chunk, s, 0, 1, h1[lo:hi].tobytes(), h2[lo:hi].tobytes(), ids[lo:hi].tobytes()) for s, lo, hi in runs])

    def group(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out, own = [(r["chunk"], r["shard"], r["row"], 0, r["a"], None, None) for r in rows if not r["kind"]], [r for r in rows if r["kind"]]
        if own:
            h1, h2, ids = (np.concatenate([np.frombuffer(r[k], t) for r in own]) for k, t in (("a", np.uint64), ("b", np.uint32), ("c", np.int64)))
            order = np.lexsort((ids, h2, h1))
            new = np.ones(len(order), bool)
            new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
            later = np.empty(len(order), bool)
            later[order] = ids[order] > ids[order][new][np.cumsum(new) - 1]
            at = 0
            for r in own:
                n = len(r["a"]) // 8
                out.append((r["chunk"], r["shard"], 0, 1, np.packbits(later[at : at + n]).tobytes(), None, None))
                at += n
        return _messages(out)

    result = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return result.empty_table()
        c = Chunk(table, width)
        gone = np.zeros(int(c.ends[-1]) + 1, np.int64)
        if replies.num_rows:
            told = _replies(replies)
            windows = c.repeated(*c.items(), told, shards, cells)
            _, _, ids, place, runs = c.groups(windows, shards)
            later = np.zeros(len(ids), bool)
            for s, lo, hi in runs:
                later[lo:hi] = np.unpackbits(np.frombuffer(told[1, s, 0], np.uint8), count=hi - lo).astype(bool)
            at = c.at[windows[later[place] | (c.ids[c.doc[windows]] > ids[place])]]
            np.add.at(gone, at, 1)
            np.add.at(gone, at + width, -1)
        gone, out, lo = np.cumsum(gone)[:-1] > 0, [], 0
        for i, text, (s, e), hi in zip(table.column("id").to_pylist(), c.texts, c.words, c.ends):
            off = gone[lo:hi]
            kept = b" ".join([text[a:b] for a, b in zip(s[~off].tolist(), e[~off].tolist())])
            out.append((i, len(s), int(off.sum()), hashlib.sha256(kept).hexdigest(), kept))
            lo = hi
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), result.types)], schema=result)

    by_chunk = docs.groupBy("chunk")
    sketched = by_chunk.applyInArrow(sketch, MESSAGE).groupBy("shard").applyInArrow(merge, MESSAGE)
    found = by_chunk.cogroup(sketched.groupBy("chunk")).applyInArrow(candidates, MESSAGE)
    found = found.groupBy("shard").applyInArrow(group, MESSAGE)
    out = by_chunk.cogroup(found.groupBy("chunk")).applyInArrow(remove, "id long, n_words long, n_removed long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("id", id_col)
