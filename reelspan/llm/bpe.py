"""Byte-level BPE encoding and decoding.

A text is cut by the tokenizer's pattern. Pieces that a worker has not seen are gathered over a batch of rows, bucketed by
length and padded into numpy matrices; in each round every row merges its leftmost pair of minimum rank. Ranks of pairs
come from an open-addressing hash table, and rows that are done leave the matrix. Pieces too long for a matrix take the same
merges from a heap, so that their time stays near linear.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.int64(1 << 40)
#: Pieces over so many bytes are not padded; pieces a worker remembers; rows and bytes encoded together.
LONGEST, REMEMBER, ROWS, BYTES = 128, 200_000, 512, 4 << 20


class Vocabulary:
    """Ranks and the hashed pairs (left id, right id) -> merged id."""

    def __init__(self, file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines()) if a}
        self.bytes = {i: t for t, i in self.ranks.items()}
        self.digits = {i: str(i) for i in self.bytes}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        get = self.ranks.get
        pairs = [(a << 32 | b, r) for t, r in self.ranks.items() for k in range(1, len(t)) if (a := get(t[:k])) is not None and (b := get(t[k:])) is not None]
        self.pairs = dict(pairs)
        self._hash(np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int64))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys, self.values = np.full(1 << self.bits, np.uint64(2**64 - 1)), np.full(1 << self.bits, NONE)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == np.uint64(2**64 - 1)
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            put = first[free[first]]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of merged pairs, NONE where there is no such token; negative ids are padding."""
        out = np.full(left.shape, NONE)
        where = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        keys = left.ravel()[where].astype(np.uint64) << np.uint64(32) | right.ravel()[where].astype(np.uint64)
        at = self._slot(keys)
        while len(where):
            found, end = self.keys[at] == keys, self.keys[at] == np.uint64(2**64 - 1)
            out.reshape(-1)[where[found]] = self.values[at[found]]
            go = ~(found | end)
            where, keys, at = where[go], keys[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece."""
        out: list[tuple[int, ...] | None] = [(self.ranks[p],) if p in self.ranks else None for p in pieces]
        buckets: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if out[k] is None:
                buckets.setdefault(len(p).bit_length() if len(p) <= LONGEST else -1, []).append(k)
        for k in buckets.pop(-1, []):
            out[k] = self._long(pieces[k])
        for members in buckets.values():
            for lo in range(0, len(members), 4096):
                some = members[lo : lo + 4096]
                for k, ids in zip(some, self._padded([pieces[k] for k in some])):
                    out[k] = ids
        return out

    def _padded(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        width, done = max(map(len, pieces)), [()] * len(pieces)
        m = np.full((len(pieces), width), -1, np.int64)
        for k, p in enumerate(pieces):
            m[k, : len(p)] = self.byte_ids[np.frombuffer(p, np.uint8)]
        ranks, rows, length = self.rank(m[:, :-1], m[:, 1:]), np.arange(len(pieces)), np.array([len(p) for p in pieces])
        while len(rows):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE)
            for k in np.flatnonzero(best == NONE):
                done[rows[k]] = tuple(m[k, : length[k]].tolist())
            go = best != NONE
            m, ranks, rows, length, at, best = m[go], ranks[go], rows[go], length[go] - 1, at[go], best[go]
            if not len(rows):
                break
            cols, k = np.arange(m.shape[1]), np.arange(len(rows))
            m[k, at] = best
            m = np.take_along_axis(m, np.minimum(cols + (cols > at[:, None]), m.shape[1] - 1), 1)
            m[k, length] = -1
            ranks = np.take_along_axis(ranks, np.minimum(cols[:-1] + (cols[:-1] > at[:, None]), ranks.shape[1] - 1), 1)
            ranks[k, np.maximum(length - 1, 0)] = NONE
            width = max(int(length.max()), 1)
            m, ranks = m[:, :width], ranks[:, : width - 1]
            for j in (at - 1, at):
                ok = (j >= 0) & (j < length - 1)
                ranks[k[ok], j[ok]] = self.rank(m[k[ok], j[ok]], m[k[ok], j[ok] + 1])
        return done

    def _long(self, piece: bytes) -> tuple[int, ...]:
        ids, n = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist(), len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.pairs.get
        heap = [(r, k) for k in range(n - 1) if (r := get(ids[k] << 32 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            j = after[k]
            if ids[k] < 0 or j >= n or get(ids[k] << 32 | ids[j]) != r:
                continue
            ids[k], ids[j], after[k] = r, -1, after[j]
            if after[k] < n:
                before[after[k]] = k
                if (x := get(r << 32 | ids[after[k]])) is not None:
                    heapq.heappush(heap, (x, k))
            if before[k] >= 0 and (x := get(ids[before[k]] << 32 | r)) is not None:
                heapq.heappush(heap, (x, before[k]))
        return tuple(i for i in ids if i >= 0)


class Encoder:
    """Encodes and decodes whole texts; remembers a bounded number of pieces."""

    def __init__(self, file: bytes, pattern: str):
        self.v, self.pattern, self.known = Vocabulary(file), regex.compile(pattern), {}

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        cut_texts = [self.pattern.findall(t) for t in texts]
        new = list(set(chain.from_iterable(cut_texts)) - self.known.keys())
        if len(self.known) + len(new) > REMEMBER:
            self.known, new = {}, list(set(chain.from_iterable(cut_texts)))
        self.known.update(zip(new, self.v.encode_pieces([p.encode() for p in new])))
        for pieces in cut_texts:
            yield list(chain.from_iterable(map(self.known.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.v.bytes.__getitem__, ids))


_encoders: dict[tuple[int, str], Encoder] = {}


def encoder(file: bytes, pattern: str) -> Encoder:
    """The worker's encoder for a vocabulary file's content."""
    key = (hash(file), pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(file, pattern)
    return _encoders[key]


def _parts(texts: pa.Array) -> Iterator[list[str]]:
    """Texts of a batch, some rows and bytes at a time."""
    part, size = [], 0
    for t in texts:
        part.append(t.as_py() or "")
        size += len(part[-1])
        if len(part) >= ROWS or size >= BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def _map(df: DataFrame, id_col: str, text_col: str, vocabulary_path: str, pattern: str, row, types: dict[str, pa.DataType], schema: str) -> DataFrame:
    with open(vocabulary_path, "rb") as f:
        file = df.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, whatever the corpus

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(file.value, pattern)
        for b in batches:
            rows = [row(e, t, ids) for part in _parts(b.column(1)) for t, ids in zip(part, e.encode(part))]
            columns = list(zip(*rows)) or [[] for _ in types]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types.values()))], ["id", *types])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(task, schema).withColumnRenamed("id", id_col)


def encode(df: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id and its token ids. Null texts count as empty and have no ids; other columns are ignored."""
    return _map(df, id_col, text_col, vocabulary_path, pattern, lambda e, t, ids: (ids,), {"ids": pa.list_(pa.int32())}, "id long, ids array<int>")


def decode(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: id and the bytes of its token ids; null ids give no bytes."""
    with open(vocabulary_path, "rb") as f:
        file = df.sparkSession.sparkContext.broadcast(f.read())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(file.value, "")
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e.decode(x.as_py() or []) for x in b.column(1)], pa.binary())], ["id", "bytes"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(task, "id long, bytes binary").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of each row's ids and of what they decode to: id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no tokens and the digests of nothing. Repeated rows give repeated results; other columns are ignored.
    """

    def row(e: Encoder, text: str, ids: list[int]) -> tuple[int, str, str]:
        listed = ",".join(map(e.v.digits.__getitem__, ids))
        return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(e.decode(ids)).hexdigest()

    types = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return _map(df, id_col, text_col, vocabulary_path, pattern, row, types, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
