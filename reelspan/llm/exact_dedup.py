"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts, Spark's external sort puts equal texts beside each other, the best row first, and
each row is compared in full with its neighbour: a run of equals is a group, its first row stays. Splitters are made of a short
prefix, a hash and the id, so what the driver samples stays small however long the texts are, and a group of copies that is larger than a
partition is split between several. Only runs that share prefix and hash with a partition's first or last row can go on in another
partition; these few (one row each) meet in a boundary pass, under the digest that each run computed once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, cut, tagged

#: Characters of the normalised text in a splitter; rows of an output batch; runs at boundaries that are broadcast (some 150 bytes each).
SPLITTER_PREFIX, ROWS, BROADCAST = 24, 10_000, 100_000
DECIDED = "id long, n int, sha string, keep_id long, group_size long, kept boolean, edge boolean, head boolean, part int"


class _Run:
    """Equal neighbours, the best one first: ids, lengths, keys."""

    def __init__(self, text: bytes):
        self.text, self.ids, self.lengths, self.keys = text, [], [], []


def _decided(named: bool):
    """Decisions on rows (id, n, t, p, h, maybe row) in order of p, h, t, longest first, id. edge: the run may go on in another partition; head: its first row."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("sha", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("kept", pa.bool_()), ("edge", pa.bool_()), ("head", pa.bool_()), ("part", pa.int32())] + [("row", pa.string())] * named)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, held, first = TaskContext.get().partitionId(), None, [], True
        ready: list[list] = [[] for _ in schema]

        def settle(runs: list[_Run], edge: bool) -> None:
            """Runs of one prefix and hash are complete."""
            for r in runs:
                n, first_row = len(r.ids), [True] + [False] * (len(r.ids) - 1)
                values = [r.ids, r.lengths, [hashlib.sha256(r.text).hexdigest()] * n, [r.ids[0]] * n, [n] * n, first_row, [edge] * n, first_row, [part] * n, *([r.keys] * named)]
                for column, own in zip(ready, values):
                    column += own

        def out() -> pa.RecordBatch:
            whole = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(ready, schema)], schema=schema)
            for c in ready:
                c.clear()
            return whole

        for b in batches:
            keys = b.column(5).to_pylist() if named else [None] * b.num_rows
            for i, n, text, p, h, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), keys):
                if (p, h) != place:
                    settle(held, first)
                    first, place, held = first and not held, (p, h), []
                now = text.as_py()
                if not held or now != held[-1].text:
                    held.append(_Run(now))
                held[-1].ids.append(i)
                held[-1].lengths.append(n)
                if named:
                    held[-1].keys.append(key)
            if len(ready[0]) >= ROWS:
                yield out()
        settle(held, True)
        if ready[0]:
            yield out()

    return task


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One decision per row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; the row with the most code points, then the smallest id, stays.
    Null and empty texts are equal to each other. A null id sorts first. Of rows repeated with the same id and length,
    one stays. Other columns of df are ignored, whatever their names; an empty table gives an empty result.
    row_col: a column of keys (string) of the rows themselves, put out as well.
    """
    named = ["row"] if row_col else []
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.char_length(text).alias("n"), F.translate(text, WHITE, "").alias("t"), *[F.col(row_col).alias(c) for c in named])
    rows = rows.select("id", "n", F.encode("t", "UTF-8").alias("t"), F.substring("t", 1, SPLITTER_PREFIX).alias("p"), F.xxhash64("t").alias("h"), *named)
    rows = rows.repartitionByRange("p", "h", "id").sortWithinPartitions("p", "h", "t", F.desc("n"), "id")
    rows = cut(rows.mapInArrow(_decided(bool(named)), DECIDED + ", row string" * bool(named)))
    runs = rows.where("edge and head").groupBy("sha").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("id").alias("id"), F.col("part").alias("part"))).alias("best"), F.sum("group_size").alias("whole"))
    runs = cut(runs.select(F.col("sha").alias("s"), "best", "whole"))
    edges = rows.where("edge").join(F.broadcast(runs) if runs.count() <= BROADCAST else runs, F.col("sha") == F.col("s"))
    best = F.col("head") & F.col("id").eqNullSafe(F.col("best.id")) & (F.col("n") == -F.col("best.m")) & (F.col("part") == F.col("best.part"))
    edges = edges.withColumns({"keep_id": F.col("best.id"), "group_size": F.col("whole"), "kept": best}).select(rows.columns)
    out = rows.where("not edge").union(edges)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"), *[F.col(c).alias(row_col) for c in named])


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that exact_dedup() keeps: one of each group, ids repeated or null alike."""
    rows, key = tagged(df)
    kept = exact_dedup(rows, id_col, text_col, key).where("kept").select(key)
    return rows.join(kept, key, "left_semi").select(*df.columns)
