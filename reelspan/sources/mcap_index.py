"""The chunk indexes of many MCAP recordings as a table, and what is read by way of it.

Tasks read the ends of the files, each once; the table is kept as Parquet and only files that are new or have changed are read again.
A row is a chunk, the records between a file's chunks (`rest`), a whole file without an index (`whole`) or no recording (`bad`).
Messages come from a join of this table with the times asked for: its pieces are dealt to tasks by bytes. Times of topics and first messages
open only the chunks that can still change the answer.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from . import mcap

_KEY = ["file", "size", "modified_ms"]
CHUNK, REST, WHOLE, BAD = "chunk", "rest", "whole", "bad"
#: names: topics by channel. channels: what a chunk holds (null: not told). Counts are the whole file's, by channel (null: not told).
ROW = (
    "file string, size long, modified_ms long, kind string, ordinal int, start_ns long, end_ns long, offset long, length long, channels array<int>, "
    "names map<int,string>, counts map<int,long>"
)
_ROW = pa.schema(
    [("file", pa.string()), ("size", pa.int64()), ("modified_ms", pa.int64()), ("kind", pa.string()), ("ordinal", pa.int32()), ("start_ns", pa.int64()), ("end_ns", pa.int64())]
    + [("offset", pa.int64()), ("length", pa.int64()), ("channels", pa.list_(pa.int32())), ("names", pa.map_(pa.int32(), pa.string())), ("counts", pa.map_(pa.int32(), pa.int64()))]
)
BYTES = 128 << 20
LAST = 2**63 - 1


def files(spark: SparkSession, folder: str) -> DataFrame:
    """file, size and modified_ms of the recordings in a folder and below, as Spark lists them; no file is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][cC][aA][pP]").load(folder)
    return found.select(F.regexp_replace("path", "^file:/+", "file:///").alias("file"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_ms"))


def entries(listed: DataFrame) -> DataFrame:
    """The index rows of listed files; each file's end is read once, by a task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, size, modified in zip(*(b.column(k).to_pylist() for k in range(3))):
                key = {"file": name, "size": size, "modified_ms": modified}
                with mcap.open_file(name) as f:
                    good = f.read(len(mcap.MAGIC)) == mcap.MAGIC
                    index = mcap.read_index(f, size) if good else None
                if not index or not index.chunks:
                    rows.append(key | {"kind": WHOLE if good else BAD, "ordinal": 0, "offset": 0, "length": size})
                    continue
                told = key | {"names": [(i, c[1]) for i, c in index.channels.items()], "counts": list(index.counts.items()) or None}
                rows += [told | {"kind": REST, "ordinal": 0, "offset": lo, "length": hi - lo} for lo, hi in index.gaps()]
                order = sorted(range(len(index.chunks)), key=lambda k: index.chunks[k][2])
                for n, k in enumerate(order):
                    start, end, offset, length = index.chunks[k]
                    rows.append(told | {"kind": CHUNK, "ordinal": n + 1, "start_ns": start, "end_ns": end, "offset": offset, "length": length, "channels": index.held[k]})
            yield pa.RecordBatch.from_pylist(rows, schema=_ROW)

    return listed.select(*_KEY).mapInArrow(task, ROW)


def current(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The folder's index, from the Parquet table at `table`: rows of files that are new or have changed are added to it first, and rows of
    files that are gone or were replaced are left out."""
    listed = files(spark, folder)
    try:
        known = spark.read.schema(ROW).parquet(table)
        fresh = listed.join(known.select(*_KEY).distinct(), _KEY, "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        fresh = listed
    if not fresh.isEmpty():
        entries(fresh).write.mode("append").parquet(table)
    # two refreshes at a time may both have added a file
    return spark.read.schema(ROW).parquet(table).join(listed, _KEY, "left_semi").dropDuplicates(["file", "size", "modified_ms", "kind", "offset"])


def _wanted(index: DataFrame, topics: list[str] | None, low: int, high: int) -> DataFrame:
    """Pieces that can hold such messages."""
    in_time = F.col("start_ns").isNull() | ((F.col("end_ns") >= low) & (F.col("start_ns") <= high))
    rows = index.where(in_time & (F.col("kind") != BAD))
    if topics:
        of = F.map_keys(F.map_filter("names", lambda _, topic: topic.isin(topics)))
        rows = rows.where(F.coalesce(F.arrays_overlap("channels", of), F.lit(True)))
    return rows


def messages(index: DataFrame, topics: list[str] | None = None, from_ns: int = 0, to_ns: int = LAST, columns: list[str] | None = None, wanted: DataFrame | None = None, task_bytes: int = BYTES) -> DataFrame:
    """Messages of indexed recordings, of these columns of mcap_messages. wanted: rows (file, from_ns, to_ns) besides; messages come from the
    files and times of at least one of them. No file's index is read again."""
    columns = columns or list(mcap.COLUMNS)
    rows = _wanted(index, topics, from_ns, to_ns)
    need = columns
    if wanted is not None:
        need = [*columns, *(c for c in ("file", "log_time_ns") if c not in columns)]
        w = wanted.select(F.col("file").alias("__f"), F.col("from_ns").alias("__a"), F.col("to_ns").alias("__z"))
        touched = (F.col("file") == F.col("__f")) & (F.col("start_ns").isNull() | ((F.col("end_ns") >= F.col("__a")) & (F.col("start_ns") <= F.col("__z"))))
        rows = rows.join(w, touched, "left_semi")
    before = Window.partitionBy("file").orderBy("ordinal", "offset").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("share", F.floor(F.sum("length").over(before) / task_bytes))
    total = rows.agg(F.sum("length")).first()[0] or 0
    tasks = int(max(1, min(-(-total // task_bytes) * 2, 100_000)))
    dealt = rows.select("file", "kind", "ordinal", "offset", "length", "size", "names", "share").repartition(tasks, "file", "share").sortWithinPartitions("file", "ordinal", "offset")
    found = dealt.mapInArrow(_read(need, set(topics or ()), from_ns, to_ns), ", ".join(f"{c} {_kind(c)}" for c in need))
    if wanted is not None:
        held = (F.col("file") == F.col("__f")) & ((F.col("log_time_ns").isNull()) | F.col("log_time_ns").between(F.col("__a"), F.col("__z")))
        found = found.join(w, held, "left_semi").select(*columns)
    return found


def _kind(column: str) -> str:
    return next(c.split()[1] for c in mcap.MESSAGES.split(", ") if c.split()[0] == column)


def _read(columns: list[str], topics: set, low: int, high: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = mcap._Messages({"path": "", "from_ns": low, "to_ns": high}, columns)
        reader.topics = topics
        file = name = index = None
        try:
            for b in batches:
                for row in b.to_pylist():
                    if name != row["file"]:
                        if file:
                            file.close()
                        name, file, index = row["file"], mcap.open_file(row["file"]), mcap.Index([], {i: (0, t, "") for i, t in row["names"] or ()}, {}, {})
                    if row["kind"] == CHUNK:
                        parts = reader._unpacked(file, row["offset"], row["length"], row["ordinal"])
                    elif row["kind"] == REST:
                        parts = ((d, 0, e) for d, e in mcap._plain(file, row["offset"], row["offset"] + row["length"], index))
                    else:
                        parts = ((d, k, e) for k, (d, e) in enumerate(mcap._records(file, row["size"], index)))
                    yield from reader._rows(parts, name, index)
        finally:
            if file:
                file.close()

    return task


class _File:
    """The chunks of one file, and how many have been opened. Loose records between chunks are read with the first."""

    def __init__(self, name: str, pieces: list[dict], names: list, counts: list | None):
        self.name, self.index, self.opened = name, mcap.Index([], {i: (0, t, "") for i, t in names or ()}, {}, {}), 0
        self.chunks = [p for p in pieces if p["kind"] == CHUNK]
        self.loose = [p for p in pieces if p["kind"] != CHUNK]
        self.counts = dict(counts) if counts else None
        self.error: str | None = None

    def bodies(self, f, piece: dict) -> Iterator[mcap.Bodies]:
        if piece["kind"] == CHUNK:
            self.opened += 1
            try:
                parts = [(mcap.read_chunk(f, piece["offset"], piece["length"]), None)]
            except mcap.McapError as e:
                parts = [(b"", str(e))]
        elif piece["kind"] == REST:
            parts = mcap._plain(f, piece["offset"], piece["offset"] + piece["length"], self.index)
        else:
            parts = mcap._records(f, piece["length"], self.index)
        for data, error in parts:
            b = mcap.Bodies(data, self.index)
            self.error = self.error or error or b.error
            if len(b.starts):
                yield b

    def expected(self, topics: set) -> set[str]:
        """Wanted topics that the file may hold messages of, as far as its index tells."""
        told = self.counts if self.counts is not None else None
        ids = [i for i, c in self.index.channels.items() if (not topics or c[1] in topics) and (told is None or told.get(i, 0))]
        if told is None and all(c["channels"] is not None for c in self.chunks):
            held = {i for c in self.chunks for i in c["channels"]}
            ids = [i for i in ids if i in held]
        return {self.index.channels[i][1] for i in ids}

    def topics_of(self, chunk: dict) -> set[str] | None:
        return None if chunk["channels"] is None else {self.index.channels[i][1] for i in chunk["channels"] if i in self.index.channels}


def _span(found: dict, bodies: mcap.Bodies, index: mcap.Index, topics: set) -> None:
    times = bodies.times()
    for i in np.unique(bodies.channel).tolist():
        topic = index.channels[i][1]
        if not topics or topic in topics:
            own = times[bodies.channel == i]
            low, high = found.get(topic, (LAST, -1))
            found[topic] = min(low, int(own.min())), max(high, int(own.max()))


def _spans(f, file: _File, topics: set) -> dict[str, tuple[int, int]]:
    """First and last time of each topic. Chunks are taken by their start, and by their end from the last, until every topic's bound is at
    least as good as the next chunk's; a chunk without a topic that it could improve is passed over."""
    found: dict[str, tuple[int, int]] = {}
    for piece in file.loose:
        for b in file.bodies(f, piece):
            _span(found, b, file.index, topics)
    wanted, seen = file.expected(topics), set()
    for side, order in ((0, sorted(file.chunks, key=lambda c: c["start_ns"])), (1, sorted(file.chunks, key=lambda c: -c["end_ns"]))):
        for chunk in order:
            edge = chunk["end_ns" if side else "start_ns"]
            better = {t for t in wanted if t not in found or (edge > found[t][1] if side else edge < found[t][0])}
            if not better:
                break
            held = file.topics_of(chunk)
            if chunk["offset"] not in seen and (held is None or better & held):
                seen.add(chunk["offset"])
                for b in file.bodies(f, chunk):
                    _span(found, b, file.index, topics)
    return found


def _by_file(index: DataFrame) -> DataFrame:
    """One row a file; its chunks' index rows (not their data) together."""
    piece = F.struct("kind", "start_ns", "end_ns", "offset", "length", "channels")
    return index.where(F.col("kind") != BAD).groupBy("file").agg(F.collect_list(piece).alias("pieces"), F.first("names", True).alias("names"), F.first("counts", True).alias("counts"))


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_File, object]]:
    for b in batches:
        for row in b.to_pylist():
            with mcap.open_file(row["file"]) as f:
                yield _File(row["file"], row["pieces"], row["names"], row["counts"]), f


def topic_times(index: DataFrame, topics: list[str] | None = None) -> DataFrame:
    """file, topic, first_ns and last_ns of its messages, chunks (of the file), opened (of these) and error (the first that was met)."""
    wanted = set(topics or ())
    names = ["file", "topic", "first_ns", "last_ns", "chunks", "opened", "error"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, f in _opened(batches):
            found = _spans(f, file, wanted)
            rows = [(file.name, t, a, z, len(file.chunks), file.opened, file.error) for t, (a, z) in sorted(found.items())]
            kinds = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)

    return _by_file(index).mapInArrow(task, "file string, topic string, first_ns long, last_ns long, chunks long, opened long, error string")


def first_messages(index: DataFrame, limit: int = 1, topics: list[str] | None = None) -> DataFrame:
    """The earliest `limit` messages of each topic of each file: file, topic, n (from 1), log_time_ns, sequence, data, chunks, opened.

    Chunks are taken by their start, until every topic has its messages and none of them is later than the next chunk's start. Of equal
    times, the message that comes first in the file is the earlier one."""
    wanted = set(topics or ())
    names = ["file", "topic", "n", "log_time_ns", "sequence", "data", "chunks", "opened"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, f in _opened(batches):
            best: dict[str, list] = {}  # heaps of (-time, -place, sequence, data): the latest on top

            def offer(piece: dict) -> None:
                for k, b in enumerate(file.bodies(f, piece)):
                    times, sequence = b.times(), b.field(2, "<u4")
                    for i in np.unique(b.channel).tolist():
                        topic = file.index.channels[i][1]
                        if wanted and topic not in wanted:
                            continue
                        heap, own = best.setdefault(topic, []), np.flatnonzero(b.channel == i)
                        for j in own[np.argsort(times[own], kind="stable")[:limit]].tolist():
                            at, n = int(b.starts[j]), int(b.sizes[j])
                            item = (-int(times[j]), (-piece["offset"], -k, -at), int(sequence[j]), b.data[at + mcap.HEAD : at + n])
                            if len(heap) < limit:
                                heapq.heappush(heap, item)
                            elif item[:2] > heap[0][:2]:
                                heapq.heapreplace(heap, item)

            for piece in file.loose:
                offer(piece)
            expected = file.expected(wanted)
            least = {t: limit for t in expected}
            if file.counts is not None:
                for t in expected:
                    least[t] = min(limit, sum(file.counts.get(i, 0) for i, c in file.index.channels.items() if c[1] == t))
            for chunk in sorted(file.chunks, key=lambda c: (c["start_ns"], c["offset"])):
                open_topics = {t for t in expected if len(best.get(t, [])) < least[t] or -best[t][0][0] >= chunk["start_ns"]}
                if not open_topics:
                    break
                held = file.topics_of(chunk)
                if held is None or open_topics & held:
                    offer(chunk)
            rows = [(file.name, t, n + 1, -x[0], x[2], x[3], len(file.chunks), file.opened) for t, heap in sorted(best.items()) for n, x in enumerate(sorted(heap, key=lambda x: (-x[0], tuple(-p for p in x[1]))))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, kinds)], names)

    return _by_file(index).mapInArrow(task, "file string, topic string, n long, log_time_ns long, sequence long, data binary, chunks long, opened long")
