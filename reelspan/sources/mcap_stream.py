"""Growing MCAP recordings of a folder as a stream: readStream.format("mcap_messages").

A batch takes what has been added since the last one: the offset is the size of each recording that was seen, and a task owns the records that
end within the bytes that are new. A record that is still being written, and so ends beyond, belongs to a later batch; nothing is read
twice, nor after a restart from a checkpoint. Tasks walk the heads of a file's records and pass over the bodies of those read before.
The driver lists the folder and opens nothing. The offset has an entry for each file, so a folder should hold some 100,000 at most. A file
that shrinks is left alone until it is longer again than it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSourceStreamReader, InputPartition

from . import mcap


@dataclass
class Growth(InputPartition):
    """A file, and the range of its bytes that is new."""

    file: str
    start: int
    end: int


class McapStream(DataSourceStreamReader):
    """Options: path, flat, topics, from_ns and to_ns, as of mcap_messages."""

    def __init__(self, options: dict, columns: list[str]):
        self.batch = mcap._Messages(options, columns)

    def initialOffset(self) -> dict:
        return {"sizes": {}}

    def latestOffset(self) -> dict:
        return {"sizes": dict(self.batch.files())}

    def partitions(self, start: dict, end: dict) -> list[Growth]:
        before = start["sizes"]
        return [Growth(f, before.get(f, 0), n) for f, n in sorted(end["sizes"].items()) if n > before.get(f, 0)] or [Growth("", 0, 0)]

    def commit(self, end: dict) -> None:
        pass

    def read(self, partition: Growth) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        name, columns = partition.file, self.batch.columns
        with mcap.open_file(name) as f:
            if f.read(len(mcap.MAGIC)) != mcap.MAGIC:
                if not partition.start and partition.end >= len(mcap.MAGIC):
                    yield mcap.failed(name, "no MCAP file", columns)
                return
            index = mcap.Index([], {}, {}, {})
            for k, op, at, n in _heads(f, partition.end):
                end = at + 9 + n
                if op in (mcap.FOOTER, mcap.DATA_END):
                    return
                if op in (mcap.SCHEMA, mcap.CHANNEL):
                    mcap.add_definition(index, op, _body(f, at, n))
                elif end > partition.start and op in (mcap.CHUNK, mcap.MESSAGE):
                    yield from self._record(f, name, k, op, at, n, index)

    def _record(self, f, name: str, k: int, op: int, at: int, n: int, index: mcap.Index) -> Iterator[pa.RecordBatch]:
        try:
            data = mcap.unpack_chunk(_body(f, at, n)) if op == mcap.CHUNK else mcap._RECORD.pack(op, n) + _body(f, at, n)
        except mcap.McapError as e:
            yield mcap.failed(name, str(e), self.batch.columns)
            return
        bodies = mcap.Bodies(data, index)
        if bodies.error and bodies.error.startswith("unknown channel"):  # named in an earlier batch's chunk
            _define(f, at, index)
            bodies = mcap.Bodies(data, index)
        yield from bodies.batches(name, (k << 32) + 1, index, self.batch.columns, self.batch.topics, self.batch.low, self.batch.high)
        if bodies.error:
            yield mcap.failed(name, bodies.error, self.batch.columns)


def _heads(f, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(number, opcode, place, length) of the records that end by `end`."""
    at, k = len(mcap.MAGIC), 0
    while at + 9 <= end:
        f.seek(at)
        head = f.read(9)
        if len(head) < 9:
            return
        op, n = mcap._RECORD.unpack(head)
        if at + 9 + n > end:
            return
        yield k, op, at, n
        at, k = at + 9 + n, k + 1


def _body(f, at: int, n: int) -> bytes:
    f.seek(at + 9)
    return f.read(n)


def _define(f, end: int, index: mcap.Index) -> None:
    """Definitions from the chunks before `end`."""
    for _, op, at, n in _heads(f, end):
        if op == mcap.CHUNK:
            try:
                mcap.Bodies(mcap.unpack_chunk(_body(f, at, n)), index)
            except mcap.McapError:
                continue
