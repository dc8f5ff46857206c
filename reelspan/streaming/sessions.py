"""Streaming forms: sessions behind a watermark, and the drift controller as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener

from reelspan.functions.text import list_key


def sessions(stream: DataFrame, keys: list[str], time: str, gap: str, late: str = "1 hour") -> DataFrame:
    """keys, start, end, n of sessions by gap; rows repeated within the watermark count once. time is a timestamp."""
    w = F.session_window(time, gap)
    out = stream.withWatermark(time, late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.max(time).alias("last"))
    return out.select(*keys, F.col("w.start").alias("start"), "last", "n")


def windows(stream: DataFrame, keys: list[str], time: str, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """keys, start, n of tumbling or sliding windows."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return stream.withWatermark(time, late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), "n")


def distinct(stream: DataFrame, ids: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """stream without repeats of ids within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(ids)


#: Fixed values, in milliseconds and shares of the rate: the drift that is seeked away, the least that is trimmed, the settling
#: time after a seek, and the smallest and largest trim.
SEEK_MS, TRIM_MS, SETTLE_MS, LEAST, MOST = 400, 40, 600, 0.04, 0.25


ACTIONS = "key long, at long, action string, trim double"


def controller(rows: Iterator[tuple], trimmed: bool = False, settles: float = float("-inf")) -> Iterator[tuple[tuple, bool, float]]:
    """(at, action, trim) and the state after it for rows (at, event, drift, paused) in order. A play, resume or seek by the user lets things
    settle; the controller's own seeks don't. drift is the follower's time less the master's."""
    for at, event, ms, paused in rows:
        action, trim = "hold", 0.0
        if event in ("play", "resume", "seek"):
            settles = at + SETTLE_MS
        elif at >= settles:
            if abs(ms) > SEEK_MS or (paused and abs(ms) > TRIM_MS):
                action, trimmed = "seek", False
            elif not paused and abs(ms) > TRIM_MS:
                action, trimmed, trim = "trim", True, min(MOST, max(LEAST, abs(ms) / 1000)) * (-1 if ms > 0 else 1)
            elif trimmed and abs(ms) <= TRIM_MS / 2:
                action, trimmed = "restore", False
        yield (int(at), action, trim), trimmed, settles


class _Drift(StatefulProcessor):
    """State by key: whether the rate is trimmed, and until when things settle."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("drift", "trimmed boolean, settles double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.state.get() if self.state.exists() else (False, float("-inf"))
        out = []
        for part in rows:
            for done, *state in controller(part.sort_values("at")[["at", "event", "drift", "paused"]].itertuples(index=False), *state):
                out.append((key[0], *done))
        self.state.update((bool(state[0]), float(state[1])))
        yield pd.DataFrame(out, columns=["key", "at", "action", "trim"])

    def close(self) -> None:
        pass


def drift_actions(df: DataFrame) -> DataFrame:
    """Rows (key, at, event, drift, paused) become actions: seek, trim, restore or hold; event is null for a tick, or play, resume or seek.

    On a stream a key's state is kept between batches (RocksDB state store); a table's rows are walked through by key in order of at, as a stream in
    each task, whatever a key's size."""
    if df.isStreaming:
        return df.groupBy("key").transformWithStateInPandas(_Drift(), ACTIONS, "append", "none")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, (False, float("-inf"))
        for b in batches:
            out = []
            for k, *row in b[["key", "at", "event", "drift", "paused"]].itertuples(index=False):
                key, state = (key, state) if k == key else (k, (False, float("-inf")))
                done, *state = next(controller(iter([row]), *state))
                out.append((k, *done))
            yield pd.DataFrame(out, columns=["key", "at", "action", "trim"])

    return df.select("key", "at", "event", "drift", "paused").repartition("key").sortWithinPartitions("key", "at").mapInPandas(walk, ACTIONS)


def growing_sessions(files: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of files (folder, name, at: timestamp) as sessions' lists: folder, start, files (sorted names), key, each time a folder's window
    closes after an hour without a new file. A file list that grows gets a new key."""
    w = F.session_window("at", "1 hour")
    out = files.withWatermark("at", late).groupBy("folder", w.alias("w")).agg(F.array_sort(F.collect_set("name")).alias("files"))
    return out.select("folder", F.col("w.start").alias("start"), "files", list_key(F.col("files")).alias("key"))


class Progress(StreamingQueryListener):
    """Keeps what a session's streams report: (event, query id, batch, rows)."""

    def __init__(self):
        self.events: list[tuple] = []

    def onQueryStarted(self, event) -> None:
        self.events.append(("started", str(event.id), None, None))

    def onQueryProgress(self, event) -> None:
        self.events.append(("progress", str(event.progress.id), event.progress.batchId, event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:
        self.events.append(("idle", str(event.id), None, None))

    def onQueryTerminated(self, event) -> None:
        self.events.append(("terminated", str(event.id), None, None))
