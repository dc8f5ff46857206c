"""Profiles of channels: counts, spans, periods, last states, ordered digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import Ordered, median


def topic_profile(df: DataFrame, keys: list[str], topic: str, time: str, per_second: int) -> DataFrame:
    """keys, topic, messages, first, last and rate_hz: messages by the seconds that all topics of the keys span, to 3 places; null for no span."""
    out = df.groupBy(*keys, topic).agg(F.count("*").alias("messages"), F.min(time).alias("first"), F.max(time).alias("last"))
    every = Window.partitionBy(*keys)  # over one row a topic
    span = (F.max("last").over(every) - F.min("first").over(every)) / per_second
    return out.withColumn("rate_hz", F.when(span > 0, F.bround(F.col("messages") / span, 3)))


def diagnose(df: DataFrame, keys: list[str], order: list[str], time: str, data: str, fmt: str, per_second: int, top: int = 5, head: int = 16, tracked: int = 1000, accuracy: int = 1000) -> DataFrame:
    """keys, messages, smallest, largest, mean_size and median_size of payloads, first_bytes (of the first payload in order), formats (the `top`
    most frequent ones as (item, count)) and rate_hz (n - 1 steps by the span; null for no span), in one pass.

    All states are bounded and merge: formats come from a sketch of `tracked` items, which is exact for up to that many distinct formats and
    else off by the messages divided by `tracked` at most; the median's rank is within the messages divided by `accuracy`."""
    size = F.octet_length(F.col(data)).cast("long")
    out = df.groupBy(*keys).agg(
        F.count("*").alias("messages"), F.min(size).alias("smallest"), F.max(size).alias("largest"), F.avg(size).alias("mean_size"), F.percentile_approx(size, 0.5, accuracy).alias("median_size"),
        F.min_by(F.substring(data, 1, head), F.struct(*order)).alias("first_bytes"), F.expr(f"approx_top_k(`{fmt}`, {top}, {tracked})").alias("formats"), F.min(time).alias("__a"), F.max(time).alias("__z"),
    )
    span = (F.col("__z") - F.col("__a")) / per_second
    return out.withColumn("rate_hz", F.when(span > 0, (F.col("messages") - 1) / span)).drop("__a", "__z")


def mean_period(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """keys, n, period: (last - first) / (n - 1), null for fewer than two rows."""
    out = df.groupBy(*keys).agg(F.count(time).alias("n"), F.min(time).alias("a"), F.max(time).alias("z"))
    return out.select(*keys, "n", F.when(F.col("n") > 1, (F.col("z") - F.col("a")) / (F.col("n") - 1)).alias("period"))


def median_period(df: DataFrame, keys: list[str], order: list[str], time: str, hot: int | None = None) -> DataFrame:
    """keys, period: the median of the positive steps between neighbours, 0.0 without any. Steps are whole numbers; a key of more than `hot` rows is
    ordered in blocks and its median selected by counting (see ordered.py)."""
    rows = Ordered(df, keys, order, hot).neighbour(time, "__next", 1).rows()
    steps = rows.select(*keys, (F.col("__next") - F.col(time)).alias("__step"))
    found = median(steps.withColumn("__step", F.when(F.col("__step") > 0, F.col("__step"))), keys, "__step", hot)
    every = df.select(*keys).distinct()
    named, on = found.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)}), F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return every.join(named, on, "left").select(*keys, F.coalesce("median", F.lit(0.0)).alias("period"))


def latest(df: DataFrame, keys: list[str], order: list[str], *values: str) -> DataFrame:
    """The values of each key's last row (the last write wins)."""
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v"))
    return out.select(*keys, *[F.col(f"v.{v}").alias(v) for v in values])


def ordered_digest(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """keys, rows and sha256 of each key's values (text or bytes; nulls skipped) one after the other.

    Rows are sorted by Spark and hashed as they stream by, so a key of any size needs no more memory than a batch.
    """
    rows = df.select(*keys, F.col(value).cast("binary").alias("__value"), *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)])
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, *[f"__o{i}" for i in range(len(order))]).select(*keys, "__value")
    kinds = [df.schema[k].dataType.simpleString() for k in keys]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h, n, types = None, None, 0, None
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) or [[]] * (len(keys) + 2)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*types, pa.int64(), pa.string()])], [*keys, "rows", "sha256"])

        for b in batches:
            types = [b.schema.field(k).type for k in keys]
            for *now, data in zip(*(b.column(i).to_pylist() for i in range(len(keys) + 1))):
                if h is None or now != key:
                    if h is not None:
                        done.append((*key, n, h.hexdigest()))
                    key, h, n = now, hashlib.sha256(), 0
                n += 1
                h.update(data or b"")
            if len(done) > 4096:
                yield flush()
                done.clear()
        if h is not None:
            done.append((*key, n, h.hexdigest()))
            yield flush()

    return rows.mapInArrow(task, ", ".join([*(f"`{k}` {t}" for k, t in zip(keys, kinds)), "rows long", "sha256 string"]))


def drift(df: DataFrame, keys: list[str], delta: Column) -> DataFrame:
    """keys, samples, worst and mean of absolute differences; zeros where there are none."""
    out = df.groupBy(*keys).agg(F.count(delta).alias("samples"), F.max(F.abs(delta)).alias("worst"), F.avg(F.abs(delta)).alias("mean"))
    return out.fillna(0, ["worst"]).fillna(0.0, ["mean"])
