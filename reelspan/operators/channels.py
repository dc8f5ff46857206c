"""Which channels of a recording are cameras and microphones, which of them can be used, and the state of their H.265 streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import Ordered

#: Schema names and message encodings of the channels that can be read.
VIDEO_SCHEMAS = {("foxglove.CompressedVideo", "protobuf"): "foxglove", ("sensor_msgs/msg/CompressedImage", "cdr"): "ros2", ("sensor_msgs/CompressedImage", "cdr"): "ros2"}
AUDIO_SCHEMAS = {("foxglove.RawAudio", "protobuf"): "foxglove"}
#: Error codes of a channel.
NO_SAMPLES, NO_SETS, UNSUPPORTED = "no_video_samples", "missing_parameter_sets", "unsupported_codec"


def _by_schema(channels: DataFrame, schemas: dict, schema: str, encoding: str) -> DataFrame:
    adapter = F.lit(None).cast("string")
    for (name, message), value in schemas.items():
        adapter = F.when((F.col(schema) == name) & (F.col(encoding) == message), value).otherwise(adapter)
    return channels.withColumn("adapter", adapter).where(F.col("adapter").isNotNull())


def video_channels(channels: DataFrame, schema: str = "schema_name", encoding: str = "message_encoding", schemas: dict = VIDEO_SCHEMAS) -> DataFrame:
    """channels with their adapter; those of other schemas, and without one, are left out."""
    return _by_schema(channels, schemas, schema, encoding)


def audio_channels(channels: DataFrame, schema: str = "schema_name", encoding: str = "message_encoding", schemas: dict = AUDIO_SCHEMAS) -> DataFrame:
    return _by_schema(channels, schemas, schema, encoding)


def select_topics(files: DataFrame, channels: DataFrame, topics: list[str] | None = None, key: str = "file") -> tuple[DataFrame, DataFrame]:
    """The wanted channels (None: all), and a status for each file: pending, or no_video_channel for one that has none of them."""
    wanted = channels if topics is None else channels.where(F.col("topic").isin(topics))
    found = wanted.groupBy(key).agg(F.count("*").alias("channels"))
    status = files.select(key).distinct().join(found, key, "left").select(key, F.when(F.col("channels").isNull(), "no_video_channel").otherwise("pending").alias("status"))
    return wanted, status


def codec_flag(frames: DataFrame, keys: list[str], order: list[str], fmt: str = "format", wanted: str = "h265") -> DataFrame:
    """frames before their channel's first one of another codec, and the channel's error if it has one; other channels go on."""
    bad = frames.where(~F.col(fmt).eqNullSafe(F.lit(wanted))).groupBy(*keys).agg(F.min(F.struct(*order)).alias("__end"))
    rows = frames.join(bad, keys, "left")
    ok = F.col("__end").isNull() | (F.struct(*order) < F.col("__end"))
    return rows.where(ok).withColumn("error", F.when(F.col("__end").isNotNull(), UNSUPPORTED)).drop("__end")


def stream_stats(frames: DataFrame, keys: list[str], order: list[str], hot: int | None = None) -> DataFrame:
    """keys, frames, keyframes, dropped_leading, gop_min, gop_max of H.265 frames (is_key, has_vps, has_sps, has_pps; null is false).

    Frames before the first key frame at which all three parameter sets have been seen, the frame's own ones included, are dropped; the last
    group of pictures is open and doesn't count. A channel whose sets never come has no frames. One scan in order; hot: see ordered.Ordered. Only
    one row for each group of pictures is looked at by channel.
    """
    kinds = ("vps", "sps", "pps")
    key = F.coalesce("is_key", F.lit(False))
    scan = Ordered(frames, keys, order, hot).running(**{f"__{s}": ("any", F.col(f"has_{s}")) for s in kinds})
    # sets once seen stay seen, so the first ready key frame begins group 1, each later key frame the next one
    rows = scan.running(__gop=("sum", (key & F.col("__vps") & F.col("__sps") & F.col("__pps")).cast("long"))).rows()
    on = F.col("__gop") > 0
    groups = rows.groupBy(*keys, "__gop").agg(F.count_if(on).alias("__n"), F.count_if(on & key).alias("__k"), F.count_if(~on).alias("__d"))
    groups = groups.withColumn("__last", F.max("__gop").over(Window.partitionBy(*keys)))
    closed = F.when(on & (F.col("__gop") < F.col("__last")), F.col("__n"))
    return groups.groupBy(*keys).agg(F.sum("__n").alias("frames"), F.sum("__k").alias("keyframes"), F.sum("__d").alias("dropped_leading"), F.min(closed).alias("gop_min"), F.max(closed).alias("gop_max"))


def parameter_sets(units: DataFrame, keys: list[str], order: list[str], unit: str = "unit") -> DataFrame:
    """Distinct units of each key in the order they came in, numbered from 0; parameter sets of a stream are few."""
    first = units.groupBy(*keys, unit).agg(F.min(F.struct(*order)).alias("__at"))
    return first.withColumn("i", (F.row_number().over(Window.partitionBy(*keys).orderBy("__at")) - 1).cast("int")).drop("__at")


def triage(channels: DataFrame, key: str = "file") -> DataFrame:
    """channels (file, topic, error, frames, ready) with code: the channel's own error, no_video_samples, missing_parameter_sets or null
    for a good one; and file_error: a file's first code in topic order where none of its channels is good."""
    code = F.when(F.col("error").isNotNull(), F.col("error")).when(F.coalesce("frames", F.lit(0)) == 0, NO_SAMPLES).when(~F.coalesce("ready", F.lit(False)), NO_SETS)
    rows = channels.withColumn("code", code)
    of = Window.partitionBy(key)
    none = F.count_if(F.col("code").isNull()).over(of) == 0
    return rows.withColumn("file_error", F.when(none, F.min_by("code", "topic").over(of)))


def channel_warnings(rows: DataFrame, key: str = "file") -> DataFrame:
    """One warning (file, topic, code) for each channel that failed in a file that goes on without it."""
    return rows.where(F.col("code").isNotNull() & F.col("file_error").isNull()).select(key, "topic", "code")


def held_back(blocks: DataFrame, keys: list[str], order: list[str], size: str, cap: int = 32 << 20) -> DataFrame:
    """blocks with kept: audio that comes before the first picture is held while it fits under the cap; one that doesn't is lost, later
    smaller ones may still fit. A key's blocks before the first one that doesn't fit are a running sum; the rest of it is walked through as a stream."""
    import pandas as pd

    upto = F.sum(size).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = blocks.withColumn("__upto", upto)
    over = rows.where(F.col("__upto") > cap).groupBy(*keys).agg(F.min(F.struct(*order)).alias("__full"), F.min(F.col("__upto") - F.col(size)).alias("__held"))
    rows = rows.join(over, keys, "left")
    easy = rows.where(F.col("__full").isNull() | (F.struct(*order) < F.col("__full"))).withColumn("kept", F.lit(True)).select(*blocks.columns, "kept")
    hard = rows.where(F.struct(*order) >= F.col("__full")).select(*blocks.columns, F.col("__held"))

    def walk(batches):
        key, held = None, 0
        for b in batches:
            kept = []
            for k, n, start in zip(b[keys].itertuples(index=False, name=None), b[size], b["__held"]):
                if k != key:
                    key, held = k, start
                kept.append(held + n <= cap)
                held += n if kept[-1] else 0
            yield b.drop(columns="__held").assign(kept=pd.Series(kept, index=b.index, dtype=bool))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema), "kept boolean"])
    return easy.unionByName(hard.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(walk, schema))
