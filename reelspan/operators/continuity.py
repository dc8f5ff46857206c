"""Gaps and overlaps of sampled streams: what has to be filled in, what cut, and where every block lands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import BIN, Ordered, with_steps


def blocks(df: DataFrame, keys: list[str], order: list[str], stamp: str, length: str, rate: int, per_second: int = 1_000_000_000, tolerance: int = 1_000_000, policy: str = "fill", width: int | None = None) -> DataFrame:
    """df with fill, trim (samples), kind (gap, overlap or null), delta and position (samples written before the row's fill).

    A block is expected at the previous block's stamp plus its whole length. A gap of more than tolerance is filled (policy fill)
    or only reported (ignore), an overlap trims the block. Empty blocks are skipped before: they have no row. Sample counts are
    rounded half-even. order begins with the integer column of time. width: bins of time that are ordered at once, a day by default.
    """
    width = width or BIN * per_second // 1_000_000
    rows = df.where(F.col(length) > 0)
    expected = F.col(stamp) + F.bround(F.col(length).cast("decimal(20,0)") * per_second / rate, 0).cast("long")
    samples = lambda d: F.bround(d.cast("decimal(20,0)") * rate / per_second, 0).cast("long")

    def judged(previous: Column) -> tuple[Column, Column, Column, Column]:
        delta = F.coalesce(F.col(stamp) - previous, F.lit(0).cast("long"))
        kind = F.when(delta > tolerance, "gap").when(delta < -tolerance, "overlap")
        fill = F.when((delta > tolerance) & F.lit(policy == "fill"), samples(delta)).otherwise(0).cast("long")
        trim = F.when(delta < -tolerance, F.least(F.col(length).cast("long"), samples(-delta))).otherwise(0).cast("long")
        return delta, kind, fill, trim

    def written(previous: Column) -> Column:
        _, _, fill, trim = judged(previous)
        return fill + F.col(length) - trim

    rows = with_steps(rows.withColumn("__end", expected), keys, order, "__end", written, "__expected", "__upto", width)
    for column, value in zip(("delta", "kind", "fill", "trim"), judged(F.col("__expected"))):
        rows = rows.withColumn(column, value)
    return rows.withColumn("position", F.col("__upto") - (F.col("fill") + F.col(length) - F.col("trim"))).drop("__upto", "__end", "__expected")


def totals(df: DataFrame, keys: list[str], length: str, listed: int = 50) -> DataFrame:
    """Counts and samples of gaps and overlaps by key, samples written, and the first `listed` gaps as (position, fill)."""
    gap, overlap = F.col("kind") == "gap", F.col("kind") == "overlap"
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    first = df.where(gap).select(*keys, "position", "fill", F.row_number().over(Window.partitionBy(*keys).orderBy("position", "fill")).alias("__n")).where(F.col("__n") <= listed)
    gaps = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("position", "fill"))).alias("first_gaps"))
    out = df.groupBy(*keys).agg(n(gap).alias("gaps"), n(overlap).alias("overlaps"), F.sum("fill").alias("filled"), F.sum("trim").alias("trimmed"), F.sum(F.col("fill") + F.col(length) - F.col("trim")).alias("written"))
    return out.join(gaps, keys, "left")


def summary(df: DataFrame, keys: list[str], order: list[str], stamp: str, length: str, rate: int, per_second: int = 1_000_000_000, policy: str = "fill", listed: int = 50, hot: int | None = None) -> DataFrame:
    """What a report says of each stream, of all its blocks (empty ones too): messages, samples, source_samples, first and end stamp, duration_s,
    gaps and overlaps with the first `listed` of each (position_s, duration_ms, of gaps also filled), silence and trimmed samples, source_exact.

    The end is the first stamp plus the time of all samples written. Gaps and overlaps are numbered by ordered.Ordered, so that a stream with
    any number of them costs no memory."""
    every = df.groupBy(*keys).agg(F.count("*").alias("messages"))
    rows = blocks(df, keys, order, stamp, length, rate, per_second, policy=policy)
    ms, at = 1000 / per_second, F.bround(F.col("position") / rate, 6).alias("position_s")
    faults = Ordered(rows.where("kind is not null"), [*keys, "kind"], order, hot).running(__n=("sum", F.lit(1).cast("long"))).rows().where(F.col("__n") <= listed)
    long = F.bround(F.abs("delta") * ms, 3).alias("duration_ms")
    lists = faults.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "gap", F.struct("__n", at, long, (F.col("fill") > 0).alias("filled"))))).alias("gap_list"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "overlap", F.struct("__n", at, long)))).alias("overlap_list"),
    )
    n = lambda kind: F.count_if(F.coalesce(F.col("kind") == kind, F.lit(False)))
    source = F.sum(F.col(length) - F.col("trim"))
    out = rows.groupBy(*keys).agg(
        (source + F.sum("fill")).alias("samples"), source.alias("source_samples"), F.min_by(stamp, F.struct(*order)).alias("first"), n("gap").alias("gaps"), n("overlap").alias("overlaps"),
        F.sum("fill").alias("silence_samples"), F.sum("trim").alias("trimmed_samples"),
    )
    out = every.join(out, keys, "left").join(lists, keys, "left").fillna(0, ["samples", "source_samples", "gaps", "overlaps", "silence_samples", "trimmed_samples"])
    plain = lambda c: F.coalesce(F.transform(c, lambda x: x.dropFields("__n")), F.array())
    return out.withColumns({
        "end": F.col("first") + F.bround(F.col("samples").cast("decimal(20,0)") * per_second / rate, 0).cast("long"), "duration_s": F.bround(F.col("samples") / rate, 6),
        "gap_list": plain("gap_list"), "overlap_list": plain("overlap_list"), "source_exact": (F.col("silence_samples") == 0) & (F.col("trimmed_samples") == 0),
    })


def usable_stamp(stamp: Column, log_time: Column) -> Column:
    """A block's stamp, or its log time where the stamp is null or 0."""
    return F.when(F.coalesce(stamp, F.lit(0)) == 0, log_time).otherwise(stamp)


def whole_samples(n_bytes: Column, bytes_per_sample: Column) -> Column:
    """Samples of a block without the bytes of an incomplete last one."""
    return F.floor(n_bytes / bytes_per_sample).cast("long")


def format_lock(df: DataFrame, keys: list[str], order: list[str], fmt: str, supported: list[str], also: tuple[str, ...] = ()) -> DataFrame:
    """Rows before a key's first unsupported or changed format, by its first one; and error codes of keys that end early. also: columns (rate,
    channels) that are part of the format and may not change either; nulls are equal to each other."""
    whole = F.struct(fmt, *also)
    first = df.groupBy(*keys).agg(F.min_by(whole, F.struct(*order)).alias("__fmt"))
    rows = df.join(first, keys)
    good = lambda c: F.coalesce(c.isin(*supported), F.lit(False))
    bad = ~(good(F.col(fmt)) & whole.eqNullSafe(F.col("__fmt")))
    error = F.when(good(F.col(f"__fmt.{fmt}")), "audio_format_changed").otherwise("unsupported_audio_format")
    ends = rows.groupBy(*keys).agg(F.min(F.when(bad, F.struct(*order))).alias("__end"), F.first(error).alias("__error"))
    rows = rows.join(ends, keys)
    ok = F.col("__end").isNull() | (F.struct(*order) < F.col("__end"))
    return rows.withColumn("error", F.when(F.col("__end").isNotNull(), F.col("__error"))).where(ok).drop("__fmt", "__end", "__error")


def offset(audio_first_stamp: Column, video_first_stamp: Column, audio_first_log: Column, video_first_log: Column, time_source: Column, setting: Column) -> Column:
    """Audio's first time less video's, by the payload's clock if the video is timed by it, else by the log's, and the setting."""
    by_payload = F.coalesce((time_source == "payload_timestamp") & audio_first_stamp.isNotNull() & video_first_stamp.isNotNull(), F.lit(False))
    return F.when(by_payload, audio_first_stamp - video_first_stamp).otherwise(audio_first_log - video_first_log) + setting


def delays(offset: Column) -> tuple[Column, Column]:
    """Delays of audio and of video by an offset; a negative one delays the video."""
    return F.greatest(offset, F.lit(0)), F.greatest(-offset, F.lit(0))
