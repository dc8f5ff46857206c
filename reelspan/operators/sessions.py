"""Sessions: cuts at gaps, and the ladder of reasons why two neighbouring parts are joined or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions.text import list_key

from .ordered import BIN, with_steps


def sessionize(df: DataFrame, keys: list[str], time: str, max_gap: int, ties: list[str] | None = None, name: str = "session", width: int = BIN) -> DataFrame:
    """df with a session number from 1 in each key: a row begins one if it comes more than max_gap after the row before.

    time is an integer column; rows without a time are in no session (null). Null keys are keys of their own.
    """
    order = [time, *(ties or [])]
    new = lambda previous: F.coalesce(F.col(time) - previous > max_gap, F.lit(True)).cast("long")
    rows = with_steps(df.where(F.col(time).isNotNull()), keys, order, time, new, "__previous", name, width).drop("__previous")
    return rows.unionByName(df.where(F.col(time).isNull()).withColumn(name, F.lit(None).cast("long")))


def roll_up(sessions: DataFrame, keys: list[str], time: str, name: str = "session") -> DataFrame:
    """Rows, first and last time of each session."""
    return sessions.where(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))


def join_reason(same_folder: Column, has_video: Column, same_topics: Column, same_codec: Column, gap: Column, period: Column, most_seconds: float = 2.0, tolerance: float = 1.5, per_second: int = 1_000_000_000) -> Column:
    """Why a part follows the one before. gap: from its last to this first frame, in units of which a second has per_second.

    A gap is continuous from half a period to 1 + tolerance periods if it also is most_seconds at most.
    """
    frames = gap / period
    return (
        F.when(~same_folder, "different_folder").when(~has_video, "no_video").when(~same_topics, "topics_differ").when(~same_codec, "codec_differs")
        .when(F.coalesce(period, F.lit(0)) <= 0, "period_unknown").when(gap < 0, "time_backwards").when(frames < 0.5, "overlap")
        .when((frames > 1 + tolerance) | (gap > most_seconds * per_second), "gap_too_large").otherwise("continuous")
    )


def worst_topic(topics: DataFrame, keys: list[str], topic: str = "topic", reason: str = "reason", gap: str = "gap") -> DataFrame:
    """Of the reasons by topic the first, in topic order, that isn't continuous, and the first topic's gap."""
    bad = F.min(F.when(F.col(reason) != "continuous", F.struct(topic, reason)))[reason]
    return topics.groupBy(*keys).agg(F.coalesce(bad, F.lit("continuous")).alias(reason), F.min_by(gap, topic).alias(gap))


def override(df: DataFrame, pairs: DataFrame, folder: str, previous: str, name: str, reason: str = "reason") -> DataFrame:
    """df with reasons overridden by pairs (folder, a, b, kind): split always wins, join turns a refusal into manual_join."""
    p = pairs.groupBy(F.col("folder").alias("__f"), F.col("a").alias("__a"), F.col("b").alias("__b")).agg(F.max((F.col("kind") == "split").cast("int")).alias("__s"), F.max((F.col("kind") == "join").cast("int")).alias("__j"))
    rows = df.join(p, (F.col(folder) == F.col("__f")) & (F.col(previous) == F.col("__a")) & (F.col(name) == F.col("__b")), "left")
    forced = F.when(F.col("__s") == 1, "manual_split").when((F.col("__j") == 1) & (F.col(reason) != "continuous"), "manual_join").otherwise(F.col(reason))
    return rows.withColumn(reason, forced).drop("__f", "__a", "__b", "__s", "__j")


def detect(parts: DataFrame, overrides: DataFrame, most_seconds: float = 2.0, tolerance: float = 1.5) -> DataFrame:
    """Sessions of file parts: one row per part with session, part_index, part_count, session_key, origin, reason, gap_frames, title.

    parts: folder, name, first_ns (null without video), tracks: array of (topic, first_ns, last_ns, period_ns, codec), one for each video topic.
    Parts of a folder are ordered by start (null last), then name. A part joins the one before if both have the same topics and
    codecs and every topic goes on; of topics that don't, the first in order gives the reason. A topic's period is the earlier part's or, where
    that is unknown or 0, its own. gap_frames is the failing topic's, of continuous parts the first topic's. Only names, starts and tracks of a
    folder's parts are ordered, and a session's ends and key are aggregated once and joined back.
    """
    w = Window.partitionBy("folder").orderBy(F.col("first_ns").asc_nulls_last(), "name")
    none = F.array().cast(parts.schema["tracks"].dataType)
    rows = parts.withColumn("previous", F.lag("name").over(w)).withColumn("__before", F.coalesce(F.lag("tracks").over(w), none))
    by_topic = lambda c: F.array_sort(F.coalesce(c, none), lambda a, b: F.when(a["topic"] < b["topic"], -1).when(a["topic"] > b["topic"], 1).otherwise(0))
    old, new = by_topic(F.col("__before")), by_topic(F.col("tracks"))
    pairs = F.zip_with(old, new, lambda a, b: F.struct(a["topic"].alias("topic"), (b["first_ns"] - a["last_ns"]).alias("gap"), F.coalesce(F.nullif(a["period_ns"], F.lit(0)), b["period_ns"]).cast("double").alias("period"), a["codec"].eqNullSafe(b["codec"]).alias("same")))
    names = lambda c: F.transform(c, lambda x: x["topic"])
    rows = rows.withColumn("__same", names(old) == names(new)).withColumn("__pairs", F.when(F.col("__same"), pairs))
    video = (F.size(old) > 0) & (F.size(new) > 0)
    own = F.transform("__pairs", lambda p: F.struct(p["gap"].alias("gap"), p["period"].alias("period"), join_reason(F.lit(True), F.lit(True), F.lit(True), F.lit(True), p["gap"], p["period"], most_seconds, tolerance).alias("reason")))
    rows = rows.withColumn("__codec", F.forall("__pairs", lambda p: p["same"])).withColumn("__first", F.coalesce(F.get(F.filter(own, lambda p: p["reason"] != "continuous"), F.lit(0)), F.get(own, F.lit(0))))
    reason = F.when(~video, "no_video").when(~F.col("__same"), "topics_differ").when(~F.col("__codec"), "codec_differs").otherwise(F.col("__first.reason"))
    rows = rows.withColumn("reason", F.when(F.col("previous").isNotNull(), reason))
    gap = F.when(F.col("reason").isin("time_backwards", "overlap", "gap_too_large", "continuous"), F.bround(F.col("__first.gap") / F.col("__first.period"), 4))
    rows = override(rows.withColumn("gap_frames", gap).drop("__before", "__pairs", "__same", "__codec", "__first"), overrides, "folder", "previous", "name")
    starts = (~F.coalesce(F.col("reason").isin("continuous", "manual_join"), F.lit(False))).cast("long")
    rows = rows.withColumn("session", F.sum(starts).over(w))
    order = Window.partitionBy("folder", "session").orderBy(F.col("first_ns").asc_nulls_last(), "name")
    rows = rows.withColumn("part_index", F.row_number().over(order))
    listed = F.array_sort(F.collect_list(F.struct("part_index", "name")))
    manual = F.max(((F.col("reason") == "manual_join") & (F.col("part_index") > 1)).cast("int"))
    of = rows.groupBy(F.col("folder").alias("__f"), F.col("session").alias("__s")).agg(F.count("*").alias("part_count"), F.transform(listed, lambda x: x["name"]).alias("__names"), F.when(manual == 1, "manual").otherwise("auto").alias("origin"))
    stem = lambda n: F.regexp_replace(n, r"(?<=.)\.[^.]*$", "")
    title = F.when(F.col("part_count") > 1, F.concat_ws("~", stem(F.element_at("__names", 1)), stem(F.element_at("__names", -1)))).otherwise(stem(F.element_at("__names", 1)))
    of = of.select("__f", "__s", "part_count", list_key(F.col("__names")).alias("session_key"), title.alias("title"), "origin")
    return rows.join(of, F.col("folder").eqNullSafe(F.col("__f")) & (F.col("session") == F.col("__s"))).drop("__f", "__s")


def session_durations(detected: DataFrame) -> DataFrame:
    """folder, session, parts, duration_s of detected parts: from the first part's start to the last part's end and one period, by the first
    part's first topic in order; where the last part lacks it, that of the first part."""
    topic = lambda c: F.get(F.array_sort(c, lambda a, b: F.when(a["topic"] < b["topic"], -1).when(a["topic"] > b["topic"], 1).otherwise(0)), F.lit(0))
    ends = detected.groupBy("folder", "session").agg(F.count("*").alias("parts"), topic(F.min_by("tracks", "part_index")).alias("a"), F.max_by("tracks", "part_index").alias("z"))
    last = F.coalesce(F.get(F.filter("z", lambda x: x["topic"] == F.col("a.topic")), F.lit(0)), F.col("a"))
    return ends.select("folder", "session", "parts", ((last["last_ns"] - F.col("a.first_ns") + F.coalesce(last["period_ns"], F.lit(0))) / 1e9).alias("duration_s"))


def probe_limit(messages: DataFrame, key: str, order: list[str], most: int = 2_000) -> DataFrame:
    """The first `most` messages of each file."""
    return messages.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def recordings(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, parts, duration_s, has_audio, cameras of recordings' parts (part_index, duration_s, has_audio, cameras: array); cameras are counted in the first."""
    return parts.groupBy(*keys).agg(F.count("*").alias("parts"), F.sum("duration_s").alias("duration_s"), F.bool_or("has_audio").alias("has_audio"), F.size(F.min_by("cameras", "part_index")).alias("cameras"))
