"""Checks of MP4 files by their tracks (source mp4_tracks): the quick one by rules, the full one by digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quick(tracks: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """file, ok, failed (codes in order), frames, duration_s, keyframes, co64.

    expected: file, kind (vide or soun), nth (from 0, of that kind), samples. Video samples of a file without audio lie one after
    the other from the first to the last byte of the media data; with audio, samples and chunks lie within it and don't overlap.
    Tables are in each track's row; nothing is read from the media data.
    """
    t = tracks.where("error is null and kind in ('vide', 'soun')")
    before = F.transform("before", lambda x: x["track"])
    same = F.collect_list(F.struct("track", "kind")).over(_by_file())
    t = t.withColumn("before", F.filter(same, lambda x: (x["kind"] == F.col("kind")) & (x["track"] < F.col("track")))).withColumn("nth", F.size(before)).drop("before")
    t = t.where("kind = 'soun' or nth = 0")
    ends = F.transform(F.arrays_zip("offsets", "sizes"), lambda x: F.struct(x["offsets"].alias("lo"), (x["offsets"] + x["sizes"]).alias("hi")))
    total = F.aggregate("stts", F.lit(0).cast("long"), lambda a, x: a + x["count"])
    ticks = F.aggregate("stts", F.lit(0).cast("long"), lambda a, x: a + x["count"] * x["delta"])
    n = F.size("sizes")
    video = F.col("kind") == "vide"
    rules = [
        F.when(F.size("offsets") != n, F.when(video, "offsets_differ").otherwise("audio_chunks_differ")),
        F.when(video & (total != n), "stts_differs").when(~video & (ticks != F.col("samples")), "audio_length_differs"),
    ]
    if expected is not None:
        e = expected.select("file", "kind", "nth", F.col("samples").alias("wanted"))
        t = t.join(e, ["file", "kind", "nth"], "full")
        rules.append(F.when(F.col("track").isNull(), "audio_missing").when(F.col("wanted") != F.when(video, n).otherwise(F.col("samples")), F.when(video, "frames_differ").otherwise("audio_samples_differ")))
    t = t.withColumn("failed", F.array_compact(F.array(*rules))).withColumn("ranges", ends)
    files = t.groupBy("file").agg(
        F.flatten(F.collect_list("failed")).alias("failed"), F.array_sort(F.flatten(F.collect_list("ranges"))).alias("ranges"), F.count_if(F.col("kind") == "soun").alias("audio"),
        F.max(F.when(video, F.struct(F.size("sizes").alias("frames"), (ticks / F.col("timescale")).alias("duration_s"), "keyframes", "co64", F.col("ranges").alias("own"), "mdat_start", "mdat_end"))).alias("v"),
    )
    steps = lambda r: F.zip_with(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 2, F.greatest(F.size(r), F.lit(1))), lambda a, b: b["lo"] - a["hi"])
    own, every = F.col("v.own"), F.col("ranges")
    alone = F.array(
        F.when(F.element_at(own, 1)["lo"] < F.col("v.mdat_start"), "before_media"), F.when(F.element_at(own, -1)["hi"] != F.col("v.mdat_end"), "not_to_the_end"),
        F.when(F.exists(steps(own), lambda d: d != 0), "not_contiguous"),
    )
    mixed = F.array(F.when((F.element_at(every, 1)["lo"] < F.col("v.mdat_start")) | (F.array_max(F.transform(every, lambda x: x["hi"])) > F.col("v.mdat_end")), "outside_media"), F.when(F.exists(steps(every), lambda d: d < 0), "overlap"))
    empty = F.array().cast("array<string>")
    placed = F.when((F.col("v.frames") == 0) | F.array_contains("failed", "offsets_differ"), empty).when(F.col("audio") == 0, F.array_compact(alone)).otherwise(F.array_compact(mixed))
    files = files.withColumn("failed", F.array_sort(F.array_distinct(F.concat("failed", placed))))
    good = files.select("file", (F.size("failed") == 0).alias("ok"), "failed", "v.frames", "v.duration_s", "v.keyframes", "v.co64")
    bad = tracks.where("error is not null").select("file", F.lit(False).alias("ok"), F.array(F.lit("structure")).alias("failed"))
    return good.unionByName(bad, allowMissingColumns=True)


def _by_file():
    from pyspark.sql import Window

    return Window.partitionBy("file")


def full(written: DataFrame, read_back: DataFrame, source: DataFrame | None = None, keys: tuple[str, ...] = ("file", "track")) -> DataFrame:
    """keys, matches_written, matches_source: the digest read back from a file against the one of writing and, if given, of the source. A
    track that isn't there matches nothing."""
    rows = written.select(*keys, F.col("sha256").alias("w")).join(read_back.select(*keys, F.col("sha256").alias("r")), list(keys), "left")
    out = rows.withColumn("matches_written", F.coalesce(F.col("w") == F.col("r"), F.lit(False)))
    if source is not None:
        out = out.join(source.select(*keys, F.col("sha256").alias("s")), list(keys), "left").withColumn("matches_source", F.coalesce(F.col("s") == F.col("r"), F.lit(False)))
    return out.drop("w", "r", "s")
