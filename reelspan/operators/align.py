"""Channels beside each other: by position with a tolerance, as-of, and what the first difference says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "i", hot: int | None = None) -> DataFrame:
    """df with the position, from 0, of each row in its key. hot: see ordered.Ordered."""
    return Ordered(df, keys, order, hot).running(**{name: ("sum", F.lit(1).cast("long"))}).rows().withColumn(name, F.col(name) - 1)


def pair_by_position(df: DataFrame, keys: list[str], channel: str, time: str, reference: str, others: list[str], ties: list[str] | None = None) -> DataFrame:
    """One row per (keys, channel of others, i): the i-th times of reference and channel, null where one has no i-th row."""
    rows = numbered(df.where(F.col(channel).isin(reference, *others)), [*keys, channel], [time, *(ties or [])])
    rows = rows.withColumn("channel", F.explode(F.when(F.col(channel) == reference, F.array(*map(F.lit, others))).otherwise(F.array(F.col(channel)))))
    side = lambda own: F.max(F.when((F.col("__c") == reference) == own, F.col(time)))
    return rows.withColumn("__c", F.col(channel)).groupBy(*keys, "channel", "i").agg(side(True).alias("reference_time"), side(False).alias("time"))


def first_mismatch(pairs: DataFrame, keys: list[str], tolerance: Column, period: Column) -> DataFrame:
    """Per keys: reason (time_base, tolerance, frame_count or null), i, channel and delta of the first row beyond tolerance, and counts.

    A first row that is more than ten periods off speaks of another time base.
    """
    delta = F.col("time") - F.col("reference_time")
    both = F.col("time").isNotNull() & F.col("reference_time").isNotNull()
    off = F.when(both & (F.abs(delta) > tolerance), F.struct("i", "channel", delta.alias("delta"), ((F.col("i") == 0) & (F.abs(delta) > 10 * period)).alias("base")))
    out = pairs.groupBy(*keys).agg(F.min(off).alias("m"), F.count("reference_time").alias("n_reference"), F.count("time").alias("n"), F.max((~both).cast("int")).alias("uneven"))
    reason = F.when(F.col("m.base"), "time_base").when(F.col("m").isNotNull(), "tolerance").when(F.col("uneven") == 1, "frame_count")
    return out.select(*keys, reason.alias("reason"), F.col("m.i").alias("i"), F.col("m.channel").alias("channel"), F.col("m.delta").alias("delta"), "n_reference", "n")


def apply_policy(reason: Column, policy: str) -> Column:
    """What strict, warn or trim make of a sync reason: ok, warned, trimmed or out_of_sync. Only frame counts can be trimmed."""
    bad = {"strict": F.lit("out_of_sync"), "warn": F.lit("warned"), "trim": F.when(reason == "frame_count", "trimmed").otherwise("out_of_sync")}[policy]
    return F.when(reason.isNull(), "ok").otherwise(bad)


def trim_to_shortest(df: DataFrame, keys: list[str], channel: str, order: list[str]) -> DataFrame:
    """Each channel's first rows, as many as the shortest channel of its keys has."""
    rows = numbered(df, [*keys, channel], order, "__i")
    least = df.groupBy(*keys, channel).agg(F.count("*").alias("__n")).groupBy(*keys).agg(F.min("__n").alias("__least"))
    if keys:
        rows = rows.join(least, keys)
    else:
        rows = rows.join(F.broadcast(least), F.col("__i") < F.col("__least"))  # one row
    return rows.where(F.col("__i") < F.col("__least")).drop("__i", "__least")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, ties: list[str] | None = None, name: str = "as_of", hot: int | None = None) -> DataFrame:
    """left with the value of right's last row at or before its time (null before the first); equal times count, ties break by ties.
    hot: see ordered.Ordered; a key's rows of both sides are ordered together, a hot key's in blocks."""
    order = [time, *(ties or [])]
    r = right.select(*keys, *order, F.lit(0).alias("__side"), F.struct(F.col(value).alias("v"), F.col(time).alias("t")).alias("__r"))
    rows = left.withColumn("__side", F.lit(1)).unionByName(r, allowMissingColumns=True)
    rows = Ordered(rows, keys, [time, "__side", *(ties or [])], hot).running(__near=("last", F.col("__r"))).rows().where("__side = 1")
    return rows.withColumn(name, F.col("__near.v")).withColumn(f"{name}_time", F.col("__near.t")).drop("__r", "__near", "__side")


def extrapolate(value: Column, since: Column, rate: Column, most: float = 0.6) -> Column:
    """A clock's reading `since` seconds after its anchor: no further than most seconds, at a rate."""
    return value + F.least(F.greatest(since, F.lit(0.0)), F.lit(most)) * rate


def locate(probes: DataFrame, parts: DataFrame, keys: list[str], position: str, start: str, duration: str, part: str, hot: int | None = None) -> DataFrame:
    """probes with part and offset: the part whose [start, start + duration) holds the position, clamped to the first and last part."""
    bounds = parts.groupBy(*keys).agg(F.max(F.col(start) + F.col(duration)).alias("__end"))
    clamped = probes.join(bounds, keys).withColumn("__p", F.least(F.greatest(F.col(position), F.lit(0)), F.col("__end")))
    found = as_of(clamped, parts.select(*keys, F.col(start).alias("__p"), F.struct(part, start).alias("__s")), keys, "__p", "__s", name="__at", hot=hot)
    return found.withColumn("part", F.col(f"__at.{part}")).withColumn("offset", F.col("__p") - F.col(f"__at.{start}")).drop("__p", "__end", "__at", "__at_time")
