"""Runs, groups of pictures, durations and offsets along an order.

All go through ordered.Ordered: a key of more than `hot` rows (default ordered.HOT) is ordered in blocks by many tasks. Orders should be total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.functions.timing import LONE_FRAME, ticks

from .ordered import Ordered


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with right's columns, one row for each of the keys; nulls are equal."""
    named, on = right.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)}), F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return left.join(named, on).drop(*(f"__k{i}" for i in range(len(keys))))


def runs(df: DataFrame, keys: list[str], order: list[str], value: str, hot: int | None = None) -> DataFrame:
    """Run-length encoding: keys, run (from 1), value, n. Nulls are equal to each other."""
    scan = Ordered(df, keys, order, hot).neighbour(value, "__was", first="__first")
    scan.running(run=("sum", (F.col("__first") | ~F.col(value).eqNullSafe(F.col("__was"))).cast("long")))
    return scan.rows().groupBy(*keys, "run", value).agg(F.count("*").alias("n"))


def run_starts(df: DataFrame, keys: list[str], order: list[str], value: str, hot: int | None = None) -> DataFrame:
    """Only the rows whose value differs from the row before (as in a sample-to-chunk table)."""
    rows = Ordered(df, keys, order, hot).neighbour(value, "__was", first="__first").rows()
    return rows.where(F.col("__first") | ~F.col(value).eqNullSafe(F.col("__was"))).drop("__was", "__first")


def fill_forward(df: DataFrame, keys: list[str], order: list[str], value: str, hot: int | None = None) -> DataFrame:
    """value, where null, becomes the last one before (expands a sample-to-chunk table)."""
    rows = Ordered(df, keys, order, hot).running(__last=("last", F.col(value))).rows()
    return rows.withColumn(value, F.col("__last")).drop("__last")


def groups_of_pictures(df: DataFrame, keys: list[str], order: list[str], is_key: Column, hot: int | None = None) -> DataFrame:
    """keys, gop (from 1), n: rows from one key row up to the next; rows before the first and the open last group are left out."""
    rows = Ordered(df, keys, order, hot).running(gop=("sum", is_key.cast("long"))).rows().where("gop > 0")
    out = rows.groupBy(*keys, "gop").agg(F.count("*").alias("n"))
    return _joined(out, out.groupBy(*keys).agg(F.max("gop").alias("__last")), keys).where("gop < __last").drop("__last")


def drop_leading(df: DataFrame, keys: list[str], order: list[str], *needed: Column, hot: int | None = None) -> DataFrame:
    """Rows from the first on by which every condition has held (the first of them has to hold on that row itself)."""
    scan = Ordered(df, keys, order, hot)
    ready = needed[0]
    if needed[1:]:
        scan.running(**{f"__seen{i}": ("any", c) for i, c in enumerate(needed[1:])})
        for i in range(len(needed) - 1):
            ready = ready & F.col(f"__seen{i}")
    rows = scan.running(__on=("any", ready)).rows()
    return rows.where("__on").drop("__on", *(f"__seen{i}" for i in range(len(needed) - 1)))


def drop_at_seams(df: DataFrame, keys: list[str], part: str, order: list[str], is_key: Column, hot: int | None = None) -> DataFrame:
    """Parts after a key's first lose their rows before the first key row."""
    rows = Ordered(df, [*keys, part], order, hot).running(__on=("any", is_key)).rows()
    rows = _joined(rows, df.groupBy(*keys).agg(F.min(part).alias("__first")), keys)
    return rows.where(F.col("__on") | (F.col(part) == F.col("__first"))).drop("__on", "__first")


def sample_durations(df: DataFrame, keys: list[str], order: list[str], time: str, per_second: int, hot: int | None = None) -> DataFrame:
    """df with duration in ticks: to the next row, the last repeating the one before, a lone row LONE_FRAME."""
    rows = Ordered(df, keys, order, hot).neighbour(time, "__next", 1).neighbour(time, "__before").rows()
    step = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), ticks(F.col(b) - F.col(a), per_second))
    return rows.withColumn("duration", F.coalesce(step(time, "__next"), step("__before", time), F.lit(LONE_FRAME)).cast("long")).drop("__next", "__before")


def starts(df: DataFrame, keys: list[str], order: list[str], length: Column, name: str = "start", hot: int | None = None) -> DataFrame:
    """df with the sum of the lengths before each row."""
    rows = Ordered(df, keys, order, hot).running(before=True, **{name: ("sum", length)}).rows()
    return rows.withColumn(name, F.col(name).cast("long"))


def neighbours(df: DataFrame, keys: list[str], order: list[str], item: str, wrap: bool = True, hot: int | None = None) -> DataFrame:
    """df with next and previous item; wrap: the ends meet."""
    rows = Ordered(df, keys, order, hot).neighbour(item, "next", 1, "__end").neighbour(item, "previous", -1, "__begin").rows()
    if wrap:
        at = F.struct(*order)
        ends = df.groupBy(*keys).agg(F.min_by(F.struct(F.col(item).alias("v")), at).alias("__first"), F.max_by(F.struct(F.col(item).alias("v")), at).alias("__last"))
        rows = _joined(rows, ends, keys)
        rows = rows.withColumns({"next": F.when(F.col("__end"), F.col("__first.v")).otherwise(F.col("next")), "previous": F.when(F.col("__begin"), F.col("__last.v")).otherwise(F.col("previous"))}).drop("__first", "__last")
    return rows.drop("__end", "__begin")


def increasing(df: DataFrame, keys: list[str], order: list[str], value: str, hot: int | None = None) -> DataFrame:
    """keys, increasing: whether every value is larger than the one before; true for a lone row."""
    rows = Ordered(df, keys, order, hot).neighbour(value, "__was").rows()
    return rows.groupBy(*keys).agg(F.coalesce(F.bool_and(F.col(value) > F.col("__was")), F.lit(True)).alias("increasing"))
