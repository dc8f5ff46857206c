"""Playlists as tables (list, pos from 0, item): what is next, and inserting, removing and moving entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .align import numbered
from .ordered import Ordered

#: Play modes.
MODES = ("sequential", "repeat", "shuffle")


def step(index: Column, n: Column, mode: str, forward: bool = True, seed: int = 0, turn: Column | None = None) -> Column:
    """The index after (or before) `index` among n entries; null at the end of a sequential list, or for no entries.

    repeat wraps forward; backward stops at the first entry in every mode. shuffle takes any other entry, by a hash of seed, turn and index, or the only one there is.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if not forward:
        return F.when(n == 0, None).otherwise(F.greatest(index - 1, F.lit(0)))
    if mode == "shuffle":
        by = F.pmod(F.xxhash64(F.lit(seed), turn if turn is not None else F.lit(0), index), F.greatest(n - 1, F.lit(1)))
        return F.when(n == 0, None).when(n == 1, 0).otherwise(F.when(by >= index, by + 1).otherwise(by))
    end = F.lit(0) if mode == "repeat" else F.lit(None)
    return F.when(n == 0, None).when(index + 1 < n, index + 1).otherwise(end)


def previous_played(plays: DataFrame, keys: list[str], order: list[str], index: str, hot: int | None = None) -> DataFrame:
    """plays with back: the entry that was played before this one, which shuffle goes back to; null for the first. hot: see ordered.Ordered."""
    return Ordered(plays, keys, order, hot).neighbour(index, "back").rows()


def _numbered(rows: DataFrame, keys: list[str], order: list[str], hot: int | None) -> DataFrame:
    return numbered(rows, keys, order, "__n", hot).withColumn("pos", F.col("__n")).drop("__n", "__o", "__t")


def insert(items: DataFrame, new: DataFrame, keys: list[str], at: str = "at", hot: int | None = None) -> DataFrame:
    """items with each of new (keys, item, at) before the entry at that place; null or too large a place is the end, too small a one the start. Entries
    for one place come in the order of their items. hot: see ordered.Ordered."""
    old = items.withColumn("__o", F.col("pos")).withColumn("__t", F.lit(1))
    place = F.greatest(F.coalesce(F.col(at), F.lit((1 << 62))), F.lit(0)).cast("long")
    rows = old.unionByName(new.withColumn("__o", place).withColumn("__t", F.lit(0)).drop(at), allowMissingColumns=True)
    return _numbered(rows, keys, ["__o", "__t", "item"], hot)


def remove(items: DataFrame, gone: DataFrame, keys: list[str], hot: int | None = None) -> DataFrame:
    """items without the places of gone (keys, pos); places that aren't there change nothing. hot: see ordered.Ordered."""
    return _numbered(items.join(gone.select(*keys, "pos"), [*keys, "pos"], "left_anti"), keys, ["pos"], hot)


def move(items: DataFrame, moves: DataFrame, keys: list[str]) -> DataFrame:
    """items after at most one move (keys, src, dst) of each list: the entry at src is taken out and put in at dst. Places outside the list change nothing."""
    n = items.groupBy(*keys).agg(F.count("*").alias("__n"))
    ok = moves.join(n, keys).where("src >= 0 and dst >= 0 and src < __n and dst < __n and src <> dst").select(*keys, "src", "dst")
    rows = items.join(ok, keys, "left")
    inside = F.when(F.col("pos") == F.col("src"), F.col("dst")).when((F.col("src") < F.col("pos")) & (F.col("pos") <= F.col("dst")), F.col("pos") - 1).when((F.col("dst") <= F.col("pos")) & (F.col("pos") < F.col("src")), F.col("pos") + 1)
    return rows.withColumn("pos", F.coalesce(inside, F.col("pos")).cast("long")).drop("src", "dst")


def index_after_insert(index: Column, at: Column) -> Column:
    """Where the current entry is after an insertion at `at`."""
    return F.when(index >= at, index + 1).otherwise(index)


def index_after_remove(index: Column, gone: Column) -> Column:
    """Where the current entry is after a removal; -1 if it was removed."""
    return F.when(index == gone, -1).when(index > gone, index - 1).otherwise(index)
