"""Windows along an order that no task has to see whole keys for.

with_steps cuts the rows of a key into bins of the ordering column. Ordered is the general form, a segmented scan: where a key has more rows than
HOT, Spark range-partitions all rows by key and order, so that a hot key lies in many blocks of like size; windows run inside (key,
block). What a block passes on (its last or first value, its last non-null one, its sum, whether any row held) is one row, these rows alone are ordered
for each key, and each block gets what the ones before it add up to. All of these combine associatively, so blocks can lie anywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.shared import stash

#: Rows of a key up to which one task orders them.
HOT = 2_000_000
BIN = 86_400_000_000  # a day of microseconds


def bins(df: DataFrame, at: str, width: int = BIN) -> DataFrame:
    return df.withColumn("__bin", F.floor(F.col(at) / width))


def join_bins(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of table, one row for each (keys, __bin); nulls are equal."""
    named = table.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__bin").alias("__b"), *[c for c in table.columns if c not in [*keys, "__bin"]])
    on = F.col("__bin").eqNullSafe(F.col("__b"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(named, on).drop("__b", *(f"__k{i}" for i in range(len(keys))))


def with_steps(df: DataFrame, keys: list[str], order: list[str], value: str, step: Callable[[Column], Column], previous: str, running: str, width: int = BIN) -> DataFrame:
    """df with `previous`, the value of the row before in its key (null for the first), and `running`, the sum of step(previous) up to and with each row.

    One table of bins serves both: it holds each bin's first row, last value and sum of inner steps. step may use the row's columns.
    """
    rows = bins(df, order[0], width)
    inside = Window.partitionBy(*keys, "__bin").orderBy(*order)
    rows = rows.withColumn("__lag", F.lag(value).over(inside)).withColumn("__first", F.row_number().over(inside) == 1)
    rows = rows.withColumn("__in", F.when(F.col("__first"), 0).otherwise(step(F.col("__lag"))))
    rows = rows.withColumn("__cum", F.sum("__in").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    others = [c for c in df.columns if c not in keys]
    table = rows.groupBy(*keys, "__bin").agg(F.min_by(F.struct(*others), F.struct(*order)).alias("__row"), F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("__last"), F.sum("__in").alias("__sum"))
    by_bin = Window.partitionBy(*keys).orderBy("__bin")
    table = table.withColumn("__before", F.lag("__last").over(by_bin)["v"]).select(*keys, "__bin", "__row.*", "__before", "__sum")
    table = table.withColumn("__step", step(F.col("__before")))
    carried = F.coalesce(F.sum(F.col("__sum") + F.col("__step")).over(by_bin.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = join_bins(rows, table.select(*keys, "__bin", "__before", (carried + F.col("__step")).alias("__carried")), keys)
    rows = rows.withColumn(previous, F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__lag"))).withColumn(running, F.col("__carried") + F.col("__cum"))
    return rows.drop("__lag", "__first", "__in", "__cum", "__before", "__carried", "__bin")


def largest(df: DataFrame, keys: list[str]) -> int:
    """Rows of the key that has most of them."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


class Ordered:
    """df's rows in order within their keys; null keys are a key. The order should be total: rows that tie come in any order.

    Each step adds columns; rows() gives the result. hot: the number of rows of a key beyond which rows are cut into blocks (0: always).
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], hot: int | None = None):
        self.keys, self.order = list(keys), list(order)
        hot = HOT if hot is None else hot
        self.cut = not hot or largest(df, keys) > hot
        if self.cut:
            # written, so that every later reading sees the same blocks
            df = stash(df.repartitionByRange(*keys, *order).withColumn("__block", F.spark_partition_id()), "blocks")
        self.df, self.inner = df, [*self.keys, "__block"] if self.cut else self.keys

    def rows(self) -> DataFrame:
        return self.df.drop("__block")

    def _inside(self):
        return Window.partitionBy(*self.inner).orderBy(*self.order)

    def _carried(self, told: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
        """One row a block: what its rows tell, and what the blocks before or after it pass on."""
        table = self.df.groupBy(*self.inner).agg(*[c.alias(n) for n, c in told.items()])
        return table.select(*self.inner, *[c.alias(n) for n, c in carry.items()])

    def _join(self, rows: DataFrame, table: DataFrame) -> DataFrame:
        named = table.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(self.inner)})
        on = F.lit(True)
        for i, k in enumerate(self.inner):
            on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        return rows.join(named, on).drop(*(f"__k{i}" for i in range(len(self.inner))))

    def neighbour(self, value: str | Column, name: str, step: int = -1, first: str | None = None) -> Ordered:
        """name: the value of the row before (step -1) or after (1), null without one. first: a boolean column for rows without one."""
        value = F.col(value) if isinstance(value, str) else value
        held, w = F.struct(value.alias("v")), self._inside()
        rows = self.df.withColumn("__near", (F.lag if step < 0 else F.lead)(held).over(w))
        if self.cut:
            pick, beside = (F.max_by, F.lag) if step < 0 else (F.min_by, F.lead)
            by_block = Window.partitionBy(*self.keys).orderBy("__block")
            table = self._carried({"__edge": pick(held, F.struct(*self.order))}, {"__over": beside("__edge").over(by_block)})
            rows = self._join(rows, table).withColumn("__near", F.coalesce("__near", "__over")).drop("__over")
        if first:
            rows = rows.withColumn(first, F.col("__near").isNull())
        self.df = rows.withColumn(name, F.col("__near")["v"]).drop("__near")
        return self

    def running(self, before: bool = False, **columns: tuple[str, Column]) -> Ordered:
        """Columns of (kind, value) over the rows up to each one; before: without the row itself. Kinds: sum (0 for none), any (false for none), max, min, and
        last (the last value that isn't null)."""
        w = self._inside().rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        over = {"sum": lambda v: F.sum(v), "any": lambda v: F.bool_or(v), "max": lambda v: F.max(v), "min": lambda v: F.min(v), "last": lambda v: F.last(v, ignorenulls=True)}
        joined = {
            "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "any": lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)),
            "max": F.greatest, "min": F.least, "last": lambda a, b: F.coalesce(b, a),
        }
        self.df = self.df.withColumns({f"__v_{n}": v for n, (_, v) in columns.items()})
        rows = self.df.withColumns({f"__in_{n}": over[kind](F.col(f"__v_{n}")).over(w) for n, (kind, _) in columns.items()})
        if self.cut:
            last = lambda v: F.max_by(v, F.when(v.isNotNull(), F.struct(*self.order)))
            earlier = Window.partitionBy(*self.keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
            told = {f"__t_{n}": last(F.col(f"__v_{n}")) if kind == "last" else over[kind](F.col(f"__v_{n}")) for n, (kind, _) in columns.items()}
            rows = self._join(rows, self._carried(told, {f"__c_{n}": over[kind](F.col(f"__t_{n}")).over(earlier) for n, (kind, _) in columns.items()}))
        carried = lambda n: F.col(f"__c_{n}") if self.cut else F.lit(None)
        value = {n: joined[kind](carried(n), F.col(f"__in_{n}")) if self.cut or kind in ("sum", "any") else F.col(f"__in_{n}") for n, (kind, _) in columns.items()}
        self.df = rows.withColumns(value).drop(*(f"__{p}_{n}" for p in ("v", "in", "c") for n in columns))
        return self


def median(df: DataFrame, keys: list[str], value: str, hot: int | None = None) -> DataFrame:
    """keys, median (double): the exact median of a whole number, of the two middle ones their mean; keys without a value that isn't null are left out.

    A key of up to `hot` values is sorted in memory. Beyond, the median is selected: values are counted by their leading 16 bits, the bin of the middle
    rank is refined by the next 16, and so on, so that a task never holds more than bins, and each pass reads what is left of the bins.
    """
    hot = HOT if hot is None else hot
    rows = df.select(*keys, F.col(value).cast("long").alias("__v")).where("__v is not null")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    wide = sizes.where(F.col("__n") > hot)
    if wide.isEmpty():
        return rows.groupBy(*keys).agg(F.median("__v").alias("median")).where("median is not null")
    wide = stash(wide, "median")
    on = lambda a, b: _all(a[k].eqNullSafe(b[k]) for k in keys)
    few = rows.join(wide, on(rows, wide), "left_anti").groupBy(*keys).agg(F.median("__v").alias("median")).where("median is not null")
    n = F.col("__n")
    aims = wide.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor((n - 1) / 2).alias("rank")), F.struct(F.lit(1).alias("side"), F.floor(n / 2).alias("rank")))).alias("__a"))
    aims = aims.select(*keys, "__a.*").withColumn("bin", F.lit(0).cast("long"))
    for shift in (48, 32, 16, 0):
        named = aims.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "side", "rank", F.col("bin").alias("__bin"))
        same = _all(F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys))
        inside = same if shift == 48 else same & (F.shiftright("__v", shift + 16) == F.col("__bin"))
        bins = rows.join(named, inside).groupBy(*keys, "side", "rank", F.shiftright("__v", shift).alias("bin")).count()
        upto = F.sum("count").over(Window.partitionBy(*keys, "side").orderBy("bin"))
        bins = bins.withColumn("upto", upto).where("upto > rank and upto - count <= rank")
        aims = stash(bins.select(*keys, "side", (F.col("rank") - F.col("upto") + F.col("count")).alias("rank"), "bin"), "median")
    return few.unionByName(aims.groupBy(*keys).agg(F.avg("bin").alias("median")))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
