"""Mixing sources to target weights by entropy balancing; DataFrame functions only.

Of all rates at which documents may be taken, entropy balancing seeks those nearest (in relative entropy) to taking each once, under one
token constraint for each source and no rate above MOST. A document's rate is then an exponential tilt, min(MOST, exp(lambda * size / mean)),
with one lambda for each source. Newton's method finds the lambdas: each step aggregates, over all documents (grouped by source and
size), how many words the present rates take and how fast that changes, and moves each source's lambda, by bisection where Newton's
step would leave the bracket; it ends when every source is within TOLERANCE of its target.
Rates become whole copies by systematic rounding along documents ordered by size, to the whole number below or above each; what is then
left of a source's target, at most about the words of one long document, is closed by a few documents that were rounded the other way,
long ones first: a histogram by size tells how many of each size fit into what is left.
Running sums need no task that sees a whole source: rows are summed by (source, size class, hash slot), a bounded number of cells, and
windows run over cells and inside a cell. Rates are whole numbers of 1/ONE, so that sums don't depend on the order of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, stash, unstash

#: Weights of the sources in code-point order, repeating; most copies of a document.
WEIGHTS, MOST = (5, 2, 1), 3
#: Newton steps at most (bisection alone would end sooner), and steps between two looks at what has converged; the share of a target that
#: it may be off (or one word); the bracket of lambdas; the parts that a rate of 1 has.
STEPS, LOOK, TOLERANCE, WIDEST, ONE = 120, 3, 1e-4, 1e6, 1 << 20
#: Size classes for each doubling, and hash slots of a class; passes that close what rounding leaves.
CLASSES, SLOTS, PASSES = 16, 256, 6


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """sources (source, source_size) with the column target.

    The total size is shared by weight; a target stops at `most` times its source's size and the excess is shared again
    among the rest by weight. That ends in least(cap, level * weight), with one level for all: sources sorted by the
    level at which they fill up give it from running sums. The windows see one row for each source.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("w", F.element_at(table, ((F.row_number().over(one) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", (most * F.col("source_size")).cast("double")).withColumn("total", F.sum("source_size").over(every).cast("double"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open", F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    # the first source, in order of filling up, that does not fill up at its own level sets the level of all later ones
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("at"), "level"))).over(every)["level"])
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def rate(size: Column, tilt: Column, mean: Column, full: Column) -> Column:
    """How often a document is taken, in parts of ONE."""
    e = F.exp(F.least(tilt * size / mean, F.lit(math.log(MOST) + 1)))
    return F.when(full, MOST * ONE).otherwise(F.least(F.lit(MOST * ONE), F.floor(e * ONE))).cast("long")


def solve(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """sources (source, source_size, target, mean) with tilt and full, by Newton steps over sizes (source, size, n: documents)."""
    exact = lambda c: c.cast("decimal(38,0)")
    state = sources.select("*", F.lit(0.0).alias("tilt"), F.lit(-WIDEST).alias("lo"), F.lit(WIDEST).alias("hi"), (F.col("target") >= MOST * F.col("source_size")).alias("full"))
    state = stash(state.withColumn("done", F.col("full") | (F.col("source_size") == 0)))

    def step(state: DataFrame) -> DataFrame:
        """One step for every source that isn't done."""
        at = state.where("not done").select(F.col("source").alias("s"), "tilt", "mean", "full")
        q = rate(F.col("size"), F.col("tilt"), F.col("mean"), F.col("full"))
        rows = sizes.join(at, F.col("source").eqNullSafe(F.col("s"))).withColumn("q", q)
        words = F.sum(exact(F.col("n") * F.col("size")) * F.col("q"))
        slope = F.sum(F.when(F.col("q") < MOST * ONE, exact(F.col("n") * F.col("size")) * F.col("size") * F.col("q")))
        found = rows.groupBy("s").agg((words.cast("double") / ONE).alias("words"), (slope.cast("double") / ONE / F.first("mean")).alias("slope"))
        new = state.join(found, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        off = F.col("words") - F.col("target")
        new = new.withColumn("done", F.col("done") | F.coalesce(F.abs(off) <= F.greatest(F.lit(1.0), TOLERANCE * F.col("target")), F.lit(True)))
        new = new.withColumn("hi", F.when(~F.col("done") & (off > 0), F.col("tilt")).otherwise(F.col("hi"))).withColumn("lo", F.when(~F.col("done") & (off <= 0), F.col("tilt")).otherwise(F.col("lo")))
        next_tilt = F.col("tilt") - F.try_divide(off, F.col("slope"))
        next_tilt = F.when((next_tilt > F.col("lo")) & (next_tilt < F.col("hi")), next_tilt).otherwise((F.col("lo") + F.col("hi")) / 2)
        new = new.withColumn("tilt", F.when(F.col("done"), F.col("tilt")).otherwise(next_tilt))
        # where no number lies between the ends of the bracket, no rate comes nearer
        return new.withColumn("done", F.col("done") | (F.col("tilt") <= F.col("lo")) | (F.col("tilt") >= F.col("hi"))).select(state.columns)

    for _ in range(0, STEPS, LOOK):
        if state.where("not done").isEmpty():
            return state
        new = state
        for _ in range(LOOK):
            new = step(new)
        new = stash(new)
        unstash(state)
        state = new
    if not state.where("not done").isEmpty():
        raise ArithmeticError(f"rates of some sources haven't come near their targets in {STEPS} steps")
    return state


def upto(rows: DataFrame, value: Column, name: str, ties: list[str], of: tuple[str, ...] = ("source",), cell: tuple[str, ...] = ("class", "slot")) -> DataFrame:
    """rows with `name`: the sum of value over the rows with the same `of` before this one, and its own, in order of the cells and, inside one, of size."""
    rows, keys = rows.withColumn("__v", value), [*of, *cell]
    cells = rows.groupBy(*[F.col(k).alias(f"c_{k}") for k in keys]).agg(F.sum("__v").alias("v"))
    before = Window.partitionBy(*[f"c_{k}" for k in of]).orderBy(*[f"c_{k}" for k in cell]).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("v").over(before), F.lit(0))).drop("v")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"c_{k}"))
    inside = Window.partitionBy(*keys).orderBy("size", *ties).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(cells, on).withColumn(name, F.col("before") + F.sum("__v").over(inside)).drop("__v", "before", *(f"c_{k}" for k in keys))


def fitting(sizes: DataFrame) -> DataFrame:
    """sizes (source, size, up, down: how many can be taken once more or once less, left: words wanted, or given up if negative) with up and down: how many
    are turned. Passes go from the largest size that fits down and take what fits, so that each at least halves what is left; then one that is too
    long is turned as well and others the other way, where that comes nearer. Windows see one row for each size of a source."""
    every, down = Window.partitionBy("source"), Window.partitionBy("source").orderBy(F.desc("size"))
    more = F.col("left") > 0
    rows = sizes.select("source", "size", more.alias("more"), F.abs("left").alias("want"), F.when(more, F.col("up")).otherwise(F.col("down")).alias("same"), F.when(more, F.col("down")).otherwise(F.col("up")).alias("other"))

    def passes(rows: DataFrame, pool: str, want: str, take: str) -> DataFrame:
        rows = rows.withColumn(take, F.lit(0).cast("long"))
        for _ in range(PASSES):
            free = F.when(F.col("size") <= F.col(want), F.col(pool) - F.col(take)).otherwise(F.lit(0))
            above = F.coalesce(F.sum(free * F.col("size")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            rows = rows.withColumn("now", F.least(free, F.greatest(F.lit(0), F.floor((F.col(want) - above) / F.col("size")))).cast("long"))
            rows = rows.withColumn(want, F.col(want) - F.sum(F.col("now") * F.col("size")).over(every)).withColumn(take, F.col(take) + F.col("now")).drop("now")
        return rows

    rows = passes(rows, "same", "want", "take")
    rows = rows.withColumn("long", F.min(F.when((F.col("size") > F.col("want")) & (F.col("same") > F.col("take")), F.col("size"))).over(every))
    rows = passes(rows.withColumn("over", F.coalesce(F.col("long") - F.col("want"), F.lit(0))), "other", "over", "give")
    nearer = F.col("long").isNotNull() & (F.col("over") < F.col("want"))
    take = F.col("take") + (nearer & (F.col("size") == F.col("long"))).cast("long")
    give = F.when(nearer, F.col("give")).otherwise(0)
    return rows.select("source", "size", F.when(F.col("more"), take).otherwise(give).alias("up"), F.when(F.col("more"), give).otherwise(take).alias("down"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, copies, rate (copies are the whole number below or above it).

    Null texts and texts without words have size 0 and are never taken. A null source is a source of its own, the last.
    Reruns agree: all choices depend on ids, sizes and sources only. Rows repeated with the same id are documents of
    their own. Other columns of df are ignored; an empty table gives an empty result. A source's taken words miss its target by what its
    documents' sizes leave open; one of a few long documents can miss by part of the shortest.
    row_col: a column of keys (string) of the rows themselves, put out as well.
    """
    row, ties = ([F.col(row_col).alias("row")], ["id", "row"]) if row_col else ([], ["id"])
    docs = stash(df.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), *row))
    sizes = stash(docs.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")))
    per_source = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.greatest(F.avg("size"), F.lit(1e-9)).alias("mean"))
    per_source = stash(per_source.withColumn("mean", F.round("mean", 6)))
    sources = targets(per_source.select("source", "source_size"))
    sources = sources.join(per_source.select(F.col("source").alias("s"), "mean"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    solved = solve(sizes, sources).select(F.col("source").alias("s_source"), "source_size", "target", "tilt", "mean", "full")
    slot = F.pmod(F.xxhash64("id", F.lit("slot")), F.lit(SLOTS))
    docs = docs.withColumn("class", F.floor(F.log2(F.col("size") + 1) * CLASSES)).withColumn("slot", slot).join(solved, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    docs = docs.withColumn("q", F.when(F.col("size") > 0, rate(F.col("size"), F.col("tilt"), F.col("mean"), F.col("full"))).otherwise(F.lit(0).cast("long")))
    whole = lambda c: F.shiftright(c + ONE // 2, ONE.bit_length() - 1)
    rows = upto(docs, F.col("q"), "to", ties)
    rows = rows.withColumn("copies", F.least(F.lit(MOST), whole(F.col("to")) - whole(F.col("to") - F.col("q"))).cast("long")).drop("to", "tilt", "mean", "full")
    rows = stash(rows)
    left = rows.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("words"))
    left = stash(left.select(F.col("source").alias("l_source"), F.bround(F.col("t") - F.col("words"), 0).cast("long").alias("left")))
    rows = rows.join(left, F.col("source").eqNullSafe(F.col("l_source"))).drop("l_source")
    # rounded down: one more is the number above the rate; rounded up: one less is the number below
    rows = rows.withColumn("turn", F.when(F.col("copies") * ONE < F.col("q"), 1).when(F.col("copies") * ONE > F.col("q"), -1))
    sizes = rows.where("turn is not null").groupBy("source", "size").agg(F.count_if(F.col("turn") == 1).alias("up"), F.count_if(F.col("turn") == -1).alias("down"), F.first("left").alias("left"))
    turned = fitting(sizes).where("up > 0 or down > 0").select(F.col("source").alias("f_source"), F.col("size").alias("f_size"), "up", "down")
    rows = rows.join(turned, F.col("source").eqNullSafe(F.col("f_source")) & (F.col("size") == F.col("f_size")), "left").drop("f_source", "f_size")
    rows = rows.withColumn("most", F.coalesce(F.when(F.col("turn") == 1, F.col("up")).when(F.col("turn") == -1, F.col("down")), F.lit(0)))
    rows = upto(rows, F.when(F.col("most") > 0, 1).otherwise(0), "nth", ties, ("source", "size", "turn"), ("slot",))
    rows = rows.withColumn("copies", (F.col("copies") + F.when((F.col("most") > 0) & (F.col("nth") <= F.col("most")), F.col("turn")).otherwise(0)).cast("long"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", taken, "copies", (F.col("q") / ONE).alias("rate"), *[F.col("row").alias(row_col) for _ in row])
