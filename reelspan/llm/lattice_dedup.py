"""Near-duplicate vectors by lattice hashing, their links and the components of these.

Equal vectors form one class. In each of several tables a class's unit vector goes through a random projection to eight dimensions and
is decoded to its nearest point of the lattice E8, its home cell; it also visits the nearest neighbouring cells of that point. Classes
that meet in a cell are compared by cosine in double precision. Only cells that are somebody's home and hold two classes are kept.

1. A cell's classes are dealt into slots of at most SLOT or so; each slot's task puts out a spanning tree of its links, so links
   never turn into all their pairs. In a cell of several slots the classes that don't belong to its largest component yet then meet
   all of its slots, block by block, so that no link between components is lost.
2. Links are counted inside components, where every pair counts that reaches the threshold, whatever cells it met in. Components of up
   to SLOT classes are compared in one go. In a larger one the classes within half the threshold's angle of its mean direction (its
   core) are all linked by the triangle inequality and aren't compared; blocks of the others meet blocks of all.

Vectors travel with the rows of kept cells alone. `width` scales the projection: at finer (smaller) widths cells hold fewer strangers
and a near copy changes its cell more often, so that more tables or visits are needed for the same recall.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, tagged
from .jaccard_join import components
from .window_dedup import _mix

COSINE, TABLES, VISITS, WIDTH, SEED = 0.93, 6, 8, 1.0, 11
#: Classes of a slot, of a block and of a component that is compared in one go.
SLOT = 1024
#: Unit vectors are summed as integers of so many fractional bits, so that a mean doesn't depend on the order of its rows.
BITS = 30


def shortest() -> np.ndarray:
    """The shortest vectors of E8: two entries of 1 or -1, or halves with an even number of minus signs."""
    pairs = [np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    return np.array(pairs + [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0])


def _even(y: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: where rounding gives an odd one, the entry that was rounded furthest goes the other way."""
    r = np.rint(y)
    odd = np.flatnonzero(r.sum(1) % 2)
    far = np.abs(y[odd] - r[odd]).argmax(1)
    r[odd, far] += np.where(y[odd, far] >= r[odd, far], 1, -1)
    return r


def nearest(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8, which is the integer points with an even sum and the same moved by half a unit in each entry."""
    a, b = _even(y), _even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; by their largest entry first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    return np.array(column.flatten()).reshape(len(column), -1)


def _cells(tables: int, visits: int, width: float, seed: int):
    """Home and visited cells of each class: (cell, c, home)."""
    steps = shortest()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("x").value_lengths().to_numpy()
            for d in np.unique(sizes).tolist():
                part = b.filter(pa.array(sizes == d))
                c, label, u = part.column("c").to_numpy(), part.column("h").to_numpy().view(np.uint64), units(_matrix(part.column("x")))
                for t in range(tables):
                    rng = np.random.default_rng([seed, t, d])
                    y = u @ (rng.standard_normal((d, 8)) / width) + rng.random(8)
                    home = nearest(y)
                    closest = np.argsort(-((y - home) @ steps.T), axis=1, kind="stable")[:, :visits]
                    points = np.concatenate([home[:, None], home[:, None] + steps[closest]], 1)
                    key = np.repeat(_mix(label ^ np.uint64(t * 1_000_003 + d))[:, None], visits + 1, 1)
                    for k in range(8):
                        key = _mix(key + (2 * points[:, :, k]).astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k))
                    first = np.zeros(key.shape, bool)
                    first[:, 0] = True
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(c, visits + 1)), pa.array(first.ravel())], ["cell", "c", "home"])

    return task


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The runs of rows with equal first columns, of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy() for k in range(keys)]
        cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            now = tuple(c[lo] for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(b.slice(lo, hi - lo))
            last = now
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _alike(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    return a @ b.T >= cosine


def _trees(cosine: float, keys: int):
    """Spanning trees of the links among each group's classes of one label and length: (a, b), a the least that b reaches there."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, keys):
            if g.num_rows < 2:
                continue
            kind = list(zip(g.column("label").to_pylist(), g.column("x").value_lengths().to_pylist()))
            for one in dict.fromkeys(kind) if len(set(kind)) > 1 else kind[:1]:
                part = g.filter(pa.array([k == one for k in kind]))
                c, first = np.unique(part.column("c").to_numpy(), return_index=True)
                if len(c) < 2:
                    continue
                u = units(_matrix(part.column("x").take(pa.array(first))))
                linked, left = _alike(u, u, cosine), np.ones(len(c), bool)
                if linked.sum() <= len(c):
                    continue
                a, b = [], []
                for root in range(len(c)):
                    if not left[root]:
                        continue
                    left[root] = False
                    todo = [root]
                    while len(todo):
                        todo = np.flatnonzero(linked[todo].any(0) & left)
                        left[todo] = False
                        a += [c[root]] * len(todo)
                        b += c[todo].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return task


def _within(cosine: float):
    """Links of each class of a component (of one label and length) to its other classes, repeated vectors counted: (c, links)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, 1):
            u, n = units(_matrix(g.column("x"))), g.column("n").to_numpy()
            linked = _alike(u, u, cosine)
            np.fill_diagonal(linked, False)
            yield pa.RecordBatch.from_arrays([g.column("c"), pa.array(linked @ n)], ["c", "links"])

    return task


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of unit vectors by component, as integers: (comp, s)."""
    for b in batches:
        if b.num_rows:
            comps, at = np.unique(b.column("comp").to_numpy(), return_inverse=True)
            sizes = b.column("x").value_lengths().to_numpy()
            for d in np.unique(sizes):
                pick = np.flatnonzero(sizes == d)
                total = np.zeros((len(comps), d), np.int64)
                np.add.at(total, at[pick], np.rint(units(_matrix(b.column("x").take(pa.array(pick)))) * (1 << BITS)).astype(np.int64))
                own = np.unique(at[pick])
                yield pa.RecordBatch.from_arrays([pa.array(comps[own]), pa.array(list(total[own]), pa.list_(pa.int64()))], ["comp", "s"])


def _core(cosine: float):
    """Marks the classes within half the threshold's angle of their component's mean direction."""
    near = math.cos(math.acos(cosine) / 2 - 1e-9) + 1e-12 if cosine < 1 else 2.0

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            core = [bool(np.any(m)) and float(units(np.array([x]))[0] @ units(np.array([m], float))[0]) >= near for x, m in zip(b.column("x").to_pylist(), b.column("mean").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("comp"), b.column("c"), b.column("n"), b.column("x"), pa.array(core, pa.bool_())], ["comp", "c", "n", "x", "core"])

    return task


def _across(cosine: float):
    """Over groups of a block of outer classes and a slot of all: links of the outer ones to others, and of core ones to outer: (c, links)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, 3):
            side, c, n = g.column("side").to_numpy(), g.column("c").to_numpy(), g.column("n").to_numpy()
            u, core = units(_matrix(g.column("x"))), g.column("core").to_numpy(zero_copy_only=False)
            i, j = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            linked = _alike(u[i], u[j], cosine) & (c[i][:, None] != c[j][None, :])
            back = core[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([c[i], c[j][back]])), pa.array(np.concatenate([linked @ n[j], n[i] @ linked[:, back]]))], ["c", "links"])

    return task


def _usable(column: str) -> F.Column:
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def links(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, tables: int = TABLES,
          visits: int = VISITS, width: float = WIDTH, seed: int = SEED, slot: int = SLOT) -> DataFrame:
    """One row per row of df: id, n_links (other rows linked to it), component_id (smallest id reachable by links) and kept (they are equal).

    Rows are linked if their labels are equal and not null, their vectors have one length and the cosine, in double precision, reaches the
    threshold. Vectors that are null, empty or zero, or that hold null or non-finite components, are linked with nothing, as are rows
    without a label. Repeated rows count as other rows. A null id loses against any other one; a component of null ids alone has a null
    id and is kept. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    rows, _ = tagged(df)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    classes = rows.where(F.col("label").isNotNull() & _usable("x")).groupBy("label", "x").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    classes = stash(classes.withColumn("c", F.monotonically_increasing_id()))
    cells = classes.select("c", F.xxhash64("label").alias("h"), "x").mapInArrow(_cells(tables, visits, width, seed), "cell long, c long, home boolean")
    slots = lambda n: F.ceil(F.col(n) / slot).cast("int")
    deal = lambda many: F.pmod(F.xxhash64("c"), many).cast("int")
    busy = cells.groupBy("cell").agg(F.count("*").alias("m"), F.max("home").alias("home")).where("m > 1 AND home").select("cell", slots("m").alias("slots"))
    met = stash(cells.select("cell", "c").join(busy, "cell"))
    vectors = classes.select("c", "label", "x")

    def trees(met: DataFrame, *keys: str) -> DataFrame:
        dealt = met.join(vectors, "c").select(*keys, "c", "label", "x").repartition(*keys).sortWithinPartitions(*keys)
        return dealt.mapInArrow(_trees(cosine, len(keys)), "a long, b long").distinct()

    edges = stash(trees(met.withColumn("slot", deal(F.col("slots"))), "cell", "slot"))
    labels = components(edges, edges.count())
    wide = met.where("slots > 1").join(labels.withColumnRenamed("k", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    main = wide.groupBy("cell", "label").count().groupBy("cell").agg(F.max(F.struct("count", "label"))["label"].alias("main"), F.sum("count").alias("m"), F.max("count").alias("most"))
    main = main.where("m > most").select("cell", "main", slots("m").alias("slots"), F.ceil((F.col("m") - F.col("most")) / slot).cast("int").alias("blocks"))
    wide = stash(wide.drop("slots").join(main, "cell"))
    if not wide.isEmpty():
        each = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
        apart = wide.where("label <> main").select("cell", each("slots").alias("slot"), deal(F.col("blocks")).alias("block"), "c")
        whole = wide.select("cell", deal(F.col("slots")).alias("slot"), each("blocks").alias("block"), "c")
        edges = stash(edges.union(trees(apart.union(whole), "cell", "slot", "block")))
        labels = components(edges, edges.count())
    of = classes.join(labels.select(F.col("k").alias("c"), F.col("label").alias("comp")), "c")
    comps = of.groupBy("comp").agg(F.count("*").alias("m"), F.min("id").alias("least"))
    of = stash(of.join(comps, "comp").select("comp", "m", "least", "c", "n", "x"))
    few = of.where(F.col("m") <= slot).select("comp", "c", "n", "x").repartition("comp").sortWithinPartitions("comp")
    counted = few.mapInArrow(_within(cosine), "c long, links long").union(_large(of.where(F.col("m") > slot), cosine, slots, deal))
    found = counted.groupBy("c").agg(F.sum("links").alias("links"))
    found = classes.join(of.select("c", "least"), "c", "left").join(found, "c", "left")
    found = found.select("label", "x", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("least", "id").alias("least"), F.lit(True).alias("known"))
    out = rows.join(found, ["label", "x"], "left")
    component = F.when(F.col("known"), F.col("least")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _large(of: DataFrame, cosine: float, slots, deal) -> DataFrame:
    """Links in components of more than a slot: (c, links), of a core class in two rows."""
    sums = of.select("comp", "x").mapInArrow(_sums, "comp long, s array<long>").select("comp", F.posexplode("s").alias("at", "s")).groupBy("comp", "at").agg(F.sum(F.col("s").cast("decimal(20,0)")).cast("double").alias("s"))
    means = sums.groupBy("comp").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda v: v["s"]).alias("mean"))
    placed = stash(of.join(means, "comp").select("comp", "c", "n", "x", "mean").mapInArrow(_core(cosine), "comp long, c long, n long, x array<double>, core boolean"))
    sizes = placed.groupBy("comp").agg(F.sum(F.when(F.col("core"), F.col("n"))).alias("inside"), F.count("*").alias("m"), F.count_if(~F.col("core")).alias("o"))
    placed = placed.join(sizes.select("comp", "inside", slots("m").alias("slots"), slots("o").alias("blocks")), "comp")
    inside = placed.where("core").select("c", (F.col("inside") - F.col("n")).alias("links"))
    each = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    rest = placed.where("blocks > 0")
    outer = rest.where("NOT core").select("comp", each("slots").alias("slot"), deal(F.col("blocks")).alias("block"), F.lit(0).alias("side"), "c", "n", "core", "x")
    whole = rest.select("comp", deal(F.col("slots")).alias("slot"), each("blocks").alias("block"), F.lit(1).alias("side"), "c", "n", "core", "x")
    pairs = outer.union(whole).repartition("comp", "slot", "block").sortWithinPartitions("comp", "slot", "block")
    return inside.union(pairs.mapInArrow(_across(cosine), "c long, links long"))
