"""Which recordings belong together, which are covered, and what they are to be called."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions.text import camera_name


def uncovered(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key other doesn't have."""
    return df.join(other.select(key), key, "left_anti")


def covered(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key), key, "left_semi")


def member_sets(df: DataFrame, keys: list[str], member: str) -> DataFrame:
    """keys, members: each key's distinct members in order (members of a key are few: topics, sources)."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(member)).alias("members"))


def same_sets(left: DataFrame, right: DataFrame, left_key: str, right_key: str, member: str) -> DataFrame:
    """Pairs (left_key, right_key) with equal sets of members, whatever their order and repeats."""
    return member_sets(left, [left_key], member).join(member_sets(right, [right_key], member), "members").select(left_key, right_key)


def mismatched_topics(reference: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, part, topic) of a recording's reference (keys, topic, adapter) that one of its parts (keys, part, topic, adapter) lacks."""
    wanted = parts.select(*keys, "part").distinct().join(reference.select(*keys, "topic", "adapter").distinct(), keys)
    return wanted.join(parts, [*keys, "part", "topic", "adapter"], "left_anti").select(*keys, "part", "topic")


def extra_counts(reference: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, topic, messages: the messages, over all parts, of topics that the reference doesn't have."""
    return parts.join(reference, [*keys, "topic", "adapter"], "left_anti").groupBy(*keys, "topic").agg(F.sum("messages").alias("messages"))


def pair_outputs(files: DataFrame) -> DataFrame:
    """files (folder, stem, marker) with pairing and camera: by marker groups of two or more, else by camera names of two or more, else alone."""
    n = lambda *c: F.count("*").over(Window.partitionBy("folder", *c))
    prefix, digit = camera_name(F.col("stem"))
    rows = files.withColumn("__m", F.col("marker").isNotNull() & (n("marker") > 1)).withColumn("__p", F.when(~F.col("__m"), prefix))
    rows = rows.withColumn("__n", F.col("__p").isNotNull() & (n("__p") > 1))
    pairing = F.when(F.col("__m"), F.concat(F.lit("m:"), "marker")).when(F.col("__n"), F.concat(F.lit("n:"), "__p")).otherwise(F.concat(F.lit("s:"), "stem"))
    return rows.withColumn("camera", F.when(F.col("__n"), digit)).withColumn("pairing", pairing).drop("__m", "__p", "__n")


def unique_names(df: DataFrame, folder: str, order: str, name: str) -> DataFrame:
    """df's folder, order and name with `unique`: taken names get _2, _3 and so on, first come, first served, case ignored.

    Names can only meet if they are alike up to numbers at their ends (x, x_2, x_2_2). Where all names of such a family are one, they are numbered by
    a window over bins of equal names; other families are walked through in order, as a stream in each task.
    """
    cols = df.select(folder, order, name)
    rows = cols.withColumn("__low", F.lower(name)).withColumn("__root", F.regexp_replace(F.lower(name), r"(_\d+)+$", ""))
    mixed = rows.groupBy(folder, "__root").agg((F.min("__low") != F.max("__low")).alias("__mixed"))
    rows = rows.join(mixed.select(F.col(folder).alias("__f"), F.col("__root").alias("__r"), "__mixed"), F.col(folder).eqNullSafe(F.col("__f")) & F.col("__root").eqNullSafe(F.col("__r")))
    k = F.row_number().over(Window.partitionBy(folder, "__low").orderBy(order))
    plain = rows.where("not __mixed or __mixed is null").withColumn("unique", F.when(k == 1, F.col(name)).otherwise(F.concat_ws("_", name, k.cast("string"))))

    def walk(batches):
        key, taken, upto = None, set(), {}
        for b in batches:
            out = []
            for f, root, n in zip(b[folder], b["__root"], b[name]):
                if (f, root) != key:
                    key, taken, upto = (f, root), set(), {}
                low, now = n.lower(), n
                if low in taken:
                    at = upto.get(low, 1) + 1
                    while f"{low}_{at}" in taken:
                        at += 1
                    upto[low], now = at, f"{n}_{at}"
                taken.add(now.lower())
                out.append(now)
            yield b[[folder, order, name]].assign(unique=out)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema), "unique string"])
    hard = rows.where("__mixed").select(folder, order, name, "__root").repartition(folder, "__root").sortWithinPartitions(folder, "__root", order).mapInPandas(walk, schema)
    return plain.select(folder, order, name, "unique").unionByName(hard)


def recent(df: DataFrame, folder: str, time: str, most: int = 10) -> DataFrame:
    """The `most` folders used last, each once, the latest first."""
    return df.groupBy(folder).agg(F.max(time).alias(time)).orderBy(F.desc(time), folder).limit(most)


def by_path(df: DataFrame, path: str = "path") -> DataFrame:
    """df by lower-cased path, then path."""
    return df.orderBy(F.lower(path), path)


def listing(df: DataFrame, converted: str = "converted", title: str = "title") -> DataFrame:
    """Recordings: converted ones first, then by title, case ignored."""
    return df.orderBy(~F.col(converted), F.lower(title), title)


def chunk_order(df: DataFrame, first: bool = True) -> DataFrame:
    """Chunks by start, or by end from the last on."""
    return df.orderBy("start_ns", "offset") if first else df.orderBy(F.desc("end_ns"), F.desc("offset"))


def outputs(*folders: DataFrame) -> DataFrame:
    """The folders' work items in one table, by lower-cased relative path."""
    out = folders[0]
    for f in folders[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.orderBy(F.lower("rel"), "rel")


def distinct_in_order(df: DataFrame, value: str, order: str) -> DataFrame:
    """value, order: each value once, where it came first."""
    return df.groupBy(value).agg(F.min(order).alias(order)).orderBy(order)


def keep_with_ancestors(nodes: DataFrame, text: str) -> DataFrame:
    """nodes (path, value) that contain text, case ignored, in their path or value, and all nodes above these."""
    hit = nodes.where(F.lower(F.concat_ws(" ", "path", "value")).contains(text.lower()))
    steps = F.split("path", "/")
    above = hit.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))).alias("path")).distinct()
    return nodes.join(above, "path", "left_semi")
