"""Checks of outputs: rules, overlaps, states, and what a manifest's claims are worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlapping(df: DataFrame, keys: list[str], order: list[str], start: str, end: Column, name: str = "overlapping") -> DataFrame:
    """df with whether a row starts before the end of the row before."""
    before = F.lag(end).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, F.coalesce(F.col(start) < before, F.lit(False)))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n: how many rows break each rule, counted in one pass; rules that nothing breaks are there with 0."""
    counts = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in rules])).alias("r")).select("r.rule", "r.n")


def failed_rules(rules: dict[str, Column]) -> Column:
    """Codes of the rules that a row breaks."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())


def output_state(existing: Column, expected: Column) -> Column:
    return F.when(F.coalesce(existing, F.lit(0)) == 0, "pending").when(existing == expected, "complete").otherwise("incomplete")


def done(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """source, done: whether the last record is final (success or skipped) and each of its outputs is there with the size it claims.

    manifest: source, line, status, outputs (array of path, bytes); files: path, size. Records without outputs are not done.
    """
    last = manifest.groupBy("source").agg(F.max_by(F.struct("status", "outputs"), "line").alias("r")).select("source", "r.status", "r.outputs")
    claims = last.select("source", "status", F.explode_outer("outputs").alias("o")).select("source", "status", F.col("o.path").alias("__p"), F.col("o.bytes").alias("__b"))
    held = claims.join(files.select(F.col("path").alias("__p"), "size"), "__p", "left")
    same = F.bool_and(F.coalesce(F.col("size") == F.col("__b"), F.lit(False)))
    return held.groupBy("source", "status").agg(same.alias("__same")).select("source", (F.col("status").isin("success", "skipped") & F.col("__same")).alias("done"))
