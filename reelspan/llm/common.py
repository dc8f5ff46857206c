"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space bytes of every contract, and the word pattern they define.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="reelspan-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stash(df: DataFrame) -> DataFrame:
    """df written once as a Parquet table in the shared folder; compressed, so for wider rows than cut()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/reelspan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stashed = path
    return found


def unstash(df: DataFrame) -> None:
    """Removes a table that stash() gave, once nothing reads it any more; other tables stay."""
    if getattr(df, "_stashed", None):
        _drop(df.sparkSession, df._stashed)


def _drop(spark: SparkSession, path: str) -> None:
    """Removes a written table at the driver's end; a session that has stopped leaves it to the folder's owner."""
    if spark.sparkContext._jsc is not None:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def tagged(df: DataFrame) -> tuple[DataFrame, str]:
    """df with a key (string) of its own for each row, and the name of that column, which is longer than any of df's.

    The key is the row's place in its Parquet file, so that all reads agree on it; anything but a bare Parquet table is
    written first. Files are told apart by 64-bit hashes of their paths.
    """
    if not re.fullmatch(r"Relation \[.*\] parquet", df._jdf.queryExecution().analyzed().toString().strip()):
        df = stash(df)
    key = max([*df.columns, "row"], key=len) + "_"
    return df.select("*", F.concat_ws(":", F.hex(F.xxhash64("_metadata.file_path")), "_metadata.row_index").alias(key)), key


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)
