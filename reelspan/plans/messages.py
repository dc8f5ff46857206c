"""Queries over camera and microphone messages that are built byte by byte from the event log and decoded again, and over the log as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.functions import payloads, timing
from reelspan.operators import continuity
from reelspan.plans.catalog import DAY, HOUR, events, query
from reelspan.shared import scratch


def _hex(n: Column) -> Column:
    return F.lpad(F.hex(n), 2, "0")


def _varint(n: Column | int) -> Column:
    """A protobuf varint of up to 35 bits in five bytes, whatever its value: readers take padded ones."""
    n = (F.lit(n) if isinstance(n, int) else n).cast("long")
    return F.unhex(F.concat(*[_hex(F.shiftright(n, 7 * i).bitwiseAND(127) + (128 if i < 4 else 0)) for i in range(5)]))


def _number(field: int, n: Column | int) -> Column:
    return F.concat(F.lit(bytes([field << 3])), _varint(n))


def _text(field: int, data: Column) -> Column:
    return F.concat(F.lit(bytes([field << 3 | 2])), _varint(F.octet_length(data)), data)


def _little(n: Column | int) -> Column:
    """Four bytes, the lowest first."""
    n = (F.lit(n) if isinstance(n, int) else n).cast("long")
    return F.unhex(F.concat(*[_hex(F.shiftright(n, 8 * i).bitwiseAND(255)) for i in range(4)]))


def _clock() -> tuple[Column, Column]:
    return F.floor(F.col("us") / 1_000_000), F.pmod(F.col("us"), F.lit(1_000_000)) * 1000


def _stamp() -> Column:
    seconds, nanos = _clock()
    return _text(1, F.concat(_number(1, seconds), _number(2, nanos)))


def _cut(data: Column, when: Column) -> Column:
    """data without its last byte, where it is to be damaged."""
    return F.when(when, F.substring(data, F.lit(1), F.octet_length(data) - 1)).otherwise(data)


@query("""
WITH e AS (SELECT *, CASE WHEN event_id % 10 = 5 THEN 'other' WHEN event_id % 2 = 0 THEN 'foxglove' ELSE 'ros2' END AS adapter, event_id % 7 = 0 AS cut FROM events),
g AS (SELECT *, adapter <> 'other' AND NOT cut AS good FROM e)
SELECT event_id, adapter, CASE WHEN good THEN CASE adapter WHEN 'foxglove' THEN 'h265' ELSE 'h264' END END AS format, CASE WHEN good THEN epoch_us(ts) END AS us, CASE WHEN good THEN props END AS payload, NOT good AS failed FROM g""")
def video_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as protobuf and CDR video messages: every seventh is cut short, every tenth is of an adapter that nobody knows."""
    k = F.col("event_id")
    adapter = F.when(k % 10 == 5, "other").when(k % 2 == 0, "foxglove").otherwise("ros2")
    data = F.encode(F.coalesce("props", F.lit("")), "UTF-8")
    proto = F.concat(_stamp(), _text(3, data), _text(4, F.lit(b"HEVC")))
    seconds, nanos = _clock()
    cdr = F.concat(F.lit(b"\0\1\0\0"), _little(seconds), _little(nanos), _little(4), F.lit(b"cam\0"), _little(5), F.lit(b"avc1\0\0\0\0"), _little(F.octet_length(data)), data)
    rows = events(spark, sf_dir).select("event_id", adapter.alias("adapter"), _cut(F.when(adapter == "ros2", cdr).otherwise(proto), k % 7 == 0).alias("data"))
    got = rows.select("event_id", "adapter", payloads.video_frame(F.col("adapter"), F.col("data")).alias("f"))
    return got.select("event_id", "adapter", "f.format", F.expr("f.stamp_ns div 1000").alias("us"), F.decode("f.payload", "UTF-8").alias("payload"), F.col("f.error").isNotNull().alias("failed"))


@query("""
WITH e AS (SELECT *, octet_length(encode(props)) AS n, CASE event_id % 9 WHEN 0 THEN 0 WHEN 1 THEN 44100 ELSE 16000 END AS hz, event_id % 3 AS ch, event_id % 11 = 0 AS cut FROM events),
g AS (SELECT *, hz > 0 AND ch > 0 AND NOT cut AS good FROM e)
SELECT event_id, CASE WHEN good THEN epoch_us(ts) END AS us, CASE WHEN good THEN 'pcm-s16' END AS format, CAST(CASE WHEN good THEN hz END AS INTEGER) AS rate, CAST(CASE WHEN good THEN ch END AS INTEGER) AS channels, CASE WHEN good THEN n // (2 * ch) END AS samples, NOT good AS failed FROM g""")
def audio_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as protobuf audio messages: some without a rate or channels, some cut short; samples leave out an incomplete last one."""
    k = F.col("event_id")
    data = F.encode(F.coalesce("props", F.lit("")), "UTF-8")
    message = F.concat(_stamp(), _text(2, data), _text(3, F.lit(b" PCM-S16 ")), _number(4, F.when(k % 9 == 0, 0).when(k % 9 == 1, 44_100).otherwise(16_000)), _number(5, k % 3))
    got = events(spark, sf_dir).select("event_id", payloads.audio_block(_cut(message, k % 11 == 0)).alias("a"))
    samples = continuity.whole_samples(F.octet_length("a.data"), F.col("a.channels") * 2)
    return got.select("event_id", F.expr("a.stamp_ns div 1000").alias("us"), "a.format", "a.rate", "a.channels", samples.alias("samples"), F.col("a.error").isNotNull().alias("failed"))


@query(f"""
WITH e AS (SELECT event_type, epoch_us(ts) AS us FROM events)
SELECT event_type, 'day' AS kind, us // {DAY} * {DAY} AS start_us, count(*) AS n FROM e GROUP BY ALL
UNION ALL SELECT event_type, 'sliding', (us // {6 * HOUR} - s) * {6 * HOUR}, count(*) FROM e, range(4) AS r(s) GROUP BY ALL""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream, counted in days and in days that slide by six hours. Each batch writes the counts as a whole, those of open windows too."""
    from reelspan.streaming import sessions as streams

    def counted(kind: str, slide: str | None) -> DataFrame:
        source = spark.read.parquet(f"{sf_dir}/events.parquet").schema
        stream = spark.readStream.schema(source).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("at", F.timestamp_micros(timing.epoch_us(F.col("ts"))))
        at = scratch(spark, "windows")
        out = streams.windows(stream, ["event_type"], "at", "1 day", slide)
        written = []

        def write(df: DataFrame, batch: int) -> None:
            df.write.mode("overwrite").parquet(f"{at}/{batch}")
            written.append(batch)

        out.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.schema(out.schema).parquet(f"{at}/{written[-1]}") if written else spark.createDataFrame([], out.schema)
        return rows.select("event_type", F.lit(kind).alias("kind"), F.unix_micros("start").alias("start_us"), "n")

    return counted("day", None).unionByName(counted("sliding", "6 hours"))
