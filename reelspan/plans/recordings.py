"""Queries over MCAP recordings that are written from the event log, one for each 30 days of it, and read back by way of their indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.operators import profile
from reelspan.plans.catalog import DAY, events, query
from reelspan.shared import scratch
from reelspan.sinks import mcap as sink
from reelspan.sources import mcap, mcap_index

BIN = 30 * DAY
_FILE = f"epoch_us(ts) // {BIN} AS bin"


def _written(spark: SparkSession, sf_dir: str, compression: str = "zstd") -> str:
    """The folder of the recordings: topics are event types, payloads properties."""
    folder = scratch(spark, "mcap")
    rows = events(spark, sf_dir).select(
        F.concat(F.floor(F.col("us") / BIN).cast("string"), F.lit(".mcap")).alias("output"), F.col("event_type").alias("topic"), (F.col("us") * 1000).alias("log_time_ns"),
        F.col("event_id").alias("sequence"), F.encode("props", "UTF-8").alias("data"), F.lit("Event").alias("schema_name"), F.lit("json").alias("message_encoding"),
    )
    sink.write_mcap(rows, folder, compression=compression, chunk_bytes="65536")
    return folder


def _index(spark: SparkSession, sf_dir: str, compression: str = "zstd") -> DataFrame:
    return mcap_index.current(spark, _written(spark, sf_dir, compression), scratch(spark, "mcap-index"))


def _bin() -> F.Column:
    return F.regexp_extract("file", r"(-?\d+)\.mcap$", 1).cast("long").alias("bin")


def _us(column: str) -> F.Column:
    return F.expr(f"{column} div 1000")


@query("SELECT event_type AS topic, count(*) AS messages, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM events GROUP BY event_type")
def mcap_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of all messages, profiled by topic."""
    times = mcap_index.messages(_index(spark, sf_dir), columns=["topic", "log_time_ns"])
    found = profile.topic_profile(times, [], "topic", "log_time_ns", 1_000_000_000)
    return found.select("topic", "messages", _us("first").alias("first_us"), _us("last").alias("last_us"))


@query(f"SELECT {_FILE}, event_type AS topic, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us, true AS few FROM events GROUP BY ALL")
def topic_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last time of each topic of each recording; of long recordings, a part of the chunks is opened alone."""
    few = (F.col("chunks") < 12) | (F.col("opened") < F.col("chunks"))
    return mcap_index.topic_times(_index(spark, sf_dir)).select(_bin(), "topic", _us("first_ns").alias("first_us"), _us("last_ns").alias("last_us"), few.alias("few"))


@query(f"""
WITH a AS (SELECT {_FILE}, event_type AS topic, row_number() OVER (PARTITION BY epoch_us(ts) // {BIN}, event_type ORDER BY ts, event_id) AS n, epoch_us(ts) AS us, event_id, md5(coalesce(props, '')) AS data FROM events)
SELECT * FROM a WHERE n <= 3""")
def first_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three messages of each topic of each recording."""
    found = mcap_index.first_messages(_index(spark, sf_dir), 3)
    return found.select(_bin(), "topic", "n", _us("log_time_ns").alias("us"), F.col("sequence").alias("event_id"), F.md5("data").alias("data"))


@query(f"""
WITH a AS (SELECT *, {_FILE}, epoch_us(ts) AS us FROM events),
w AS (SELECT bin, min(us) + (max(us) - min(us)) // 4 AS a, min(us) + (max(us) - min(us)) // 2 AS z FROM a GROUP BY bin)
SELECT a.bin, event_id, md5(coalesce(props, '')) AS data FROM a JOIN w ON a.bin = w.bin AND us BETWEEN a AND z WHERE event_type IN ('view', 'error')""")
def mcap_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second quarter of each recording, two topics: the index is joined with the times asked for, and the chunks that are left are read."""
    index = _index(spark, sf_dir)
    span = index.where("kind = 'chunk'").groupBy("file").agg(_us("min(start_ns)").alias("a"), _us("max(end_ns)").alias("z"))
    wanted = span.select("file", (F.expr("a + (z - a) div 4") * 1000).alias("from_ns"), (F.expr("a + (z - a) div 2") * 1000).alias("to_ns"))
    found = mcap_index.messages(index, ["view", "error"], columns=["file", "sequence", "data"], wanted=wanted)
    return found.select(_bin(), F.col("sequence").alias("event_id"), F.md5("data").alias("data"))


@query(f"""
WITH a AS (SELECT {_FILE}, event_type AS topic, count(*) AS messages FROM events GROUP BY ALL)
SELECT bin, topic, messages, min(first_us) OVER (PARTITION BY bin) AS start_us, max(last_us) OVER (PARTITION BY bin) AS end_us, 'Event' AS schema_name, true AS from_index
FROM a JOIN (SELECT {_FILE}, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM events GROUP BY ALL) USING (bin)""")
def mcap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans from the summaries of lz4 recordings."""
    folder = _written(spark, sf_dir, "lz4")
    mcap.register(spark)
    found = spark.read.format("mcap_summary").option("path", folder).load()
    return found.select(_bin(), "topic", "messages", _us("start_ns").alias("start_us"), _us("end_ns").alias("end_us"), "schema_name", "from_index")


@query("SELECT event_id, event_type AS topic, epoch_us(ts) AS us, md5(coalesce(props, '')) AS data FROM events WHERE event_type = 'error'")
def mcap_lz4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One topic of lz4 recordings, by a filter that reaches the reader."""
    folder = _written(spark, sf_dir, "lz4")
    mcap.register(spark)
    found = spark.read.format("mcap_messages").schema("topic string, sequence long, log_time_ns long, data binary").option("path", folder).load().where("topic = 'error'")
    return found.select(F.col("sequence").alias("event_id"), "topic", _us("log_time_ns").alias("us"), F.md5("data").alias("data"))


@query(f"SELECT {_FILE}, event_type AS topic, count(*) AS messages, count(DISTINCT event_id) AS ids FROM events GROUP BY ALL")
def growing_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings read as a stream of their folder, in two runs from one checkpoint: the second one finds nothing new."""
    folder, at = _written(spark, sf_dir), scratch(spark, "stream")
    mcap.register(spark)
    columns = "file string, topic string, sequence long, error string"
    stream = spark.readStream.format("mcap_messages").schema(columns).option("path", folder).load()
    for _ in range(2):
        run = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").start()
        try:
            run.processAllAvailable()
        finally:
            run.stop()
    rows = spark.read.schema(columns).parquet(f"{at}/rows").where("error is null")
    return rows.groupBy(_bin(), "topic").agg(F.count("*").alias("messages"), F.count_distinct("sequence").alias("ids"))
