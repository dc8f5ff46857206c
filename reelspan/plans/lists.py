"""Queries with their SQL: edits of playlists, titles of sessions, topics that only parts have, warnings, report lines, sidecars read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.functions import text
from reelspan.operators import align, channels, library, playlist, report
from reelspan.plans.catalog import SQL, events, query, table
from reelspan.plans.more import channel_triage
from reelspan.shared import scratch
from reelspan.sources import documents

_ITEMS = "SELECT conv_id, turn, role AS item, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as lists, their turns as entries."""
    rows = align.numbered(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "pos")
    return rows.select("conv_id", "turn", F.col("role").alias("item"), "pos")


@query(f"""
WITH c AS ({_ITEMS}),
u AS (SELECT conv_id, item, pos AS o, 1 AS t FROM c UNION ALL SELECT conv_id, 'new' || turn, CASE WHEN turn % 5 = 0 THEN 4611686018427387904 ELSE greatest(turn * 2 - 3, 0) END, 0 FROM c WHERE turn % 3 = 0)
SELECT conv_id, item, row_number() OVER (PARTITION BY conv_id ORDER BY o, t, item) - 1 AS pos FROM u""")
def playlist_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new entry for every third turn: before the start, within the list, past its end, or without a place."""
    c = _items(spark, sf_dir)
    turn = F.col("turn")
    new = c.where(turn % 3 == 0).select("conv_id", F.concat(F.lit("new"), turn.cast("string")).alias("item"), F.when(turn % 5 != 0, turn * 2 - 3).cast("long").alias("at"))
    return playlist.insert(c.select("conv_id", "item", "pos"), new, ["conv_id"]).select("conv_id", "item", "pos")


@query(f"""
WITH c AS (SELECT *, conv_id % 5 AS src, conv_id % 3 AS dst FROM ({_ITEMS}))
SELECT conv_id, turn, CAST(CASE WHEN src >= n OR dst >= n OR src = dst THEN pos WHEN pos = src THEN dst WHEN src < pos AND pos <= dst THEN pos - 1 WHEN dst <= pos AND pos < src THEN pos + 1 ELSE pos END AS BIGINT) AS pos FROM c""")
def playlist_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One move in each list, some of them from or to places that it doesn't have."""
    c = _items(spark, sf_dir)
    moves = c.select("conv_id").distinct().select("conv_id", (F.col("conv_id") % 5).alias("src"), (F.col("conv_id") % 3).alias("dst"))
    return playlist.move(c, moves, ["conv_id"]).select("conv_id", "turn", "pos")


@query(f"""
WITH c AS (SELECT *, n // 2 AS "at" FROM ({_ITEMS}))
SELECT conv_id, turn, CAST(CASE WHEN pos >= "at" THEN pos + 1 ELSE pos END AS BIGINT) AS inserted, CAST(CASE WHEN pos = "at" THEN -1 WHEN pos > "at" THEN pos - 1 ELSE pos END AS BIGINT) AS removed FROM c""")
def playlist_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each entry is, as the current one, after an insertion or a removal in the middle of its list."""
    c = _items(spark, sf_dir)
    c = c.join(c.groupBy("conv_id").agg(F.floor(F.count("*") / 2).alias("at")), "conv_id")
    return c.select("conv_id", "turn", playlist.index_after_insert(F.col("pos"), F.col("at")).cast("long").alias("inserted"), playlist.index_after_remove(F.col("pos"), F.col("at")).cast("long").alias("removed"))


@query("SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS back FROM events")
def playlist_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry that each user played before."""
    return playlist.previous_played(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type", "back")


@query("""
SELECT o_custkey, o_orderpriority AS topic, CAST(sum(o_orderkey) AS BIGINT) AS messages FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM orders r WHERE r.o_orderstatus = 'F' AND r.o_custkey = o.o_custkey AND r.o_orderpriority = o.o_orderpriority) GROUP BY o_custkey, o_orderpriority""")
def extra_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of topics that a recording's parts have and its reference, the filled orders, doesn't."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("topic"), F.lit("x").alias("adapter"), F.col("o_orderkey").alias("messages"), "o_orderstatus")
    return library.extra_counts(o.where("o_orderstatus = 'F'").select("o_custkey", "topic", "adapter"), o, ["o_custkey"])


@query(f"SELECT file, topic, code FROM ({SQL['channel_triage']}) WHERE code IS NOT NULL AND file_error IS NULL")
def channel_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.channel_warnings(channel_triage(spark, sf_dir))


@query(r"""
WITH s AS (SELECT o_custkey, 'drive_Cam' || o_orderkey AS stem, o_orderkey FROM orders),
g AS (SELECT o_custkey, min(stem) AS a, max(stem) AS b, arg_min(stem, o_orderkey) AS first, arg_max(stem, o_orderkey) AS last, count(*) AS n FROM s GROUP BY o_custkey),
t AS (SELECT *, regexp_replace(left(a, list_max(list_filter(range(0, length(a) + 1), lambda k: left(a, k) = left(b, k)))), '[_\-. 0-9]+$', '') AS title FROM g)
SELECT o_custkey, CASE WHEN regexp_matches(title, '(?i)(_camera|_cam|camera|cam)$') THEN regexp_replace(regexp_replace(title, '(?i)(_camera|_cam|camera|cam)$', ''), '[_\-. ]+$', '') ELSE title END AS title,
  "first" || '~' || "last" AS name, "first" || '_' || n AS counted FROM t""")
def session_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the names of a session's parts have in common, and its name by two patterns."""
    stem, key = F.concat(F.lit("drive_Cam"), F.col("o_orderkey").cast("string")), F.col("o_orderkey")
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(stem).alias("stems"), F.min_by(stem, key).alias("first"), F.max_by(stem, key).alias("last"), F.count("*").alias("n"))
    name = lambda *pattern: text.session_name(F.col("first"), F.col("last"), F.col("n"), *pattern)
    return s.select("o_custkey", text.common_title(F.col("stems")).alias("title"), name().alias("name"), name("{pertama}:{jumlah}").alias("counted"))


@query("SELECT event_id, value + least(greatest((epoch_us(ts) % 2000000) / 1e6 - 0.5e0, 0e0), 0.6e0) * 1.25e0 AS reading FROM events")
def clock_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clock's reading up to 1.5 s after its anchor, carried on for 0.6 s at most."""
    return events(spark, sf_dir).select("event_id", align.extrapolate(F.col("value"), F.col("us") % 2_000_000 / 1e6 - 0.5, F.lit(1.25)).alias("reading"))


_RESULTS = """
SELECT l_orderkey, CASE l_orderkey % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'skipped' WHEN 2 THEN 'out_of_sync' ELSE 'failed' END AS status,
  CASE l_orderkey % 4 WHEN 2 THEN 'out_of_sync' WHEN 3 THEN 'mcap_error' END AS code, count(*) AS n, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_quantity) AS frames, list(l_linenumber ORDER BY l_linenumber) AS topics,
  bool_and(l_linestatus = 'F') AS sound, min(l_linenumber) AS place FROM lineitem GROUP BY l_orderkey"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as results, their lines as outputs."""
    k = F.col("l_orderkey") % 4
    path = F.concat(F.lit("/out/"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"), F.lit(".mp4"))
    audio = F.array().cast("array<struct<samples:long,gaps:long,offset_to_video_ms:double>>")
    output = F.struct(
        "l_linenumber", path.alias("path"), F.concat(F.lit("/cam"), F.col("l_linenumber").cast("string")).alias("topic"), F.col("l_quantity").cast("long").alias("frames"),
        (F.col("l_linenumber") + 0.5).alias("duration_s"), F.lit(640).alias("width"), F.lit(480).alias("height"), (F.col("l_linenumber") > 3).alias("co64"), audio.alias("audio"),
    )
    whole = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(output)).alias("outputs"), F.bool_and(F.col("l_linestatus") == "F").alias("sound"), F.min("l_linenumber").alias("first"))
    status = F.when(k == 0, "success").when(k == 1, "skipped").when(k == 2, "out_of_sync").otherwise("failed")
    return whole.withColumn("status", status).withColumn("code", F.when(k == 2, "out_of_sync").when(k == 3, "mcap_error"))


@query(f"""
WITH r AS ({_RESULTS})
SELECT l_orderkey, CASE status WHEN 'success' THEN n || ' MP4, ' || array_to_string(frames, '+') || ' frames, 2.5 s, 0.0 MB/s' WHEN 'skipped' THEN '' WHEN 'out_of_sync' THEN ': out_of_sync (tolerance at ' || place || ')' ELSE ': mcap_error' END AS line,
  CASE status WHEN 'success' THEN n || ' MP4, ' || array_to_string(frames, '+') || ' frames, 2.5 s, 0.0 MB/s' WHEN 'skipped' THEN '' WHEN 'out_of_sync' THEN ': out_of_sync (tolerance at ' || place || ')' || chr(10) || '    bad ' || l_orderkey ELSE ': mcap_error' || chr(10) || '    bad ' || l_orderkey END AS long FROM r""")
def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line on each result, short and long."""
    sync = F.struct(F.lit("tolerance").alias("reason"), F.col("first").alias("index"))
    error = F.concat(F.lit("bad "), F.col("l_orderkey").cast("string"))
    line = lambda verbose: report.describe(F.col("status"), F.transform("outputs", lambda o: o["frames"]), F.lit(2.5), F.lit(None).cast("double"), F.col("code"), sync, error, verbose)
    return _results(spark, sf_dir).select("l_orderkey", line(False).alias("line"), line(True).alias("long"))


@query(f"""
WITH r AS ({_RESULTS})
SELECT CAST(l_orderkey AS VARCHAR) AS source, CASE status WHEN 'success' THEN 'done' ELSE status END AS status, CASE code WHEN 'mcap_error' THEN 'cannot be read' WHEN 'out_of_sync' THEN 'out_of_sync' ELSE '' END AS error,
  array_to_string(list_transform(topics, lambda t: l_orderkey || '_' || t || '.mp4'), '; ') AS outputs,
  CASE WHEN len(topics) > 0 THEN array_to_string(list_transform(list_zip(topics, frames), lambda z: '/cam' || z[1] || '=' || z[2]), '; ') END AS frames,
  array_to_string(list_transform(topics, lambda t: t || '.5'), '; ') AS duration_s, array_to_string(list_transform(topics, lambda t: '640x480'), '; ') AS resolution,
  array_to_string(list_transform(topics, lambda t: CASE WHEN t > 3 THEN 'True' ELSE 'False' END), '; ') AS co64, CASE WHEN sound THEN 'ok' ELSE 'failed' END AS verify, CAST(n AS INTEGER) AS warnings FROM r""")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's rows of all results, statuses and errors in words where there are some."""
    labels = spark.createDataFrame([("en", "status.success", "done"), ("en", "err.mcap_error", "cannot be read"), ("de", "status.success", "fertig")], "language string, key string, text string")
    none = F.lit(None)
    results = _results(spark, sf_dir).select(
        F.col("l_orderkey").cast("string").alias("source"), "status", F.col("code").alias("error_code"), none.cast("string").alias("error"), none.cast("long").alias("source_bytes"), none.cast("double").alias("elapsed_s"),
        none.cast("double").alias("mb_per_s"), "outputs", none.cast("double").alias("fps_used"), none.cast("string").alias("time_source"),
        F.create_map(F.lit("a"), F.struct(F.lit(True).alias("quick"), F.col("sound").alias("payload_matches_source"))).alias("verify"), F.transform("outputs", lambda o: o["path"]).alias("warnings"), none.cast("string").alias("sidecar"),
    )
    return report.rows(results, labels, "en").select("source", "status", "error", "outputs", "frames", "duration_s", "resolution", "co64", "verify", "warnings")


@query("""
SELECT s_suppkey || '.metadata.json' AS name, array_to_string(CASE WHEN s_suppkey % 2 = 0 THEN ['a' || s_suppkey] ELSE ['a' || s_suppkey, 'b'] END, '|') AS source, 's' || s_nationkey AS session, CAST(s_suppkey % 5 AS INTEGER) AS index, 'o' || s_suppkey || '.mp4' AS output, s_suppkey % 3 = 0 AS has_audio
FROM supplier WHERE s_suppkey % 7 <> 0""")
def sidecar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sidecars beside outputs, each written twice (the second text of a path is refused) and read back; every seventh has no video."""
    folder = scratch(spark, "sidecars")
    k, s = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    one = F.concat(F.lit("a"), s)
    video = F.when(k % 7 != 0, F.array(F.struct(F.lit("/cam").alias("topic"), F.concat(F.lit("o"), s, F.lit(".mp4")).alias("output"))))
    session = F.struct(F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("id"), (k % 5).cast("int").alias("index"))
    source = F.when(k % 2 == 0, F.to_json(F.array(one))).otherwise(F.to_json(F.array(one, F.lit("b"))))
    body = F.to_json(F.struct(session.alias("session"), video.alias("video"), F.when(k % 3 == 0, F.array(F.lit("mic"))).alias("audio")))
    document = F.concat(F.lit('{"source": '), source, F.lit(", "), F.substring(body, F.lit(2), F.length(body)))
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit(folder + "/"), s, F.lit(documents.SIDECAR)).alias("path"), document.alias("document"))
    for text_ in (F.col("document"), F.lit("{}")):
        documents.write_sidecars(rows.withColumn("document", text_)).agg(F.count_if("written")).first()
    found = documents.read_sidecars(spark, folder)
    return found.select("name", F.array_join("source", "|").alias("source"), F.col("session.id").alias("session"), F.col("session.index").alias("index"), F.col("video")[0]["output"].alias("output"), "has_audio")
