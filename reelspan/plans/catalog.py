"""The named queries over the driver's tables and their SQL: each puts generic operators to work on stand-ins for recordings."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.functions import text, timing
from reelspan.operators import align, continuity, integrity, islands, library, profile, report, sessions

HOUR, DAY = 3_600_000_000, 86_400_000_000
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("us", timing.epoch_us(F.col("ts")))


def only(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.where(F.col(column) == value)


@query(f"""
WITH a AS (SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= {12 * HOUR} THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS BIGINT) AS sid FROM a)
SELECT user_id, sid, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM b GROUP BY user_id, sid""")
def sessionize_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions.sessionize(events(spark, sf_dir), ["user_id"], "us", 12 * HOUR, ["event_id"], "sid")
    return sessions.roll_up(rows, ["user_id"], "us", "sid").withColumnsRenamed({"first": "first_us", "last": "last_us"})


@query("""
WITH a AS (SELECT event_type, count(*) AS messages, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM events GROUP BY event_type)
SELECT *, round_even(messages / ((max(last_us) OVER () - min(first_us) OVER ()) / 1000000.0), 3) AS rate_hz FROM a""")
def topic_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.topic_profile(events(spark, sf_dir), [], "event_type", "us", 1_000_000).withColumnsRenamed({"first": "first_us", "last": "last_us"})


@query("""SELECT user_id, count(*) AS n, CASE WHEN count(*) > 1 THEN round((max(epoch_us(ts)) - min(epoch_us(ts))) / (count(*) - 1), 3) END AS period FROM events GROUP BY user_id""")
def period_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.mean_period(events(spark, sf_dir), ["user_id"], "us").withColumn("period", F.round("period", 3))


@query("""
WITH a AS (SELECT user_id, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts) AS step FROM events)
SELECT user_id, coalesce(CAST(median(step) FILTER (WHERE step > 0) AS DOUBLE), 0.0) AS period FROM a GROUP BY user_id""")
def period_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.median_period(events(spark, sf_dir), ["user_id"], ["us", "event_id"], "us")


@query("""
WITH a AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM events),
b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run FROM a)
SELECT user_id, run, event_type, count(*) AS n FROM b GROUP BY user_id, run, event_type""")
def rle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.runs(events(spark, sf_dir), ["user_id"], ["us", "event_id"], "event_type")


@query("""
SELECT e.event_id, e.user_id, p.event_id AS last_purchase, epoch_us(e.ts) - epoch_us(p.ts) AS age_us
FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    found = align.as_of(only(e, "event_type", "error"), only(e, "event_type", "purchase"), ["user_id"], "us", "event_id", name="last_purchase")
    return found.select("event_id", "user_id", "last_purchase", (F.col("us") - F.col("last_purchase_time")).alias("age_us"))


_PAIRS = """n AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS i, epoch_us(ts) AS us FROM events WHERE event_type IN ('click', 'view')),
p AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.i, b.i) AS i, a.us AS click_us, b.us AS view_us
  FROM (SELECT * FROM n WHERE event_type = 'click') a FULL JOIN (SELECT * FROM n WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.i = b.i)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.pair_by_position(events(spark, sf_dir), ["user_id"], "event_type", "us", "click", ["view"], ["event_id"])


@query(f"WITH {_PAIRS} SELECT user_id, i, click_us, view_us FROM p")
def positional_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("user_id", "i", F.col("reference_time").alias("click_us"), F.col("time").alias("view_us"))


@query(f"""
WITH {_PAIRS}, m AS (SELECT user_id, min(i) FILTER (WHERE abs(view_us - click_us) > {6 * HOUR}) AS i, bool_or(click_us IS NULL OR view_us IS NULL) AS uneven FROM p GROUP BY user_id)
SELECT m.user_id, CASE WHEN m.i = 0 AND abs(p.view_us - p.click_us) > {120 * HOUR} THEN 'time_base' WHEN m.i IS NOT NULL THEN 'tolerance' WHEN uneven THEN 'frame_count' END AS reason, m.i, p.view_us - p.click_us AS delta
FROM m LEFT JOIN p ON m.user_id = p.user_id AND m.i = p.i""")
def first_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.first_mismatch(_pairs(spark, sf_dir), ["user_id"], F.lit(6 * HOUR), F.lit(12 * HOUR)).select("user_id", "reason", "i", "delta")


@query(f"WITH {_PAIRS} SELECT user_id, count(view_us - click_us) AS samples, coalesce(max(abs(view_us - click_us)), 0) AS worst, coalesce(round(avg(abs(view_us - click_us)), 3), 0.0) AS mean FROM p GROUP BY user_id")
def drift_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.drift(_pairs(spark, sf_dir), ["user_id"], F.col("time") - F.col("reference_time")).withColumn("mean", F.round("mean", 3))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.latest(events(spark, sf_dir), ["user_id"], ["us", "event_id"], "event_type", "event_id")


@query("SELECT user_id, count(*) AS rows, sha256(string_agg(props, '' ORDER BY ts, event_id)) AS sha256 FROM events GROUP BY user_id")
def ordered_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.ordered_digest(events(spark, sf_dir), ["user_id"], ["us", "event_id"], "props")


@query("""
SELECT coalesce(s, o_orderstatus) AS status, count(o_orderkey) AS n FROM (VALUES ('success'), ('skipped'), ('incomplete'), ('out_of_sync'), ('failed')) v(s) FULL JOIN orders ON s = o_orderstatus GROUP BY 1""")
def status_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.status_counts(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")))


@query("""
WITH a AS (SELECT user_id, event_id, epoch_us(ts) AS us, CAST(floor(value * 100) AS BIGINT) + 1 AS n FROM events),
b AS (SELECT *, coalesce(us - lag(us + n * 1000000) OVER (PARTITION BY user_id ORDER BY us, event_id), 0) AS delta FROM a),
c AS (SELECT *, CASE WHEN delta > 1000000 THEN CAST(round_even(delta / 1000000.0, 0) AS BIGINT) ELSE 0 END AS fill, CASE WHEN delta < -1000000 THEN least(n, CAST(round_even(-delta / 1000000.0, 0) AS BIGINT)) ELSE 0 END AS trim FROM b)
SELECT event_id, user_id, n, delta, CASE WHEN delta > 1000000 THEN 'gap' WHEN delta < -1000000 THEN 'overlap' END AS kind, fill, trim,
  CAST(sum(fill + n - trim) OVER (PARTITION BY user_id ORDER BY us, event_id) - (fill + n - trim) AS BIGINT) AS position FROM c""")
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("n", F.floor(F.col("value") * 100).cast("long") + 1)
    rows = continuity.blocks(e, ["user_id"], ["us", "event_id"], "us", "n", rate=1, per_second=1_000_000)
    return rows.select("event_id", "user_id", "n", "delta", "kind", "fill", "trim", "position")


_GAP_SQL = SQL["gap_fill"]


@query(f"WITH g AS ({_GAP_SQL}) SELECT user_id, count(*) FILTER (WHERE kind = 'gap') AS gaps, count(*) FILTER (WHERE kind = 'overlap') AS overlaps, CAST(sum(fill) AS BIGINT) AS filled, CAST(sum(trim) AS BIGINT) AS trimmed, CAST(sum(fill + n - trim) AS BIGINT) AS written FROM g GROUP BY user_id")
def gap_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return continuity.totals(gap_fill(spark, sf_dir), ["user_id"], "n").drop("first_gaps")


def _order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders")
    before = {c: F.lag(c).over(w) for c in ("o_orderdate", "o_orderpriority", "o_orderstatus")}
    urgent = lambda c: c == "1-URGENT"
    reason = sessions.join_reason(
        F.year("o_orderdate") == F.year(before["o_orderdate"]), F.col("o_totalprice") > 1000, urgent(F.col("o_orderpriority")) == urgent(before["o_orderpriority"]),
        (F.col("o_orderstatus") == "P") == (before["o_orderstatus"] == "P"), F.date_diff("o_orderdate", before["o_orderdate"]), F.lit(30), most_seconds=70, per_second=1,
    )
    rows = o.withColumn("previous", F.lag("o_orderkey").over(w)).withColumn("reason", reason)
    return rows.where("previous IS NOT NULL").select("o_custkey", "previous", "o_orderkey", "reason")


_REASON_SQL = """
SELECT o_custkey, previous, o_orderkey, CASE WHEN year(d) <> year(pd) THEN 'different_folder' WHEN o_totalprice <= 1000 THEN 'no_video' WHEN (pr = '1-URGENT') <> (ppr = '1-URGENT') THEN 'topics_differ'
  WHEN (s = 'P') <> (ps = 'P') THEN 'codec_differs' WHEN gap < 0 THEN 'time_backwards' WHEN gap / 30.0 < 0.5 THEN 'overlap' WHEN gap / 30.0 > 2.5 OR gap > 70 THEN 'gap_too_large' ELSE 'continuous' END AS reason
FROM (SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate AS d, o_orderpriority AS pr, o_orderstatus AS s, lag(o_orderkey) OVER w AS previous, lag(o_orderdate) OVER w AS pd, lag(o_orderpriority) OVER w AS ppr, lag(o_orderstatus) OVER w AS ps,
  date_diff('day', lag(o_orderdate) OVER w, o_orderdate) AS gap FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE previous IS NOT NULL"""


@query(_REASON_SQL)
def join_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_pairs(spark, sf_dir)


@query(f"""
WITH r AS ({_REASON_SQL}) SELECT o_custkey, previous, o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'manual_split' WHEN o_orderkey % 5 = 0 AND reason <> 'continuous' THEN 'manual_join' ELSE reason END AS reason FROM r""")
def manual_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_pairs(spark, sf_dir)
    pair = [F.col("o_custkey").alias("folder"), F.col("previous").alias("a"), F.col("o_orderkey").alias("b")]
    pairs = rows.where("o_orderkey % 11 = 0").select(*pair, F.lit("split").alias("kind")).unionByName(rows.where("o_orderkey % 5 = 0").select(*pair, F.lit("join").alias("kind")))
    return sessions.override(rows, pairs, "o_custkey", "previous", "o_orderkey")


_ON = "max(CAST(role = 'user' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn)"


@query(f"SELECT conv_id, turn, role FROM (SELECT *, {_ON} AS ready FROM conversations) WHERE ready = 1")
def leading_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.drop_leading(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user").select("conv_id", "turn", "role")


@query(f"SELECT conv_id % 10 AS file, conv_id, turn, role FROM (SELECT *, {_ON} AS ready, min(conv_id) OVER (PARTITION BY conv_id % 10) AS least FROM conversations) WHERE ready = 1 OR conv_id = least")
def seam_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("file", F.col("conv_id") % 10)
    return islands.drop_at_seams(c, ["file"], "conv_id", ["turn"], F.col("role") == "user").select("file", "conv_id", "turn", "role")


@query("""
WITH a AS (SELECT conv_id, CAST(sum(CAST(role = 'user' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS gop FROM conversations),
b AS (SELECT conv_id, gop, count(*) AS n FROM a WHERE gop > 0 GROUP BY conv_id, gop)
SELECT conv_id, gop, n FROM (SELECT *, max(gop) OVER (PARTITION BY conv_id) AS z FROM b) WHERE gop < z""")
def gop_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.groups_of_pictures(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user")


@query("""
WITH a AS (SELECT event_id, user_id, us, lead(us) OVER w - us AS d FROM (SELECT *, epoch_us(ts) AS us FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
b AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(1, CAST(round_even(d * 90000 / 1000000.0, 0) AS BIGINT)) END AS t FROM a)
SELECT event_id, user_id, CAST(coalesce(t, lag(t) OVER (PARTITION BY user_id ORDER BY us, event_id), 3000) AS BIGINT) AS duration FROM b""")
def pts_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.sample_durations(events(spark, sf_dir), ["user_id"], ["us", "event_id"], "us", 1_000_000).select("event_id", "user_id", "duration")


@query("""
WITH s AS (SELECT conv_id, turn, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM conversations WHERE length(text) > 0),
q AS (SELECT conv_id, position, least(greatest(position, 0), z) AS p FROM (SELECT conv_id, max(a + n) AS z FROM s GROUP BY conv_id), (VALUES (-5), (100), (500), (99999999)) v(position))
SELECT q.conv_id, CAST(q.position AS BIGINT) AS position, s.turn, CAST(p - a AS BIGINT) AS "offset" FROM q ASOF JOIN s ON q.conv_id = s.conv_id AND q.p >= s.a""")
def prefix_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("n", F.char_length("text").cast("long")).where("n > 0")
    parts = islands.starts(c, ["conv_id"], ["turn"], F.col("n"))
    probes = c.select("conv_id").distinct().withColumn("position", F.explode(F.array(*[F.lit(x).cast("long") for x in (-5, 100, 500, 99999999)])))
    return align.locate(probes, parts, ["conv_id"], "position", "start", "n", "turn").select("conv_id", "position", F.col("part").alias("turn"), "offset")


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN epoch_us(o_orderdate) WHEN o_orderpriority LIKE '1%' THEN o_orderkey ELSE 0 END AS value,
  CASE WHEN o_totalprice > 300000 THEN 'payload_timestamp' WHEN o_orderpriority LIKE '1%' THEN 'log_time' ELSE 'file_mtime' END AS source FROM orders""")
def fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, source = timing.first_usable(
        (F.col("o_totalprice") > 300000, timing.epoch_us(F.col("o_orderdate")), "payload_timestamp"), (F.col("o_orderpriority").startswith("1"), F.col("o_orderkey"), "log_time"), default=(F.lit(0).cast("long"), "file_mtime"),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", value.alias("value"), source.alias("source"))


@query("""
WITH a AS (SELECT user_id, event_type, value > lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS up FROM events)
SELECT user_id, event_type, coalesce(bool_and(up), true) AS increasing FROM a GROUP BY user_id, event_type""")
def monotone_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.increasing(events(spark, sf_dir), ["user_id", "event_type"], ["us", "event_id"], "value")


@query("""
WITH l AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'F') AS f FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, CASE WHEN coalesce(f, 0) = 0 THEN 'pending' WHEN f = n THEN 'complete' ELSE 'incomplete' END AS state FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def exists_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("f"))
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", integrity.output_state(F.col("f"), F.col("n")).alias("state"))


@query("SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.uncovered(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, lang FROM documents SEMI JOIN labels USING (doc_id)")
def semi_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.covered(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query("""
WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS members FROM events GROUP BY ALL)
SELECT members, count(*) AS n, min(user_id) AS first_user FROM s GROUP BY members""")
def set_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = library.member_sets(events(spark, sf_dir).withColumn("day", F.col("ts").cast("date")), ["user_id", "day"], "event_type")
    return sets.groupBy(F.array_join("members", ",").alias("members")).agg(F.count("*").alias("n"), F.min("user_id").alias("first_user"))


@query("SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name")
def dim_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return counts.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "r_name", "customers")


@query("""
WITH a AS (SELECT *, epoch_us(l_shipdate) < lag(epoch_us(l_shipdate) + CAST(l_quantity AS BIGINT) * 86400000000) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS o FROM lineitem)
SELECT 'intervals_overlap' AS rule, count(*) FILTER (WHERE o) AS n FROM a UNION ALL SELECT 'discount_range', count(*) FILTER (WHERE l_discount < 0 OR l_discount > 0.05) FROM a UNION ALL SELECT 'price_by_quantity', count(*) FILTER (WHERE l_extendedprice < l_quantity) FROM a""")
def integrity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("us", timing.epoch_us(F.col("l_shipdate")))
    end = F.col("us") + F.col("l_quantity").cast("long") * DAY
    rows = integrity.overlapping(lines, ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], "us", end)
    rules = {"intervals_overlap": F.col("overlapping"), "discount_range": (F.col("l_discount") < 0) | (F.col("l_discount") > 0.05), "price_by_quantity": F.col("l_extendedprice") < F.col("l_quantity")}
    return integrity.violations(rows, rules)


@query(r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[<>:"/\\|?*\x00-\x1F]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g') AS name,
  nullif(regexp_extract(url, '/([a-z]{2})/', 1), '') AS lang, nullif(regexp_extract(url, '(\d)$', 1), '') AS digit FROM pages WHERE url IS NOT NULL""")
def sanitize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lambda pattern: F.nullif(F.regexp_extract("url", pattern, 1), F.lit(""))
    pages = table(spark, sf_dir, "pages").where("url IS NOT NULL")
    return pages.select("page_id", text.sanitize(F.regexp_replace("url", "^[a-z]+://", "")).alias("name"), found("/([a-z]{2})/").alias("lang"), found(r"(\d)$").alias("digit"))


@query("""
SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR) AS total, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '; ') AS priorities FROM orders GROUP BY 1""")
def rollup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("string")
    out = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), total.alias("total"), F.array_sort(F.collect_set("o_orderpriority")).alias("p"))
    return out.select("status", "n", "total", report.joined(F.col("p")).alias("priorities"))


@query("SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, length(lines[i]) AS n_chars FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) t(i)")
def warnings_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.flatten(table(spark, sf_dir, "documents"), ["doc_id"], F.split("text", "\n"))
    return rows.select("doc_id", "i", F.char_length("item").cast("long").alias("n_chars"))


@query("SELECT o_orderstatus AS status, round(sum(CAST(o_totalprice AS BIGINT) * (o_orderkey % 101)) / sum(CAST(o_totalprice AS BIGINT)), 6) AS progress FROM orders GROUP BY 1")
def progress_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("size", F.round("o_totalprice", 0).cast("long"))
    out = report.progress(o.withColumnRenamed("o_orderstatus", "status"), ["status"], F.col("size"), F.col("o_orderkey") % 101)
    return out.select("status", F.round("progress", 6).alias("progress"))


@query(r"""SELECT r_name, substr(sha1(r_name || '|' || CAST(count(*) AS VARCHAR)), 1, 8) AS fingerprint, substr(sha1(string_agg(n_name, chr(10) ORDER BY n_name)), 1, 12) AS "key" FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = rows.groupBy("r_name").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("n_name")).alias("names"))
    return out.select("r_name", text.fingerprint(F.col("r_name"), F.col("n").cast("string")).alias("fingerprint"), text.list_key(F.col("names")).alias("key"))


@query("""
WITH a AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events)
SELECT user_id, event_type, event_id FROM (SELECT *, min(n) OVER (PARTITION BY user_id) AS least FROM a) WHERE i <= least""")
def trim_to_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.trim_to_shortest(events(spark, sf_dir), ["user_id"], "event_type", ["us", "event_id"]).select("user_id", "event_type", "event_id")


@query("""
SELECT conv_id, turn, coalesce(lead(turn) OVER w, first_value(turn) OVER w) AS "next", coalesce(lag(turn) OVER w, max(turn) OVER (PARTITION BY conv_id)) AS previous FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def playlist_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.neighbours(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "turn").select("conv_id", "turn", "next", "previous")


@query(r"""
WITH p AS (SELECT p_brand AS folder, p_partkey, regexp_replace(regexp_replace(p_type, '[<>:"/\\|?*\x00-\x1F]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g') AS name FROM part)
SELECT folder, p_partkey, name, CASE WHEN row_number() OVER w = 1 THEN name ELSE name || '_' || row_number() OVER w END AS "unique" FROM p WINDOW w AS (PARTITION BY folder, lower(name) ORDER BY p_partkey)""")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("folder"), "p_partkey", text.sanitize(F.col("p_type")).alias("name"))
    return library.unique_names(parts, "folder", "p_partkey", "name")


@query(f"""
WITH a AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= {12 * HOUR} THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS sid FROM a)
SELECT user_id, min(us) AS start_us, max(us) AS last_us, count(*) AS n FROM b GROUP BY user_id, sid""")
def stream_session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of events read as a stream; those that the watermark hasn't closed at its end come from the batch form."""
    from reelspan.shared import shared_dir
    from reelspan.streaming import sessions as streams

    source = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(source).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = streams.sessions(stream, ["user_id"], "ts", "12 hours")
    out.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    us = lambda c: timing.epoch_us(F.col(c).cast("timestamp_ntz"))
    closed = spark.read.schema(out.schema).parquet(f"{at}/rows").select("user_id", us("start").alias("start_us"), us("last").alias("last_us"), "n")
    rows = sessions.roll_up(sessions.sessionize(events(spark, sf_dir), ["user_id"], "us", 12 * HOUR, ["event_id"], "sid"), ["user_id"], "us", "sid")
    every = rows.select("user_id", F.col("first").alias("start_us"), F.col("last").alias("last_us"), "n")
    end = events(spark, sf_dir).agg(F.max("us")).first()[0] or 0
    # open sessions end within the gap and the delay before the last event
    opened = every.where(F.col("last_us") > end - 14 * HOUR).join(closed, ["user_id", "start_us"], "left_anti")
    return closed.unionByName(opened)


def queries() -> dict:
    from reelspan.plans import lists, messages, more, recordings  # noqa: F401 (they register their queries)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
