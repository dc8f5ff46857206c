"""The numbered queries op<N>_<name>, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, exact_dedup, jaccard_join, lattice_dedup, mixing, periodic, quality, rules, suffix_dedup, url_filter, warc, window_dedup
from .common import WORD, table

#: Host labels whose urls make up the list of op5.
LISTED_HOSTS = ("casino-win", "free-bets", "ads-track", "spam-farm", "cheap-pills", "adult-x")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.withColumn("n_kept", F.col("n_bytes") - F.col("n_removed")).withColumn("kept_text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op2_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.remove_windows(table(spark, sf_dir, "documents")).drop("kept")


def op3_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host, path = url_filter.host(F.col("url")), url_filter.path(F.col("url"))
    listed = pages.select(url_filter.canonical(host, path).alias("key")).where(F.col("key").rlike(rf"^[^/]*\b({'|'.join(LISTED_HOSTS)})\."))
    return url_filter.filter_urls(pages, listed).drop("listed")


_OP5_PARTS = """
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
fits AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
"""
OP5_SQL = f"""{_OP5_PARTS}
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(regexp_replace(host, '^www\\.', ''), '\\b({'|'.join(LISTED_HOSTS)})\\.') THEN 'block' ELSE 'allow' END AS verdict
FROM fits
"""


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    return warc.read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""


def op11_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.links(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x,
         len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND label IS NOT NULL AS ok
  FROM embeddings),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE a.ok AND b.ok AND list_cosine_similarity(a.x, b.x) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = v.vec_id
"""


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


def _op12_sql() -> str:
    """Every round spelled out."""
    assigned = """(
  SELECT vec_id, q, unnest(min(struct_pack(distance := distance, cluster := k))) FROM (
    SELECT vec_id, q, k, CAST(list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS distance FROM v, c{i})
  GROUP BY vec_id, q)"""
    moved = """(
  SELECT k, coalesce(moved.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
    SELECT cluster, list(s ORDER BY place) AS c FROM (
      SELECT cluster, place, CAST(floor(CAST(sum(q[place]) AS DOUBLE) / count(*)) AS BIGINT) AS s FROM a{i}, range(1, 65) places(place) GROUP BY cluster, place)
    GROUP BY cluster) moved ON moved.cluster = k)"""
    start = """WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS k, q AS c FROM (SELECT q, sha256('3:' || vec_id) AS h FROM v ORDER BY h LIMIT 8))"""
    rounds = [f"a{i} AS MATERIALIZED {assigned.format(i=i)},\nc{i + 1} AS MATERIALIZED {moved.format(i=i)}" for i in range(centroids.ROUNDS)]
    last = centroids.ROUNDS
    return ",\n".join([start, *rounds, f"a{last} AS MATERIALIZED {assigned.format(i=last)}"]) + f"""
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} ON k = cluster
"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = periodic.find_runs(_repeating(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    rows = runs.withColumn("best", best).withColumn("length", -F.col("best.less"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "length", "best.period", F.expr("1000 * length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _repeating(docs: DataFrame) -> DataFrame:
    """Documents, of which those whose id's checksum is a multiple of ten go on in periods from some word on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g")).withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    changed = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", place(i))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_suffix_dedup, op2_window_dedup, op3_entropy_mix, op4_quality, op5_url_filter, op6_quality_rules, op7_byte_bpe, op8_jaccard_join,
            op9_warc, op10_exact_dedup, op11_lattice_dedup, op12_centroids, op13_periodic_runs,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": OP5_SQL, "op10_exact_dedup": OP10_SQL, "op11_lattice_dedup": OP11_SQL, "op12_centroids": _op12_sql()}
