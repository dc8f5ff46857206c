"""Roll-ups of result records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses that are always listed, in order.
STATUSES = ("success", "skipped", "incomplete", "out_of_sync", "failed")


def status_counts(df: DataFrame, status: str = "status", listed: tuple[str, ...] = STATUSES) -> DataFrame:
    """status, n: counts of all statuses found, and 0 for listed ones that aren't."""
    zeros = df.sparkSession.createDataFrame([(s, 0) for s in listed], f"`{status}` string, n long")
    found = df.groupBy(status).agg(F.count("*").alias("n"))
    return found.unionByName(zeros).groupBy(status).agg(F.sum("n").alias("n"))


def throughput(total_bytes: Column, seconds: Column) -> Column:
    """MB a second, null for no time."""
    return F.try_divide(total_bytes / 1e6, seconds)


def exit_code(df: DataFrame, status: str = "status", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, exit_code: 1 if something failed, else 2 if something is incomplete or out of sync, else 0. Without keys one row, 0 for no results."""
    worst = F.max(F.when(F.col(status) == "failed", 2).when(F.col(status).isin("incomplete", "out_of_sync"), 1).otherwise(0))
    return df.groupBy(*keys).agg(F.element_at(F.array(F.lit(0), F.lit(2), F.lit(1)), F.coalesce(worst, F.lit(0)) + 1).alias("exit_code"))


def flatten(df: DataFrame, keys: list[str], items: Column, name: str = "item") -> DataFrame:
    """keys, i (from 0), item: one row an element; rows without elements have none."""
    return df.select(*keys, F.posexplode(items).alias("i", name))


def joined(items: Column, separator: str = "; ") -> Column:
    return F.array_join(F.array_compact(items), separator)


def progress(df: DataFrame, keys: list[str], size: Column, share: Column) -> DataFrame:
    """keys, done, total, progress: finished shares weighted by size; 0 for no size."""
    out = df.groupBy(*keys).agg(F.sum(size * share).alias("done"), F.sum(size).alias("total"))
    return out.withColumn("progress", F.coalesce(F.try_divide(F.col("done").cast("double"), F.col("total")), F.lit(0.0)))


def eta(total: Column, done: Column, elapsed: Column) -> Column:
    """Seconds left at the speed so far; null at a speed of one byte a second or less."""
    speed = F.try_divide(done, elapsed)
    return F.when(speed > 1, (total - done) / speed)


#: The columns of a report, in order.
COLUMNS = (
    "source", "status", "error", "message", "source_bytes", "elapsed_s", "mb_per_s", "outputs", "frames",
    "fps", "time_source", "duration_s", "resolution", "co64", "audio", "verify", "warnings", "sidecar",
)
#: The error code that each kind of failure has.
ERRORS = {"McapError": "mcap_error", "AdapterError": "bitstream_error", "ValueError": "bitstream_error", "Mp4TooLarge": "too_large", "KeyboardInterrupt": "cancelled"}


def lookup(df: DataFrame, labels: DataFrame, key: Column, name: str, language: str, fallback: str = "id") -> DataFrame:
    """df with name: key's text (labels: language, key, text) in that language, else in the fallback, else the key itself. An empty text counts as none."""
    rows = df.withColumn("__key", key)
    for k, lang in enumerate(dict.fromkeys((language, fallback))):
        own = labels.where((F.col("language") == lang) & (F.col("text") != "")).groupBy(F.col("key").alias(f"__k{k}")).agg(F.min("text").alias(f"__t{k}"))
        rows = rows.join(own, F.col("__key") == F.col(f"__k{k}"), "left").drop(f"__k{k}")
    texts = [c for c in rows.columns if c.startswith("__t")]
    return rows.withColumn(name, F.coalesce(*texts, "__key")).drop("__key", *texts)


def error_code(kind: Column, own: Column) -> Column:
    """A failure's stable code: the one it brings, else by its kind, else internal_error; null for no failure."""
    by_kind = F.lit("internal_error")
    for name, code in ERRORS.items():
        by_kind = F.when(kind == name, code).otherwise(by_kind)
    return F.when(own.isNotNull(), own).when(kind.isNotNull(), by_kind)


def failure_status(code: Column) -> Column:
    """The status of a result that failed with a code."""
    return F.when(code == "out_of_sync", "out_of_sync").when(code == "exists_incomplete", "incomplete").otherwise("failed")


def _texts(items: Column, each, separator: str = "; ") -> Column:
    return F.coalesce(F.array_join(F.array_compact(F.transform(items, each)), separator), F.lit(""))


def rows(results: DataFrame, labels: DataFrame | None = None, language: str = "en") -> DataFrame:
    """The COLUMNS of results (as in a manifest); labels (language, key, text) translate statuses and errors, by status.x, err.x and verify.x."""
    sound = lambda a: F.concat_ws("; ", a["samples"].cast("string"), F.coalesce(a["gaps"], F.lit(0)).cast("string"), F.bround(F.coalesce(a["offset_to_video_ms"], F.lit(0.0)), 3).cast("string"))
    good = F.forall(F.map_values("verify"), lambda v: F.coalesce(v["quick"], F.lit(True)) & F.coalesce(v["payload_matches_source"], F.lit(True)))
    verify = F.when(F.coalesce(F.size("verify"), F.lit(0)) > 0, F.when(good, "verify.ok").otherwise("verify.failed"))
    out = results.select(
        "source", F.concat(F.lit("status."), F.coalesce("status", F.lit(""))).alias("status"), F.concat(F.lit("err."), "error_code").alias("error"), F.coalesce("error", F.lit("")).alias("message"),
        "source_bytes", "elapsed_s", "mb_per_s", _texts(F.col("outputs"), lambda o: F.regexp_extract(o["path"], r"([^/\\]*)$", 1)).alias("outputs"),
        _texts(F.col("outputs"), lambda o: F.when(o["frames"].isNotNull(), F.concat(F.coalesce(o["topic"], F.lit("None")), F.lit("="), o["frames"].cast("string")))).alias("frames"), F.col("fps_used").alias("fps"), "time_source",
        _texts(F.col("outputs"), lambda o: o["duration_s"].cast("string")).alias("duration_s"), _texts(F.col("outputs"), lambda o: F.when(o["width"] > 0, F.concat_ws("x", o["width"], o["height"]))).alias("resolution"),
        _texts(F.col("outputs"), lambda o: F.initcap(o["co64"].cast("string"))).alias("co64"), _texts(F.flatten(F.transform("outputs", lambda o: F.coalesce(o["audio"], F.array().cast("array<struct<samples:long,gaps:long,offset_to_video_ms:double>>")))), sound, " | ").alias("audio"),
        verify.alias("verify"), F.coalesce(F.size("warnings"), F.lit(0)).alias("warnings"), F.coalesce("sidecar", F.lit("")).alias("sidecar"),
    )
    for column in ("status", "error", "verify"):
        if labels is not None:
            out = lookup(out, labels, F.col(column), column, language)
        out = out.withColumn(column, F.coalesce(F.regexp_replace(column, r"^(status|err|verify)\.", ""), F.lit("")))
    return out.select(*COLUMNS)


def describe(status: Column, frames: Column, seconds: Column, speed: Column, code: Column, sync: Column, error: Column, verbose: bool = False) -> Column:
    """One line on a result. frames: array of counts; sync: struct of reason, counts and index, or null."""
    good = F.format_string("%d MP4, %s frames, %s s, %s MB/s", F.size(frames), F.array_join(F.transform(frames, lambda n: n.cast("string")), "+"), F.coalesce(seconds, F.lit(0.0)), F.coalesce(speed, F.lit(0.0)))
    why = F.when((code == "out_of_sync") & sync["reason"].isNotNull(), F.concat(F.lit(" ("), sync["reason"], F.coalesce(F.concat(F.lit(" at "), sync["index"].cast("string")), F.lit("")), F.lit(")"))).otherwise("")
    bad = F.concat(F.coalesce(F.concat(F.lit(": "), code), F.lit("")), why, F.when(error.isNotNull() & F.lit(verbose), F.concat(F.lit("\n    "), error)).otherwise(""))
    return F.when(status == "success", good).when(status == "skipped", "").otherwise(bad)


def summary(results: DataFrame, seconds: float) -> DataFrame:
    """One row: counts by status (map, the listed ones with 0), files, total_source_bytes, elapsed_s, throughput_mb_s, exit_code."""
    zeros = results.sparkSession.createDataFrame([(s, 0, 0) for s in STATUSES], "status string, n long, bytes long")
    by_status = results.groupBy("status").agg(F.count("*").alias("n"), F.sum("source_bytes").alias("bytes")).unionByName(zeros).groupBy("status").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    n = lambda *s: F.sum(F.when(F.col("status").isin(*s), F.col("n")))
    total = by_status.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("counts"), F.sum("n").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_source_bytes"),
        F.when(n("failed") > 0, 1).when(n("incomplete", "out_of_sync") > 0, 2).otherwise(0).alias("exit_code"),
    )
    return total.withColumn("elapsed_s", F.bround(F.lit(float(seconds)), 2)).withColumn("throughput_mb_s", F.bround(throughput(F.col("total_source_bytes"), F.lit(float(seconds))), 2))


def write_csv(report: DataFrame, folder: str, delimiter: str = ",") -> None:
    """report as CSV parts, each with a header."""
    report.write.option("header", True).option("sep", delimiter).option("encoding", "UTF-8").csv(folder)


def write_json(report: DataFrame, whole: DataFrame, folder: str) -> None:
    """files/: a JSON object for each result; summary/: the one of all."""
    report.write.json(f"{folder}/files")
    whole.write.json(f"{folder}/summary")


def export_json(report: DataFrame, whole: DataFrame, path: str, order: str = "source") -> None:
    """One JSON document {summary, files}: the row of whole, and report's rows in order. Rows pass the driver one partition at a time; large
    reports take write_json."""
    text = lambda df: df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    files = text(report.orderBy(order)).toLocalIterator()
    rows = ((",\n" if k else "") + r[0] for k, r in enumerate(files))
    _stream_out(path, '{"summary": ' + text(whole).first()[0] + ', "files": [\n', rows, "\n]}\n")


def _stream_out(path: str, head: str, lines, foot: str) -> None:
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with store.open_output_stream(name) as out:
        out.write(head.encode())
        for line in lines:
            out.write(line.encode())
        out.write(foot.encode())


def export_csv(report: DataFrame, path: str, delimiter: str = ",", order: str = "source") -> None:
    """report as one CSV file behind a byte-order mark, for spreadsheets. Rows pass the driver one partition at a time; large reports take write_csv."""
    quoted = lambda c: F.coalesce(F.when(F.col(c).cast("string").rlike(f'[{delimiter}"\r\n]'), F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c).cast("string")), F.lit(""))
    lines = report.orderBy(order).select(F.concat(F.concat_ws(delimiter, *[quoted(c) for c in report.columns]), F.lit("\r\n")))
    _stream_out(path, "\ufeff" + delimiter.join(report.columns) + "\r\n", (r[0] for r in lines.toLocalIterator()), "")


def export_html(report: DataFrame, whole: list[tuple], path: str, title: str = "Report", order: str = "source") -> None:
    """Two tables, the summary's pairs and report, as one page; texts are escaped. Rows pass the driver one partition at a time."""
    import html

    cell = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    lines = report.orderBy(order).select(F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *[cell(c) for c in report.columns]), F.lit("</td></tr>")))
    row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape('' if c is None else str(c))}</{tag}>" for c in cells) + "</tr>"
    head = f"<!doctype html><meta charset=utf-8><h1>{html.escape(title)}</h1><table border=1 cellpadding=4>{''.join(row(r, 'td') for r in whole)}</table><br><table border=1 cellpadding=4>{row(report.columns, 'th')}"
    _stream_out(path, head, (r[0] for r in lines.toLocalIterator()), "</table>")
