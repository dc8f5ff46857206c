"""Names and labels as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that file names can't hold, and names that Windows keeps for devices.
ILLEGAL = r'[<>:"/\\|?*\x00-\x1F]'
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
LONGEST = 200


def sanitize(text: Column, fallback: str = "channel") -> Column:
    """A legal file name: illegal characters become _, blanks and dots at the ends go, reserved names get a _ before them."""
    clean = F.regexp_replace(F.regexp_replace(text, ILLEGAL, "_"), r"^[ .]+|[ .]+$", "")
    clean = F.when(F.upper(clean).isin(*RESERVED), F.concat(F.lit("_"), clean)).otherwise(clean)
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit(fallback)).otherwise(clean)


def topic_label(topic: Column) -> Column:
    """/a/cam/0 becomes a_cam_0; the label is a legal file name, channel for an empty one."""
    return sanitize(F.replace(F.trim(topic, F.lit("/")), F.lit("/"), F.lit("_")), "channel")


def codec(fmt: Column) -> Column:
    """h265, h264 or the lower-cased name; unknown for an empty one."""
    f = F.lower(F.trim(F.coalesce(fmt, F.lit(""))))
    return F.when(f == "", "unknown").when(f.contains("265") | f.contains("hevc"), "h265").when(f.contains("264") | f.contains("avc"), "h264").otherwise(f)


#: The names that stand in for an empty recording and an empty session.
RECORDING, SESSION = "rekaman", "sesi"


def fill(pattern: str, fallback: str = RECORDING, **tokens: Column) -> Column:
    """pattern with its {tokens} replaced, as a legal file name of at most LONGEST characters without blanks or dots at its end."""
    text = reduce(lambda t, kv: F.replace(t, F.lit("{%s}" % kv[0]), kv[1].cast("string")), tokens.items(), F.lit(pattern))
    cut = F.regexp_replace(F.substring(sanitize(text, fallback), 1, LONGEST), r"[ .]+$", "")
    return F.when(cut == "", fallback).otherwise(cut)


def output_name(stem: Column, topic: Column, index: Column, date: Column, pattern: str) -> Column:
    """An output's name by a pattern of {nama}, {topik}, {indeks} and {tanggal}; date is a date or timestamp."""
    return fill(pattern, nama=sanitize(stem, RECORDING), topik=topic_label(topic), indeks=index, tanggal=F.date_format(date, "yyyyMMdd"))


def session_name(first: Column, last: Column, count: Column, pattern: str = "{pertama}~{terakhir}") -> Column:
    """A session's name by a pattern of {pertama}, {terakhir} and {jumlah}."""
    text = reduce(lambda t, kv: F.replace(t, F.lit("{%s}" % kv[0]), kv[1].cast("string")), (("pertama", first), ("terakhir", last), ("jumlah", count)), F.lit(pattern))
    return sanitize(text, SESSION)


def common_title(stems: Column) -> Column:
    """The longest beginning that all names of an array share, without digits and separators at its end, and without a word for camera there."""
    first = F.array_min(stems)
    other = F.array_max(stems)  # in order, the first and last differ soonest
    same = F.filter(F.sequence(F.lit(0), F.length(first)), lambda n: F.substring(first, F.lit(1), n) == F.substring(other, F.lit(1), n))
    title = F.regexp_replace(F.substring(first, F.lit(1), F.array_max(same)), r"[_\-. 0-9]+$", "")
    word = F.regexp_extract(title, r"(?i)(_camera|_cam|camera|cam)$", 1)
    return F.when(word != "", F.regexp_replace(F.substring(title, F.lit(1), F.length(title) - F.length(word)), r"[_\-. ]+$", "")).otherwise(title)


def output_folder(mode: Column, path_folder: Column, output_dir: Column, rel_folder: Column, mirror: Column) -> Column:
    """Where a file's outputs go: beside it, else to the output folder, with the source's folders below it if mirrored."""
    below = F.when(F.coalesce(mirror, F.lit(True)) & ~rel_folder.isin("", "."), F.concat_ws("/", output_dir, rel_folder)).otherwise(output_dir)
    return F.when(mode == "beside", path_folder).otherwise(below)


def reports_folder(reports_dir: Column, mode: Column, output_dir: Column, source_dir: Column) -> Column:
    """The folder of reports: the named one, else the output folder, else one in the source folder."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(given(reports_dir), reports_dir).when((mode != "beside") & given(output_dir), output_dir).otherwise(F.concat(source_dir, F.lit("/_reports")))


def camera_name(stem: Column) -> tuple[Column, Column]:
    """Prefix and digit of a name that ends in one camera digit; null for others."""
    prefix, digit = (F.regexp_extract(stem, r"^(.*\D)(\d)$", k) for k in (1, 2))
    is_camera = F.lower(prefix).contains("cam")
    return F.when(is_camera, prefix), F.when(is_camera, digit.cast("int"))


def fingerprint(*parts: Column) -> Column:
    """Eight hex digits of the SHA-1 of the parts, joined by |."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 8)


def group_id(stem: Column, topics: Column, sources: Column) -> Column:
    """The key of outputs that belong together: 16 hex digits of the SHA-1 of the stem, the topics in order and the sources, apart by NUL."""
    nul = "\x00"
    return F.substring(F.sha1(F.concat_ws(nul, stem, F.array_join(F.array_sort(topics), nul), F.array_join(sources, nul))), 1, 16)


def list_key(names: Column, digits: int = 12) -> Column:
    """A key of an ordered list of names."""
    return F.substring(F.sha1(F.array_join(names, "\n")), 1, digits)
