"""The small JSON documents beside recordings: manifests, frame rates, overrides of sessions, sidecars and playlists.

Tables of them are read by Spark with explicit schemas; one document of one folder is replaced by the driver in one move.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.sinks.staging import OutputExists, publish

#: The names of documents in a folder, and the largest frame rate.
SESSIONS, FPS, SIDECAR, LARGEST_FPS = "sessions.json", "session.json", ".metadata.json", 90_000
OUTPUTS = "array<struct<topic:string,path:string,bytes:long,frames:long,duration_s:double,width:int,height:int,co64:boolean,audio:array<struct<samples:long,gaps:long,offset_to_video_ms:double>>>>"
#: The fields of a manifest's record.
MANIFEST = f"source string, status string, outputs {OUTPUTS}, warnings array<struct<topic:string,code:string,message:string>>, error_code string, error string, source_bytes long, elapsed_s double, mb_per_s double, fps_used double, time_source string, topics map<string,long>, verify map<string,struct<quick:boolean,payload_matches_source:boolean>>, sidecar string"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def replace(path: str, text: str) -> None:
    """Writes a document beside its place and moves it there."""
    store, name = _store(path)
    part = f"{name}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(text.encode())
    store.move(part, name)


#: Where the segments of a manifest on a store that can't append lie: a folder of this name beside its place, one file a batch.
SEGMENTS = ".segments"


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """A manifest of one JSON object a line, with line, which rises along it: segments come after the file, in the order of their numbers. Lines that are
    no JSON or name no source are left out."""
    lines = None
    for place, segment in ((path, F.lit(-1).cast("long")), (f"{path}{SEGMENTS}", F.regexp_extract("_metadata.file_name", r"^(\d+)", 1).cast("long"))):
        store, name = _store(place)
        if store.get_file_info(name).type != fs.FileType.NotFound:
            found = spark.read.text(place).select("value", F.struct(segment.alias("segment"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k")).alias("line"))
            lines = found if lines is None else lines.unionByName(found)
    if lines is None:
        raise FileNotFoundError(path)
    rows = lines.select("line", F.from_json("value", f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r")).select("line", "r.*")
    return rows.where(F.col("__bad").isNull() & F.col("source").isNotNull()).drop("__bad")


def append_manifest(path: str, records: list[dict], segmented: bool | None = None) -> None:
    """Adds the records of one batch to a manifest, in order; one writer at a time. On a local disk they go to the end of the file and are on disk when
    this returns. On stores that can't append (segmented) a batch is a file of its own in a folder beside it; nothing that is there is written again."""
    store, name = _store(path)
    text = "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in records).encode()
    if not (isinstance(store, fs.LocalFileSystem) if segmented is None else not segmented):
        store.create_dir(f"{name}{SEGMENTS}")
        taken = [f.base_name for f in store.get_file_info(fs.FileSelector(f"{name}{SEGMENTS}"))]
        number = max((int(t.split("-")[0]) for t in taken if t.split("-")[0].isdigit()), default=0) + 1
        place = f"{name}{SEGMENTS}/{number:09d}-{uuid.uuid4().hex}.jsonl"
        with store.open_output_stream(f"{name}{SEGMENTS}/.{number}.part") as out:  # hidden from readers until it is whole
            out.write(text)
        store.move(f"{name}{SEGMENTS}/.{number}.part", place)
        return
    store.create_dir(name.rpartition("/")[0] or ".")
    with open(name, "ab") as out:
        out.write(text)
        out.flush()
        os.fsync(out.fileno())


def _json_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """folder (local ones without a scheme), name, value (the whole text) of the files whose name fits pattern."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.regexp_replace(F.regexp_replace("_metadata.file_path", "/[^/]*$", ""), "^file:(//)?(?=/)", "").alias("folder"), F.col("_metadata.file_name").alias("name"), "value")


def folder_fps(spark: SparkSession, path: str) -> DataFrame:
    """folder, fps, num, den of the session.json files at or below path; fps may be a number or a fraction. Invalid ones, and rates that aren't
    above 0 and at most 90000, are left out."""
    rows = _json_files(spark, path, FPS).select("folder", F.trim(F.get_json_object("value", "$.fps")).alias("v"))
    part = lambda k: F.regexp_extract("v", r"^([0-9]+(?:\.[0-9]+)?)(?:/([0-9]+))?$", k)
    num, den = F.expr("try_cast(n as decimal(20,6))"), F.expr("try_cast(if(d = '', '1', d) as long)")
    rows = rows.select("folder", part(1).alias("n"), part(2).alias("d")).select("folder", num.alias("num"), den.alias("den"))
    return rows.withColumn("fps", F.try_divide(F.col("num").cast("double"), F.col("den"))).where((F.col("fps") > 0) & (F.col("fps") <= LARGEST_FPS))


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """folder, a, b, kind (join or split) of the sessions.json files at or below path; invalid ones have none."""
    shape = "overrides struct<join:array<array<string>>,split:array<array<string>>>"
    rows = _json_files(spark, path, SESSIONS).select("folder", F.from_json("value", shape).alias("d"))
    none = F.array().cast("array<array<string>>")

    def pairs(kind: str):
        return F.transform(F.coalesce(F.col(f"d.overrides.{kind}"), none), lambda p: F.struct(F.lit(kind).alias("kind"), F.get(p, F.lit(0)).alias("a"), F.get(p, F.lit(1)).alias("b")))

    kinds = F.concat(pairs("join"), pairs("split"))
    return rows.select("folder", F.explode(kinds).alias("o")).select("folder", "o.a", "o.b", "o.kind")


def set_override(folder: str, a: str, b: str, kind: str) -> dict:
    """Sets a pair's override in a folder's document to join or split, or clears it; the rest of the document stays."""
    if kind not in ("join", "split", "clear"):
        raise ValueError("kind is join, split or clear")
    store, name = _store(f"{folder}/{SESSIONS}")
    document = {"version": 1, "sessions": []}
    if store.get_file_info(name).is_file:
        with store.open_input_stream(name) as file:
            try:
                document = json.loads(file.read()) or document
            except ValueError:
                pass
    old = document.get("overrides") or {}
    document["overrides"] = {k: [p for p in old.get(k, []) if list(p) != [a, b]] + ([[a, b]] if k == kind else []) for k in ("join", "split")}
    replace(f"{folder}/{SESSIONS}", json.dumps(document, indent=2, ensure_ascii=False))
    return document["overrides"]


def save_sessions(detected: DataFrame, overrides: dict[str, dict] | None = None) -> None:
    """Writes each folder's sessions (of sessions.detect) as its sessions.json, from tasks; overrides by folder are kept as given."""
    given = overrides or {}
    sessions = detected.groupBy("folder", "session").agg(F.min("title").alias("id"), F.min("origin").alias("origin"), F.transform(F.array_sort(F.collect_list(F.struct("part_index", "name", "previous", "reason", "gap_frames"))), lambda x: x).alias("parts"))
    folders = sessions.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("session", "id", "origin", "parts"))).alias("sessions"))

    def write(rows) -> None:
        for r in rows:
            found = [
                {"id": s.id, "origin": s.origin, "files": [p.name for p in s.parts], "joins": [{"from": p.previous, "to": p.name, "gap_frames": p.gap_frames, "reason": p.reason} for p in s.parts[1:]]}
                for s in r.sessions
            ]
            replace(f"{r.folder}/{SESSIONS}", json.dumps({"version": 1, "sessions": found, "overrides": given.get(r.folder, {"join": [], "split": []})}, indent=2, ensure_ascii=False))

    folders.foreachPartition(write)


#: The fields of a sidecar that are read.
SIDE = "source array<string>, session struct<id:string,index:int,count:int,merged:boolean>, video array<struct<topic:string,output:string,mp4:struct<duration_s:double>>>, audio array<string>"


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """folder, name and the fields of SIDE of the sidecars at or below path; those without video, or that are no JSON, are left out. A source
    that is one text counts as a list of one."""
    raw = _json_files(spark, path, f"*{SIDECAR}")
    source = F.get_json_object("value", "$.source")
    rows = raw.select("folder", "name", F.from_json("value", SIDE).alias("d"), source.alias("s"), F.get_json_object("value", "$.video").alias("v"))
    own = F.when(F.col("s").startswith("["), F.from_json("s", "array<string>")).when(F.col("s").isNotNull(), F.array("s")).otherwise(F.array().cast("array<string>"))
    return rows.where(F.col("v").isNotNull()).select("folder", "name", own.alias("source"), "d.session", "d.video", (F.size(F.coalesce("d.audio", F.array().cast("array<string>"))) > 0).alias("has_audio"))


def write_sidecars(rows: DataFrame) -> DataFrame:
    """Writes rows (path, document: JSON text) as files; path, written. A file that is there already is never replaced. Of rows with one path the smallest
    document counts. Folders that aren't there are made.

    Tasks write each document beside its place; the driver publishes those of the attempts that counted, each by a step that only one
    of two racing writers can make on a local disk (staging.publish). So a repeated task never reports a file as another's."""
    spark, run = rows.sparkSession, uuid.uuid4().hex

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = set()
        for b in batches:
            parts = []
            for path, text in zip(b["path"], b["document"]):
                store, name = _store(path)
                if "/" in name and (folder := name.rsplit("/", 1)[0]) not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                parts.append(f"{name}.{run}.{uuid.uuid4().hex}.part")
                with store.open_output_stream(parts[-1]) as out:
                    out.write(text.encode())
            yield pd.DataFrame({"path": b["path"], "part": parts})

    staged = rows.groupBy("path").agg(F.min("document").alias("document")).mapInPandas(task, "path string, part string")
    done = []
    for path, part in staged.collect():  # one short row a document
        store, name = _store(path)
        try:
            publish(store, part, name)
            done.append((path, True))
        except OutputExists:
            done.append((path, False))
    for folder in {path.rpartition("/")[0] for path, _ in done}:
        store, name = _store(folder)
        for f in store.get_file_info(fs.FileSelector(name or ".")):
            if f".{run}." in f.base_name:  # of this run: published ones' second names, losers, and attempts that didn't count
                store.delete_file(f.path)
    return spark.createDataFrame(done, "path string, written boolean")


#: The fields of a playlist.
PLAYLIST = "version int, play_mode string, items array<struct<title:string,parts:array<struct<cameras:map<string,string>,duration_s:double,has_audio:boolean>>,kind:string,source_files:array<string>>>, state struct<index:int,position_s:double,speed:double>"


def read_playlists(spark: SparkSession, path: str, pattern: str = "*.m2playlist") -> DataFrame:
    """folder, name, play_mode, items, state of playlists; an unknown mode is sequential, and an index outside the items -1."""
    from reelspan.operators.playlist import MODES

    rows = _json_files(spark, path, pattern).select("folder", "name", F.from_json("value", PLAYLIST).alias("d"))
    items = F.coalesce("d.items", F.array().cast(rows.schema["d"].dataType["items"].dataType))
    index = F.coalesce("d.state.index", F.lit(0))
    state = F.struct(F.when((index >= 0) & (index < F.size(items)), index).otherwise(-1).alias("index"), F.coalesce("d.state.position_s", F.lit(0.0)).alias("position_s"), F.coalesce("d.state.speed", F.lit(1.0)).alias("speed"))
    return rows.where(F.col("d").isNotNull()).select("folder", "name", F.when(F.col("d.play_mode").isin(*MODES), F.col("d.play_mode")).otherwise("sequential").alias("play_mode"), items.alias("items"), state.alias("state"))


def playlist_documents(playlists: DataFrame) -> DataFrame:
    """path, document of playlists (folder, name, play_mode, items, state), for write_sidecars or replace()."""
    state = F.struct(F.greatest("state.index", F.lit(0)).alias("index"), F.col("state.position_s").alias("position_s"), F.col("state.speed").alias("speed"))
    return playlists.select(F.concat_ws("/", "folder", "name").alias("path"), F.to_json(F.struct(F.lit(1).alias("version"), "play_mode", "items", state.alias("state"))).alias("document"))
