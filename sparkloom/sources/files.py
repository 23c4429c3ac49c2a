"""Workspaces, rule files and memory mirrors as DataFrames."""

from __future__ import annotations

import json
import os
import re
import uuid

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import GENERATED, LANGUAGES

#: A memory row.
MEMORY = (
    "id string, project_id string, kind string, content string, tags array<string>, source string, superseded_by string, contradicts array<string>, parent_id string, caused_by array<string>, "
    "enables array<string>, created_at timestamp, updated_at timestamp, access_count int, last_accessed_at timestamp"
)


def workspace(spark: SparkSession, root: str, limit: int = 10_000, max_bytes: int | None = None, languages=tuple(LANGUAGES)) -> DataFrame:
    """Source files (file, text) under a folder: known extensions, no generated folders, at most limit files."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(languages) + "}").load(root)
    for g in GENERATED:
        df = df.where(~F.col("path").contains(g if g.startswith("/") else "/" + g))
    if max_bytes is not None:
        df = df.where(F.col("length") <= max_bytes)
    return df.select(F.col("path").alias("file"), F.decode("content", "utf-8").alias("text")).orderBy("file").limit(limit)


def _file_system(folder: str) -> tuple[str, pafs.FileSystem, str] | None:
    """URI, Arrow's file system and path of a folder; None where Arrow does not know its scheme."""
    uri = folder if "://" in folder else f"file://{os.path.abspath(folder)}"
    try:
        return uri, *pafs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None


def import_mirror(spark: SparkSession, folder: str, project: str) -> DataFrame:
    """Memory rows of a folder of JSON files: what does not parse, control files and other projects are left out. One task lists the
    folder (of this machine name by name), others read the files; the driver has none of the names. Where Arrow does not know the
    folder's scheme Spark's reader serves, whose driver lists all files."""
    reader = spark.read.schema(MEMORY + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record")
    at = _file_system(folder)
    if at is None or at[1].get_file_info(at[2]).type != pafs.FileType.Directory:
        df = reader.option("multiLine", True).json(folder, pathGlobFilter="*.json")
        df = df.where(~F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1).rlike("^(pending|ack)"))
    else:
        df = reader.json(_contents(spark, at[0]))
    return df.where("_corrupt_record is null and id is not null").where(F.col("project_id") == project).drop("_corrupt_record")


def _contents(spark: SparkSession, uri: str) -> RDD[str]:
    """Texts of the JSON files of a folder but hidden and control files. What has bytes of no encoding of JSON is left out."""

    def names(_):
        fs, root = pafs.FileSystem.from_uri(uri)
        if isinstance(fs, pafs.LocalFileSystem):
            with os.scandir(root) as found:
                yield from (f.name for f in found if f.name.endswith(".json") and f.is_file())
        else:
            yield from (f.base_name for f in fs.get_file_info(pafs.FileSelector(root)) if f.extension == "json" and f.is_file)

    def read(some):
        fs, root = pafs.FileSystem.from_uri(uri)
        for name in some:
            with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                raw = f.read()
            try:
                yield raw.decode(json.detect_encoding(raw))
            except UnicodeDecodeError:
                continue

    listed = spark.sparkContext.parallelize([0], 1).mapPartitions(names).filter(lambda name: not re.match(r"[.]|_(?!.*=)|pending|ack", name))
    return listed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapPartitions(read)


def export_mirror(rows: DataFrame, folder: str) -> None:
    """One JSON file for each row with a safe id, named by it; what the folder held before is gone. Tasks write the files by Arrow's file
    systems, each under a hidden name first, so that files appear whole. Spark's writer would make, commit and list a folder for each
    row, and start a process for the rights of each local file; it serves where Arrow does not know the folder's scheme."""
    safe = rows.where(F.col("id").rlike(r"^[A-Za-z0-9_.:-]{1,200}$") & ~F.col("id").contains(".."))
    if (at := _file_system(folder)) is None:
        return safe.withColumn("file", F.col("id")).write.mode("overwrite").partitionBy("file").json(folder)
    uri, fs, root = at
    fs.create_dir(root)
    fs.delete_dir_contents(root)

    def put(parts):
        own, _ = pafs.FileSystem.from_uri(uri)
        n = 0
        for batch in parts:
            for name, text in zip(batch["name"], batch["text"]):
                hidden = f"{root}/.{uuid.uuid4().hex}"
                with own.open_output_stream(hidden) as out:
                    out.write(text.encode())
                own.move(hidden, f"{root}/row-{name}.json")
            n += len(batch)
        yield pd.DataFrame({"n": [n]})

    each = safe.select(F.col("id").alias("name"), F.to_json(F.struct(*rows.columns)).alias("text"))
    each.mapInPandas(put, "n long").agg(F.sum("n")).collect()
    return None


def dependencies(manifest: DataFrame) -> DataFrame:
    """The names that package manifests (text) depend on."""
    keys = lambda p: F.coalesce(F.map_keys(F.from_json(F.get_json_object("text", p), "map<string,string>")), F.array().cast("array<string>"))
    return manifest.select(F.explode(F.array_sort(F.array_union(keys("$.dependencies"), keys("$.devDependencies")))).alias("name"))


def agent_specs(text: str) -> list[dict]:
    """Agents of a markdown text: sections '## Agent: name' with a fenced yaml block of 'key: value' lines."""
    out = []
    for section in re.split(r"(?m)^## Agent:\s*", text)[1:]:
        name, _, body = section.partition("\n")
        block = re.search(r"```ya?ml\n(.*?)```", body, re.S)
        if not block:
            continue
        spec, key = {"name": name.strip()}, None
        for line in block[1].split("\n"):
            if m := re.match(r"^(\w+):\s*(.*)$", line):
                key = m[1]
                spec[key] = "" if m[2] == "|" else m[2].strip().strip("\"'")
            elif key and line.startswith(" "):
                spec[key] = (spec[key] + "\n" + line.strip()).strip()
        out.append(spec)
    return out


def otel_export(summary: dict, events: list[str]) -> dict:
    """A summary as resource attributes and numbered events."""
    return {
        "resource": {"attributes": [{"key": k, "value": v} for k, v in sorted(summary.items())]},
        "events": [{"name": "project.event", "attributes": [{"key": "index", "value": i}, {"key": "text", "value": e}]} for i, e in enumerate(events, 1)],
    }
