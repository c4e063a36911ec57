"""Chunk, vector and session stores.

Tables are Parquet snapshots: a write goes to a folder of its own, and one file
that names the current snapshots is moved over the old one, so readers see the old
or the new tables whole, also after a crash between the two. A pointer names one
table's snapshot, a manifest those of several tables that belong together.
"""

from __future__ import annotations

import json
import os
import tomllib
import uuid
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.schemas import CHUNK, SESSION, VECTOR


def _paths(spark: SparkSession):
    jvm = spark.sparkContext._jvm
    return jvm, spark.sparkContext._jsc.hadoopConfiguration(), jvm.org.apache.hadoop.fs.Path


def _replace(spark: SparkSession, path: str, text: str) -> None:
    """A small file's new content, switched to in one step."""
    jvm, conf, Path_ = _paths(spark)
    target, new = Path_(path), Path_(f"{path}.{uuid.uuid4().hex}.new")
    out = target.getFileSystem(conf).create(new, True)
    out.write(text.encode())
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(new, target, options)


def _staged(df: DataFrame, folder: str, partition: str | None = None) -> str:
    name = f"snapshot-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition) if partition else writer).parquet(f"{folder}/{name}")
    return name


def _snapshots(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """Age and name of all snapshots, the oldest first."""
    _, conf, Path_ = _paths(spark)
    fs = Path_(folder).getFileSystem(conf)
    if not fs.exists(Path_(folder)):
        return []
    return sorted((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(Path_(folder)) if s.getPath().getName().startswith("snapshot-"))


def _cleaned(spark: SparkSession, folder: str, current: str, before: str | None) -> None:
    """Snapshots but the current one and the one before it go: its readers may
    still be at work."""
    _, conf, Path_ = _paths(spark)
    for _, name in _snapshots(spark, folder):
        if name not in (current, before):
            Path_(folder).getFileSystem(conf).delete(Path_(f"{folder}/{name}"), True)


def save(df: DataFrame, folder: str, partition: str | None = None) -> None:
    """K1, K2: a staged snapshot, then the switch."""
    spark = df.sparkSession
    name, before = _staged(df, folder, partition), _current(spark, folder)
    _replace(spark, f"{folder}/pointer", name)
    _cleaned(spark, folder, name, before)


def save_all(tables: dict[str, DataFrame], data: str) -> None:
    """Tables below ``data`` that are switched to together."""
    spark = next(iter(tables.values())).sparkSession
    before = {n: _current(spark, f"{data}/{n}") for n in tables}
    names = {n: _staged(df, f"{data}/{n}") for n, df in tables.items()}
    _replace(spark, f"{data}/manifest", json.dumps(names))
    for n, name in names.items():
        _cleaned(spark, f"{data}/{n}", name, before[n])


def save_if(df: DataFrame, folder: str, changed: bool) -> bool:
    """K6: only when something was indexed anew or removed."""
    if changed:
        save(df, folder)
    return changed


def _current(spark: SparkSession, folder: str) -> str | None:
    """The name of the current snapshot."""
    if _exists(spark, f"{folder}/pointer"):
        return spark.read.text(f"{folder}/pointer").first()[0]
    parent, _, name = folder.rstrip("/").rpartition("/")
    if _exists(spark, f"{parent}/manifest"):
        return json.loads(spark.read.text(f"{parent}/manifest").first()[0]).get(name)
    return None


def load(spark: SparkSession, folder: str) -> DataFrame | None:
    """The current snapshot, None if there is none. Snapshots that nothing names
    as current are an error unless they are remains of a first write that failed."""
    name = _current(spark, folder)
    if name is not None:
        return spark.read.parquet(f"{folder}/{name}")
    if len(_snapshots(spark, folder)) > 1:
        raise RuntimeError(f"{folder} has snapshots but no pointer to the current one")
    return None


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_vectors(spark: SparkSession, folder: str, dimension: int) -> DataFrame | None:
    """None for a missing table or another dimension."""
    df = load(spark, folder)
    if df is None or dimension <= 0 or df.where(F.size("embedding") != dimension).limit(1).count():
        return None
    return df.select(*[f.name for f in VECTOR])


def import_chunks(spark: SparkSession, path: str) -> DataFrame | None:
    """Chunks from one JSON object of chunks by id. A row that lacks a field
    is passed over, but a missing file hash is ''; None for a missing file, bad
    JSON, another kind of value, or an object with no good row."""
    if not _exists(spark, path):
        return None
    fields = "map<string, struct<source_text:string,file_path:string,start_line:int,end_line:int,language:string,symbol_name:string,chunk_id:string,file_content_hash:string>>"
    held = spark.read.text(path, wholetext=True).select(F.from_json("value", fields).alias("m"), (F.trim("value") == "{}").alias("empty")).where("m is not null")
    rows = held.select(F.explode("m").alias("key", "c")).select("c.*").withColumn("file_content_hash", F.coalesce("file_content_hash", F.lit("")))
    rows = rows.dropna(subset=[f.name for f in CHUNK])
    return rows if rows.limit(1).count() or held.where("empty").limit(1).count() else None


class SessionStore:
    """Sessions as one JSON file each."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def save(self, summary: str, key_files: list[str] | None = None, key_decisions: list[str] | None = None, id: str = "", timestamp: str = "") -> str:
        now = datetime.now()
        self.folder.mkdir(parents=True, exist_ok=True)
        if not id:
            id = base = now.strftime("%Y%m%d_%H%M%S")
            k = 1
            while self._file(id).exists():  # two saves in a second
                id, k = f"{base}_{k}", k + 1
        row = {"id": id, "timestamp": timestamp or now.strftime("%Y-%m-%dT%H:%M:%S"), "summary": summary, "key_files": key_files or [], "key_decisions": key_decisions or []}
        new = self.folder / f".{uuid.uuid4().hex}.tmp"
        new.write_text(json.dumps(row), encoding="utf-8")
        os.replace(new, self._file(id))
        return id

    def _file(self, id: str) -> Path:
        return self.folder / f"session_{id}.json"

    def delete(self, id: str) -> bool:
        found = self._file(id).is_file()
        self._file(id).unlink(missing_ok=True)
        return found

    def load_all(self, spark: SparkSession) -> DataFrame:
        """All sessions; files that are no session are passed over."""
        if not any(self.folder.glob("session_*.json")):
            return spark.createDataFrame([], SESSION)
        rows = spark.read.schema(SESSION).option("multiLine", True).option("mode", "PERMISSIVE").json(str(self.folder), pathGlobFilter="session_*.json")
        return rows.where("id is not null")

    def load(self, spark: SparkSession, id: str) -> DataFrame:
        return self.load_all(spark).where(F.col("id") == id)


def projects(path: str) -> list[dict[str, str]]:
    """The ``[[project]]`` tables of a TOML file; other keys are ignored."""
    with open(path, "rb") as f:
        found = tomllib.load(f).get("project", [])
    found = found if isinstance(found, list) else []
    return [{"path": str(p["path"]).strip(" \t\"'"), "data_dir": str(p.get("data_dir", "")).strip(" \t\"'")} for p in found if isinstance(p, dict) and p.get("path")]
