"""Cold and warm indexing of project trees into chunk and vector tables."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.operators.changes import file_status
from corvine.operators.chunking import Limits, chunk_files
from corvine.plans.tools import embedded
from corvine.sources import stores
from corvine.sources.files import scan


@dataclass
class Project:
    name: str
    root: str
    data: str

    @property
    def files(self) -> str:
        return f"{self.data}/files"

    @property
    def chunks(self) -> str:
        return f"{self.data}/chunks"

    @property
    def vectors(self) -> str:
        return f"{self.data}/vectors"


def distinct_projects(specs: list[Project]) -> list[Project]:
    """The first of every root."""
    seen: dict[str, Project] = {}
    for s in specs:
        seen.setdefault(os.path.realpath(s.root), s)
    return list(seen.values())


def index(spark: SparkSession, project: Project, rebuild: bool = False, limits: Limits = Limits()) -> dict[str, int]:
    """H1-H3: chunks and embeds what is new or changed, drops what is gone, and
    writes nothing if nothing is. Files are remembered by hash, with or without
    chunks. Returns counts by file status and of chunks and vectors (A3, A4)."""
    found = scan(spark, project.root).cache()
    old_files = None if rebuild else stores.load(spark, project.files)
    old_chunks = None if rebuild else stores.load(spark, project.chunks)
    warm = old_files is not None and old_chunks is not None
    listed = found.select("path", F.col("file_content_hash").alias("hash"))
    if not warm:
        old_files = listed.limit(0)
    status = file_status(old_files, listed).cache()
    counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
    if warm and not set(counts) - {"unchanged"}:
        found.unpersist()
        status.unpersist()
        return counts
    delta = found.join(status.where("status in ('new', 'changed')").select("path"), "path", "left_semi")
    fresh = chunk_files(delta.select("path", "content"), limits).withColumn("project", F.lit(project.name))
    vectors = embedded(fresh).select("project", "chunk_id", F.col("v").cast("array<float>").alias("embedding"))
    if warm:
        stay = old_chunks.join(status.where("status = 'unchanged'").select(F.col("path").alias("file_path")), "file_path", "left_semi")
        old_vectors = stores.load(spark, project.vectors)
        vectors = old_vectors.join(stay.select("chunk_id"), "chunk_id", "left_semi").unionByName(vectors)
        fresh = stay.unionByName(fresh)
    stores.save_all({"chunks": fresh, "vectors": vectors, "files": listed}, project.data)
    found.unpersist()
    status.unpersist()
    chunks = stores.load(spark, project.chunks)
    return counts | {"chunks": chunks.count(), "vectors": stores.load(spark, project.vectors).where("embedding is not null").count()}


def specs(paths: list[str], data_dir: str = "", config: str = "") -> list[Project]:
    """Projects of the command line, then those of a TOML file, the first
    of every root. ``data_dir`` is for a single project; else data lies in the
    project's own folder ``.corvine``."""
    named = [{"path": p, "data_dir": data_dir if len(paths) == 1 else ""} for p in paths]
    named += stores.projects(config) if config and os.path.isfile(config) else []
    out = []
    for s in named:
        root = os.path.realpath(s["path"])
        data = s["data_dir"] or f"{root}/.corvine"
        out.append(Project(os.path.basename(root), root, data if "://" in data else f"file://{os.path.abspath(data)}"))
    return distinct_projects(out)


def chunks_of(spark: SparkSession, projects: list[Project]) -> DataFrame | None:
    """The chunks of all projects."""
    out = None
    for p in projects:
        own = stores.load(spark, p.chunks)
        if own is not None:
            out = own if out is None else out.unionByName(own)
    return out
