"""The five tools over indexed projects, as handlers of the protocol."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions.embed import HashingEmbedder
from corvine.plans import tools
from corvine.plans.indexer import Project, chunks_of, index
from corvine.plans.protocol import Server
from corvine.schemas import CHUNK
from corvine.sources import stores


class Engine:
    """Projects, their stores and their sessions. Answers have ``results``, their
    number ``count`` (A1), and ``indexing_status`` while any project is indexed (A11)."""

    def __init__(self, spark: SparkSession, projects: list[Project], embedder: HashingEmbedder | None = None):
        self.spark, self.projects, self.embedder = spark, projects, embedder or HashingEmbedder()
        self.busy = dict.fromkeys((p.root for p in projects), False)
        self.sessions = [stores.SessionStore(p.data.removeprefix("file://") + "/sessions") for p in projects]

    def index(self, rebuild: bool = False) -> dict[str, dict[str, int]]:
        out = {}
        for p in self.projects:
            self.busy[p.root] = True
            try:
                out[p.root] = index(self.spark, p, rebuild)
            finally:
                self.busy[p.root] = False
        return out

    def chunks(self) -> DataFrame:
        """U1, with the root of each project."""
        found = chunks_of(self.spark, self.projects)
        return self.spark.createDataFrame([], CHUNK).withColumn("project", F.lit("")) if found is None else found

    def vectors(self) -> DataFrame:
        out = None
        for p in self.projects:
            own = stores.load(self.spark, p.vectors)
            own = None if own is None else own.select("project", "chunk_id", F.col("embedding").cast("array<double>").alias("v"))
            out = own if out is None else out if own is None else out.unionByName(own)
        return self.spark.createDataFrame([], "project string, chunk_id string, v array<double>") if out is None else out

    def answer(self, rows: DataFrame, *more: str) -> dict[str, Any]:
        """What a tool shows of ``rows``, paths relative to their project's root."""
        root = F.lit("")
        for p in self.projects:
            root = F.when(F.col("project") == p.name, F.lit(p.root)).otherwise(root)
        shown = tools.output_rows(rows, root, len(self.projects) > 1, more)
        found = [{k: v for k, v in r.asDict().items() if v is not None} for r in shown.collect()]
        return self.told({"results": found, "count": len(found)})

    def told(self, answer: dict[str, Any]) -> dict[str, Any]:
        return answer | {"indexing_status": "in_progress"} if any(self.busy.values()) else answer

    def search_code(self, a: dict) -> dict[str, Any]:
        limit = int(a.get("limit", 10))
        return self.answer(tools.search_code(self.chunks(), self.vectors(), str(a["query"]), limit, self.embedder), "warning")

    def search_symbol(self, a: dict) -> dict[str, Any]:
        return self.answer(tools.search_symbol(self.chunks(), str(a["name"]), str(a.get("kind", "any"))))

    def get_context(self, a: dict) -> dict[str, Any]:
        line, radius = int(a.get("line", 0)), int(a.get("radius", 50))
        parts: dict[str, list] = {"local": [], "related": []}
        chunks, vectors = self.chunks(), self.vectors()
        for p in self.projects:
            own = F.col("project") == p.name
            found = self.answer(tools.get_context(chunks.where(own), vectors.where(own), str(a["file"]), line, radius, p.root), "relation")
            for r in found["results"]:
                parts[r.pop("relation")].append(r)
        return self.told({"results": parts["local"], "related": parts["related"], "count": len(parts["local"])})

    def get_session_memory(self, a: dict) -> dict[str, Any]:
        rows = tools.get_session_memory([s.load_all(self.spark) for s in self.sessions], str(a.get("query") or "")).collect() if self.sessions else []
        return {"results": [r.asDict() for r in rows], "count": len(rows)}

    def save_session_summary(self, a: dict) -> dict[str, Any]:
        """T-5: to the first project's store."""
        if not self.sessions:
            return {"saved": False, "error": "no project has a session store"}
        texts = lambda key: [str(x) for x in a.get(key) or []]
        return {"saved": True, "id": self.sessions[0].save(str(a["summary"]), texts("key_files"), texts("key_decisions"))}

    def server(self) -> Server:
        out = Server()
        handlers: list[Callable[[dict], Any]] = [self.search_code, self.search_symbol, self.get_context, self.get_session_memory, self.save_session_summary]
        for h in handlers:
            out.register(h.__name__, h)
        return out
