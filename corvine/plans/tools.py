"""The five tools as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.functions.embed import HashingEmbedder
from corvine.functions.text import ascii_lower, basename, contains_all_words, contains_icase, l2_normalize, relative_path, session_keywords
from corvine.operators.changes import first_wins
from corvine.operators.vectors import inner, ranked, searched
from corvine.session import ship, tune


def output_rows(rows: DataFrame, root: Column, many_projects: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """What a tool shows of chunks: a relative path, a symbol only if
    there is one, a score only from 0 on, a project only among several."""
    shown = [relative_path(F.col("file_path"), root).alias("file_path"), "start_line", "end_line", "language", "source_text", "chunk_id", F.when(F.col("symbol_name") != "", F.col("symbol_name")).alias("symbol_name")]
    if "score" in rows.columns:
        shown.append(F.when(F.col("score") >= 0, F.col("score")).alias("score"))
    if many_projects:
        shown.append("project")
    shown += more
    return rows.select(*shown)


def embedded(chunks: DataFrame, embedder: HashingEmbedder | None = None) -> DataFrame:
    """(project, chunk_id, v) of chunk texts; texts without a word have
    a null vector and stay findable by symbol."""
    ship(chunks.sparkSession)
    tune(chunks.sparkSession)
    e, text = embedder or HashingEmbedder(), F.col("source_text")
    return chunks.select("project", "chunk_id", (e.unit(text) if isinstance(e, HashingEmbedder) else l2_normalize(e.embed(text))).alias("v"))


def with_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunks; a hit without one carries a warning."""
    joined = hits.join(chunks, ["project", "chunk_id"], "left")
    return joined.withColumn("warning", F.when(F.col("file_path").isNull(), "chunk metadata not found"))


def asked(query: str, embedder: HashingEmbedder) -> list[float]:
    """The vector of a query, of length one."""
    if not query:
        raise ValueError("query is required")
    q = embedder.embed_text(query)
    length = sum(x * x for x in q) ** 0.5
    if not length:
        raise ValueError("query has no words")
    return [x / length for x in q]


def search_code(chunks: DataFrame, vectors: DataFrame, query: str, limit: int = 10, embedder: HashingEmbedder | None = None) -> DataFrame:
    """T-1: the ``limit`` best chunks of all projects for a text."""
    wanted = asked(query, embedder or HashingEmbedder())
    if limit < 0:
        raise ValueError("limit is negative")
    hits = searched(vectors, wanted, limit, ["project", "chunk_id"]).select("project", "chunk_id", "score")
    few = F.broadcast(hits.select("project", "chunk_id"))  # chunks are not shuffled for a few hits
    return with_chunks(hits, chunks.join(few, ["project", "chunk_id"], "left_semi")).orderBy(F.desc("score"), "project", "chunk_id")


def of_kind(text: Column, kind: str) -> Column:
    """What a chunk's text looks like; unknown kinds take all."""
    has = lambda x: F.rlike(text, F.lit(f"(?i){re.escape(x)}"))  # noqa: E731  (ASCII letters only, and no copy of the text)
    if kind == "function":
        return has("def ") | has("function ") | has("fn ") | (has("(") & ~has("class ") & ~has("struct "))
    if kind == "class":
        return has("class ") | has("struct ")
    return F.lit(True)


def search_symbol(chunks: DataFrame, name: str, kind: str = "any") -> DataFrame:
    """T-2, P6: chunks whose symbol contains ``name``, in the order of project,
    path, line and id."""
    if not name:
        raise ValueError("name is required")
    found = chunks.where((F.col("symbol_name") != "") & contains_icase(F.col("symbol_name"), F.lit(name)) & of_kind(F.col("source_text"), kind))
    found = found.repartition(F.col("chunk_id"))  # else the chunks are made once more, to sample them for the order
    return found.orderBy("project", "file_path", "start_line", "chunk_id")


def file_tier(path: Column, root: Column, wanted: Column) -> Column:
    """P10: 1 the whole path, 2 the relative path, 3 the base name with a
    relative path that ends in what was asked for; null: another file."""
    low, ask = ascii_lower(path), ascii_lower(wanted)
    relative = ascii_lower(relative_path(path, root))
    return F.when(low == ask, 1).when(relative == ask, 2).when((basename(low) == basename(ask)) & F.endswith(relative, ask), 3)


def in_window(line: Column, radius: Column) -> Column:
    """Lines of a chunk meet [line - radius, line + radius]."""
    return ~((F.col("end_line") < F.greatest(F.lit(1), line - radius)) | (F.col("start_line") > line + radius))


def maybe_named(path: Column, file: str) -> Column:
    """True of all paths that ``file_tier`` may take for ``file``, and of few others."""
    return F.rlike(path, F.lit(f"(?i){re.escape(file.rsplit('/', 1)[-1])}\\z"))


def _near(file: str, line: int, radius: int, root: str) -> Column:
    if not file:
        raise ValueError("file is required")
    near = maybe_named(F.col("file_path"), file) & file_tier(F.col("file_path"), F.lit(root), F.lit(file)).isNotNull()
    return near & in_window(F.lit(line), F.lit(radius)) if line > 0 else near


def _context(local: DataFrame, others: DataFrame) -> DataFrame:
    out = local.withColumns({"score": F.lit(None).cast("double"), "relation": F.lit("local")}).unionByName(others.withColumn("relation", F.lit("related")))
    return out.orderBy("relation", F.desc("score"), "project", "file_path", "start_line", "chunk_id")


def get_context(chunks: DataFrame, vectors: DataFrame, file: str, line: int = 0, radius: int = 50, root: str = "", related: int = 5) -> DataFrame:
    """T-3: chunks of a file near a line (all of them for line 0), and up to
    ``related`` chunks of each project nearest to the first of them there,
    without those (L10, J2, J3). ``relation`` is local or related."""
    local = chunks.where(_near(file, line, radius, root))
    seeds = local.groupBy("project").agg(F.min(F.struct("file_path", "start_line", "chunk_id"))["chunk_id"].alias("chunk_id"))
    # what is few is sent to all tasks, so that neither vectors nor chunks are shuffled
    seeds = vectors.select("project", "chunk_id", F.col("v").alias("q")).join(F.broadcast(seeds), ["project", "chunk_id"]).select("project", "q")
    scored = vectors.join(F.broadcast(seeds), "project").withColumn("score", F.round(inner(F.col("v"), F.col("q")), 6) + 0.0)
    best = ranked(scored.where("score is not null"), related, ["project"], ["chunk_id"]).select("project", "chunk_id", "score")
    best = best.join(F.broadcast(local.select("project", "chunk_id")), ["project", "chunk_id"], "left_anti")
    return _context(local, chunks.join(F.broadcast(best), ["project", "chunk_id"]))


def context_of_files(own: DataFrame, scored: Callable[[list[list[float]]], DataFrame], file: str, line: int = 0, radius: int = 50, root: str = "", related: int = 5) -> DataFrame:
    """The same for chunks that are not stored. ``own`` has chunks and vectors ``v`` of
    files that may be that one, ``scored`` gives all chunks with their ``scores`` for
    vectors. The few chunks near the line go to the driver."""
    spark, shown = own.sparkSession, [c for c in own.columns if c != "v"]
    near = own.where(_near(file, line, radius, root))
    rows = near.collect()
    local = spark.createDataFrame([tuple(r[c] for c in shown) for r in rows], near.select(*shown).schema)
    seeds = {}
    for r in sorted(rows, key=lambda r: (r.file_path, r.start_line, r.chunk_id)):
        seeds.setdefault(r.project, r.v)
    seeds = {p: v for p, v in seeds.items() if v is not None}
    all_rows = scored(list(seeds.values()))
    own_score = F.lit(None).cast("double")
    for k, p in enumerate(seeds):
        own_score = F.when(F.col("project") == p, F.col("scores")[k]).otherwise(own_score)
    found = all_rows.select(*shown, (F.round(own_score, 6) + 0.0).alias("score")).where("score is not null")
    best = ranked(found, related, ["project"], ["chunk_id"]).drop("rank")
    return _context(local, best.join(F.broadcast(local.select("project", "chunk_id")), ["project", "chunk_id"], "left_anti"))


def get_session_memory(stores: list[DataFrame], query: str = "") -> DataFrame:
    """T-4: sessions of all stores (the first store wins an id), latest first,
    those with every word of ``query``."""
    every = None
    for k, s in enumerate(stores):
        s = s.withColumn("_store", F.lit(k))
        every = s if every is None else every.unionByName(s)
    once = first_wins(every, "id", "_store").drop("_store")
    text = session_keywords(F.col("summary"), F.col("key_files"), F.col("key_decisions"))
    return once.where(contains_all_words(text, F.lit(query))).orderBy(F.desc("id"))
