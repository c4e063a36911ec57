"""Chunking of (path, content) files.

A row is a file, whole, so nothing is shuffled: blocks, pieces, groups and chunks
are found on the bytes of batches of files (``corvine.operators.cutting``). Sizes
are bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.functions.arrow import lists, matrix, spread
from corvine.functions.embed import HashingEmbedder
from corvine.functions.languages import language
from corvine.operators.cutting import Batch, Parts, chunks
from corvine.session import ship, tune


@dataclass(frozen=True)
class Limits:
    """C15."""

    min_tokens: int = 50
    max_tokens: int = 500
    chars_per_token: int = 4

    @property
    def least(self) -> int:
        return self.min_tokens * self.chars_per_token

    @property
    def most(self) -> int:
        return self.max_tokens * self.chars_per_token


def _lines(content: Column) -> Column:
    """A line end closes a line, and one carriage return before it goes."""
    parts = F.split(content, "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda x: F.when(F.endswith(x, F.lit("\r")), F.substr(x, F.lit(1), F.length(x) - 1)).otherwise(x))


def lines(files: DataFrame) -> DataFrame:
    """(path, lang, ln, line), numbered from 1. Empty files have no lines. The
    language is found once a file, not once a line."""
    some = files.where(F.octet_length("content") > 0)
    line = F.posexplode(_lines(F.col("content"))).alias("ln", "line")
    return some.select("path", language(F.col("path")).alias("lang"), line).select("path", "lang", (F.col("ln") + 1).alias("ln"), "line")


KIND = "path string, blk long, piece int, start_line int, end_line int, symbol string, size long"


def _by_batch(files: DataFrame, make: Callable[[Batch, pa.Array], pa.RecordBatch], kind: str) -> DataFrame:
    """What ``make`` gives for batches of the files that are not empty."""
    ship(files.sparkSession)
    tune(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield make(Batch(b.column("content"), b.column("lang").to_pylist()), b.column("path"))

    some = files.where(F.octet_length("content") > 0)
    return some.select("path", language(F.col("path")).alias("lang"), "content").mapInArrow(run, kind)


def boundaries(files: DataFrame) -> DataFrame:
    """(path, ln, symbol) of the lines that start blocks. Languages without
    patterns start blocks, without a symbol, after blank lines."""

    def make(b: Batch, path: pa.Array) -> pa.RecordBatch:
        at, symbol = b.heads()
        file = np.searchsorted(b.first, at, "right") - 1
        return pa.RecordBatch.from_arrays([path.take(pa.array(file)), pa.array((at - b.first[file] + 1).astype(np.int32)), b.names(symbol)], ["path", "ln", "symbol"])

    return _by_batch(files, make, "path string, ln int, symbol string")


def _parts(b: Batch, p: Parts, path: pa.Array) -> pa.RecordBatch:
    start, end = b.lines_of(p)
    return pa.RecordBatch.from_arrays([path.take(pa.array(p.file)), pa.array(p.number), pa.array(p.piece.astype(np.int32)), start, end, b.names(p.symbol), pa.array(b.size(p))], ["path", "blk", "piece", "start_line", "end_line", "symbol", "size"])


def blocks(files: DataFrame) -> DataFrame:
    """C4: (path, blk, piece, start_line, end_line, symbol, size), each block one
    piece; lines before the first start are block 0."""
    return _by_batch(files, lambda b, path: _parts(b, b.blocks(), path), KIND)


def pieces(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The same with oversize blocks split; the symbol stays on the first piece."""
    most = limits.most
    return _by_batch(files, lambda b, path: _parts(b, b.pieces(b.blocks(), most), path), KIND)


def merged(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(path, grp, start_line, end_line, symbol, size), tiny pieces joined to what
    is before them unless both are named."""
    least, most = limits.least, limits.most

    def make(b: Batch, path: pa.Array) -> pa.RecordBatch:
        p = b.pieces(b.blocks(), most)
        g, top = b.merged(p, least)
        start, end = b.lines_of(g)
        return pa.RecordBatch.from_arrays([path.take(pa.array(g.file)), pa.array(g.number), start, end, b.names(g.symbol), pa.array(b.sizes(p, top))], ["path", "grp", "start_line", "end_line", "symbol", "size"])

    return _by_batch(files, make, "path string, grp long, start_line int, end_line int, symbol string, size long")


def _chunked(files: DataFrame, make: Callable[[Batch], Parts], limits: Limits, hashed: bool = True) -> DataFrame:
    least, most = limits.least, limits.most
    found = _by_batch(files, lambda b, path: chunks(b, make(b), path, least, most, hashed), "source_text string, file_path string, start_line int, end_line int, symbol_name string, chunk_id string, file_content_hash string")
    found = found if hashed else found.drop("file_content_hash")
    return found.select("source_text", "file_path", "start_line", "end_line", language(F.col("file_path")).alias("language"), "symbol_name", "chunk_id", *["file_content_hash"] * hashed)


def chunk_files(files: DataFrame, limits: Limits = Limits(), hashed: bool = True) -> DataFrame:
    """The chunks of (path, content) files, by patterns of lines; without
    ``file_content_hash`` if not ``hashed``."""
    return _chunked(files, Batch.blocks, limits, hashed)


_FOUND = "file_path string, start_line int, end_line int, symbol_name string, chunk_id string"


def _vectors_of(files: DataFrame, embedder: HashingEmbedder, limits: Limits, last: Callable[[pa.Array], pa.Array], kind: str) -> DataFrame:
    least, most = limits.least, limits.most
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def make(b: Batch, path: pa.Array) -> pa.RecordBatch:
        c = chunks(b, b.blocks(), path, least, most, False)
        return pa.RecordBatch.from_arrays([*map(c.column, names), last(embedder.units(c.column("source_text")))], [*names, kind.split()[0]])

    return _by_batch(files, make, f"{_FOUND}, {kind}")


def embedded_files(files: DataFrame, embedder: HashingEmbedder, limits: Limits = Limits()) -> DataFrame:
    """The chunks by patterns with their vectors ``v`` for their texts, made
    where the texts are."""
    return _vectors_of(files, embedder, limits, lambda v: v, "v array<double>")


def scored_files(files: DataFrame, embedder: HashingEmbedder, queries: list[list[float]], limits: Limits = Limits()) -> DataFrame:
    """The same with the ``scores`` of a few queries of length one for the vectors;
    null for chunks without a vector."""
    q = np.array(queries, np.float64).reshape(len(queries), embedder.dimension)

    def scores(v: pa.Array) -> pa.Array:
        full = v.is_valid()
        x = matrix(v.filter(full)).reshape(-1, q.shape[1])
        return spread(lists(np.stack([(x * y).sum(axis=1) for y in q], axis=1) if len(q) else np.empty((len(x), 0))), full)

    return _vectors_of(files, embedder, limits, scores, "scores array<double>")


def defined(files: DataFrame) -> DataFrame:
    """(path, start, end, symbol) of all definitions, lines from 0, ends
    exclusive; nothing for files that can't be read by structure."""

    def make(b: Batch, path: pa.Array) -> pa.RecordBatch:
        rows = [(f, first - 1, last, name) for f, defs in enumerate(b.found()) for first, last, name in defs or []]
        file, start, end, name = ([r[k] for r in rows] for k in range(4))
        return pa.RecordBatch.from_arrays([path.take(pa.array(file, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(name, pa.string())], ["path", "start", "end", "symbol"])

    return _by_batch(files, make, "path string, start int, end int, symbol string")


def structured(files: DataFrame) -> DataFrame:
    """(path, start, end, symbol) of the blocks of files that have
    definitions: the innermost ones, and unnamed ones for what lies before, between
    and after them."""

    def make(b: Batch, path: pa.Array) -> pa.RecordBatch:
        p = b.by_structure(b.found())
        start, end = b.lines_of(p)
        return pa.RecordBatch.from_arrays([path.take(pa.array(p.file)), pc.subtract(start, pa.scalar(1, pa.int32())), end, b.names(p.symbol)], ["path", "start", "end", "symbol"])

    return _by_batch(files, make, "path string, start int, end int, symbol string")


def chunk_by_structure(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Chunks whose blocks are innermost definitions and what lies between
    them; files without a definition that can be read are chunked by patterns."""
    return _chunked(files, Batch.structured, limits)


def compared(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """For each file with chunks the chunks and named chunks of both chunkers."""
    least, most = limits.least, limits.most

    def make(b: Batch, path: pa.Array) -> pa.RecordBatch:
        sums = []
        for p in (b.blocks(), b.structured()):
            g, full = b.filled(b.pieces(p, most), least)
            own = g.file[full]
            sums += [np.bincount(own, minlength=len(path)), np.bincount(own, weights=g.symbol[full] >= 0, minlength=len(path)).astype(np.int64)]
        out = pa.RecordBatch.from_arrays([path, *map(pa.array, sums)], ["path", "pattern_chunks", "pattern_named", "structure_chunks", "structure_named"])
        return out.filter(pa.array((sums[0] > 0) | (sums[2] > 0)))

    return _by_batch(files, make, "path string, pattern_chunks long, pattern_named long, structure_chunks long, structure_named long")


def chunk_string(spark, source: str, path: str, limits: Limits = Limits()) -> DataFrame:
    """The chunks of one text in memory."""
    return chunk_files(spark.createDataFrame([(path, source)], "path string, content string"), limits)
