"""Approximate nearest neighbours by robust-pruned directed graphs.

Vectors that take part (of the table's most frequent length, finite, not zero)
are reduced to distinct ones, each with its smallest ids, so that thousands of
equal vectors are one node and ties come out exactly. Nodes are dealt by hash to
up to 8 shards, and to more when shards would hold over ``shard_values`` numbers
(131,072 vectors of 64): a query is searched in every shard, so shards are as
large as a task's memory lets them. A shard is indexed in one task: an extra
coordinate gives all its vectors one length, so that the largest inner product
is the least distance; starting from random edges, batches of nodes look for
their neighbours by greedy search, relaxed distance pruning keeps diverse edges
(a candidate goes when a kept one is ``alpha`` times nearer to it than the node),
and reverse edges are added and pruned alike.

Queries go through every shard in blocks, by beam search in single precision;
the beam's nodes are scored again in double precision on the original vectors.
Each query's best of all shards are ranked, ties to the smaller id.

A shard's index is one row of a written table; a search task decodes one index
for a group of about 65,536 queries. Nothing but counts goes to the driver.

Defined results: vectors that are null, zero, of another length, or hold null or
non-finite components are neither queries nor candidates; rows with a null
vec_id neither; rows that repeat a vec_id with one vector are one candidate and one
query; rows that repeat a vec_id with other vectors are candidates and queries of
their own (two lists under one query_id), but not each other's neighbours; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvine.llm.common import arrow_batches, only, ship, written

DEGREE, SLACK, BEAM, ALPHA = 32, 64, 48, 1.2
SHARD_VALUES = 1 << 23
SMALL_SHARD = 8192
QUERY_GROUP = 1 << 16


def _block(n: int) -> int:
    """Queries that are searched at once: their marks of ``n`` nodes stay within
    32 MB."""
    return max(32, min(512, (1 << 25) // max(1, n)))


def _valid(width: int):
    """(vec_id, vec): vectors that take part, as bytes of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fits = pc.fill_null(pc.equal(pc.list_value_length(b.column("embedding")), width), False)
            b = b.filter(pc.and_(fits, pc.is_valid(b.column("vec_id"))))
            x = pc.fill_null(b.column("embedding").flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(-1, width) + 0.0  # -0.0 becomes 0.0
            good = np.isfinite(x).all(axis=1) & x.any(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").filter(pa.array(good)), pa.array([v.tobytes() for v in x[good]], pa.binary())], ["vec_id", "vec"])

    return run


def _smallest(keep: int):
    """Partial sums: each distinct vector of a batch with its smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[bytes, set[int]] = {}
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("vec").to_pylist(), strict=True):
                held.setdefault(v, set()).add(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([sorted(x)[:keep] for x in held.values()], pa.list_(pa.int64()))], ["vec", "ids"])

    return run


def greedy(x: np.ndarray, graph: np.ndarray, start: np.ndarray, queries: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """For every query the ``beam`` nodes of largest inner product that a search
    along the graph meets, best first, and the products (-1 and -inf: none)."""
    n, m = len(x), len(queries)
    seen = np.zeros((m, n), bool)
    seen[:, start] = True
    ids = np.full((m, beam), -1, np.int64)
    sims = np.full((m, beam), -np.inf, np.float32)
    first = queries @ x[start].T
    order = np.argsort(-first, axis=1)[:, :beam]
    ids[:, : order.shape[1]] = start[order]
    sims[:, : order.shape[1]] = np.take_along_axis(first, order, 1)
    open_ = ids >= 0
    rows = np.arange(m)
    while len(rows):
        rank = np.cumsum(open_[rows], axis=1)
        pick = open_[rows] & (rank <= wide)
        rows = rows[pick.any(axis=1)]
        if not len(rows):
            break
        pick = pick[pick.any(axis=1)]
        r, c = np.nonzero(pick)
        open_[rows[r], c] = False
        near = graph[ids[rows[r], c]].astype(np.int64)
        q = np.repeat(rows[r], near.shape[1])
        near = near.ravel()
        ok = near >= 0
        key = np.unique(q[ok] * n + near[ok])
        key = key[~seen.ravel()[key]]
        seen.ravel()[key] = True
        q, near = key // n, key % n
        s = np.einsum("ij,ij->i", x[near], queries[q])
        better = s > sims[q, -1]
        q, near, s = q[better], near[better], s[better]
        if not len(q):
            continue
        touched, at, count = np.unique(q, return_index=True, return_counts=True)
        width = count.max()
        slot = np.arange(len(q)) - np.repeat(at, count)
        line = np.repeat(np.arange(len(touched)), count)
        new_ids = np.full((len(touched), width), -1, np.int64)
        new_sims = np.full((len(touched), width), -np.inf, np.float32)
        new_ids[line, slot], new_sims[line, slot] = near, s
        all_ids = np.concatenate((ids[touched], new_ids), axis=1)
        all_sims = np.concatenate((sims[touched], new_sims), axis=1)
        all_open = np.concatenate((open_[touched], new_ids >= 0), axis=1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[touched] = np.take_along_axis(all_ids, order, 1)
        sims[touched] = np.take_along_axis(all_sims, order, 1)
        open_[touched] = np.take_along_axis(all_open, order, 1)
    return ids, sims


def pruned(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours of each node among its candidates
    (-1: none; a node itself or a repeated candidate is passed over)."""
    candidates = np.sort(candidates, axis=1)
    again = np.zeros(candidates.shape, bool)
    again[:, 1:] = candidates[:, 1:] == candidates[:, :-1]
    bad = again | (candidates < 0) | (candidates == nodes[:, None])
    at = x[np.maximum(candidates, 0)]
    square = float(x[0] @ x[0])
    far = np.maximum(square - np.einsum("bkd,bd->bk", at, x[nodes]), 0)
    far[bad] = np.inf
    order = np.argsort(far, axis=1)
    candidates, far = np.take_along_axis(candidates, order, 1), np.take_along_axis(far, order, 1)
    at = np.take_along_axis(at, order[:, :, None], 1)
    between = np.maximum(square - at @ at.transpose(0, 2, 1), 0) * np.float32(alpha * alpha)
    alive = np.isfinite(far)
    out = np.full((len(nodes), degree), -1, np.int64)
    line = np.arange(len(nodes))
    for k in range(degree):
        best = np.argmax(alive, axis=1)
        some = alive[line, best]
        if not some.any():
            break
        out[some, k] = candidates[line[some], best[some]]
        alive &= between[line, best] > far
        alive[line, best] = False
    return out


def build(vectors: np.ndarray, seed: int = 7, passes: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengthened vectors, graph, start nodes) of one shard."""
    n, batch = len(vectors), _block(len(vectors))
    norms = (vectors.astype(np.float64) ** 2).sum(axis=1)
    scale = np.sqrt(norms.max()) or 1.0
    unit = vectors / scale
    x = np.concatenate((unit, np.sqrt(np.maximum(1 - norms / scale**2, 0))[:, None]), axis=1).astype(np.float32)
    rng = np.random.default_rng(seed)
    graph = np.full((n, SLACK), -1, np.int32)
    if n > 1:
        some = min(DEGREE // 2, n - 1)
        graph[:, :some] = (np.arange(n)[:, None] + rng.integers(1, n, (n, some))) % n
    middle = np.argmax(x @ x.mean(axis=0))
    start = np.unique(np.concatenate(([middle], rng.integers(0, n, 8))))
    for _ in range(passes):
        order = rng.permutation(n)
        for k in range(0, n, batch):
            nodes = order[k : k + batch]
            found, _ = greedy(x, graph, start, x[nodes], BEAM)
            kept = pruned(x, nodes, np.concatenate((found, graph[nodes]), axis=1), DEGREE, ALPHA)
            graph[nodes] = -1
            graph[nodes, :DEGREE] = kept
            to, of = graph[nodes, :DEGREE], np.repeat(nodes, DEGREE).reshape(-1, DEGREE)
            to, of = to[to >= 0], of[to >= 0]
            missing = ~(graph[to] == of[:, None]).any(axis=1)
            to, of = to[missing], of[missing]
            by = np.argsort(to, kind="stable")
            to, of = to[by], of[by]
            targets, at, count = np.unique(to, return_index=True, return_counts=True)
            held = (graph[targets] >= 0).sum(axis=1)
            fits = np.repeat(held + count <= SLACK, count)
            slot = np.repeat(held, count) + np.arange(len(to)) - np.repeat(at, count)
            graph[to[fits], slot[fits]] = of[fits]
            full = np.flatnonzero(held + count > SLACK)
            for j in range(0, len(full), batch):
                own = full[j : j + batch]
                width = count[own].max()
                extra = np.full((len(own), width), -1, np.int64)
                for line, f in enumerate(own):
                    extra[line, : count[f]] = of[at[f] : at[f] + count[f]]
                node = targets[own]
                kept = pruned(x, node, np.concatenate((graph[node], extra), axis=1), DEGREE, ALPHA)
                graph[node] = -1
                graph[node, :DEGREE] = kept
    return x, graph, start


def _index(width: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec", kind="stable")
        vectors = np.frombuffer(b"".join(pdf["vec"]), np.float64).reshape(-1, width)
        _, graph, start = build(vectors)
        ids = [np.asarray(i, np.int64) for i in pdf["ids"]]
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "vectors": [vectors.tobytes()], "graph": [graph.astype(np.int32).tobytes()], "start": [start.astype(np.int64).tobytes()], "ids": [np.concatenate(ids).tobytes()], "counts": [np.array([len(i) for i in ids], np.int64).tobytes()]})

    return run


def _search(width: int, k: int, beam: int):
    def run(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "query_key": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(index) or not len(asked):
            return empty
        row = index.iloc[0]
        vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, width)
        graph, start = np.frombuffer(row["graph"], np.int32).reshape(-1, SLACK), np.frombuffer(row["start"], np.int64)
        counts = np.frombuffer(row["counts"], np.int64)
        ids, at = np.frombuffer(row["ids"], np.int64), np.concatenate(([0], np.cumsum(counts)))
        short, out = vectors.astype(np.float32), []
        for b in range(0, len(asked), _block(len(vectors))):
            part = asked.iloc[b : b + _block(len(vectors))]
            queries = np.frombuffer(b"".join(part["vec"]), np.float64).reshape(-1, width)
            found, _ = greedy(short, graph, start, queries.astype(np.float32), beam)
            for q, key, own, nodes in zip(part["vec_id"].tolist(), part["query_key"].tolist(), queries, found, strict=True):
                nodes = nodes[nodes >= 0]
                score = np.repeat((vectors[nodes] * own).sum(axis=1), counts[nodes])
                near = np.concatenate([ids[at[j] : at[j + 1]] for j in nodes])
                score, near = score[near != q], near[near != q]
                best = np.lexsort((near, -score))[:k]
                out.append((np.full(len(best), q), np.full(len(best), key), near[best], score[best]))
        return pd.DataFrame(dict(zip(empty.columns, (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    return run


def nearest(table: DataFrame, is_query, k: int = 20, shard_values: int = SHARD_VALUES, beam: int = 100) -> DataFrame:
    """The ``k`` nearest of all rows of ``table`` (vec_id, embedding) for every
    row where ``is_query`` holds: query_id, rank, vec_id, score."""
    spark = table.sparkSession
    ship(spark)
    table = only(table, "vec_id", "embedding").withColumn("vec_id", F.col("vec_id").cast("long"))
    width = table.where("embedding is not null and size(embedding) > 0").groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = width["w"]
    with arrow_batches(spark, 4096):
        valid = written(table.mapInArrow(_valid(width), "vec_id long, vec binary"), "vectors")
        merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")
        part = valid.mapInArrow(_smallest(k + 1), "vec binary, ids array<long>").withColumn("salt", F.spark_partition_id() % 64)
        nodes = written(part.groupBy("vec", "salt").agg(merged).groupBy("vec").agg(merged), "nodes")
        n = nodes.count()
        shards = max(1, -(-n * width // shard_values), min(8, -(-n // SMALL_SHARD)))
        dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int"))
        index = dealt.groupBy("shard").applyInPandas(_index(width), "shard int, vectors binary, graph binary, start binary, ids binary, counts binary")
        index = written(index, "index")
        asked = written(valid.where(is_query).select("vec_id", "vec").distinct().withColumn("query_key", F.xxhash64("vec")), "queries")
        groups = max(1, -(-asked.count() // QUERY_GROUP))
        by_group = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        by_shard = asked.withColumn("group", F.pmod(F.xxhash64("vec_id", "query_key"), F.lit(groups)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        both = by_group.groupBy("shard", "group").cogroup(by_shard.groupBy("shard", "group"))
        found = written(both.applyInPandas(_search(width, k, beam), "query_id long, query_key long, vec_id long, score double"), "found")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
