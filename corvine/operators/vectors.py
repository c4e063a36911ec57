"""Vector search over (id, embedding) tables.

A search takes a set of queries in blocks against all vectors: scores come from
one matrix product per slice of an Arrow batch, each task keeps its best k of
every query, and a ranked window merges them, so no pair table is made. Clustered
and hashed search keep only pairs that share a cell or a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.functions.arrow import matrix, spread
from corvine.functions.text import dot, l2_normalize
from corvine.session import ship

QUERY_BLOCK = 4096
#: Scores made at a time, 8 MB, whatever the number of queries in a block.
SCORES = 1 << 20


def normalized(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """F4 over a table; vectors without length are dropped as an index rejects them."""
    return vectors.withColumn(column, l2_normalize(F.col(column))).where(F.col(column).isNotNull())


def ranked(scored: DataFrame, k: int, by: list[str], ties: list[str], rank: str = "rank") -> DataFrame:
    """L1, L2: the ``k`` rows of largest score for each ``by``."""
    window = Window.partitionBy(*by).orderBy(F.desc("score"), *ties)
    return scored.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def _first(q: np.ndarray, g: np.ndarray, own: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of hits, the best ``k`` of each query and group, ties to the smaller id."""
    order = np.lexsort((own, -s, g, q))
    q, g, own, s = q[order], g[order], own[order], s[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (g[1:] != g[:-1])
    at = np.arange(len(q))
    keep = at - np.maximum.accumulate(np.where(new, at, 0)) < k
    return q[keep], g[keep], own[keep], s[keep]


def _slices(b: pa.RecordBatch, queries: np.ndarray) -> Iterator[pa.RecordBatch]:
    step = max(1, SCORES // max(1, len(queries)))
    for start in range(0, b.num_rows, step):
        yield b.slice(start, step)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _matrix(ids: np.ndarray, queries: np.ndarray, k: int, candidates: Callable[[np.ndarray], np.ndarray] | None = None):
    """Best ``k`` of each query and group in a task; ``candidates`` gives for
    unit vectors which query (line) looks at which of them (column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for b in batches:
            for part in _slices(b, queries):
                own, group = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "group"))
                x = _unit(matrix(part.column("v")).astype(np.float64))
                s = np.round(queries @ x.T, 6) + 0.0
                if candidates is not None:
                    s[~candidates(x)] = -np.inf
                for g in np.unique(group):
                    mine = np.flatnonzero(group == g)
                    t = s[:, mine]
                    least = np.partition(t, len(mine) - k, axis=1)[:, [len(mine) - k]] if len(mine) > k else -np.inf
                    q, at = np.nonzero((t >= least) & (t > -np.inf))
                    new = (q, np.full(len(q), g), own[mine[at]], t[q, at])
                    best = _first(*(np.concatenate(both) for both in zip(best, new, strict=True)), k)
        if len(best[0]):
            q, g, own, s = best
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(g), pa.array(own), pa.array(s)], ["query_id", "group", "id", "score"])

    return run


def blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of (query_id, v), QUERY_BLOCK rows at a time."""
    count = queries.count()
    cut = queries.withColumn("_block", F.floor((F.row_number().over(Window.orderBy("query_id")) - 1) / QUERY_BLOCK)) if count > QUERY_BLOCK else queries.withColumn("_block", F.lit(0))
    for block in range(-(-count // QUERY_BLOCK)):
        rows = cut.where(F.col("_block") == block).select("query_id", "v").collect()  # QUERY_BLOCK rows at most
        yield np.array([r[0] for r in rows], np.int64), _unit(np.array([r[1] for r in rows], np.float64))


def _usable(vectors: DataFrame) -> DataFrame:
    return vectors.where(dot(F.col("v"), F.col("v")) >= 1e-12)


def _found(vectors: DataFrame, queries: DataFrame, k: int, candidates=None, group: Column | None = None) -> DataFrame:
    """(query_id, group, id, score): the best ``k`` of each task."""
    spark = vectors.sparkSession
    ship(spark)
    rows = _usable(vectors).select("id", "v", (F.lit(0) if group is None else group).cast("long").alias("group"))
    kind, found = "query_id long, group long, id long, score double", None
    for ids, v in blocks(queries):
        part = rows.mapInArrow(_matrix(ids, v, k, candidates and candidates(v)), kind)
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], kind) if found is None else found


def exact(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score) for ``vectors`` (id, v) and ``queries``
    (query_id, v), cosine scores rounded to 6 places, ties to the smaller id.
    Queries go to the driver a block at a time and from there to all tasks."""
    return ranked(_found(vectors, queries, k), k, ["query_id"], ["id"]).select("query_id", "rank", "id", "score")


def exact_by_group(vectors: DataFrame, queries: DataFrame, k: int, group: str) -> DataFrame:
    """L2: the best ``k`` within each ``group`` (an integer column), then of all."""
    own = ranked(_found(vectors, queries, k, group=F.col(group)), k, ["query_id", "group"], ["id"], "r")
    return ranked(own, k, ["query_id"], ["id"]).select("query_id", "rank", F.col("group").alias(group), "id", "score")


def extremes(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """One row of the least score of pairs of one label and the largest of
    two labels, each query (query_id, v, label) with all other rows (id, v, label).
    A task makes one row for each block of queries."""
    ship(vectors.sparkSession)
    rows, found = _usable(vectors).select("id", "v", F.col("label").cast("long").alias("label")), None
    for ids, v in blocks(queries):
        labels = dict(queries.where(F.col("query_id").between(int(ids.min()), int(ids.max()))).select("query_id", "label").collect())
        part = rows.mapInArrow(_extremes(ids, v, np.array([labels[i] for i in ids.tolist()])), "least double, most double")
        found = part if found is None else found.union(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "least double, most double")
    least, most = F.min("least"), F.max("most")
    return found.agg(least.alias("least_similar"), most.alias("most_dissimilar"), (least > most).alias("apart"))


def _extremes(ids: np.ndarray, queries: np.ndarray, labels: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, most = np.inf, -np.inf
        for b in batches:
            for part in _slices(b, queries):
                own, label = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
                s = np.round(queries @ _unit(matrix(part.column("v")).astype(np.float64)).T, 6) + 0.0
                other, same = ids[:, None] != own, labels[:, None] == label
                least = min(least, s[other & same].min(initial=np.inf))
                most = max(most, s[other & ~same].max(initial=-np.inf))
        yield pa.RecordBatch.from_arrays([pa.array([least if least < np.inf else None], pa.float64()), pa.array([most if most > -np.inf else None], pa.float64())], ["least", "most"])

    return run


def inner(v: Column, q: Column) -> Column:
    """A6 by Arrow batches; null where a vector is."""

    @F.arrow_udf("double")
    def product(v: pa.Array, q: pa.Array) -> pa.Array:
        full = pc.and_(v.is_valid(), q.is_valid())
        x, y = matrix(v.filter(full)), matrix(q.filter(full))
        return spread((x * y).sum(axis=1), full)

    return product.asNondeterministic()(v, q)


def cosines(v: Column, query: list[float]) -> Column:
    """Inner products of one vector with vectors brought to length one, by Arrow
    batches; null where a vector is null or has no length."""
    q = np.array(query, np.float64)

    @F.arrow_udf("double")
    def product(v: pa.Array) -> pa.Array:
        full = v.is_valid()
        x = matrix(v.filter(full)).astype(np.float64)
        s = (x * x).sum(axis=1)
        score = pa.array((x / np.sqrt(np.where(s >= 1e-12, s, 1.0))[:, None]) @ q, mask=s < 1e-12)
        return spread(score, full)

    return product.asNondeterministic()(v)


def searched(vectors: DataFrame, query: Column | list[float], k: int, ties: list[str]) -> DataFrame:
    """One query, an expression or a vector: its ``k`` best rows by partial top-k."""
    score = cosines(F.col("v"), query) if isinstance(query, list) else dot(l2_normalize(F.col("v")), query)
    return best(vectors.withColumn("score", F.round(score, 6) + 0.0), k, ties)


def best(scored: DataFrame, k: int, ties: list[str]) -> DataFrame:
    """L1: the ``k`` rows of largest score."""
    return scored.where("score is not null").orderBy(F.desc("score"), *ties).limit(k)


def add(index: DataFrame, new: DataFrame) -> DataFrame:
    """Insert only; ids that are in the index already keep their vectors."""
    return index.unionByName(new.join(index.select("id"), "id", "left_anti"))


def upsert(table: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The last write of a key wins."""
    return table.join(new.select(key), key, "left_anti").unionByName(new)


def remove(index: DataFrame, ids: DataFrame) -> DataFrame:
    """V6: without the given ids; nothing stays behind as a tombstone."""
    return index.join(ids.select("id"), "id", "left_anti")


def clusters(vectors: DataFrame, cells: int, rounds: int = 8, sample: int = 20_000) -> np.ndarray:
    """Centres of spherical k-means over up to ``sample`` vectors of smallest id hash."""
    rows = vectors.select("v").orderBy(F.xxhash64("id")).limit(sample).collect()
    x = np.array([r[0] for r in rows], np.float64)
    x /= np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-12)[:, None]
    centre = x[:: max(1, len(x) // cells)][:cells].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centre.T, axis=1)
        for c in range(len(centre)):
            if (own == c).any():
                centre[c] = x[own == c].sum(axis=0)
        centre /= np.maximum(np.sqrt((centre * centre).sum(axis=1)), 1e-12)[:, None]
    return centre


def ivf(vectors: DataFrame, queries: DataFrame, k: int, cells: int = 16, probes: int = 6, spread: int = 3) -> DataFrame:
    """V6: vectors in the cells of their ``spread`` nearest centres, queries in the
    nearest ``probes`` cells; exact scores of pairs that share a cell."""
    centre = clusters(vectors, cells)

    def near(x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-(x @ centre.T), axis=1, kind="stable")[:, :n]

    def candidates(q: np.ndarray):
        looks = np.zeros((len(q), len(centre)), bool)
        np.put_along_axis(looks, near(q, probes), True, axis=1)

        def shared(x: np.ndarray) -> np.ndarray:
            at = near(x, spread)
            out = np.zeros((len(q), len(x)), bool)
            for r in range(at.shape[1]):
                out |= looks[:, at[:, r]]
            return out

        return shared

    return ranked(_found(vectors, queries, k, candidates), k, ["query_id"], ["id"]).select("query_id", "rank", "id", "score")


def lsh(vectors: DataFrame, queries: DataFrame, k: int, width: int, tables: int = 24, bits: int = 5, seed: int = 11, flips: int = 1) -> DataFrame:
    """V6: random hyperplanes; candidates share a signature of ``bits`` signs in
    any of ``tables`` tables, where a query also looks at the ``flips`` signatures
    that differ in one of its least certain signs; then exact scores."""
    planes = np.random.default_rng(seed).normal(size=(tables, bits, width))
    worth = 1 << np.arange(bits)

    def candidates(q: np.ndarray):
        lines = np.arange(len(q))
        looks = np.zeros((tables, len(q), 1 << bits), bool)
        for t in range(tables):
            side = q @ planes[t].T
            key, unsure = (side >= 0) @ worth, np.argsort(np.abs(side), axis=1, kind="stable")
            looks[t, lines, key] = True
            for f in range(min(flips, bits)):
                looks[t, lines, key ^ worth[unsure[:, f]]] = True

        def shared(x: np.ndarray) -> np.ndarray:
            out = np.zeros((len(q), len(x)), bool)
            for t in range(tables):
                out |= looks[t][:, (x @ planes[t].T >= 0) @ worth]
            return out

        return shared

    return ranked(_found(vectors, queries, k, candidates), k, ["query_id"], ["id"]).select("query_id", "rank", "id", "score")
