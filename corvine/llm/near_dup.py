"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct word shingles (A-Z lower-cased; fewer
words than a shingle: the whole sequence; no word: empty, linked to nothing).

1. Every text becomes a sketch: shingle hashes are dealt to 128 buckets by
   their leading bits; a bucket keeps its smallest hash as a leading-zero count
   and 10 mantissa bits (HyperMinHash). Buckets without a shingle borrow for
   banding only.
2. Texts of equal words (128 bits of BLAKE2b) are one class. From here on a class
   is one node, so thousands of exact copies cost one row each and no pair.
3. 25 bands of 5 compressed registers propose pairs. A pair of similarity 0.85
   shares a band with probability 1 - 4e-7. Buckets of up to 24 classes give
   all pairs. Larger ones give pairs with two common members (the one that meets
   most others in its large buckets, and one by hash).
   Once components are known, what stands outside the largest component of a
   larger bucket is joined exactly with all members of such buckets: by a prefix
   filter in rarest-first order with positions and size classes. The rarest shingles
   of a near copy are its own edits. Where those fill the positions up to which a link
   is possible, members of a family share no prefix and give no pairs. Texts with fewer
   edits are linked to the text that they are copies of; if that is not there and they
   are no links of each other either, their pairs grow with the square of their number.
4. A collision-corrected Jaccard estimate from the registers drops a pair only
   when it is five standard errors below the threshold.
5. Links are confirmed on the full shingle sets (of numbered words, not of hashes),
   and components follow from repeated smallest labels with pointer jumping over
   written tables. Joins that carry texts or sketches deal the rows of hot nodes
   (a hub with many pairs) to 16 tasks.

Defined results: null or empty text: no shingle, its own component, kept. A row
without doc_id takes no part in links: component_id null, kept. Different texts
that share a doc_id are nodes of their own, each with its own component. Other
columns are not read. A text is held in one task (about ten bytes for each of its
bytes).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvine.llm import words
from corvine.llm.common import WORD, only, tune, written

BUCKETS, MANTISSA, BANDS, ROWS = 128, 10, 25, 5
SMALL_BUCKET = 24
HUBS = 1
_U = np.uint64
_REST = 64 - 7  # bits below the bucket's


def shingles(data: np.ndarray, offs: np.ndarray, width: int, digests: list[bytes] | None = None) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; ``digests`` gets 128 bits
    over the words of each."""
    w, first = words.hashed(data, offs, fold=True, digests=digests)
    h, at = words.windows(w, first, width)
    out = []
    for k in range(len(offs) - 1):
        n = first[k + 1] - first[k]
        if n >= width:
            out.append(np.unique(h[at[k] : at[k + 1]]))
        elif n:
            whole, _ = words.windows(w[first[k] : first[k + 1]], np.array([0, n]), int(n))
            out.append(words.mix(whole + _U(n)))
        else:
            out.append(np.zeros(0, _U))
    return out


def exact_shingles(data: np.ndarray, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text as numbers that are equal just
    where the words are: words are numbered exactly, and numbers joined without
    loss (renumbered where they outgrow 63 bits)."""
    starts, ends, first = words.bounds(data, offs)
    w, distinct = words.numbered(words.spelled(data, starts, ends, fold=True))
    base, top = max(1, len(distinct)), 1
    begin, at = words.window_starts(first, width)
    key = np.zeros(len(begin), np.int64)
    for k in range(width):
        if top > (1 << 62) // base:
            _, key = np.unique(key, return_inverse=True)
            top = len(key)
        key, top = key * base + w[begin + k], top * base
    short: dict[bytes, int] = {}
    out = []
    for k in range(len(offs) - 1):
        n = first[k + 1] - first[k]
        if n >= width:
            out.append(np.unique(key[at[k] : at[k + 1]]))
        else:  # all its words are one shingle, which no longer text has
            out.append(np.array([-1 - short.setdefault(w[first[k] : first[k + 1]].tobytes(), len(short))] if n else [], np.int64))
    return out


def _borrowing() -> np.ndarray:
    rng = np.random.default_rng(20240229)
    return np.stack([rng.permutation(BUCKETS) for _ in range(BUCKETS)])


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """texts x 128: 0 for an empty bucket, else leading zeros and mantissa."""
    edges = (np.arange(BUCKETS, dtype=_U) << _U(_REST)).astype(_U)
    low = np.full((len(sets), BUCKETS), -1.0)
    mask = _U((1 << _REST) - 1)
    for k, s in enumerate(sets):
        at = np.searchsorted(s, edges)
        end = np.append(at[1:], len(s))
        has = at < end
        low[k, has] = (s[at[has]] & mask).astype(np.float64)
    frac, bits = np.frexp(np.maximum(low, 0.5))
    zeros = np.clip(_REST - bits, 0, _REST - 1)
    mant = np.minimum(((frac - 0.5) * 2 * (1 << MANTISSA)).astype(np.int64), (1 << MANTISSA) - 1)
    return np.where(low < 0, 0, (zeros << MANTISSA) + mant + 1).astype(np.uint16)


def filled(regs: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Registers with empty buckets borrowing from others, each in an order of its own."""
    out = regs.copy()
    some = regs.any(axis=1)
    for step in range(BUCKETS):
        rows, cols = np.nonzero((out == 0) & some[:, None])
        if not len(rows):
            break
        out[rows, cols] = regs[rows, table[cols, step]]
    return out


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _borrowing()
        for batch in batches:
            n, digests, dense, empty = [], [], [], []
            for _, _, data, offs in words.each_part(batch.column("text")):
                sets = shingles(data, offs, width, digests)
                regs = registers(sets)
                n += [len(s) for s in sets]
                dense += [r.tobytes() for r in filled(regs, table).astype(">u2")]
                empty += [r.tobytes() for r in np.packbits(regs == 0, axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(dense, pa.binary()), pa.array(empty, pa.binary())], ["doc_id", "mark", "n", "digest", "dense", "empty"])

    return run


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates less the collisions that two disjoint sets would have,
    and the number of buckets that they rest on."""
    used = ((ra > 0) | (rb > 0)).sum(axis=1)
    same = ((ra == rb) & (ra > 0)).sum(axis=1)
    la, lb = na[:, None] / BUCKETS, nb[:, None] / BUCKETS
    level = np.arange(_REST)[None, :]
    both = la + lb
    cell = 2.0 ** (-level - 1.0 - MANTISSA)
    chance = BUCKETS * (la * lb / both * cell * (np.exp(-both * 2.0 ** (-level - 1.0)) - np.exp(-both * 2.0**-level))).sum(axis=1)
    return (same - chance) / np.maximum(used - chance, 1e-9), used


def _likely(percent: int):
    t = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def regs(col: pa.Array, empty: pa.Array) -> np.ndarray:
            r = np.frombuffer(b"".join(col.to_pylist()), ">u2").reshape(-1, BUCKETS).astype(np.uint16)
            e = np.unpackbits(np.frombuffer(b"".join(empty.to_pylist()), np.uint8).reshape(-1, BUCKETS // 8), axis=1)
            return np.where(e == 1, 0, r)

        for b in batches:
            if b.num_rows:
                j, used = estimate(regs(b.column("da"), b.column("ea")), regs(b.column("db"), b.column("eb")), b.column("na").to_numpy().astype(float), b.column("nb").to_numpy().astype(float))
                keep = j >= t - 5 * np.sqrt(t * (1 - t) / np.maximum(used, 1)) - 1e-9
                yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep))], ["a", "b"])

    return run


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for k in range(0, b.num_rows, 128):  # both texts of up to 128 pairs are numbered together
                x, y = b.column("ta").slice(k, 128), b.column("tb").slice(k, 128)
                data, offs = words.utf8(pa.concat_arrays([x, y]))
                sets = exact_shingles(data, offs, width)
                for s, t in zip(sets[: len(x)], sets[len(x) :], strict=True):
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    keep.append(common > 0 and 100 * common >= percent * (len(s) + len(t) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    return run


SLOTS = 1 << 20
CLASS = 0.1  # width of a size class, in logarithms


def _frequencies(width: int):
    """(slot, n): how often a task's texts have shingles in each of 2**20 slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            for _, _, data, offs in words.each_part(b.column("text")):
                for s in shingles(data, offs, width):
                    total[(s & _U(SLOTS - 1)).astype(np.int64)] += 1
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(total[slot])], ["slot", "n"])

    return run


def _prefixes(shared, width: int, percent: int):
    """(token, n, i, cid, comp, minor): the shingles of a text, rarest first, up
    to the last position that a link of any size could have first in common,
    without those that no other text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(zlib.decompress(shared.value), np.int64)
        for b in batches:
            sets = [s for _, _, data, offs in words.each_part(b.column("text")) for s in shingles(data, offs, width)]
            out, places = [], []
            for s in sets:
                count = often[(s & _U(SLOTS - 1)).astype(np.int64)]
                order = np.lexsort((s, count))[: len(s) - -(-percent * len(s) // 100) + 1]
                met = np.flatnonzero(count[order] > 1)
                out.append(s[order[met]])
                places.append(met)
            rows = np.repeat(np.arange(len(out)), [len(x) for x in out])
            at = np.concatenate(places) if out else np.zeros(0, int)
            token = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
            n = np.array([len(s) for s in sets], np.int64)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n[rows] if len(rows) else [], pa.int64()), pa.array(at, pa.int64()), *[b.column(c).take(take) for c in ("cid", "comp", "minor")]], ["token", "n", "i", "cid", "comp", "minor"])

    return run


def prefix_pairs(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) that hold every link between a minor text and a text of
    another component. ``texts``: cid, comp, minor, text.

    A pair's first common shingle at positions i and j leaves at most
    min(na - i, nb - j) in common, and a link needs t / (1 + t) * (na + nb). For a
    minor text's position this bounds the partner's size, and the join is on
    shingle and size class."""
    spark = texts.sparkSession
    found = texts.mapInArrow(_frequencies(width), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # 2**20 rows at most
    total = np.zeros(SLOTS, np.int64)
    total[found["slot"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(zlib.compress(total.tobytes(), 1))
    posts = written(texts.mapInArrow(_prefixes(shared, width, percent), "token long, n long, i long, cid long, comp long, minor boolean"), "prefixes")
    t = percent / 100
    need = t / (1 + t)
    size_class = lambda c: F.floor(F.log(c) / CLASS)
    x = posts.where("minor").select("token", F.col("n").alias("nx"), F.col("i").alias("ix"), F.col("cid").alias("x"), F.col("comp").alias("cx"))
    x = x.withColumn("least", F.col("nx") * t - 1e-6).withColumn("most", F.least(F.col("nx") / t, (F.col("nx") - F.col("ix")) / need - F.col("nx")) + 1e-6)
    x = x.where("most >= least and most >= 1").withColumn("class", F.explode(F.sequence(size_class(F.greatest("least", F.lit(1.0))), size_class("most"))))
    y = posts.select("token", size_class("n").alias("class"), F.col("n").alias("ny"), F.col("i").alias("iy"), F.col("cid").alias("y"), F.col("comp").alias("cy"))
    fits = F.col("ny").between(F.col("least"), F.col("most")) & (F.col("ny") - F.col("iy") >= need * (F.col("nx") + F.col("ny")) - 1e-6)
    met = x.join(y, ["token", "class"]).where((F.col("cx") != F.col("cy")) & fits)
    return _ordered(met, F.col("x"), F.col("y")).distinct()


def _ordered(df: DataFrame, x: Column, y: Column) -> DataFrame:
    return df.where(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def _near_in_size(percent: int) -> Column:
    return F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")


FILTER_BITS = 1 << 24
HOT = 16


def having(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, text) of the nodes in ``wanted`` (cid, doc_id, mark), each once.

    A bitmap of 2**24 hash slots (2 MB however many ids there are, so it can be
    broadcast) drops most other rows before texts are shuffled; the join after
    it is exact. It is no semi join, as that would be moved below the bitmap's.
    Rows that repeat an id and text are reduced to one before the shuffle."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bits = wanted.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bits"))
    near = docs.withColumn("_slot", slot).withColumn("_bucket", F.bitmap_bucket_number("_slot")).join(F.broadcast(bits), "_bucket")
    at = F.bitmap_bit_position("_slot")
    octet = F.conv(F.hex(F.expr("substring(_bits, cast(bitmap_bit_position(_slot) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    near = near.where(F.call_function("getbit", octet, (at % 8).cast("int")) == 1)
    near = near.groupBy("doc_id", "mark").agg(F.first("text").alias("text"))
    return near.join(wanted, ["doc_id", "mark"]).select("cid", "text")


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, comp): the smallest node that each node of an edge reaches.

    Each round takes the smallest label of the neighbours and then the label of
    that label, so that chains halve; every round is a written table.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "to").distinct(), label)
    labels = written(both.groupBy("node").agg(F.min("to").alias("m")).select("node", F.least("node", "m").alias("comp")), label)
    while True:
        near = both.join(labels.toDF("to", "c"), "to").groupBy("node").agg(F.min("c").alias("c"))
        step = labels.join(near, "node").select("node", "comp", F.least("comp", "c").alias("next"))
        step = written(step, label)
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("jumped"))
        moved = written(step.join(jump, "next", "left").select("node", "comp", F.least("next", F.coalesce("jumped", "next")).alias("next")), label)
        labels = moved.select("node", F.col("next").alias("comp"))
        if not moved.where("comp <> next").limit(1).count():
            return labels


def _hot(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The keys that hold more than one part in ``most`` of ``rows``: at most
    ``most`` of them, so they may be broadcast."""
    n = rows.count()
    return written(rows.groupBy(key).agg(F.count("*").alias("_k")).where(F.col("_k") * most > n).select(key), "hot")


def dealt(big: DataFrame, small: DataFrame, key: str, most: int = 200, hot: DataFrame | None = None) -> DataFrame:
    """``big`` joined with ``small`` (a row for each ``key``): rows of hot keys are
    dealt to 16 tasks, to which the 200 hot rows at most of ``small`` are copied.
    ``hot``: the hot keys, if they are known (else ``big`` is computed to count them)."""
    hot = F.broadcast((_hot(big, key, most) if hot is None else hot).withColumn("_hot", F.lit(HOT)))
    salt = F.pmod(F.hash(*[c for c in big.columns if c != key]), F.coalesce("_hot", F.lit(1)))
    x = big.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    y = small.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_hot", F.lit(1)) - 1))).drop("_hot")
    return x.join(y, [key, "_salt"]).drop("_salt")


def _classified(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``docs`` (doc_id, mark, text): the sketches of all rows, the classes of
    rows with equal words, and the component of every class that has links."""
    sig = written(docs.mapInArrow(_sketch(width), "doc_id long, mark long, n long, digest binary, dense binary, empty binary"), "sketch")
    sets = sig.where("n > 0 and doc_id is not null")
    rep = F.min(F.struct("doc_id", "mark"))
    nodes = sets.groupBy("digest").agg(rep.alias("rep"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("dense").alias("dense"), F.first("empty").alias("empty"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("cid"), "digest", "rep.doc_id", "rep.mark", "rows", "n", "dense", "empty"), "classes")

    step = 2 * ROWS
    keys = [F.xxhash64(F.substring("dense", 1 + step * k, step), F.lit(k)) for k in range(BANDS)]
    members = nodes.select("cid", "n", F.explode(F.array(*keys)).alias("key"))
    found = members.groupBy("key").agg(F.count("*").alias("k"), F.min("cid").alias("x"), F.max("cid").alias("y")).where("k > 1")
    found = written(found, "buckets")
    pairs = _ordered(found.where("k = 2"), F.col("x"), F.col("y"))
    crowded = written(members.join(found.where("k > 2").select("key", "k"), "key"), "crowded")
    lists = crowded.where(f"k <= {SMALL_BUCKET}").groupBy("key").agg(F.sort_array(F.collect_list("cid")).alias("all"))
    lists = lists.select("all", F.posexplode("all").alias("i", "x")).select("x", F.explode(F.slice("all", F.col("i") + 2, SMALL_BUCKET)).alias("y"))
    pairs = pairs.union(_ordered(lists, F.col("x"), F.col("y")))
    large = crowded.where(f"k > {SMALL_BUCKET}")
    # the member that meets the most others over all its bands is the one that they are copies of, as far as there is one
    large = written(large.join(large.groupBy("cid").agg(F.sum("k").alias("met")), "cid"), "large")
    central = F.max(F.struct("met", F.xxhash64("cid"), "cid"))["cid"]
    others = [F.min(F.struct(F.xxhash64("cid", F.lit(k)), "cid"))["cid"] for k in range(HUBS)]
    hubs = large.groupBy("key").agg(F.array(central, *others).alias("hubs"))
    star = large.join(hubs, "key").select("cid", F.explode("hubs").alias("y"))
    pairs = pairs.union(_ordered(star, F.col("cid"), F.col("y")))

    def sided(pairs: DataFrame, table, most: int = 200) -> DataFrame:
        """Pairs (a written table) with what ``table(side)`` has of both their nodes.
        The first join keeps each pair once, so the hot keys of both are those of ``pairs``."""
        a, b = (_hot(pairs, s, most) for s in "ab")
        return dealt(dealt(pairs, table("a"), "a", most, a), table("b"), "b", most, b)

    def confirmed(likely: DataFrame) -> DataFrame:
        """The links among distinct pairs."""
        ends = likely.select(F.col("a").alias("cid")).union(likely.select("b")).distinct()
        texts = written(having(docs, nodes.select("cid", "doc_id", "mark").join(ends, "cid")), "texts")
        both = sided(likely, lambda s: texts.toDF(s, f"t{s}"))
        return written(both.mapInArrow(_confirm(width, percent), "a long, b long"), "links")

    def estimated(pairs: DataFrame) -> DataFrame:
        """The pairs that may be links, by size and registers."""
        side = lambda s: nodes.select(F.col("cid").alias(s), F.col("n").alias(f"n{s}"), F.col("dense").alias(f"d{s}"), F.col("empty").alias(f"e{s}"))
        wide = sided(pairs, side).where(_near_in_size(percent))
        return written(wide.mapInArrow(_likely(percent), "a long, b long"), "likely")

    tested = written(pairs.distinct(), "pairs")
    links = confirmed(estimated(tested))
    comps = components(links)

    # buckets with several components left: what stands outside the largest is compared with the rest
    tagged = large.select("key", "cid", "n").join(comps.toDF("cid", "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    by_comp = written(tagged.groupBy("key", "comp").agg(F.count("*").alias("k")), "bycomp")
    main = by_comp.groupBy("key").agg(F.max_by("comp", "k").alias("main"), F.count("*").alias("comps")).where("comps > 1")
    if main.limit(1).count():
        outside = tagged.join(main.select("key", "main"), "key").groupBy("cid").agg(F.first("comp").alias("comp"), F.max(F.col("comp") != F.col("main")).alias("minor"))
        outside = written(outside, "outside")
        texts = having(docs, nodes.select("cid", "doc_id", "mark").join(outside.select("cid"), "cid"))
        crossing = prefix_pairs(written(texts.join(outside, "cid"), "open"), width, percent).join(tested, ["a", "b"], "left_anti")
        more = confirmed(written(crossing, "crossing"))
        if more.limit(1).count():
            comps = components(links.union(more))
    return sig, nodes, comps


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a mark that tells texts of one doc_id apart."""
    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``
    (doc_id, text): see the module. Links have 100 * |A and B| >= percent * |A or B|.
    """
    tune(docs.sparkSession)
    sig, nodes, comps = _classified(_marked(docs), width, percent)
    at = written(comps.toDF("cid", "comp").join(nodes.select("cid", "digest", "doc_id"), "cid"), "linked")
    first = at.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    linked = dealt(at.select("comp", "digest"), first, "comp")
    alone = nodes.select("cid", "digest", "doc_id").join(comps.select(F.col("node").alias("cid")), "cid", "left_anti")
    ids = written(linked.select("digest", "component_id").union(alone.select("digest", F.col("doc_id").alias("component_id"))), "ids")
    some = F.col("n").cast("boolean") & F.col("doc_id").isNotNull()
    rows = sig.select("doc_id", "n", "digest")
    known = dealt(rows.where(some), ids, "digest", 10_000).unionByName(rows.where(~some).withColumn("component_id", F.col("doc_id")))
    return known.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (all columns) without near copies: of each component
    one row stays, that of the smallest doc_id (then of the smallest hash of its
    text and of its other columns). Different texts that share a doc_id are
    documents of their own; rows without doc_id or words all stay, repeated
    rows of such included."""
    tune(docs.sparkSession)
    _, nodes, comps = _classified(_marked(docs), width, percent)
    rep = nodes.select("cid", "doc_id", "mark").join(comps.toDF("cid", "comp"), "cid", "left")
    best = rep.groupBy(F.coalesce("comp", "cid").alias("comp")).agg(F.min(F.struct("doc_id", "mark")).alias("rep"))
    best = written(best.select(F.col("rep.doc_id").alias("_corvine_id"), F.col("rep.mark").alias("_corvine_mark")), "kept")
    marked = docs.withColumns({"_corvine_id": F.col("doc_id").cast("long"), "_corvine_mark": F.xxhash64("text")})
    wordless = F.col("_corvine_id").isNull() | ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    stay = marked.where(~wordless).join(best, ["_corvine_id", "_corvine_mark"])
    rest = [F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])]
    turn = Window.partitionBy("_corvine_id", "_corvine_mark").orderBy(*rest)
    stay = stay.withColumn("_corvine_turn", F.row_number().over(turn)).where("_corvine_turn = 1")
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(marked.where(wordless).select(*[F.col(f"`{c}`") for c in docs.columns]))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85)
