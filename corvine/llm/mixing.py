"""Mixing sources to target weights by a low-discrepancy schedule.

Only DataFrame functions are used. Every source is a stream of its documents'
words, shuffled anew for each repetition, and cut into blocks of equally many
words. The schedule has as many slots as the targets have blocks. Slot j has the
golden-ratio point frac(j * phi), kept in 62 bits; the point falls into a source
through the cumulative weights (the targets, in blocks), and the r-th slot of a
source plays its r-th block. What a source takes is what its slots play: a
low-discrepancy sequence gives it its share of any run of slots to within a few
blocks, so the mix is near the targets all along and at its end. A slot past the
end of a source's stream plays nothing.

Sources may be of any size: streams are positioned by buckets, slots are ranked
by chunks, and joins are on blocks. Blocks have 8 to 4096 words: about a
millionth of all words, as far as that is in these bounds. Only rankings of
sources are made in one task, which holds a row of numbers for each source.

Defined results: null text or text without a word has size 0 and is never taken;
a null source is a source of its own, last in order; rows that repeat a doc_id
are documents of their own, ordered by their texts (equal texts of one doc_id
stand next to each other, which of them is cut doesn't show in the result); an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvine.llm.common import WORD, joined_small, only, source_key, stream_starts, written

WEIGHTS = (3.0, 1.0, 2.0)
#: floor(2**62 / phi) as two limbs of 31 bits, the lower one made odd.
_PHI = int(2**62 * 0.6180339887498949) | 1
_HIGH, _LOW = _PHI >> 31, _PHI & ((1 << 31) - 1)
_MASK = (1 << 31) - 1
BLOCKS = 1 << 20
MIN_BLOCK, MAX_BLOCK = 8, 4096


def word_count(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _targets(sizes: DataFrame, weights: tuple[float, ...], share: float, repeats: int) -> DataFrame:
    """One row a source: source_size, n_rows, weight, target. Sources in the
    order of their cap by weight are capped one after the other while the rest,
    shared by weight, still reaches the cap. A window over one row a source."""
    stats = sizes.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    every = Window.partitionBy()
    ranked = stats.withColumn("rank", F.row_number().over(Window.orderBy("key")) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(repeats))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    ranked = ranked.withColumns({"turn": F.row_number().over(order), "spent": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "open": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)), "all": F.sum("source_size").over(every)})
    ranked = ranked.withColumn("level", (F.col("all") * F.lit(share) - F.col("spent")) / F.col("open"))
    ranked = ranked.withColumn("free", F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("turn", "level"))).over(every))
    target = F.when(F.col("free").isNull() | (F.col("turn") < F.col("free.turn")), F.col("cap").cast("double")).otherwise(F.least(F.col("free.level") * F.col("weight"), F.col("cap").cast("double")))
    return ranked.select("key", "source_size", "n_rows", "weight", target.alias("target"))


def _schedule(spark: SparkSession, plan: DataFrame, n: int) -> DataFrame:
    """(key, block, slot): the r-th of ``n`` slots of each source plays its r-th
    block, up to its ``last``. ``plan`` has key, blocks, first (the blocks of the
    sources before it) and last."""
    cells = plan.where("blocks > 0").select("key", "last", F.explode(F.expr("sequence(first, first + blocks - 1)")).alias("cell"))
    j = spark.range(0, n).withColumnRenamed("id", "slot")
    hi, lo = F.shiftright("slot", 31), F.col("slot").bitwiseAND(F.lit(_MASK))
    upper = (hi * F.lit(_LOW) + lo * F.lit(_HIGH)).bitwiseAND(F.lit(_MASK))
    point = (F.shiftleft(upper, 31) + lo * F.lit(_LOW)).bitwiseAND(F.lit((1 << 62) - 1))
    j = j.withColumn("cell", F.floor(point / F.lit(float(1 << 62)) * F.lit(float(n))))
    # there are about as many cells as slots, so neither side is small enough to be copied
    played = j.join(cells.hint("merge"), "cell").withColumn("chunk", F.floor(F.col("slot") / 1024))
    counts = played.groupBy("key", "chunk").agg(F.count("*").alias("c"))
    before = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("key", "chunk", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("key", "chunk").orderBy("slot")) - 1
    ranked = played.withColumn("rank", rank).join(counts.hint("merge"), ["key", "chunk"])
    return ranked.withColumn("block", F.col("before") + F.col("rank")).where("block < last").select("key", "block", "slot")


def mix(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> tuple[DataFrame, DataFrame, int, int]:
    """``sizes``: a written table of _rid, doc_id, key, size, mark (a hash of the
    text). Returns the pieces that the schedule plays (_rid, doc_id, key,
    repetition, word_from, words, block, slot), the sources with their targets,
    and the numbers of sources and slots."""
    spark = sizes.sparkSession
    stats = written(_targets(sizes, weights, share, repeats), "sources")
    n_sources, total = stats.agg(F.count("*"), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    block = min(MAX_BLOCK, max(MIN_BLOCK, -(-int(total) // BLOCKS)))
    plan = stats.withColumn("blocks", F.ceil(F.round("target").cast("long") / block)).withColumn("last", F.ceil(F.col("source_size") * repeats / block))
    plan = plan.withColumn("first", F.coalesce(F.sum("blocks").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    plan = written(plan, "plan")
    n = plan.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    schedule = written(_schedule(spark, plan, n), "schedule")

    turns = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repetition")
    stream = F.concat_ws("#", "key", "repetition").alias("stream")
    order = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("repetition").cast("string"), "mark"))
    rows = sizes.where("size > 0").select("_rid", "doc_id", "size", "key", "mark", turns).select("_rid", "doc_id", "size", "repetition", stream, order.alias("order"))
    about = plan.select("key", "source_size", "n_rows", turns).select(stream, "key", "source_size", "n_rows")
    placed = stream_starts(rows, "stream", "order", "size", about, n_sources * repeats)
    begin = F.col("repetition") * F.col("source_size") + F.col("start")
    placed = placed.withColumn("begin", begin).withColumn("end", F.col("begin") + F.col("size"))
    cut = placed.withColumn("block", F.explode(F.expr(f"sequence(begin div {block}, (end - 1) div {block})")))
    low, high = F.greatest("begin", F.col("block") * block), F.least("end", (F.col("block") + 1) * block)
    pieces = cut.select("_rid", "doc_id", "key", "repetition", "block", (low - F.col("begin")).alias("word_from"), (high - low).alias("words"))
    return pieces.join(schedule.hint("merge"), ["key", "block"]), stats, n_sources, n


def sized(docs: DataFrame) -> DataFrame:
    mark = F.coalesce(F.md5("text"), F.lit("")).alias("mark")
    return docs.select(F.monotonically_increasing_id().alias("_rid"), "doc_id", source_key(F.col("source")).alias("key"), word_count("text").alias("size"), mark)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows with the columns of ``docs``, in the order of the schedule:
    a document once for each repetition it is taken in, where its first slot is,
    cut to the words taken where the schedule ends in it (its words then joined
    by spaces, and n_chars, if there, counted anew)."""
    rid = "_corvine_rid"
    base = written(docs.withColumn(rid, F.monotonically_increasing_id()), "base")
    mark = F.coalesce(F.md5("text"), F.lit("")).alias("mark")
    sizes = written(base.select(F.col(rid).alias("_rid"), "doc_id", source_key(F.col("source")).alias("key"), word_count("text").alias("size"), mark), "sizes")
    pieces, _, _, slots = mix(sizes, **options)
    spans = pieces.groupBy(F.col("_rid").alias(rid), "repetition").agg(F.min("word_from").alias("_from"), F.sum("words").alias("_words"), F.min("slot").alias("_slot"))
    spans = spans.select(rid, F.struct("_from", "_words", "_slot").alias("_corvine_span"))
    rows = base.join(spans, rid)
    first, n = F.col("_corvine_span._from"), F.col("_corvine_span._words")
    some = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), (first + 1).cast("int"), n.cast("int")), " ")
    rows = rows.withColumn("text", F.when(word_count("text") == n, F.col("text")).otherwise(some))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    # tasks get equal stretches of the schedule, so nothing has to be sampled first
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    end = F.lit(float(max(1, slots)))
    task = F.least(F.lit(tasks - 1), F.floor(F.col("_corvine_span._slot") / end * tasks)).cast("int")
    return rows.repartitionById(tasks, task).sortWithinPartitions("_corvine_span._slot", rid).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``first_slot``: the first slot of the schedule that plays the document."""
    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "source", "text")
    sizes = written(sized(docs), "sizes")
    pieces, stats, n, _ = mix(sizes)
    taken = pieces.groupBy("_rid").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    out = joined_small(sizes, stats.select("key", "source_size", "target"), "key", n).join(taken, "_rid", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, '~') AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, coalesce(md5(text), '') AS mark
  FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY k) - 1 AS r FROM d GROUP BY k),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS weight, 2 * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER t AS turn, sum(source_size) OVER () AS everything,
             coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
             sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
      FROM w WINDOW t AS (ORDER BY cap / weight, k)),
l AS (SELECT *, (everything * 1.5::DOUBLE - spent) / open AS level FROM o),
f AS (SELECT min(turn) AS turn FROM l WHERE cap > level * weight),
g AS (SELECT l.*, CASE WHEN f.turn IS NULL OR l.turn < f.turn THEN l.cap::DOUBLE
                       ELSE least(x.level * l.weight, l.cap::DOUBLE) END AS target
      FROM l CROSS JOIN f LEFT JOIN l x ON x.turn = f.turn),
q AS (SELECT least(4096, greatest(8, ceil(floor(sum(target)) / 1048576)))::BIGINT AS block FROM g),
c AS (SELECT k, ceil(round(target)::BIGINT / block)::BIGINT AS blocks, ceil(2 * source_size / block)::BIGINT AS last FROM g CROSS JOIN q),
i AS (SELECT *, coalesce(sum(blocks) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM c),
n AS (SELECT sum(blocks)::BIGINT AS n FROM i),
j AS (SELECT slot, floor((((slot::HUGEINT * 2850178704830799873::HUGEINT) & 4611686018427387903::HUGEINT)::BIGINT)::DOUBLE
             / 4611686018427387904::DOUBLE * n::DOUBLE)::BIGINT AS cell FROM (SELECT unnest(range(0, n)) AS slot, n FROM n)),
y AS (SELECT k, unnest(range(first, first + blocks)) AS cell, last FROM i),
z AS (SELECT * FROM (SELECT k, slot, last, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS block FROM j JOIN y USING (cell)) WHERE block < last),
e AS (SELECT d.*, e.e, md5(coalesce(doc_id::VARCHAR, '') || ':' || e.e || ':' || mark) AS h FROM d CROSS JOIN (SELECT unnest([0, 1]) AS e) e WHERE size > 0),
p AS (SELECT doc_id, k, size, e * source_size + sum(size) OVER (PARTITION BY k, e ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
      FROM e JOIN s USING (k)),
x AS (SELECT doc_id, k, start, start + size AS stop, unnest(range((start // q.block)::BIGINT, ((start + size - 1) // q.block)::BIGINT + 1)) AS block, q.block AS width FROM p CROSS JOIN q),
t AS (SELECT doc_id, sum(least(stop, (block + 1) * width) - greatest(start, block * width)) AS taken, min(slot) AS first_slot
      FROM x JOIN z USING (k, block) GROUP BY doc_id)
SELECT d.doc_id, d.size, g.source_size, g.target, coalesce(t.taken, 0)::BIGINT AS taken, t.first_slot
FROM d JOIN g USING (k) LEFT JOIN t USING (doc_id)
"""
