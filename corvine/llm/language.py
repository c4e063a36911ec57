"""Language identification by language-bitmask n-gram filters.

Training counts the character n-grams (3 and 4 code points of lower-cased text,
a run of anything but letters being one blank) of every language over a bounded
sample of labelled texts. An n-gram enters the filter of every language in which
its share of the n-grams is at least half of its largest share in any language.

All filters share one bit-sliced Bloom table: a row of the table is a bitmask of
languages, and the AND of an n-gram's three rows is the set of all languages
containing it, from one lookup. A text is decided by per-language popcounts,
corrected for the filters' false positives ((hits - fp * n) / (1 - fp) with the
fill of each language's bits to the third power); the prior of the training
labels breaks ties.

The sample takes up to ``per_language`` rows of each language, those with the
smallest hashes of doc_id (a bound of the training set, not of what is
predicted), with whole texts; the n-grams are counted and their bits set on the
executors, and the driver gets the table of 2**``table_bits`` rows. Prediction is
one pass without a shuffle, and reads long texts in slices.

Defined results: ``und`` with score 0 for a null text or a text without a
letter, or if nothing was learned; a null lang teaches nothing; repeated rows
are predicted each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvine.llm import words
from corvine.llm.common import only, tune, written

HASHES = 3
WIDTHS = (3, 4)
PER_LANGUAGE = 2000
TABLE_BITS = 21


@cache
def _letters() -> np.ndarray:
    """For each code point itself if it is a letter, else 0 (a blank)."""
    points = np.arange(0x110000, dtype=np.uint32)
    table = np.array([chr(c).isalpha() for c in range(0x110000)])
    return np.where(table, points, 0).astype(np.uint32)


def ngrams(text: str | None, slice_: int = 1 << 20) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of a text, in both widths, from slices of it; none
    without a letter."""
    text = (text or "").lower()
    carried, some, held = np.zeros(1, np.uint64), False, []
    for at in range(0, len(text), slice_):
        code = _letters()[np.frombuffer(text[at : at + slice_].encode("utf-32-le", "replace"), np.uint32)].astype(np.uint64)
        keep = (code != 0) | (np.concatenate((carried[-1:], code[:-1])) != 0)
        code = code[keep]
        if at + slice_ >= len(text) and (code[-1:] if len(code) else carried[-1:]).any():
            code = np.append(code, np.uint64(0))
        some = some or code.any()
        held.append(_hashed(carried, code))
        carried = np.concatenate((carried, code))[-(max(WIDTHS) - 1) :]
        if some:
            yield from held
            held = []


def _hashed(carried: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams that end in ``code``."""
    out = []
    for width in WIDTHS:
        own = np.concatenate((carried[-(width - 1) :], code))
        n = len(own) - width + 1
        if n > 0:
            h = own[:n].copy()
            for k in range(1, width):
                h |= own[k : k + n] << np.uint64(21 * k) if k < 3 else (own[k : k + n] << np.uint64(43)) ^ (own[k : k + n] >> np.uint64(3))
            out.append(words.mix(h + np.uint64(width << 57)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums: n-gram counts of each language over a partition's texts."""
    held: dict[str, list[np.ndarray]] = {}

    def flush(lang: str) -> pa.RecordBatch:
        grams, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *held.pop(lang)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            held.setdefault(lang, []).extend(ngrams(text))
        for lang in [x for x, v in held.items() if sum(map(len, v)) > 4_000_000]:
            yield flush(lang)
    for lang in list(held):
        yield flush(lang)


class Model:
    """langs, log priors, and the table: 64 languages to a word of a row."""

    def __init__(self, langs: list[str], prior: np.ndarray, table: np.ndarray):
        self.langs, self.prior, self.table = langs, prior, table
        self.rows = len(table)
        fill = [((table[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(langs))]
        self.false = np.minimum(np.array(fill) ** HASHES, 0.99)

    @staticmethod
    def places(grams: np.ndarray, rows: int) -> Iterator[np.ndarray]:
        step = (grams >> np.uint64(32)) | np.uint64(1)
        for k in range(HASHES):
            yield ((grams + np.uint64(k) * step) & np.uint64(rows - 1)).astype(np.int64)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        out = None
        for at in self.places(grams, self.rows):
            out = self.table[at] if out is None else out & self.table[at]
        return out

    def popcounts(self, grams: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
        """groups x languages: n-grams of each group in each language's filter."""
        masks = self.masks(grams)
        out = np.zeros((groups, len(self.langs)))
        for k in range(len(self.langs)):
            bit = (masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
            out[:, k] = np.bincount(group, weights=bit, minlength=groups)
        return out

    def decide(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        n, hits = np.zeros(len(texts)), np.zeros((len(texts), len(self.langs)))
        held, own, size = [], [], 0
        for k, text in enumerate(texts if self.langs else []):
            for grams in ngrams(text):
                n[k] += len(grams)
                held.append(grams)
                own.append(k)
                size += len(grams)
                if size > 1 << 21:
                    hits += self.popcounts(np.concatenate(held), np.repeat(own, [len(g) for g in held]), len(texts))
                    held, own, size = [], [], 0
        if size:
            hits += self.popcounts(np.concatenate(held), np.repeat(own, [len(g) for g in held]), len(texts))
        if not n.any():
            return ["und"] * len(texts), [0.0] * len(texts)
        true = np.clip((hits - self.false * n[:, None]) / (1 - self.false), 0, None)
        best = np.argmax(true + 1e-9 * self.prior, axis=1)
        top = true[np.arange(len(texts)), best]
        # a winner's share, sharpened as it is rare for an n-gram to be in one language only
        weight = np.where(top[:, None] > 0, (true / np.maximum(top, 1e-12)[:, None]) ** 4, 1.0)
        score = 1 / weight.sum(axis=1)
        return [self.langs[b] if c else "und" for b, c in zip(best, n, strict=True)], [float(s) if c else 0.0 for s, c in zip(score, n, strict=True)]


def learn(labelled: DataFrame, per_language: int = PER_LANGUAGE, table_bits: int = TABLE_BITS) -> Model:
    """A model from ``labelled`` (doc_id, text, lang)."""
    spark = labelled.sparkSession
    tune(spark)
    labelled = labelled.where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return Model([], np.zeros(0), np.zeros((2, 1), np.uint64))
    # the rows of smallest hash: a cut that leaves slightly more than wanted, then the exact number
    order = F.abs(F.xxhash64("doc_id", F.lit("language")) % 1_000_000_007)
    cut = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1_000_000_007, int(1_000_000_007 * (per_language + 5 * per_language**0.5 + 20) / n)))])
    near = labelled.withColumn("_order", order).where(F.col("_order") <= cut[F.col("lang")])
    near = near.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_order", "doc_id", F.md5("text")))).where(F.col("_rank") <= per_language)
    sample = near.repartition(32, "_rank").select("lang", "text")
    grams = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = written(grams, "ngrams")
    totals = {r["lang"]: r["t"] for r in grams.groupBy("lang").agg(F.sum("n").alias("t")).collect()}
    langs = sorted(counts, key=lambda x: (-counts[x], x))
    total = F.create_map(*[F.lit(x) for lang in langs for x in (lang, float(max(1, totals.get(lang, 0))))])
    share = grams.withColumn("share", F.col("n") / total[F.col("lang")])
    top = share.join(share.groupBy("gram").agg(F.max("share").alias("largest")), "gram").where("share >= 0.5 * largest and n > 1")
    # bits are set on the executors: what comes back is one row a row of the table at most
    number = F.create_map(*[F.lit(x) for k, lang in enumerate(langs) for x in (lang, k)])[F.col("lang")]
    mask = F.lit((1 << table_bits) - 1)
    step = F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1))
    places = F.array(*[(F.col("gram").bitwiseAND(mask) + (step * k).bitwiseAND(mask)).bitwiseAND(mask) for k in range(HASHES)])
    bits = top.select(F.explode(places).alias("slot"), F.floor(number / 64).alias("part"), F.call_function("shiftleft", F.lit(1).cast("long"), (number % 64).cast("int")).alias("bits"))
    held = bits.groupBy("slot", "part").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros((1 << table_bits, -(-len(langs) // 64)), np.uint64)
    table[held["slot"].to_numpy(np.int64), held["part"].to_numpy(np.int64)] = held["bits"].to_numpy(np.int64).view(np.uint64)
    prior = np.log(np.array([counts[x] for x in langs]) / sum(counts.values()))
    return Model(langs, prior, table)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            lang, score, texts = [], [], b.column("text")
            sizes = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))))
            for i, j in words.parts(sizes):
                x, y = model.decide(texts.slice(i, j - i).to_pylist())
                lang, score = lang + x, score + y
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs``. The model is a few
    megabytes whatever was learned (its table has a fixed size)."""
    tune(docs.sparkSession)
    docs = only(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_predict(shared), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def remainder(column: str, divisor: int) -> Column:
    """crc32 of an id as text, modulo ``divisor``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "lang")
    model = learn(docs.where(remainder("doc_id", 4) != 2))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
