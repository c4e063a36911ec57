"""Quality rules by document, with verdicts by host.

Counts of every text come from numpy over Arrow batches (8-word windows are
compared by 64-bit hashes of their words' XXH3 hashes, lines by XXH3). Rules turn counts into failures. Failures are then
aggregated by host (the ``source`` of documents): a host's failure rates are
shrunk towards all hosts by a beta prior whose two parameters are fitted to the
hosts' rates by moments, weighted by rows, and a host is condemned when its
shrunk rate of documents that fail any rule is over ``host_limit``. Verdicts, with
the shrunk rate of every rule (``<rule>_rate``), are joined back to the documents.

The host aggregation has partial sums before its shuffle; one row a host is
broadcast up to 100,000 hosts and joined with salt beyond, so a hot host is
never gathered.

Defined results: null text has no words, so it fails the length rule; a null
source is a host of its own; repeated rows count each; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm import words
from corvine.llm.common import joined_small, only, source_key, tune, written

#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
REPEAT = 8


def text_counts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of texts."""
    h, first = words.hashed(data, offs)
    texts = len(offs) - 1
    salt = np.uint64(0x9E3779B97F4A7C15)

    def per_text(flags: np.ndarray) -> np.ndarray:
        if texts == 1:
            return np.array([np.count_nonzero(flags)])
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[offs[1:]] - total[offs[:-1]]

    inner = ~words.tables(False)[0][data]
    chars = per_text(inner & ((data & 0xC0) != 0x80))
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    symbols = per_text(symbol[data])

    # lines with a word: pieces between \n (or text ends); every text has one more
    # line than breaks, so the sorted starts and ends pair up
    breaks = np.flatnonzero(data == 10)
    lo = np.sort(np.concatenate((offs[:-1], breaks + 1)), kind="stable")
    hi = np.sort(np.concatenate((breaks, offs[1:])), kind="stable")
    text_of = np.searchsorted(offs[1:], lo, "right")
    held = np.concatenate(([0], np.cumsum(inner, dtype=np.int32)))
    has = held[hi] > held[lo]
    lo, hi, text_of = lo[has], hi[has], text_of[has]
    line = words.hashes(words.spelled(data, lo, hi))
    _, back = np.unique(words.mix(line + text_of.astype(np.uint64) * salt), return_index=True)
    again = np.ones(len(line), bool)
    again[back] = False
    dup = np.bincount(text_of[again], minlength=texts)

    # words of 8-word windows that a text has twice or more
    w, at = words.windows(h, first, REPEAT)
    owner = np.repeat(np.arange(texts), np.diff(at))
    _, group, count = np.unique(words.mix(w + owner.astype(np.uint64) * salt), return_inverse=True, return_counts=True)
    often = count[group] > 1 if len(w) else np.zeros(0, bool)
    begin = first[:-1][owner] + np.arange(len(w)) - at[:-1][owner]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, begin[often], 1)
    np.add.at(cover, begin[often] + REPEAT, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
    return np.diff(first), chars, symbols, dup, covered[first[1:]] - covered[first[:-1]]


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [text_counts(data, offs) for _, _, data, offs in words.each_part(b.column("text"))]
        cols = [pa.array(np.concatenate([f[k] for f in found]) if found else [], pa.int64()) for k in range(len(_COUNTS))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("host"), *cols], ["doc_id", "host", *_COUNTS])


def failures() -> dict[str, Column]:
    """The rules, by name; each is true for a document that fails."""
    n = F.col("n_words")
    return {
        "few_words": n < 20,
        "repeats": 100 * F.col("n_repeat_words") > 30 * n,
        "symbols": 10 * F.col("n_symbols") > n * 5,
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 25 * n),
        "dup_lines": 2 * F.col("n_dup_lines") > n,
    }


def host_verdicts(flagged: DataFrame, rules: list[str], host_limit: float) -> DataFrame:
    """One row a host: documents, shrunk rate of every rule and of any failure,
    and whether the host is condemned. All rates go through one beta prior each:
    its mean is the rate of all rows, its weight follows from the spread of the
    hosts' rates beyond binomial noise (kept between 1 and 10,000 documents)."""
    names = [*rules, "any"]
    hosts = written(flagged.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in names]), "hosts")
    m = hosts.agg(F.count("*").alias("h"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), *[F.sum(r).alias(r) for r in names], *[F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_sq") for r in names]).first()
    out = hosts
    for r in names:
        if not m["n"]:
            return out.withColumns({f"{x}_rate": F.lit(0.0) for x in names}).withColumn("condemned", F.lit(False))
        mean, noise = m[r] / m["n"], (m[r] / m["n"]) * (1 - m[r] / m["n"])
        between = m[f"{r}_sq"] - m["n"] * mean * mean  # weighted spread of rates
        free = m["n"] - m["nn"] / m["n"]
        variance = max(0.0, (between - (m["h"] - 1) * noise) / free) if free > 0 else 0.0
        weight = min(10_000.0, max(1.0, noise / variance - 1 if variance > 0 else 10_000.0))
        out = out.withColumn(f"{r}_rate", (F.col(r) + F.lit(weight * mean)) / (F.col("n") + F.lit(weight)))
    return out.withColumn("condemned", F.col("any_rate") > host_limit)


def quality_rules(docs: DataFrame, host_limit: float = 0.6) -> DataFrame:
    """Counts, failed rules and verdicts of ``docs`` (doc_id, source, text)."""
    tune(docs.sparkSession)
    named = docs.select("doc_id", source_key(F.col("source")).alias("host"), "text")
    counts = named.mapInArrow(_count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, host string, " + ", ".join(f"{c} long" for c in _COUNTS))
    rules = failures()
    flagged = counts.withColumns(rules)
    flagged = written(flagged.withColumn("base_failed", F.col("few_words") | F.col("repeats")).withColumn("any", F.greatest(*rules)), "rules")
    hosts = host_verdicts(flagged, list(rules), host_limit)
    verdicts = hosts.select("host", *[f"{r}_rate" for r in (*rules, "any")], "condemned")
    out = joined_small(flagged, verdicts, "host", hosts.count())
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("condemned"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "source", "text")
    return quality_rules(docs).select("doc_id", *_COUNTS, "base_failed", "kept")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, '~') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT *, len(w) AS n_words FROM d),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, n_words - 6)) AS i FROM n WHERE n_words >= 8)),
o AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g),
p AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words
      FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM o WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, sum(c - 1) AS n_dup_lines
      FROM (SELECT doc_id, line, count(*) AS c
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
            WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
c AS (SELECT n.doc_id, host, n_words::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM n LEFT JOIN p USING (doc_id) LEFT JOIN l USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > 5 * n_words
             OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 2 * n_dup_lines > n_words AS failed FROM c),
h AS (SELECT host, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS x FROM f GROUP BY host),
m AS (SELECT count(*) AS hosts, sum(n) AS n, sum(n * n) AS nn, sum(x) / sum(n) AS mean, sum(x * x / n) AS sq FROM h),
v AS (SELECT *, mean * (1 - mean) AS noise,
             CASE WHEN n - nn / n > 0 THEN greatest(0, (sq - n * mean * mean - (hosts - 1) * mean * (1 - mean)) / (n - nn / n)) ELSE 0 END AS variance FROM m),
b AS (SELECT mean, least(10000, greatest(1, CASE WHEN variance > 0 THEN noise / variance - 1 ELSE 10000 END)) AS weight FROM v),
r AS (SELECT host, (x + weight * mean) / (n + weight) > 0.6 AS condemned FROM h CROSS JOIN b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT condemned AS kept
FROM f JOIN r USING (host)
"""
