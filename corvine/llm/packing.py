"""Mixture-controlled packing by deficit round-robin.

Documents of a source form a queue. A window of 2048 tokens credits every queue
its share of the window; queues are visited in turn and give what their deficit
allows; less than ``min_piece`` tokens wait, as a deficit carried on, and what is
left of the window goes to the largest deficits. Without ``weights`` a queue's
share is its share of all tokens, so that all queues end together. With weights a
window has the queues' weights as proportions; when a queue is used up, those that
remain share the windows by their weights. The packing so falls into stretches,
one at most for each queue, in which every queue gives tokens at one rate.

Packing runs in partitions. Partition b of the n of a stretch holds
[floor(total * b / n), floor(total * (b + 1) / n)) of what every queue gives in it,
so the state at its start is known in closed form: tokens packed before, the position
in the open window, and every queue's deficit (share * packed - given). Windows and
deficits run on across partitions, and only the very last window is short: it is
cut into sequences of a power of two tokens each, which need no padding.

Queues are sources; beyond ``max_queues`` sources (4096, counted exactly) they
share as many queues by hash, which bounds what a task holds and what the driver
gets. With weights (for up to 255 sources) all sources that aren't named form one
queue with the weight ``rest``. Token tables are written
once; their rows are dealt to partitions in slices, so a source or document of
any size is spread.

Defined results: a null text is an empty one (its only token is the end id); a
null source is a queue of its own; repeated rows are packed each; an empty table
gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvine.llm.common import give_back, only, source_key, tune, written
from corvine.llm.words import each_part, numbered, tables

WINDOW = 2048
END_ID = 1
MAX_QUEUES = 4096
MAX_WEIGHTS = 255
PARTITION_TOKENS = 1_000_000


class WordEncoder:
    """The ids that the ``tokenizers`` library gives, piece by piece.

    The vocabulary file is a BPE with word ends that composes characters (NFC),
    lower-cases, and splits runs of letters from all else. So a text may be cut
    where ASCII letters or bytes over 0x7F meet other bytes, but for two places:
    after an apostrophe (``'s`` is one piece) and where a byte over 0x7F meets a
    sign (it may compose with it, or be a sign itself). Each distinct piece of a part is looked up
    once. Runs of letters have their pairs merged by rank in ``tiktoken``: the id
    of a vocabulary entry is its rank, and byte 0xFF, which UTF-8 lacks, stands
    for the word end. Anything else, and texts with a special token, go through
    ``tokenizers`` itself. Ids of up to about ``keep`` bytes of pieces are kept for
    the next parts, in two generations.
    """

    def __init__(self, path: str, keep: int = 40 << 20):
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.keep, self.held, self.known, self.older, self.marks = keep // 2, 0, {}, {}, {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        special = {t["id"] for t in spec["added_tokens"]}
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if i not in special:
                body = token.removesuffix("</w>")
                ranks[bytes(byte_of[c] for c in body) + b"\xff" * (body != token)] = i
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.letter = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])

    def slow(self, text: str) -> bytes:
        return array("H", self.full.encode(text, add_special_tokens=False).ids).tobytes()

    def mark(self, text: str) -> bytes:
        if len(text) > 3:
            return self.slow(text)
        if text not in self.marks:
            self.marks[text] = self.slow(text)
        return self.marks[text]

    def piece(self, w: bytes) -> bytes:
        if not w.isalpha():
            if w.isspace():
                return b""
            text = w.decode()
            word = text.rstrip(".,;:!?")
            low = word.lower()
            if not low.isalpha() or "Σ" in word or not unicodedata.is_normalized("NFC", word):
                return self.slow(text)
            if word != text:
                return self.piece(word.encode()) + self.mark(text[len(word) :])
            w = low.encode()
        return array("H", self.merge(w + b"\xff")).tobytes()

    def looked_up(self, items: list[bytes]) -> list[bytes]:
        """The ids of each distinct piece."""
        known, older, out = self.known, self.older, []
        for w in items:
            ids = known.get(w)
            if ids is None:
                ids = older.get(w)
                ids = known[w] = self.piece(w) if ids is None else ids
                self.held += len(w) + len(ids) + 180
            out.append(ids)
        if self.held > self.keep:
            self.known, self.older, self.held = {}, known, 0
        return out

    def encode_part(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a part, an end id after each, and their numbers."""
        raw = data.tobytes()
        if any(x in raw for x in self.special):
            texts = [raw[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            end = array("H", [END_ID]).tobytes()
            found = [(self.slow(t.decode()) if any(x in t for x in self.special) else self.encode_part(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tobytes()[:-2]) + end for t in texts]
            return np.frombuffer(b"".join(found), "<u2"), np.array([len(x) // 2 for x in found])
        data = tables(True)[1][data]
        kind = self.letter[data]
        mark = np.zeros(len(data) + 1, bool)
        mark[1:-1] = kind[1:] != kind[:-1]
        high, apart = data >= 128, tables(False)[0][data]
        glued = high[1:] & ~apart[:-1] | high[:-1] & ~apart[1:] | (data[:-1] == 39) & kind[1:]
        mark[1:-1] &= ~glued
        mark[offs] = True
        cut = np.flatnonzero(mark[:-1])
        items = pa.Array.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(np.append(cut, len(data))), pa.py_buffer(data)])
        at, distinct = numbered(items)
        found = [*self.looked_up(distinct.to_pylist()), array("H", [END_ID]).tobytes()]
        pool = np.frombuffer(b"".join(found), "<u2")
        begin = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 2)))
        first = np.searchsorted(cut, offs)
        del items, distinct, mark, kind, high, apart, glued, cut
        at = np.insert(at, first[1:], len(found) - 1)
        n = np.diff(begin)[at]
        after = np.concatenate(([0], np.cumsum(n)))
        # a part has far fewer than 2**31 ids unless one text alone is larger
        kind = np.int32 if after[-1] < 1 << 31 and begin[-1] < 1 << 31 else np.int64
        where = np.repeat((begin[at] - after[:-1]).astype(kind), n)
        where += np.arange(after[-1], dtype=kind)
        return pool[where], np.diff(after[first + np.arange(len(first))])

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, an end id after each, as unsigned 16-bit numbers,
        and where each text begins."""
        parts = [self.encode_part(data, offs) for _, _, data, offs in each_part(texts, 4 << 20)]
        flat = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, "<u2")
        return flat, np.concatenate(([0], np.cumsum(np.concatenate([n for _, n in parts])))) if parts else np.zeros(1, np.int64)


def _tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, given = WordEncoder(path), TaskContext.get().partitionId(), {}
        for b in batches:
            flat, at = encoder.encode_all(b.column("text"))
            n, inside = np.diff(at), []
            for q, size in zip(b.column("queue").to_pylist(), n.tolist(), strict=True):
                inside.append(given.get(q, 0))
                given[q] = inside[-1] + size
            tokens = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(2 * at.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("queue"), tokens, pa.array(n, pa.int64()), pa.array([part] * len(n), pa.int32()), pa.array(inside, pa.int64())], ["doc_id", "queue", "tokens", "n", "part", "inside"])
            del flat, at, n, tokens, b
            give_back()

    return run


def tail_sizes(n: int) -> list[int]:
    """Powers of two, largest first, that sum to ``n``."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Stretch(NamedTuple):
    """What every queue gives while the queues' rates stay as they are."""

    first: int  # its first partition
    parts: int
    before: int  # tokens packed before it
    low: dict[str, int]
    high: dict[str, int]


def stretches(totals: dict[str, int], weights: dict[str, float] | None, partition_tokens: int) -> list[Stretch]:
    """The stretches of queues with ``totals`` tokens, which give by weight (None:
    by their totals) until they are used up."""
    rate = {q: Fraction(totals[q] if weights is None else weights[q]) for q in totals}
    low, found, first, before = dict.fromkeys(totals, 0), [], 0, 0
    while active := [q for q in totals if low[q] < totals[q]]:
        time = min((totals[q] - low[q]) / rate[q] for q in active)
        high = {q: low[q] + int(rate[q] * time) for q in active}
        n = sum(high[q] - low[q] for q in active)
        parts = max(1, -(-n // partition_tokens))
        found.append(Stretch(first, parts, before, {q: low[q] for q in active}, high))
        first, before, low = first + parts, before + n, low | high
    return found


def round_robin(queues: dict[str, list[list]], totals: dict[str, int], b: int, parts: int, min_piece: int, before: int = 0, everything: int | None = None) -> Iterator[tuple]:
    """Pieces (item, from, length, sequence, offset) of one partition of a stretch.

    ``queues``: for each queue its items as lists whose first element is the
    number of tokens, in order. ``totals``: what every queue gives in the stretch;
    ``before`` tokens are packed before it, ``everything`` in all.
    """
    names = sorted(totals)
    total = np.array([totals[q] for q in names], object)
    in_stretch = int(sum(total))
    everything = in_stretch if everything is None else everything
    share = (total / in_stretch).astype(float)
    given = total * b // parts
    done = int(given.sum())
    left = (total * (b + 1) // parts - given).astype(np.int64)
    packed = before + done
    stop = packed + int(left.sum())
    deficit = np.array([float(done * t / in_stretch - g) for t, g in zip(total, given, strict=True)])
    whole = everything // WINDOW
    tails = tail_sizes(everything % WINDOW)
    at = [[0, 0] for _ in names]  # item and token reached
    turn = 0

    def bounds(pos: int) -> tuple[int, int, int]:
        if pos < whole * WINDOW:
            return pos // WINDOW, pos // WINDOW * WINDOW, WINDOW
        low = whole * WINDOW
        for k, size in enumerate(tails):
            if pos < low + size:
                return whole + k, low, size
            low += size
        raise AssertionError("past the end")

    def give(s: int, take: int, seq: int, offset: int) -> Iterator[tuple]:
        items, here = queues.get(names[s], []), at[s]
        while take:
            item = items[here[0]]
            n = min(take, item[0] - here[1])
            yield item, here[1], n, seq, offset
            take, offset, here[1] = take - n, offset + n, here[1] + n
            if here[1] == item[0]:
                here[0], here[1] = here[0] + 1, 0

    while packed < stop:
        seq, low, size = bounds(packed)
        space = min(low + size, stop) - packed
        deficit += space * share
        able = np.flatnonzero((left > 0) & (deficit >= np.minimum(min_piece, left)) & (deficit >= 1))
        able = np.concatenate((able[able >= turn], able[able < turn]))
        for s in able:
            take = int(min(deficit[s], left[s], space))
            if take:
                yield from give(s, take, seq, packed - low)
                packed, space = packed + take, space - take
                deficit[s] -= take
                left[s] -= take
            if not space:
                turn = int(s) + 1
                break
        while space:
            s = int(np.argmax(np.where(left > 0, deficit, -np.inf)))
            take = int(min(left[s], space, max(min_piece, deficit[s])))
            yield from give(s, take, seq, packed - low)
            packed, space = packed + take, space - take
            deficit[s] -= take
            left[s] -= take


def _pack(plan: list[Stretch], everything: int, min_piece: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["queue", "pos"], kind="stable")
        b = int(pdf["b"].iloc[0])
        at = plan[bisect_right(plan, b, key=lambda s: s.first) - 1]
        totals = {q: at.high[q] - at.low[q] for q in at.low}
        queues: dict[str, list[list]] = {}
        for q, doc, start, n, tokens in zip(pdf["queue"], pdf["doc_id"], pdf["start"], pdf["n"], pdf["tokens"], strict=True):
            queues.setdefault(q, []).append([len(tokens) // 2, doc, start, n, tokens])
        rows = [(item[1], item[2] + a, n, np.frombuffer(item[4], "<u2")[a : a + n].astype("<u4").tobytes(), item[3], seq, off) for item, a, n, seq, off in round_robin(queues, totals, b - at.first, at.parts, min_piece, at.before, everything)]
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    return run


def pack(docs: DataFrame, tokenizer: str, partition_tokens: int = PARTITION_TOKENS, min_piece: int = 128, max_queues: int = MAX_QUEUES, weights: dict[str | None, float] | None = None, rest: float = 1.0) -> DataFrame:
    """Pieces of ``docs`` (doc_id, source, text): doc_id, start, length, ids
    (little-endian unsigned 32-bit numbers), doc_tokens, sequence_id, offset.
    ``tokenizer`` is a path that every executor can read. ``weights``: the
    proportions of sources in windows, ``rest`` for all sources it doesn't name."""
    spark = docs.sparkSession
    tune(spark)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("queue"), "text")
    if weights is not None:
        if len(weights) > MAX_WEIGHTS or min([rest, *weights.values()]) <= 0:
            raise ValueError(f"weights are over 0 and for up to {MAX_WEIGHTS} sources")
        weights = {"~" if q is None else f"s{q}": w for q, w in weights.items()} | {"*": rest}
        named = named.withColumn("queue", F.when(F.col("queue").isin(list(weights)), F.col("queue")).otherwise("*"))
    elif named.select("queue").distinct().limit(max_queues + 1).count() > max_queues:
        named = named.withColumn("queue", F.pmod(F.xxhash64("queue"), F.lit(max_queues)).cast("string"))
    tokens = written(named.mapInArrow(_tokens(tokenizer), "doc_id long, queue string, tokens binary, n long, part int, inside long"), "tokens")
    sums = written(tokens.groupBy("part", "queue").agg(F.sum("n").alias("n")), "sums")
    totals = {r["queue"]: r["n"] for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # max_queues rows at most
    plan = stretches(totals, weights, partition_tokens)
    # a row a queue; one run each without weights, and 256 * 256 / 2 runs at most with them
    runs = [(q, [(s.low[q], s.high[q], s.first, s.parts) for s in plan if q in s.low and s.low[q] < s.high[q]]) for q in totals]
    runs = spark.createDataFrame(runs, "queue string, runs array<struct<low: long, high: long, first: long, parts: long>>")
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    sums = F.broadcast(sums) if sums.count() <= 200_000 else sums
    placed = tokens.join(sums, ["part", "queue"]).join(F.broadcast(runs), "queue").withColumn("pos", F.col("before") + F.col("inside"))
    met = F.explode(F.filter("runs", lambda r: (r["low"] < F.col("pos") + F.col("n")) & (r["high"] > F.col("pos")))).alias("r")
    met = placed.select("doc_id", "queue", "n", "tokens", "pos", met).select("doc_id", "queue", "n", "tokens", "pos", "r.*")
    wide = lambda x: f"cast({x} as decimal(38,0))"  # noqa: E731  products outgrow 64 bits on large corpora
    met = met.withColumns({"from": F.greatest("pos", "low") - F.col("low"), "to": F.least(F.col("pos") + F.col("n"), "high") - F.col("low"), "total": F.col("high") - F.col("low")})
    cut = met.withColumn("k", F.explode(F.expr(f"sequence(({wide('from + 1')} * parts - 1) div total, ({wide('to')} * parts - 1) div total)")))
    edge = lambda k: f"({wide('total')} * ({k}) div parts)"
    cut = cut.withColumn("begin", F.expr(f"low + greatest(from, {edge('k')})")).withColumn("end", F.expr(f"low + least(to, {edge('k + 1')})"))
    cut = cut.select((F.col("first") + F.col("k")).alias("b"), "doc_id", "queue", "n", (F.col("begin") - F.col("pos")).alias("start"), F.col("begin").alias("pos"), F.expr("substring(tokens, cast(1 + 2 * (begin - pos) as int), cast(2 * (end - begin) as int))").alias("tokens"))
    return cut.groupBy("b").applyInPandas(_pack(plan, sum(totals.values()), min_piece), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def packed_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "source", "text")
    return packed_digest(pack(docs, default_tokenizer()))
