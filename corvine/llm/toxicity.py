"""Toxicity by Levenshtein automata over a lexicon trie, read in context.

Learning: up to ``per_class`` labelled rows of either class, those with the
smallest hashes of doc_id and text (a bound of the training set, not of what is
scored; the lexicon holds words of these rows only).
A word is a term if its log odds of being in a toxic text, less ``z`` standard
errors, are over ``least``. Toxic texts count only as far as the word has distinct
neighbourhoods (the word before and the word after) in them, so words of copied
texts don't become terms. A weighted logistic regression then reads six context features of each
text, with the classes weighted back to their shares among all labels.

Matching: the terms form a trie. A word's Levenshtein automaton is run along the
trie, so misspelled terms are found at one edit (terms of five letters or more;
shorter ones must match). The walk starts below a half of a term that the word has
intact, from the front or from the back, as one edit leaves one half intact. Stems
of four or five letters are terms as well, learned like words and matched by the
start of a word without an edit. Results of words are kept for the next text.

Context: hits inside quotation marks of one line, or within three words after a
reporting verb, count as quotation. The features are the numbers of plain exact,
plain misspelled and quoted hits (as logarithms), distinct plain terms, the
largest weight of plain hits in any window of ten words, and hits by length.

Defined results: null and empty texts have no hits and get the score that goes
with none; without labels, or with labels of one class, there are no terms and
scores are the share of toxic labels (0 without any); repeated rows are scored
each; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm.common import at_most, only, tune, written
from corvine.llm.language import remainder

PER_CLASS = 4000
STEMS = (4, 5)
LETTERS = re.compile(r"[^\W\d_]+")
#: Quotation marks that open and close (fixed values).
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‘": "’"}
#: Verbs after which a hit is reported, not said (fixed values).
REPORTING = frozenset(("said", "says", "wrote", "writes", "called", "calls", "quoted", "quote", "reported", "term", "word", "slur"))
WINDOW = 10


def grown(terms: list[str]) -> dict:
    """A trie by letters; ``None`` in a node holds the term that ends there."""
    root: dict = {}
    for t in terms:
        node = root
        for c in t:
            node = node.setdefault(c, {})
        node[None] = t
    return root


class Trie:
    """The terms forward and backward. One edit leaves the first or the second
    half of a term intact, so the automaton starts below an intact half, in
    either direction. Stems (terms that end in ``*``) are kept apart."""

    def __init__(self, terms: list[str]):
        self.stems = {t[:-1] for t in terms if t.endswith("*")}
        terms = [t for t in terms if not t.endswith("*")]
        self.exact = set(terms)
        long = [t for t in terms if len(t) >= 5]
        self.ways = []
        for turned in (False, True):
            own = [t[::-1] for t in long] if turned else long
            halves = {len(t) - len(t) // 2 if turned else len(t) // 2 for t in own}
            roots: dict[int, dict[str, dict]] = {}
            for n in sorted(halves):
                under: dict[str, list[str]] = {}
                for t in own:
                    if (len(t) - len(t) // 2 if turned else len(t) // 2) == n:
                        under.setdefault(t[:n], []).append(t)
                roots[n] = {head: grown([t[n:] for t in rest]) for head, rest in under.items()}
            self.ways.append((turned, list(roots.items())))
        self.longest = max(map(len, terms), default=0) + 1

    def match(self, word: str) -> tuple[str, int] | None:
        """The term that the word is, else its longest stem, else the smallest
        term at one edit."""
        if word in self.exact:
            return word, 0
        for n in reversed(STEMS):
            if len(word) > n and word[:n] in self.stems:
                return f"{word[:n]}*", 0
        if not 4 <= len(word) <= self.longest:
            return None
        near = None
        for turned, roots in self.ways:
            own = word[::-1] if turned else word
            for n, heads in roots:
                if below := heads.get(own[:n]):
                    for tail in walk(below, own[n:]):
                        term = (own[:n] + tail)[::-1] if turned else own[:n] + tail
                        near = term if near is None or term < near else near
        return (near, 1) if near else None


def walk(root: dict, word: str) -> Iterator[str]:
    """The intersection of a trie with the Levenshtein automaton of ``word`` for
    one edit."""
    stack = [(root, close({0: 0}, word))]
    while stack:
        node, states = stack.pop()
        for c, below in node.items():
            if c is None:
                if states.get(len(word), 2) <= 1:
                    yield below
            elif after := step(states, c, word):
                stack.append((below, after))


def close(states: dict[int, int], word: str) -> dict[int, int]:
    """Positions of the automaton (letters of ``word`` read -> edits, at most
    one), with those reached by skipping a letter of the word."""
    for i, e in list(states.items()):
        if e == 0 and i < len(word):
            states[i + 1] = min(states.get(i + 1, 2), 1)
    return states


def step(states: dict[int, int], c: str, word: str) -> dict[int, int]:
    """The positions after the trie's letter ``c``."""
    out: dict[int, int] = {}
    for i, e in states.items():
        if i < len(word) and word[i] == c:
            out[i + 1] = min(out.get(i + 1, 2), e)
        if e == 0:
            out[i] = min(out.get(i, 2), 1)
            if i < len(word):
                out[i + 1] = min(out.get(i + 1, 2), 1)
    return close(out, word)


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """Stretches between quotation marks of the same line."""
    if not any(q in text for q in QUOTES):
        return []
    out, at = [], 0
    for line in text.split("\n"):
        i = 0
        while i < len(line):
            if close_ := QUOTES.get(line[i]):
                j = line.find(close_, i + 1)
                if j > 0:
                    out.append((at + i, at + j))
                    i = j
            i += 1
        at += len(line) + 1
    return out


class Lexicon:
    def __init__(self, weights: dict[str, float], keep: int = 300_000):
        self.weights, self.trie, self.keep = weights, Trie(sorted(weights)), keep
        self.seen: dict[str, tuple[str, int] | None] = {}

    def features(self, text: str | None) -> list[float]:
        if not text or not self.weights:
            return [0.0] * 6
        low = text.lower()
        found = LETTERS.findall(low)
        if len(self.seen) > self.keep:
            self.seen.clear()
        hit = set()
        for w in set(found):
            if w in self.seen:
                m = self.seen[w]
            else:
                m = self.seen[w] = self.trie.match(w)
            if m:
                hit.add(w)
        if not hit:
            return [0.0] * 6
        spans = quoted_spans(low)
        where = [m.start() for m in LETTERS.finditer(low)] if spans else []
        plain: list[tuple[int, float]] = []
        exact = misspelled = quoted = 0
        terms = set()
        for i, w in enumerate(found):
            if w in hit:
                term, edits = self.seen[w]
                if any(a < where[i] < b for a, b in spans) or not REPORTING.isdisjoint(found[max(0, i - 3) : i]):
                    quoted += 1
                    continue
                exact += edits == 0
                misspelled += edits > 0
                terms.add(term)
                plain.append((i, self.weights[term] / (1 + edits)))
        dense = best = 0.0
        tail = 0
        for k, (i, w) in enumerate(plain):
            dense += w
            while plain[tail][0] <= i - WINDOW:
                dense -= plain[tail][1]
                tail += 1
            best = max(best, dense)
        return [float(np.log1p(exact)), float(np.log1p(misspelled)), float(np.log1p(quoted)), float(np.log1p(len(terms))), min(best, 20.0) / 5, float(np.sqrt(min(1.0, len(plain) / len(found))))]


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic, context, n): the number of texts with a word, in toxic texts
    dealt to the neighbourhood where each text has it first."""
    plain: Counter = Counter()
    for b in batches:
        out: dict[tuple[str, int], int] = {}
        for toxic, text in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist(), strict=True):
            found = LETTERS.findall((text or "").lower())
            if toxic:
                around, new = ["", *found, ""], set()
                for i, w in enumerate(found):
                    near = zlib.crc32(f"{around[i]} {around[i + 2]}".encode())
                    for x in (w, *(f"{w[:n]}*" for n in STEMS if len(w) > n)):
                        out[x, near] = out.get((x, near), 0) + (x not in new)
                        new.add(x)
            else:
                words = set(found)
                plain.update(words)
                plain.update({f"{w[:n]}*" for w in words for n in STEMS if len(w) > n})
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.string()), pa.array([1] * len(out), pa.int32()), pa.array([c for _, c in out], pa.int64()), pa.array(list(out.values()), pa.int64())], ["word", "toxic", "context", "n"])
        if len(plain) > 500_000:
            yield _plain(plain)
            plain.clear()
    yield _plain(plain)


def _plain(counts: Counter) -> pa.RecordBatch:
    k = len(counts)
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([0] * k, pa.int32()), pa.nulls(k, pa.int64()), pa.array(list(counts.values()), pa.int64())], ["word", "toxic", "context", "n"])


def _features(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [lexicon.features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.002) -> np.ndarray:
    """Coefficients, intercept last, by damped Newton steps."""
    x = np.column_stack((x, np.ones(len(x))))
    weight = weight / weight.sum()
    penalty = np.full(x.shape[1], ridge / 10)
    penalty[-1] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty * beta
        hess = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(hess, grad)
        beta -= move * min(1.0, 4 / max(1e-12, np.abs(move).max()))
        if np.abs(move).max() < 1e-8:
            break
    return beta


class Model:
    def __init__(self, lexicon: Lexicon, beta: np.ndarray, base: float):
        self.lexicon, self.beta, self.base = lexicon, beta, base

    def score(self, text: str | None) -> float:
        if not self.lexicon.weights:
            return self.base
        z = float(np.dot(self.lexicon.features(text), self.beta[:-1]) + self.beta[-1])
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, z: float = 1.8, least: float = 1.0) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), all
    of which may be learned from. Contradicting labels of an id count as toxic."""
    spark = docs.sparkSession
    tune(spark)
    labels = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    labels = written(labels, "labels")
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    chosen = labels.where("toxic = 1").orderBy(order, "doc_id").limit(per_class).union(labels.where("toxic = 0").orderBy(order, "doc_id").limit(per_class))
    share = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    base = share.get(1, 0) / max(1, sum(share.values()))
    # at most 2 * per_class ids are broadcast, and as many rows learned from
    joined = written(only(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id"), "labelled")
    sample = written(at_most(joined, "toxic", [0, 1], per_class, "toxicity").select("toxic", "text").repartition(24), "sample")
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return Model(Lexicon({}), np.zeros(7), base)
    by_word = sample.mapInArrow(_words_of, "word string, toxic int, context long, n long")
    pairs = by_word.where("toxic = 1").groupBy("word", "context").agg(F.sum("n").alias("n"))
    bad = pairs.groupBy("word").agg(F.least(F.sum("n"), F.count("*")).alias("k1"))
    good = by_word.where("toxic = 0").groupBy("word").agg(F.sum("n").alias("k0"))
    both = bad.where("k1 > 1").join(good, "word", "left").withColumn("k0", F.coalesce("k0", F.lit(0)))
    odds = F.log((F.col("k1") + 0.5) / (n[1] + 1)) - F.log((F.col("k0") + 0.5) / (n[0] + 1))
    error = F.sqrt(1 / (F.col("k1") + 0.5) + 1 / (F.col("k0") + 0.5))
    terms = both.withColumn("odds", odds).where(F.col("odds") - z * error > least).select("word", "odds").collect()
    lexicon = Lexicon({r["word"]: min(5.0, r["odds"]) for r in terms})
    rows = sample.mapInArrow(_features(lexicon), "toxic int, x array<double>").toPandas()
    x, y = np.array(rows["x"].tolist()), rows["toxic"].to_numpy(float)
    weight = np.where(y == 1, share[1] / n[1], share[0] / n[0])
    return Model(lexicon, logistic(x, y, weight), base)


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            s = [model.score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    return run


def _keep(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            yield b.filter(pa.array([model.score(t) < 0.5 for t in b.column("text").to_pylist()], pa.bool_()))

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of ``docs``."""
    tune(docs.sparkSession)
    docs = only(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_score(shared), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that score under 0.5."""
    tune(docs.sparkSession)
    return docs.mapInArrow(_keep(docs.sparkSession.sparkContext.broadcast(model)), docs.schema)


def learnable(labels: DataFrame) -> DataFrame:
    return only(labels, "doc_id", "toxic").where(remainder("doc_id", 5) != 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    model = learn(docs, learnable(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
