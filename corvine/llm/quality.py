"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Model: P(grade <= g | text) = sigmoid(threshold_g - w . x), with one weight
vector shared by all grades and ordered thresholds (each the one before plus a
positive step). x are hashed word features of the text, 2**15 slots, each the
logarithm of its count, scaled to length one, and six shape features: share of
upper case letters, of symbols, of repeated words, of the most frequent word,
the mean word length and the logarithm of the number of words. The
expected grade and the probability of each tail follow for selection.

Training fits up to ``sample_rows`` labelled texts, spread evenly over the grades
as far as there are rows, with the smallest hashes of doc_id (a bound of the
training set, also where many rows share an id); grades are numbers of any scale
with few values; features are made on the executors, and the fit weights rows back
to the grades' shares of all labels. Scoring is one pass without a shuffle.

Defined results: null and empty texts have no features and get the grade of the
thresholds alone; a null rating teaches nothing; without ratings every text has
expected grade null, tail 1 and is selected; with a single grade every text has
that grade; repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm import words
from corvine.llm.common import at_most, only, tune, written
from corvine.llm.language import remainder

SLOTS = 1 << 15
SHAPES = 6
SAMPLE_ROWS = 6000
SYMBOLS = "#*$%&|<>!"


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot, value) of the hashed words, and texts x shapes."""
    h, first = words.hashed(data, offs, fold=True)
    n = np.diff(first)
    texts = np.arange(len(n))
    owner = np.repeat(texts, n)
    key, count = np.unique(owner.astype(np.int64) * SLOTS + (h & np.uint64(SLOTS - 1)).astype(np.int64), return_counts=True)
    text, slot = key // SLOTS, key % SLOTS
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(text, weights=value**2, minlength=len(n)))
    value = value / np.maximum(norm[text], 1e-12)

    def share(table: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(table[data])))
        return (total[offs[1:]] - total[offs[:-1]]) / np.maximum(np.diff(offs), 1)

    upper, symbol = np.zeros(256), np.zeros(256)
    upper[65:91] = 1
    symbol[list(SYMBOLS.encode())] = 1
    distinct = np.bincount(text, minlength=len(n))
    most = np.zeros(len(n))
    np.maximum.at(most, text, count)
    shape = np.column_stack((share(upper), 10 * share(symbol), 1 - distinct / np.maximum(n, 1), most / np.maximum(n, 1), np.diff(offs) / np.maximum(n, 1) / 10, np.log1p(n) / 5))
    shape[n == 0] = 0
    return text, slot, value, shape


class Model:
    def __init__(self, grades: list[float], weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    def tails(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """texts x (grades - 1): P(grade > g) for all grades but the last."""
        text, slot, value, shape = features(data, offs)
        z = np.bincount(text, weights=value * self.weights[slot], minlength=len(offs) - 1) + shape @ self.weights[SLOTS:]
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -30, 30)))


def cuts(raw: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first, then each a positive step on."""
    return np.concatenate((raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))))


def loss(theta: np.ndarray, text: np.ndarray, slot: np.ndarray, value: np.ndarray, shape: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The penalised weighted negative log likelihood and its gradient. ``theta``:
    weights of slots and shapes, then raw thresholds; ``y``: grade numbers."""
    n, lines = len(y), np.arange(len(y))
    w, raw = theta[: SLOTS + SHAPES], theta[SLOTS + SHAPES :]
    k = len(raw)
    z = np.bincount(text, weights=value * w[slot], minlength=n) + shape @ w[SLOTS:]
    c = 1 / (1 + np.exp(np.clip(z[:, None] - cuts(raw)[None, :], -30, 30)))  # P(grade <= g)
    full = np.concatenate((np.zeros((n, 1)), c, np.ones((n, 1))), axis=1)
    p = np.maximum(full[lines, y + 1] - full[lines, y], 1e-9)
    slope = np.concatenate((np.zeros((n, 1)), c * (1 - c), np.zeros((n, 1))), axis=1)
    up, low = slope[lines, y + 1], slope[lines, y]
    dz = weight * (up - low) / p
    dcut = np.zeros(k)
    np.add.at(dcut, np.minimum(y, k - 1), np.where(y < k, -weight * up / p, 0))
    np.add.at(dcut, np.maximum(y - 1, 0), np.where(y > 0, weight * low / p, 0))
    steps = np.exp(raw[1:]) * np.cumsum(dcut[::-1])[::-1][1:]
    grad = np.concatenate((np.bincount(slot, weights=value * dz[text], minlength=SLOTS) + ridge * w[:SLOTS], shape.T @ dz + ridge * w[SLOTS:], [dcut.sum()], steps))
    return float(-(weight * np.log(p)).sum() + ridge / 2 * (w @ w)), grad


def fit(rows: list[tuple], grades: list[float], share: dict[float, float], steps: int = 300, ridge: float = 2e-4, rate: float = 0.1) -> Model:
    """Full-batch Adam on ``loss``. ``rows``: (grade index, slots, values, shape)
    of each text."""
    y = np.array([r[0] for r in rows])
    sizes = [len(r[1]) for r in rows]
    text, slot = np.repeat(np.arange(len(rows)), sizes), np.concatenate([r[1] for r in rows]).astype(np.int64)
    value, shape = np.concatenate([r[2] for r in rows]), np.stack([r[3] for r in rows])
    held = np.bincount(y, minlength=len(grades))
    weight = np.array([share[g] / max(1, held[k]) for k, g in enumerate(grades)])[y]
    weight /= weight.sum()
    below = np.cumsum([share[g] for g in grades])[:-1]
    base = np.log(below / (1 - below))
    theta = np.concatenate((np.zeros(SLOTS + SHAPES), base[:1], np.log(np.maximum(np.diff(base), 1e-3))))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        _, grad = loss(theta, text, slot, value, shape, y, weight, ridge)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(grades, theta[: SLOTS + SHAPES], cuts(theta[SLOTS + SHAPES :]))


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        slots, values, shapes = [], [], []
        for _, _, data, offs in words.each_part(b.column("text")):
            text, slot, value, shape = features(data, offs)
            at = np.searchsorted(text, np.arange(len(offs)))
            for k in range(len(offs) - 1):
                slots.append(slot[at[k] : at[k + 1]].astype(np.int32).tobytes())
                values.append(value[at[k] : at[k + 1]].astype(np.float32).tobytes())
                shapes.append(shape[k].tobytes())
        yield pa.RecordBatch.from_arrays([b.column("grade"), pa.array(slots, pa.binary()), pa.array(values, pa.binary()), pa.array(shapes, pa.binary())], ["grade", "slots", "values", "shape"])


def learn(docs: DataFrame, ratings: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from ``docs`` (doc_id, text) and ``ratings`` (doc_id, grade);
    contradicting ratings of an id count as the smallest."""
    spark = docs.sparkSession
    tune(spark)
    ratings = written(ratings.where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.min("grade").cast("double").alias("grade")), "ratings")
    counts = {r["grade"]: r["count"] for r in ratings.groupBy("grade").count().collect()}
    if not counts:
        return None
    grades = sorted(counts)
    if len(grades) == 1:
        return Model(grades, np.zeros(SLOTS + SHAPES), np.zeros(0))
    chosen = None
    for g in grades:
        own = ratings.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(max(1, sample_rows // len(grades)))
        chosen = own if chosen is None else chosen.union(own)
    # at most sample_rows ids are broadcast, and features of as many rows collected
    joined = written(only(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id"), "labelled")
    sample = at_most(joined, "grade", grades, max(1, sample_rows // len(grades)), "quality").select("grade", "text")
    rows = sample.mapInArrow(_training, "grade double, slots binary, values binary, shape binary").collect()
    if not rows:
        return None
    index = {g: k for k, g in enumerate(grades)}
    held = [(index[r["grade"]], np.frombuffer(r["slots"], np.int32), np.frombuffer(r["values"], np.float32), np.frombuffer(r["shape"], np.float64)) for r in rows]
    total = sum(counts.values())
    return fit(held, grades, {g: n / total for g, n in counts.items()})


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            expected, top = [], []
            for i, j, data, offs in words.each_part(b.column("text")):
                if model is None:
                    expected += [None] * (j - i)
                    top += [1.0] * (j - i)
                    continue
                tail = model.tails(data, offs)
                expected += (model.grades[0] + tail @ np.diff(model.grades)).tolist()
                top += (tail[:, -1] if tail.shape[1] else np.ones(j - i)).tolist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(expected, pa.float64()), pa.array(top, pa.float64())], ["doc_id", "expected_grade", "tail"])

    return run


def rate(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, expected_grade and tail (the probability of the best grade)."""
    tune(docs.sparkSession)
    docs = only(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_score(shared), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, expected_grade double, tail double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held out: rows whose crc32(doc_id as text) mod 5 is 0."""
    docs = only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    ratings = only(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "quality").where(remainder("doc_id", 5) != 0)
    out = rate(docs, learn(docs, ratings.withColumnRenamed("quality", "grade")))
    return out.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "expected_grade", "tail", (F.col("tail") >= 0.5).alias("kept"))
