"""Counts of texts that hold all words of a query."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.session import ship


def _counted(asked: list[tuple[int, list[bytes]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [0] * len(asked)
        for b in batches:
            for text in b.column("text").to_pylist():
                if text is None:
                    continue
                low = text.encode().lower()  # of bytes, A to Z only
                for k, (_, words) in enumerate(asked):
                    for w in words:
                        if w not in low:
                            break
                    else:
                        n[k] += 1
        some = [k for k in range(len(asked)) if n[k]]
        yield pa.RecordBatch.from_arrays([pa.array([asked[k][0] for k in some], pa.int64()), pa.array([n[k] for k in some], pa.int64())], ["item_id", "n"])

    return run


def count_all_words(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """P5: (item_id, n), how many rows of ``texts`` (text) hold every word of each
    query (item_id, text) as a substring, ASCII letters of either case; queries
    without rows are left out, one without words takes all. Queries go to all tasks
    (a benchmark's few hundred); their longest words, the rarest, are tried first."""
    ship(texts.sparkSession)
    asked = [(r["item_id"], sorted(set(r["text"].encode().lower().split()), key=lambda w: (-len(w), w))) for r in queries.where("text is not null").select("item_id", "text").collect()]
    return texts.select("text").mapInArrow(_counted(asked), "item_id long, n long").groupBy("item_id").agg(F.sum("n").alias("n"))
