"""Project trees as (path, content) rows."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions.languages import PRUNED, SCANNED
from corvine.session import ship


def walk(root: str, skip: tuple[str, ...] = tuple(PRUNED)) -> list[str]:
    """Sorted paths of wanted files; pruned and unreadable folders are
    not entered. Spark's file sources pass over names that start with ``_`` or
    ``.``, so trees are walked here and read by the executors."""
    out, pruned, wanted = [], set(skip), set(SCANNED)
    for folder, folders, names in os.walk(root, onerror=lambda _: None):
        folders[:] = sorted(d for d in folders if d not in pruned)
        for name in names:
            path = os.path.join(folder, name)
            if os.path.splitext(name)[1].lower() in wanted and os.path.isfile(path):
                out.append(path.replace(os.sep, "/"))
    return sorted(out)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for path in b["path"]:
            try:
                with open(path, "rb") as f:
                    data = f.read()
            except OSError:
                continue
            if data:
                rows.append((path, data.decode("utf-8", "replace"), data))
        yield pd.DataFrame(rows, columns=["path", "content", "bytes"])


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, file_content_hash) of a tree on a file system that all
    executors mount; empty and unreadable files have no row (S4)."""
    ship(spark)
    paths = walk(root)
    if not paths:
        return spark.createDataFrame([], "path string, content string, file_content_hash string")
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), spark.sparkContext.defaultParallelism)))
    read = listed.mapInPandas(_read, "path string, content string, bytes binary")
    return read.select("path", "content", F.sha2("bytes", 256).substr(1, 16).alias("file_content_hash"))


#: How a block starts in each language of the derived corpus.
HEADERS = {
    "py": "def {name}(q):",
    "js": "function {name}(q) {{",
    "rs": "fn {name}(q: i64) -> i64 {{",
    "go": "func {name}(q int) int {{",
    "rb": "def {name}(q)",
    "java": "    public int {name}(int q) {{",
    "cs": "    public static int {name}(int q) {{",
    "cpp": "static int {name}(int q) {{",
    "xyz": "{name}",
}


def code_corpus(lineitem: DataFrame, ext: str) -> DataFrame:
    """(path, content): a source file for every order, a block for every line
    item, of a size that differs from block to block."""
    before, after = HEADERS[ext].format(name="\0").split("\0")

    def block(x: Column) -> Column:
        body = F.repeat(F.concat(F.lit("    total = q * "), x["l_partkey"].cast("string"), F.lit("\n")), (x["l_suppkey"] % 13).cast("int"))
        return F.concat(F.lit(f"{before}item_"), x["l_linenumber"].cast("string"), F.lit(f"{after}\n"), body, F.when(x["l_linenumber"] % 3 == 0, "    value = part.lookup(total, region)\n" * 70).otherwise(""), F.lit("\n"))

    # orders are dealt and grouped while they are numbers: the text made of them is twenty times larger
    tasks = int(lineitem.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    items = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition(tasks, "l_orderkey")
    files = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("b"))
    text = F.concat(F.lit("# order\n\n"), F.array_join(F.transform("b", block), ""))
    return files.select(F.concat(F.lit("src/order_"), F.col("l_orderkey").cast("string"), F.lit(f".{ext}")).alias("path"), text.alias("content"))
