"""Intervals of captured definitions: (path, start, end), end exclusive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_intervals(rows: DataFrame) -> DataFrame:
    """C11."""
    return rows.dropDuplicates(["path", "start", "end"])


def leaves(rows: DataFrame) -> DataFrame:
    """Distinct intervals with no other inside them.

    One window instead of a theta join: in the order of start, then of longer
    first, an interval holds another exactly if the least end of those after it
    is not past its own end (those start no earlier)."""
    rows = distinct_intervals(rows)
    after = Window.partitionBy("path").orderBy("start", F.desc("end")).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("_least", F.min("end").over(after)).where(F.col("_least").isNull() | (F.col("_least") > F.col("end"))).drop("_least")


def gaps(leaf: DataFrame) -> DataFrame:
    """What lies between leaves of a path, (path, start, end)."""
    order = Window.partitionBy("path").orderBy("start", "end")
    covered = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return leaf.withColumn("_to", covered).where(F.col("start") > F.col("_to")).select("path", F.col("_to").alias("start"), F.col("start").alias("end"))
