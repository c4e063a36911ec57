"""Snapshots and changes of file tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_status(old: DataFrame, new: DataFrame) -> DataFrame:
    """H4: (path, status) from two (path, hash) snapshots: unchanged, changed,
    new or removed."""
    both = old.select("path", F.col("hash").alias("old")).join(new.select("path", F.col("hash").alias("new")), "path", "full_outer")
    status = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return both.select("path", status.alias("status"))


def orphans(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks of files that are gone."""
    return chunks.join(files.select("path"), "path", "left_anti")


def replaced(chunks: DataFrame, status: DataFrame) -> DataFrame:
    """Chunks that a re-index replaces."""
    return chunks.join(status.where("status = 'changed'").select("path"), "path", "left_semi")


def first_hashes(chunks: DataFrame) -> DataFrame:
    """A5: one non-empty hash a file; the smallest, so that it is the same on every run."""
    return chunks.where("hash <> ''").groupBy("path").agg(F.min("hash").alias("hash"))


def last_events(events: DataFrame) -> DataFrame:
    """The last event of every path, by ``seq``; sums before it shuffles."""
    last = F.max_by(F.struct("event", "seq"), "seq").alias("last")
    return events.groupBy("path").agg(last).select("path", "last.event", "last.seq")


def action(name: Column) -> Column:
    """What a notification means."""
    return F.when(name == "ADDED", "Created").when(name == "REMOVED", "Deleted").when(name == "RENAMED_OLD", "Renamed").when(name == "RENAMED_NEW", "Created").otherwise("Modified")


def apply_events(state: DataFrame, events: DataFrame, contents: DataFrame) -> DataFrame:
    """Rows of paths with an event go; paths whose last event isn't a
    deletion come back with what ``contents`` holds for them (nothing there: gone)."""
    last = last_events(events)
    kept = state.join(last.select("path"), "path", "left_anti")
    live = contents.join(last.where("event <> 'Deleted'").select("path"), "path", "left_semi")
    return kept.unionByName(live)


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the first in order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
