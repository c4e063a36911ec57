"""Changes of files as a stream that keeps chunk tables current."""

from __future__ import annotations

import os
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvine.functions.languages import scannable, watched
from corvine.operators.changes import apply_events
from corvine.sources import stores
from corvine.sources.files import walk


def relevant(changes: DataFrame) -> DataFrame:
    """Changes that an index follows."""
    return changes.where(watched(F.col("path")) & scannable(F.col("path")))


def follow(changes: DataFrame, folder: str, contents: Callable[[DataFrame], DataFrame], checkpoint: str, every: str | None = "200 milliseconds") -> StreamingQuery:
    """Micro-batches of (path, event, seq) applied to the snapshot in
    ``folder``. ``contents`` gives the current rows of a batch's live paths. The
    last event of a path in a batch counts; each batch writes a whole snapshot and
    then switches to it. A batch that is replayed after a failure writes the same
    state again."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        state = stores.load(batch.sparkSession, folder)
        rows = contents(batch)
        stores.save(apply_events(state if state is not None else rows.limit(0), batch, rows), folder)

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class TreeWatcher:
    """Changes of a tree by comparing its listings.

    A listing is made ``every`` seconds; once two listings in a row agree (the
    debounce: ``quiet`` seconds apart) what differs from the last report goes to
    ``report`` as rows (path, event, seq). Sizes and times tell changed files; what
    they hold is compared by hash when it is indexed."""

    def __init__(self, spark: SparkSession, root: str, report: Callable[[DataFrame], None], every: float = 1.0, quiet: float = 0.2):
        self.spark, self.root, self.report, self.every, self.quiet = spark, root, report, every, quiet
        self._thread: threading.Thread | None = None
        self._stop = threading.Event()
        self._seen: dict[str, tuple[int, int]] = {}
        self._seq = 0

    def start(self) -> bool:
        """False if it runs already or the root is no folder."""
        if self._thread is not None or not os.path.isdir(self.root):
            return False
        self._seen, self._stop = self._listed(), threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()
        return True

    def stop(self) -> None:
        """Reports what is pending; a second call does nothing."""
        thread, self._thread = self._thread, None
        if thread is not None:
            self._stop.set()
            thread.join()
            self.flush()

    def _listed(self) -> dict[str, tuple[int, int]]:
        out = {}
        for path in walk(self.root):
            try:
                s = os.stat(path)
            except OSError:
                continue
            out[path] = (s.st_size, s.st_mtime_ns)
        return out

    def flush(self) -> int:
        """Reports all changes since the last report; their number."""
        now = self._listed()
        events = [(p, "Created" if p not in self._seen else "Modified") for p in sorted(now) if now[p] != self._seen.get(p)]
        events += [(p, "Deleted") for p in sorted(set(self._seen) - set(now))]
        self._seen = now
        if events:
            rows = [(p, e, self._seq + k) for k, (p, e) in enumerate(events)]
            self._seq += len(rows)
            self.report(relevant(self.spark.createDataFrame(rows, "path string, event string, seq long")))
        return len(events)

    def _run(self) -> None:
        while not self._stop.wait(self.every):
            now = self._listed()
            if now == self._seen:
                continue
            while not self._stop.wait(self.quiet):
                before, now = now, self._listed()
                if now == before:
                    break
            if not self._stop.is_set():
                self.flush()
