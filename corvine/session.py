"""What the executors need of the driver."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application, so that their
    Python workers can import it wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="corvine-engine-")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/corvine_engine", "zip", package.parent, package.name))


def tune(spark: SparkSession) -> None:
    """Arrow batches of whole texts stay near 4 MB, however long the texts, as far
    as the session has no sizes of its own."""
    for key, default, value in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", str((1 << 31) - 1), str(4 << 20))):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key).removesuffix("b") == default:
            spark.conf.set(key, value)
