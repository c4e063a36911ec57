"""Session settings, shared tables and distributed stream positions."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words in every operator of this subpackage (fixed values).
SEPARATORS = "\x20\x09-\x0d"
WORD = r"[^\x20\x09-\x0D]+"

_runs: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests, local runs) a temporary folder
    is used, and only with a local master.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _runs.setdefault("root", "file://" + tempfile.mkdtemp(prefix="corvine-"))


def run_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one; removed when the driver ends."""
    app = spark.sparkContext.applicationId
    base = f"{shared_root(spark)}/corvine-{app}"
    if _runs.get("app") != app:
        _runs["app"] = app
        atexit.register(_remove, spark, base)
    return f"{base}/{label}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it is computed once,
    its lineage is cut, and losing an executor loses none of it."""
    spark = df.sparkSession
    path = folder or run_folder(spark, label)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, records: int):
    """Rows per Arrow batch while a plan runs inside the block."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(records))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that their
    Python workers can import it wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if _runs.get("shipped") != app:
        _runs["shipped"] = app
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="corvine-code-")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/corvine", "zip", package.parent, package.name))


def tune(spark: SparkSession) -> None:
    """Arrow batches of whole texts stay near 4 MB, however long the texts, as
    far as the session has no sizes of its own."""
    ship(spark)
    for key, default, value in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", str((1 << 31) - 1), str(4 << 20))):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key).removesuffix("b") == default:
            spark.conf.set(key, value)


def give_back() -> None:
    """Hand memory that a Python worker has freed back to the system, so that idle
    workers and later stages don't keep the largest batch's pages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def only(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns of a table that may have any others as well."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def at_most(rows: DataFrame, column: str, values: list, n: int, label: str) -> DataFrame:
    """Up to ``n`` rows of ``rows`` (a written table) of each value of ``column``:
    those with the smallest hashes of doc_id and text, however many rows repeat
    an id."""
    out = None
    for k, v in enumerate(values):
        own = rows.where(F.col(column) == v).orderBy(F.xxhash64("doc_id", "text", F.lit(label)), "doc_id").limit(n)
        out = own if k == 0 else out.union(own)
    return out


def source_key(source: Column) -> Column:
    """A key that is never null and sorts as code points with null last."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("~"))


def joined_small(big: DataFrame, small: DataFrame, key: str, rows: int, limit: int = 100_000) -> DataFrame:
    """Inner join with a table of one row per ``key``.

    ``rows`` is the counted size of ``small``. Up to ``limit`` rows it is
    broadcast; beyond that both sides are salted, so that a hot key is dealt
    to 16 tasks.
    """
    if rows <= limit:
        return big.join(F.broadcast(small), key)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    dealt = big.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(16)).cast("int"))
    return dealt.join(salted, [key, "_salt"]).drop("_salt")


def stream_starts(df: DataFrame, key: str, order: str, size: str, stats: DataFrame, rows: int, per_bucket: int = 4096) -> DataFrame:
    """Each row's start in its key's stream, ``size`` long, in the order of the
    hexadecimal string ``order``.

    A key may hold any share of the rows: rows are dealt to buckets by leading
    digits of ``order`` (about ``per_bucket`` rows each), summed within a
    bucket, and shifted by the sum of the buckets before. No task sorts more
    than a bucket; rows of one ``order`` are in one, so it should differ between
    rows. ``stats`` has ``key`` and ``n_rows``; the result has the
    columns of ``stats`` as well.
    """
    span = 1 << 32
    wide = joined_small(df, stats, key, rows)
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / per_bucket)).cast("double")
    digits = F.conv(F.substring(order, 1, 8), 16, 10).cast("double")
    wide = wide.withColumn("_bucket", F.floor(digits * buckets / span))
    sums = wide.groupBy(key, "_bucket").agg(F.sum(size).alias("_sum"))
    # one row per bucket: a window over them is per_bucket times smaller than the table
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_bucket").orderBy(order, "_rid").rowsBetween(Window.unboundedPreceding, -1)
    wide = wide.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return wide.join(sums, [key, "_bucket"]).withColumn("start", F.col("_before") + F.col("_inside")).drop("_before", "_inside", "_bucket")
