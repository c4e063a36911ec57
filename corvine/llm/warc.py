"""Deterministic sharded WARC files.

Pages are put into shards by ranges of page_id that hold about ``shard_bytes``
of payload each (more beyond 2**20 shards, so that their bounds are 8 MB at most);
the ranges come from exact byte sums over ids, so they depend on the pages alone.
Pages without an id are dealt to all shards by their digests. Spark then deals
ranges of shards to tasks. A shard is sorted and written as gzip members, one a record, and
rolls to a new file when the file has ``file_bytes`` compressed bytes. Headers
and digests are made anew: record ids are name-based UUIDs, the date is a
parameter, gzip headers hold no time. So reruns give the same bytes.

Of records with equal payloads of at least ``min_bytes`` the one with the smallest
page_id is a response and the others are revisits of it. Equality is by SHA-1 and
length; groups are summed before they are shuffled, and only revisits carry a row
of their own, merged in front of their page when the shard is sorted, so that
payloads are shuffled once.

Commit: every task attempt writes under a temporary name of its own and reports
its files; only the files that the finished job reports are renamed, by tasks
that can be run again; the manifest (one row a file, with its SHA-1) is written
last, and readers go by the manifest. Lost tasks leave temporary files that no
manifest names.

Defined results: a null html is an empty payload, a null url an empty target; a
null page_id is no smaller than any other and never revisited to unless all ids
of its payload are null (then all are responses); rows that repeat the smallest
page_id of a payload are all responses, and repeated rows are records each; rows
of one page_id are in one shard; an empty table gives no file and no row;
other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm.common import only, run_folder, tune, written

SHARD_BYTES = 16 << 20
MAX_SHARDS = 1 << 20
FILE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:corvine:warc")
_FILES = "shard int, part int, temporary string, name string, records long, first_id long, last_id long, bytes long, sha1 string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record: a response with its payload, or a revisit without."""
    digest = base32_sha1(payload)
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = lambda i: f"<urn:uuid:{uuid.uuid5(_SPACE, str(i))}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {''.join((url or '').splitlines())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    return gzip.compress(data, 6, mtime=0)


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record, a member at a time."""
    buffer = stream.read(1 << 20)
    while buffer:
        unzip, out = zlib.decompressobj(31), []
        while not unzip.eof:
            if not buffer:
                raise EOFError("the file ends inside a record")
            out.append(unzip.decompress(buffer))
            buffer = unzip.unused_data if unzip.eof else stream.read(1 << 20)
        if not buffer:
            buffer = stream.read(1 << 20)
        head, _, rest = b"".join(out).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(fields["Content-Length"])
        if rest[size:] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(rest[:size])}":
            raise ValueError("a record's block doesn't match its header")
        yield fields, rest[:size]


def filesystem(folder: str):
    """The store that holds ``folder`` and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _write(folder: str, file_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        attempt, out, done = uuid.uuid4().hex, None, []
        shard = part = page = None
        refers: dict = {}

        def finish() -> None:
            out.close()
            done.append({"shard": shard, "part": part, "temporary": temporary, "name": f"pages-{shard:06d}-{part:04d}.warc.gz", "records": count, "first_id": first, "last_id": page, "bytes": size, "sha1": sha.hexdigest()})

        for b in batches:
            for s, page_id, url, html, to in zip(*(b.column(c).to_pylist() for c in ("shard", "page_id", "url", "html", "refers_to")), strict=True):
                if to is not None:
                    refers = {page_id: {**refers.get(page_id, {}), html: to}}
                    continue
                if out is None or s != shard or size >= file_bytes:
                    if out is not None:
                        finish()
                    part = part + 1 if s == shard else 0
                    shard, first, count, size, sha = s, page_id, 0, 0, hashlib.sha1()
                    temporary = f"_temporary-{attempt}-{shard:06d}-{part:04d}"
                    out = store.open_output_stream(f"{base}/{temporary}", compression=None)
                payload = (html or "").encode()
                to = refers.get(page_id, {}).get(hashlib.sha1(payload).hexdigest())
                data = member(record(page_id, url, payload, to, date))
                out.write(data)
                sha.update(data)
                count, size, page = count + 1, size + len(data), page_id
        if out is not None:
            finish()
        schema = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("temporary", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())])
        yield pa.RecordBatch.from_pylist(done, schema=schema)

    return run


def _rename(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = filesystem(folder)
        for b in batches:
            for old, new in zip(b.column("temporary").to_pylist(), b.column("name").to_pylist(), strict=True):
                if store.get_file_info(f"{base}/{old}").type == fs.FileType.File:
                    store.move(f"{base}/{old}", f"{base}/{new}")
                elif store.get_file_info(f"{base}/{new}").type != fs.FileType.File:
                    raise FileNotFoundError(f"{base}/{new}")
            yield b

    return run


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        for b in batches:
            for name in b.column("name").to_pylist():
                rows = []
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for head, block in records(stream):
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if head["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if base32_sha1(payload) != digest or len(payload) != int(head["X-Payload-Length"]):
                                raise ValueError("a payload doesn't match its header")
                        rows.append((int(head["X-Page-ID"]) if head["X-Page-ID"] else None, int(head["X-Payload-Length"]), digest, head["WARC-Type"], int(head["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in head else None))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)

    return run


def _shards(sizes: DataFrame, shard_bytes: int) -> list[int]:
    """Largest ids of all shards but the last: ranges of about equal bytes.

    Byte sums over 4096 equal ranges of ids go to the driver; ranges that alone
    are over two shards are divided again."""
    cuts, todo = [], [sizes.where("page_id is not null").agg(F.min("page_id"), F.max("page_id")).first()]
    while todo:
        low, high = todo.pop(0)
        if low is None:
            break
        step = max(1, -(-(high - low + 1) // 4096))
        part = sizes.where(F.col("page_id").between(low, high)).groupBy(((F.col("page_id") - low) / step).cast("long").alias("bin")).agg(F.sum("bytes").alias("bytes"))
        held = 0
        for r in sorted(part.collect()):  # 4096 rows at most
            start, end = low + r["bin"] * step, min(high, low + (r["bin"] + 1) * step - 1)
            if r["bytes"] > 2 * shard_bytes and end > start:
                todo.append((start, end))
            held += r["bytes"]
            if held >= shard_bytes and end < high:
                cuts.append(end)
                held = 0
    return sorted(set(cuts))


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, min_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder``; the manifest."""
    tune(pages.sparkSession)
    pages = only(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    html = F.coalesce("html", F.lit(""))
    sizes = written(pages.select("page_id", F.sha1(html).alias("sha"), F.octet_length(html).cast("long").alias("bytes")), "sizes")
    groups = sizes.where(F.col("bytes") >= min_bytes).groupBy("sha", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("k")).where("k > 1").select("sha", "bytes", "first")
    again = sizes.join(groups, ["sha", "bytes"]).where("page_id <> first").select("page_id", F.lit(None).cast("string").alias("url"), F.col("sha").alias("html"), F.col("first").alias("refers_to")).distinct()
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    cuts = np.array(_shards(sizes, max(shard_bytes, -(-total // MAX_SHARDS))), np.int64)
    columns = ("page_id", "url", "html", "refers_to")
    rows = only(pages.withColumn("refers_to", F.lit(None).cast("long")).unionByName(again), *columns)
    shared = pages.sparkSession.sparkContext.broadcast(cuts)
    rows = rows.mapInArrow(_dealt(shared), "shard int, page_id long, url string, html string, refers_to long")
    dealt = rows.repartitionByRange(len(cuts) + 1, "shard").sortWithinPartitions("shard", F.asc_nulls_first("page_id"), F.desc_nulls_last("refers_to"), "html", "url")
    found = written(dealt.mapInArrow(_write(folder, file_bytes, date), _FILES), "", f"{folder}/_files")
    return written(found.repartition(24, "name").mapInArrow(_rename(folder), _FILES), "", f"{folder}/_manifest")


def _dealt(shared):
    """The shard of each row: the number of bounds below its page_id, or without
    one a shard by its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value
        for b in batches:
            ids = b.column("page_id")
            shard = np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int32)
            for k in np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False)).tolist():
                shard[k] = zlib.crc32((b.column("html")[k].as_py() or "").encode()) % (len(cuts) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *b.columns], ["shard", *b.schema.names])

    return run


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every record that the manifest of ``folder`` names, checked against its
    headers: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    tune(spark)
    manifest = spark.read.parquet(f"{folder}/_manifest").select("name")
    return manifest.repartition(24, "name").mapInArrow(_read(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = run_folder(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_warc(spark, folder)


OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
h AS (SELECT *, sha1(html) AS hex FROM p),
b AS (SELECT page_id, i, list_sum(list_transform(range(8), lambda k: ('0x' || hex[i * 10 + k + 1])::BIGINT << (36 - 4 * k)::BIGINT)) +
             0 AS high, ('0x' || hex[i * 10 + 9 : i * 10 + 10])::BIGINT AS low
      FROM h, (SELECT unnest(range(4)) AS i)),
d AS (SELECT page_id, string_agg(s, '' ORDER BY i) AS payload_digest
      FROM (SELECT page_id, i, array_to_string(list_transform(range(8), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((high + low) >> (35 - 5 * k)::BIGINT) & 31)::INT, 1)), '') AS s FROM b)
      GROUP BY page_id)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM h JOIN d USING (page_id)
"""
