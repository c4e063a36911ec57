"""Row types of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.StringType())])

CHUNK = T.StructType(
    [
        T.StructField("source_text", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("language", T.StringType()),
        T.StructField("symbol_name", T.StringType()),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("file_content_hash", T.StringType()),
    ]
)

SESSION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("key_files", T.ArrayType(T.StringType())),
        T.StructField("key_decisions", T.ArrayType(T.StringType())),
    ]
)

VECTOR = T.StructType([T.StructField("project", T.StringType()), T.StructField("chunk_id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])

CHANGE = T.StructType([T.StructField("path", T.StringType()), T.StructField("event", T.StringType()), T.StructField("seq", T.LongType())])
EVENTS = ("Created", "Modified", "Deleted", "Renamed")
