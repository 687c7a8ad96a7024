"""Explicit schemas of the stored tables."""

from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType())

# One row per text window. A file without text keeps one row whose chunk_idx is
# null, so the ledger can be derived from the very bytes that were chunked.
STORED_CHUNKS = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("chunk_idx", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("embedding", VECTOR),
        T.StructField("content_hash", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

LEDGER = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("processed_at", T.TimestampType()),
        T.StructField("status", T.StringType()),
    ]
)

STALE = T.StructType([T.StructField("doc_id", T.StringType())])

VECTOR_CACHE = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("text_hash", T.StringType()),
        T.StructField("embedding", VECTOR),
    ]
)

FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)

# Versions that an index of a store covers.
INDEXED = T.StructType([T.StructField("indexed", T.IntegerType())])


def with_version(schema: T.StructType) -> T.StructType:
    """The stored form of a table: its columns plus the partition column."""
    return T.StructType(schema.fields + [T.StructField("version", T.IntegerType())])
