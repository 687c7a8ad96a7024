"""Counts and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ingest_counts(chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks, and chunks without a vector."""
    per_doc = chunks.groupBy("doc_id").agg(
        F.count("chunk_idx").alias("chunks"), F.count_if(F.col("embedding").isNull() & F.col("chunk_idx").isNotNull()).alias("failed")
    )
    return per_doc.agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"),
    )


def chunks_per_document(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))


def dimension_range(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: smallest and largest dimension and the number of vectors."""
    size = F.size(vector)
    usable = vectors.filter(F.col(vector).isNotNull())
    return usable.agg(F.min(size).alias("min_dim"), F.max(size).alias("max_dim"), F.count(F.lit(1)).alias("n_vectors"))


def dimension(vectors: DataFrame, vector: str = "embedding") -> int:
    """The one dimension all vectors share; an error when they differ or none exists."""
    seen = dimension_range(vectors, vector).first()
    if seen.min_dim is None or seen.min_dim != seen.max_dim:
        raise ValueError(f"vectors need one common dimension, found {seen.min_dim} to {seen.max_dim}")
    return seen.min_dim


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count; empty when unique."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)
