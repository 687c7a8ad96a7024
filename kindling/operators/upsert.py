"""Decide what is new, and replace rows by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kindling.cluster import BROADCAST_BYTES, byte_size, settle
from kindling.operators.joins import anti_join, semi_join

FILE_KEY = ["file_path", "content_hash"]


def pending(files: DataFrame, ledger: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Files whose pair of path and content hash the ledger does not hold.

    With a ledger that fits a broadcast, file contents stay in the task that read
    them. With a larger one only the pairs are shuffled; the outcome is written down
    and used to pick the files, so the contents are shuffled in neither case unless
    the list of changed files is itself too large to broadcast.
    """
    known = ledger.select(*FILE_KEY)
    if byte_size(known) <= max_bytes:
        return files.join(F.broadcast(known), FILE_KEY, "left_anti")
    changed = settle(files.select(*FILE_KEY).join(known, FILE_KEY, "left_anti"), "changed")
    return semi_join(files, changed, FILE_KEY, max_bytes)


def upsert_ledger(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """Insert or replace ledger rows by ``file_path``.

    Of several new rows for one path the latest ``processed_at`` counts, then the
    largest content hash.
    """
    order = W.partitionBy("file_path").orderBy(F.desc("processed_at"), F.desc("content_hash"))
    latest = entries.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") == 1).drop("_n")
    return anti_join(ledger, latest, ["file_path"]).unionByName(latest)


def replace_documents(chunks: DataFrame, replaced: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """Drop every chunk of the documents in ``replaced`` and add the new chunks.

    A document listed in ``replaced`` without new chunks is deleted.
    """
    return anti_join(chunks, replaced, ["doc_id"]).unionByName(new_chunks)
