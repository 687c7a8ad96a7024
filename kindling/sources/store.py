"""Chunk table, file ledger and vector cache as Parquet folders.

A store is a folder with three append-only tables, each partitioned by ``version``:

* ``chunks`` - the chunks of the documents written in that version
* ``stale``  - documents whose chunks in earlier versions no longer count
* ``ledger`` - the files processed in that version, written last

A version counts once its ledger part exists, so readers never see half a write and
a failed write is simply overwritten by the next. Replacing a few documents writes
those documents only; the rest of the table is not touched. One writer at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindling import schemas
from kindling.cluster import TASK_BYTES, broadcast_if_small, hadoop_path, scan_bytes, settle
from kindling.sources.files import open_filesystem

DELETED = "deleted"


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _table(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    return _read(spark, f"{root}/{name}", schemas.with_version(schema))


def last_version(spark: SparkSession, root: str) -> int:
    """The newest complete version; 0 for an empty store. Reads no data columns."""
    return _table(spark, root, "ledger", schemas.LEDGER).agg(F.max("version").alias("v")).first().v or 0


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """The latest row of each file that has not been deleted."""
    rows = _table(spark, root, "ledger", schemas.LEDGER)
    names = [f.name for f in schemas.LEDGER.fields if f.name != "file_path"]
    latest = rows.groupBy("file_path").agg(F.max_by(F.struct(*names), "version").alias("r"))
    return latest.select("file_path", "r.*").filter(F.col("status") != DELETED)


def read_stored(spark: SparkSession, root: str) -> DataFrame:
    """Every live row of the chunk table, with all stored columns and ``version``.

    Only documents that were ever replaced or deleted appear in ``stale``; while that
    list is small the chunks are filtered in place, and shuffled only when it is not.
    """
    version = last_version(spark, root)
    chunks = _table(spark, root, "chunks", schemas.STORED_CHUNKS).filter(F.col("version") <= version)
    return without_stale(spark, root, chunks)


def without_stale(spark: SparkSession, root: str, chunks: DataFrame) -> DataFrame:
    """Rows of ``doc_id, version`` and more, less those that a later version replaced or deleted."""
    stale = _table(spark, root, "stale", schemas.STALE).filter(F.col("version") <= last_version(spark, root))
    if stale.isEmpty():
        return chunks
    cut = stale.groupBy("doc_id").agg(F.max("version").alias("since"))
    return chunks.alias("c").join(
        broadcast_if_small(cut).alias("s"),
        (F.col("c.doc_id") == F.col("s.doc_id")) & (F.col("c.version") < F.col("s.since")),
        "left_anti",
    )


def read_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Live chunks: ``doc_id, chunk_idx, text, embedding, metadata``."""
    live = read_stored(spark, root).filter(F.col("chunk_idx").isNotNull())
    return live.select("doc_id", "chunk_idx", "text", "embedding", "metadata")


def write_version(spark: SparkSession, root: str, chunks: DataFrame, after: Snapshot | None = None) -> int:
    """Publish the given documents as a new version, replacing earlier ones; returns it.

    ``chunks`` has the columns of ``STORED_CHUNKS`` and all chunks of each document.
    They are computed once: the ledger is read back from what was written. ``after`` tells
    what the store holds, so that it is not looked up.
    """
    version = (after.version if after else last_version(spark, root)) + 1
    _commit(spark, root, version, _write_chunks(spark, chunks, f"{root}/chunks/version={version}"), after)
    return version


def _write_chunks(spark: SparkSession, chunks: DataFrame, path: str, few: bool = False) -> DataFrame:
    """Write chunks and return the ledger's rows for them; ``few``: of a micro-batch."""
    chunks.select(*schemas.STORED_CHUNKS.fieldNames()).write.mode("overwrite").parquet(path)
    written = spark.read.schema(schemas.STORED_CHUNKS).parquet(path)
    if few and scan_bytes(written) <= TASK_BYTES:
        written = written.coalesce(1)  # one task tells the files apart without a shuffle
    # The time of writing, as the current time would be a constant, for which each version had its own code compiled.
    told = written.select("doc_id", "content_hash", "file_size", "_metadata.file_modification_time") if few else written
    when = F.max("file_modification_time") if few else F.current_timestamp()
    entries = told.groupBy("doc_id", "content_hash", "file_size").agg(when.alias("processed_at"))
    return entries.select(F.col("doc_id").alias("file_path"), "content_hash", "file_size", "processed_at", F.lit("processed").alias("status"))


def prepare_version(spark: SparkSession, root: str, chunks: DataFrame, after: Snapshot) -> str:
    """Write all that ``write_version`` would, but to a folder of its own in the store, which no reader looks at.

    ``publish_prepared`` makes it a version. Many may be prepared at once.
    """
    folder = f"{root}/prepared/{uuid.uuid4().hex}"
    entries = _write_chunks(spark, chunks, f"{folder}/chunks", few=True)
    if after.ledger is not None:
        _replaced(entries, after.ledger).write.parquet(f"{folder}/stale")
    entries.write.parquet(f"{folder}/ledger")
    return folder


def publish_prepared(spark: SparkSession, root: str, folder: str, after: Snapshot) -> int:
    """Make what was prepared against the ledger of ``after`` the next version: folders are renamed, the ledger's last."""
    version = after.version + 1
    for name in ("chunks", "stale", "ledger"):
        made, system = hadoop_path(spark, f"{folder}/{name}")
        target, _ = hadoop_path(spark, f"{root}/{name}/version={version}")
        system.delete(target, True)  # of a version that was never finished
        if name != "stale" or after.ledger is not None:
            system.mkdirs(target.getParent())
            if not system.rename(made, target):
                raise OSError(f"cannot rename {made} to {target}")
    system.delete(hadoop_path(spark, folder)[0], True)
    return version


def delete_documents(spark: SparkSession, root: str, doc_ids: DataFrame) -> int:
    """Remove the documents named in column ``doc_id``; returns the new version."""
    version = last_version(spark, root) + 1
    spark.createDataFrame([], schemas.STORED_CHUNKS).write.mode("overwrite").parquet(f"{root}/chunks/version={version}")
    rows = doc_ids.select(
        F.col("doc_id").alias("file_path"),
        F.lit(None).cast("string").alias("content_hash"),
        F.lit(None).cast("long").alias("file_size"),
        F.current_timestamp().alias("processed_at"),
        F.lit(DELETED).alias("status"),
    ).distinct()
    _commit(spark, root, version, rows)
    return version


def _commit(spark: SparkSession, root: str, version: int, entries: DataFrame, after: Snapshot | None = None) -> None:
    stale = f"{root}/stale/version={version}"
    if not (after and after.ledger is None and _children(stale) == []):
        known = (after and after.ledger) or read_ledger(spark, root)
        _replaced(entries, known).write.mode("overwrite").parquet(stale)
    entries.write.mode("overwrite").parquet(f"{root}/ledger/version={version}")


def _replaced(entries: DataFrame, known: DataFrame) -> DataFrame:
    replaced = entries.select("file_path").join(known.select("file_path"), "file_path", "left_semi")
    return replaced.select(F.col("file_path").alias("doc_id"))


def _children(folder: str) -> list[tuple[str, int]] | None:
    """Names and times of what is in a folder, none if it is missing; None if only Spark can read there."""
    try:
        system, inner = open_filesystem(folder)
        found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    except (OSError, ValueError, NotImplementedError):
        return None
    return sorted((f.base_name, f.mtime_ns or 0) for f in found)


@dataclass
class Snapshot:
    """What a store holds: its newest version, and its ledger, or None if that is empty."""

    version: int
    ledger: DataFrame | None


class Writer:
    """For one that writes many versions of different documents: looks a store up again only after others have written.

    The ledger of ``snapshot`` has no files that were published through this writer since it was taken.
    """

    def __init__(self, root: str):
        self.root, self._held, self._marks = root, None, None

    def snapshot(self, spark: SparkSession) -> Snapshot:
        marks = _children(f"{self.root}/ledger")
        if self._held is None or marks is None or marks != self._marks:
            ledger = settle(read_ledger(spark, self.root), "known")
            self._held = Snapshot(last_version(spark, self.root), None if ledger.isEmpty() else ledger)
        return self._held

    def wrote(self, version: int) -> None:
        """To be called after a version was published with the last snapshot."""
        self._held.version, self._marks = version, _children(f"{self.root}/ledger")


def compact_into(spark: SparkSession, root: str, new_root: str) -> int:
    """Copy the live rows to a new, empty store, leaving replaced chunks behind."""
    if last_version(spark, new_root):
        raise ValueError(f"{new_root} already holds a store")
    return write_version(spark, new_root, read_stored(spark, root))


def truncate(spark: SparkSession, root: str) -> None:
    """Empty the store. The index goes first, as versions start again, then the ledger, so what remains is already invisible."""
    spark.createDataFrame([], schemas.INDEXED).write.mode("overwrite").parquet(f"{root}/index/versions")
    for name, schema in (("ledger", schemas.LEDGER), ("stale", schemas.STALE), ("chunks", schemas.STORED_CHUNKS)):
        empty = spark.createDataFrame([], schemas.with_version(schema))
        empty.write.mode("overwrite").partitionBy("version").parquet(f"{root}/{name}")


def indexed_version(spark: SparkSession, root: str) -> int | None:
    """The newest version that an index of the store covers; None without an index."""
    return _read(spark, f"{root}/index/versions", schemas.INDEXED).agg(F.max("indexed").alias("v")).first().v


def append_rows(df: DataFrame, path: str) -> None:
    """Append records to a plain Parquet table."""
    df.write.mode("append").parquet(path)


def read_rows(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All records of a plain Parquet table; with a schema, a missing table is empty."""
    return spark.read.parquet(path) if schema is None else _read(spark, path, schema)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Saved vectors ``model, text_hash, embedding``."""
    return _read(spark, path, schemas.VECTOR_CACHE)


def save_vectors(vectors: DataFrame, path: str) -> None:
    append_rows(vectors.select(*schemas.VECTOR_CACHE.fieldNames()), path)
