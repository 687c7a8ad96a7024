"""File scans, the per-file visitor, and a writer of file trees.

A tree is listed folder by folder by the tasks and its listing is a table, as Spark's own
listing holds every file of it in the driver. Spark's listing leaves out files of zero bytes
and hidden names, in batch and in streams; so does this one. Trees that Arrow cannot
open, and patterns that only Hadoop knows, are left to Spark.
"""

from __future__ import annotations

import fnmatch
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kindling import schemas
from kindling.cluster import TASK_BYTES, gather, hadoop_path, new_folder, settle

LOG_GLOB = "*.log"

# Ingest handles a file as one row up to this size and splits larger ones.
MAX_FILE_BYTES = 1 << 30

_READ_BYTES = 4 << 20

# Contents leave a task in batches of about this size, or one file.
_BATCH_BYTES = 16 << 20

# A task is given about this many files at most, as opening one takes longer than reading a few KB.
_TASK_FILES = 4096

_LISTED = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("parent_dir", T.StringType()),
        T.StructField("modified_ms", T.LongType()),
        T.StructField("file_size", T.LongType()),
    ]
)


def _columns(raw: DataFrame, content: bool) -> DataFrame:
    path = F.col("_metadata.file_path")
    kept = [
        path.alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.regexp_replace(path, "/[^/]*$", "").alias("parent_dir"),
        F.col("modificationTime").alias("modified_at"),
        F.col("length").alias("file_size"),
    ]
    return raw.select(*kept, *(["content"] if content else []))


def _reader(reader, glob: str | None):
    reader = reader.format("binaryFile").option("recursiveFileLookup", "true")
    return reader if glob is None else reader.option("pathGlobFilter", glob)


def list_files(spark: SparkSession, root: str, glob: str | None = LOG_GLOB) -> DataFrame:
    """Files below ``root``: path, name, parent folder, time and size. Contents stay unread.

    ``glob`` matches the file name, case-sensitive; None takes every file. The listing is
    written down: it is of the time of the call, and dealt out evenly.
    """
    found = _walk_root(spark, root, glob)
    if found is None:
        return gather(_columns(_reader(spark.read, glob).load(root), content=False))
    listed = _walk(spark, *found, glob)
    size = listed.agg(F.sum("file_size").alias("bytes"), F.count(F.lit(1)).alias("files")).first()
    cores = spark.sparkContext.defaultParallelism
    tasks = max(cores * 2, -(-(size.bytes or 0) // TASK_BYTES), -(-size.files // _TASK_FILES))
    dealt = listed.select(
        "file_path", "file_name", "parent_dir", F.timestamp_millis("modified_ms").alias("modified_at"), "file_size"
    )
    return dealt.repartition(int(min(tasks, max(size.files, 1))), "file_path")


def _walk_root(spark: SparkSession, root: str, glob: str | None) -> tuple[str, str] | None:
    """URI and inner path of a folder that tasks can list; None leaves it to Spark."""
    if re.search(r"[\[\]{}*?\\^]", root) or (glob is not None and re.search(r"[\[\]{}\\^]", glob)):
        return None
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    local = root.startswith("file:")
    if not local and "://" not in root and not default.startswith("file:"):
        return None
    try:
        # Spark takes the text of a path as it is, so nothing in it is an escape.
        system, inner = (fs.LocalFileSystem(), re.sub("^file:(//)?", "", root)) if local else open_filesystem(root)
        info = system.get_file_info(inner)
    except (OSError, ValueError, NotImplementedError):
        return None
    if info.type != fs.FileType.Directory or not (inner.startswith("/") or "://" in root):
        return None
    if isinstance(system, fs.LocalFileSystem):
        inner = re.sub("/+", "/", inner).rstrip("/")
        return "file:" + _escaped(inner), inner
    return root.rstrip("/"), inner.rstrip("/")


def _escaped(path: str) -> str:
    """A path as in the URIs that Spark gives: all but ASCII signs of no meaning and other letters is quoted."""
    return re.sub(r"[^A-Za-z0-9\-_.!~*'(),;:$&+=/@\u00a1-\U0010ffff]|[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", lambda m: quote(m[0], safe=""), path)


def _hidden(name: str, is_folder: bool) -> bool:
    """Names that Spark's listing leaves out."""
    if is_folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _walk(spark: SparkSession, uri: str, inner: str, glob: str | None) -> DataFrame:
    """All files below a folder, written down level by level; a task lists the folders it is given."""
    kind = T.StructType([T.StructField("is_folder", T.BooleanType()), *_LISTED.fields])
    names, base = kind.fieldNames(), len(inner)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in kind.fields])
    wanted = re.compile(fnmatch.translate(glob)).match if glob is not None else lambda _name: True

    def children(folder: str) -> Iterator[tuple]:
        system, _ = open_filesystem(uri)
        parent = uri + _escaped(folder[base:])
        for info in system.get_file_info(fs.FileSelector(folder or "/")):
            name = info.base_name
            if _hidden(name, info.type == fs.FileType.Directory):
                continue
            if info.type == fs.FileType.Directory:
                yield True, f"{folder}/{name}", name, parent, None, None
            elif info.type == fs.FileType.File and info.size and wanted(name):
                yield False, f"{parent}/{_escaped(name)}", _escaped(name), parent, info.mtime_ns // 1_000_000, info.size

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for folder in batch.column("file_path").to_pylist():
                for row in children(folder):
                    rows.append(row)
                    if len(rows) == 8192:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], arrow)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], arrow)

    path, level = new_folder(spark, "listing"), 0
    folders = spark.createDataFrame([(inner,)], "file_path string")
    while True:
        folders.mapInArrow(visit, kind).write.parquet(f"{path}/level={level}")
        found = spark.read.schema(kind).parquet(f"{path}/level={level}").filter("is_folder")
        n = found.count()
        if not n:
            break
        folders, level = found.select("file_path").repartition(min(n, spark.sparkContext.defaultParallelism * 4)), level + 1
    return spark.read.schema(kind).parquet(path).filter("not is_folder").select(*_LISTED.fieldNames())


def first_per_directory(listing: DataFrame, n: int) -> DataFrame:
    """The first ``n`` files of each folder by path.

    Every task keeps only ``n`` per folder before the shuffle, so a folder with most
    of the files is no burden.
    """
    order = W.partitionBy("parent_dir").orderBy("file_path")
    return listing.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= n).drop("_place")


def scan_files(
    spark: SparkSession,
    root: str,
    glob: str | None = LOG_GLOB,
    max_files_per_dir: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Files with their bytes in ``content``.

    With ``max_bytes`` larger files are left out and not opened; the caller must
    handle them. Without it Spark stops with an error at a file of 2 GB or more.
    With ``max_files_per_dir`` files are chosen from the listing and only those opened.
    """
    listing = list_files(spark, root, glob)
    if max_files_per_dir is not None:
        listing = first_per_directory(listing, max_files_per_dir)
    return contents_of(spark, root, listing, glob, max_bytes, picked=max_files_per_dir is not None)


def contents_of(
    spark: SparkSession, root: str, listing: DataFrame, glob: str | None = LOG_GLOB, max_bytes: int | None = None, picked: bool = False
) -> DataFrame:
    """A listing of ``root`` with its contents, less files above ``max_bytes``. ``picked``: it has not all files.

    A whole tree that Spark listed is read by Spark, too.
    """
    if not picked and _walk_root(spark, root, glob) is None:
        raw = _reader(spark.read, glob).load(root)
        return gather(_columns(raw if max_bytes is None else raw.filter(F.col("length") <= max_bytes), content=True))
    return read_contents(listing if max_bytes is None else listing.filter(F.col("file_size") <= max_bytes))


def read_contents(listing: DataFrame) -> DataFrame:
    """The listed files with their bytes in ``content``, opened by the tasks that hold the names.

    A task holds about ``_BATCH_BYTES`` of them at once, or one file.
    """
    kind = T.StructType([*listing.schema.fields, T.StructField("content", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, size = 0, [], 0
            for i, path in enumerate(batch.column("file_path").to_pylist()):
                system, inner = open_filesystem(path)
                with system.open_input_stream(inner) as stream:
                    held.append(stream.read())
                size += len(held[-1])
                if size >= _BATCH_BYTES:
                    yield with_content(batch.slice(first, len(held)), held)
                    first, held, size = i + 1, [], 0
            if held:
                yield with_content(batch.slice(first, len(held)), held)

    def with_content(rows: pa.RecordBatch, contents: list[bytes]) -> pa.RecordBatch:
        column = pa.array(contents, pa.binary())
        contents.clear()
        return pa.RecordBatch.from_arrays([*rows.columns, column], names=[*rows.schema.names, "content"])

    return listing.mapInArrow(read, kind)


def stream_files(spark: SparkSession, root: str, glob: str | None = LOG_GLOB, max_files_per_trigger: int = 1000) -> DataFrame:
    """The listing as a stream; every file that appears below ``root`` is seen once. Contents stay unread."""
    reader = _reader(spark.readStream, glob).option("maxFilesPerTrigger", max_files_per_trigger)
    return _columns(reader.schema(schemas.FILES).load(root), content=False)


def can_stream_listing(spark: SparkSession, root: str, checkpoint: str, glob: str | None = LOG_GLOB) -> bool:
    """Whether ``stream_listing`` can list the tree and no other source has begun at the checkpoint."""
    (begun, system), (listing, _) = (hadoop_path(spark, f"{checkpoint}/{name}") for name in ("sources", "listing"))
    return _walk_root(spark, root, glob) is not None and (system.exists(listing) or not system.exists(begun))


@dataclass
class ListingStream:
    """A stream of a written listing: each row names the file it is listed in, and a file is a micro-batch.

    They come in this order if nothing is amiss.
    """

    rows: DataFrame
    schema: T.StructType
    folder: str
    order: list[str]
    largest: int
    tasks: int

    def batch(self, spark: SparkSession, name: str) -> DataFrame:
        """The paths of one micro-batch, dealt out to as many tasks as keep the cores busy."""
        listing = spark.read.schema(self.schema).parquet(f"{self.folder}/{name}")
        return listing if self.tasks == 1 else listing.repartition(self.tasks, "file_path")


def stream_listing(
    spark: SparkSession, root: str, checkpoint: str, max_files_per_trigger: int = 1000, glob: str | None = LOG_GLOB
) -> ListingStream:
    """What lies below ``root`` now as a stream, of files that hold ``max_files_per_trigger`` paths at most.

    The listing is kept at ``checkpoint``, older files first; each call adds the paths that it lacks. Only
    its file names are held by the driver.
    """
    folder = f"{checkpoint}/listing"
    at, system = hadoop_path(spark, folder)
    system.mkdirs(at)
    earlier = {s.getPath().getName() for s in system.listStatus(at)}
    now = list_files(spark, root, glob)
    held = spark.read.schema(now.schema).parquet(folder)
    new = settle(now.join(held.select("file_path"), "file_path", "left_anti").select(*now.columns), "new-files")
    size = new.agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes")).first()
    # A write of no rows would leave a file, and that would make a micro-batch.
    if size.files:
        ordered = new.sort("modified_at", "file_path")
        ordered.write.mode("append").option("maxRecordsPerFile", max_files_per_trigger).parquet(folder)
    # Spark takes files by time, and tasks have written them side by side.
    found = sorted((s for s in system.listStatus(at) if s.getPath().getName().endswith(".parquet")), key=lambda s: s.getPath().getName())
    start = max((s.getModificationTime() for s in found), default=0)
    for i, status in enumerate(s for s in found if s.getPath().getName() not in earlier):
        system.setTimes(status.getPath(), start + 1 + i, -1)
    times = [(s.getModificationTime(), s.getPath().getName()) for s in system.listStatus(at)]
    order = [name for _, name in sorted(times) if name.endswith(".parquet")]
    cores = spark.sparkContext.defaultParallelism
    batches = max(len(order) - len(earlier), 1)
    tasks = max(-(-(size.bytes or 0) // (batches * TASK_BYTES)), -(-cores // batches))
    # Read anew, as a table read before does not see files added since.
    largest = spark.read.schema(now.schema).parquet(folder).agg(F.max("file_size").alias("n")).first().n or 0
    rows = spark.readStream.schema(now.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    rows = rows.select(F.col("_metadata.file_name").alias("listed_in"))
    return ListingStream(rows, now.schema, folder, order, largest, min(tasks, max_files_per_trigger))


def content_hash(files: DataFrame) -> DataFrame:
    """Add ``content_hash``: hex SHA-256 of the raw bytes."""
    return files.withColumn("content_hash", F.sha2("content", 256))


def visit_files(listing: DataFrame, operation: Callable[[str], object]) -> DataFrame:
    """Call ``operation`` with the path of every listed file: ``file_path, result``.

    The calls run on the executors and results are returned as strings. A task that
    is retried calls again, so the operation should be repeatable.
    """

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results = [operation(path) for path in batch["file_path"]]
            batch["result"] = [None if r is None else str(r) for r in results]
            yield batch

    return listing.select("file_path").mapInPandas(visit, "file_path string, result string")


def open_filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path for a path or URI."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    scheme, rest = path.split(":", 1)
    if scheme == "file":
        from urllib.parse import unquote

        return fs.LocalFileSystem(), "/" + unquote(rest).lstrip("/")
    return fs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + ":" + rest)


def streamed_sha256(path: str) -> str:
    """Hex SHA-256 of a file of any size, read in pieces; for use with ``visit_files``."""
    system, inner = open_filesystem(path)
    digest = hashlib.sha256()
    with system.open_input_stream(inner) as stream:
        while piece := stream.read(_READ_BYTES):
            digest.update(piece)
    return digest.hexdigest()


def write_tree(files: DataFrame, root: str) -> None:
    """Write each row ``rel_path, content`` as one file below ``root``.

    Runs on the executors; a retried task overwrites its files with the same bytes.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_filesystem(root)
        made: set[str] = set()
        for batch in batches:
            for rel, content in zip(batch.column("rel_path").to_pylist(), batch.column("content").to_pylist()):
                target = f"{base}/{rel}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(target) as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["written"])

    files.select("rel_path", "content").mapInArrow(write, "written long").write.format("noop").mode("overwrite").save()
