"""Where shared files go, and how data is placed on the cluster."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Above this many bytes a join side is shuffled instead of broadcast.
BROADCAST_BYTES = 64 << 20

# A task should read about this much.
TASK_BYTES = 64 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Only needed where it is not installed on the executors.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="kindling-ship-")) / package.name
    sc.addPyFile(shutil.make_archive(str(target), "zip", package.parent, package.name))
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    chosen = sc.getCheckpointDir()
    if chosen:
        return chosen.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="kindling-"))
    return sc.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def hadoop_path(spark: SparkSession, path: str):
    """Hadoop's path and its file system, for what Spark alone may be able to open."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Give a plain file scan at least one task per core.

    One file with a single row group is read by one task, however many splits it
    has, and everything fused to that scan would run there: such a scan is dealt out
    by ``keys``, which should be unique, hence even. A scan that has a split per core
    already, as any large table has, is returned unchanged.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores * 2, *keys) if scan.rdd.getNumPartitions() < cores else scan


def gather(scan: DataFrame) -> DataFrame:
    """Join the tiny tasks that a scan of very many tiny files gets, without a shuffle.

    Every file counts as at least 4 MB when splits are planned. A scan whose splits
    hold about ``TASK_BYTES`` is returned unchanged.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    # Asking for at least as many tasks as there are changes nothing and plans nothing.
    return scan.coalesce(min(max(cores * 2, -(-scan_bytes(scan) // TASK_BYTES)), 1 << 20))


def scan_bytes(scan: DataFrame) -> int:
    """Bytes of the files behind a scan, from the statistics of its plan; runs no job."""
    return int(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _width(column: Column, kind: T.DataType) -> Column:
    """Estimated bytes of a value, by its type."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            total = F.aggregate(column, F.lit(24).cast("long"), lambda n, x: n + _width(x, kind.elementType))
            return F.coalesce(total, F.lit(24).cast("long"))
        return F.greatest(F.size(column), F.lit(0)).cast("long") * 8 + 24
    if isinstance(kind, T.MapType):
        return _width(F.map_keys(column), T.ArrayType(kind.keyType)) + _width(F.map_values(column), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StructType):
        return sum((_width(column[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    if isinstance(kind, T.VariantType):
        return F.coalesce(F.octet_length(F.to_json(column)), F.lit(0)).cast("long") + 16
    return F.lit(16).cast("long")


def byte_size(df: DataFrame) -> int:
    """Estimated in-memory bytes of ``df``, one aggregate over its rows."""
    total = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0))
    return df.agg(F.sum(total.cast("long")).alias("n")).first().n or 0


def is_plain_scan(df: DataFrame) -> bool:
    """Whether a second pass over ``df`` only reads files or local rows again."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return not any(word in plan for word in ("Join", "Aggregate", "Python", "Pandas", "Arrow", "ScalaUDF", "Window", "Sort", "Generate"))


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after measuring that the side is small.

    A side that takes more than a scan is written down first, so it is computed once.
    """
    if not is_plain_scan(df):
        df = settle(df, "side")
    return F.broadcast(df) if byte_size(df) <= max_bytes else df
