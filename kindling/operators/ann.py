"""Approximate nearest-vector search: cells around centroids, and hashed projections.

Both keep the index as plain columns of the vector table. A search reads the
candidates once and returns partial top-k lists from every task; candidates are
never paired up as rows, so a cell or hash bucket holding a large share of the
vectors is just more splits of the scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kindling.operators import knn

# Fixed value: number of cells.
CELLS = 100


@dataclass(frozen=True)
class Cells:
    """Centroids of a cell index; ``centroids[i]`` is the centre of cell i."""

    centroids: np.ndarray

    def nearest(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of every row, in ascending order of their numbers."""
        n = min(n, len(self.centroids))
        out = np.zeros((len(vectors), n), np.int64)
        lengths = (self.centroids * self.centroids).sum(1)
        for at in range(0, len(vectors), 1024):
            rows = vectors[at : at + 1024]
            # The row's own length is the same for all cells.
            gaps = lengths - 2 * (rows @ self.centroids.T)
            # Of equal distances the lower number counts.
            out[at : at + 1024] = np.sort(np.argsort(gaps, axis=1, kind="stable")[:, :n], axis=1)
        return out


def train_cells(
    vectors: DataFrame, cells: int = CELLS, vector: str = "embedding", seed: int = 42
) -> Cells:
    """k-means centroids of all vectors."""
    usable = vectors.filter(F.col(vector).isNotNull())
    points = usable.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, featuresCol="features").fit(points)
    return Cells(np.array(model.clusterCenters()))


def assign_cells(vectors: DataFrame, index: Cells, vector: str = "embedding") -> DataFrame:
    """Add ``cell``, the nearest centroid; null where the vector is null. No shuffle.

    The centroids are bounded by the number of cells.
    """
    centroids = index.centroids
    half_sq = (centroids * centroids).sum(axis=1) / 2

    @F.arrow_udf("int")
    def cell(column: pa.Array) -> pa.Array:
        out = np.full(len(column), -1)
        valid = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        if len(valid):
            rows = knn._matrix(column.take(pa.array(valid)))
            out[valid] = np.argmin(half_sq[None, :] - rows @ centroids.T, axis=1)
        return pa.array(out, pa.int32(), mask=out < 0)

    return vectors.withColumn("cell", cell(F.col(vector)))


def write_cells(assigned: DataFrame, path: str, mode: str = "append") -> None:
    """Store vectors in one folder per cell, so a search reads only the cells it probes.

    The rebalance hint groups rows by cell into few files and splits a cell that
    holds a large share of them.
    """
    assigned.hint("rebalance", "cell").write.mode(mode).partitionBy("cell").parquet(path)


def save_centroids(spark: SparkSession, index: Cells, path: str) -> None:
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(index.centroids)]
    spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_centroids(spark: SparkSession, path: str) -> Cells:
    rows = spark.read.parquet(path).orderBy("cell").collect()
    return Cells(np.array([r.centroid for r in rows]))


def ivf_search(
    assigned: DataFrame,
    index: Cells,
    queries: DataFrame,
    k: int,
    probes: int = 8,
    metric: str = "l2",
    ids: Sequence[str] = ("vec_id",),
    vector: str = "embedding",
    query_bytes: int = knn.QUERY_BYTES,
) -> DataFrame:
    """Top k per query among the ``probes`` cells nearest to it.

    ``assigned`` carries ``cell``. Probing every cell gives the exact result.
    """
    knn._check_k(k)
    knn._check_metric(metric)
    ids = list(ids)
    data = assigned.filter(F.col(vector).isNotNull()).select(*ids, "cell", F.col(vector).alias("_v"))
    asked = queries.filter(F.col(vector).isNotNull()).select("query_id", F.col(vector).alias("_v"))

    def search(data: DataFrame, names: pa.Array, matrix: np.ndarray) -> DataFrame:
        member = _members(index.nearest(matrix, probes))
        candidates = data.filter(F.col("cell").isin(sorted(member)))
        partial = _scan_candidates(candidates, ids, "cell", asked, names, matrix, k, metric, _by_number(member))
        return knn._ranked(partial, ids, metric, k).select("query_id", "rank", *ids, "distance")

    return knn.by_slabs(data, asked, search, query_bytes)


def _members(numbers: np.ndarray) -> dict[int, np.ndarray]:
    """For every number in a table of numbers, the rows that have it."""
    flat, row = numbers.ravel(), np.repeat(np.arange(len(numbers)), numbers.shape[1] if numbers.ndim == 2 else 0)
    order = np.argsort(flat, kind="stable")
    cuts = np.flatnonzero(np.diff(flat[order])) + 1
    return {int(flat[rows[0]]): row[rows] for rows in np.split(order, cuts) if len(rows)}


def _by_number(member: dict[int, np.ndarray]):
    """Candidate pairs of a batch: rows of a cell or bucket with the queries that want it."""

    def groups(column: pa.Array):
        numbers = column.to_numpy()
        for n in np.unique(numbers):
            if int(n) in member:
                yield np.flatnonzero(numbers == n), member[int(n)]

    return groups


def _scan_candidates(data, ids, label, asked, names, matrix, k, metric, groups) -> DataFrame:
    """Each task's k nearest per query among the candidates that ``groups`` names."""
    schema = knn.topk_schema(data, ids, asked.schema["query_id"].dataType)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys, vectors = table.select(ids), knn._matrix(table.column("_v"))
            found = [best] if best is not None else []
            for rows, asking in groups(batch.column(label)):
                part = knn.block_topk(keys.take(rows), vectors[rows], names.take(pa.array(asking)), matrix[asking], k, metric)
                found += [t.cast(arrow) for t in part]
            if found:
                best = knn.keep_nearest(pa.concat_tables(found), ids, k, metric)
        if best is not None:
            yield from best.combine_chunks().to_batches()

    return knn.fewer_tasks(data, len(names) * k).mapInArrow(nearest, schema)


@dataclass(frozen=True)
class Projections:
    """Directions by table; a vector's bucket is its projection cut into ``bucket_length``."""

    directions: np.ndarray
    bucket_length: float

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        return np.floor(vectors @ self.directions.T / self.bucket_length).astype(np.int64)


def fit_lsh(dimensions: int, bucket_length: float, tables: int, seed: int = 42) -> Projections:
    """Random unit directions for squared-L2 search; longer buckets and more tables raise recall."""
    drawn = np.random.default_rng(seed).standard_normal((tables, dimensions))
    return Projections(drawn / np.linalg.norm(drawn, axis=1, keepdims=True), bucket_length)


def bucket_rows(vectors: DataFrame, model: Projections, vector: str = "embedding") -> DataFrame:
    """One row per vector and table, with ``tab`` and ``bucket``; rows without a vector have none."""

    @F.arrow_udf("array<long>")
    def buckets(column: pa.Array) -> pa.Array:
        return pa.array(list(model.buckets(knn._matrix(column))), pa.list_(pa.int64()))

    usable = vectors.filter(F.col(vector).isNotNull())
    return usable.select("*", F.posexplode(buckets(F.col(vector))).alias("tab", "bucket"))


def write_buckets(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Store rows of ``bucket_rows`` in a folder per table and bucket; a large bucket becomes several files."""
    rows.hint("rebalance", "tab", "bucket").write.mode(mode).partitionBy("tab", "bucket").parquet(path)


def lsh_search(
    stored: DataFrame, model: Projections, query: Sequence[float], k: int, ids: Sequence[str] = ("vec_id",), vector: str = "embedding"
) -> DataFrame:
    """About the k nearest to one query: ``query_id, rank, <ids>, distance``."""
    schema = "query_id bigint, `" + vector + "` array<double>"
    asked = stored.sparkSession.createDataFrame([(0, [float(x) for x in query])], schema)
    return lsh_search_batch(stored, model, asked, k, "l2", ids, vector)


def _wanted(buckets: np.ndarray) -> Column:
    """Rows of the tables' wanted buckets; on stored buckets, only their folders are read."""
    parts = [(F.col("tab") == t) & F.col("bucket").isin(np.unique(buckets[:, t]).tolist()) for t in range(buckets.shape[1])]
    out = parts[0]
    for part in parts[1:]:
        out = out | part
    return out


def lsh_search_batch(
    stored: DataFrame,
    model: Projections,
    queries: DataFrame,
    k: int,
    metric: str = "l2",
    ids: Sequence[str] = ("vec_id",),
    vector: str = "embedding",
    query_bytes: int = knn.QUERY_BYTES,
) -> DataFrame:
    """About the k nearest for each query, among vectors that share a bucket with it in any table.

    ``stored`` has the rows of ``bucket_rows``. A vector found through several tables
    counts once.
    """
    knn._check_k(k)
    knn._check_metric(metric)
    ids, tables = list(ids), len(model.directions)
    data = stored.select(*ids, "tab", "bucket", F.col(vector).alias("_v"))
    asked = queries.filter(F.col(vector).isNotNull()).select("query_id", F.col(vector).alias("_v"))

    def search(data: DataFrame, names: pa.Array, matrix: np.ndarray) -> DataFrame:
        # Bucket b of table t has number b * tables + t.
        buckets = model.buckets(matrix) if len(matrix) else np.zeros((0, tables), np.int64)
        member = _members(buckets * tables + np.arange(tables))
        candidates = data.filter(_wanted(buckets)).select(*ids, "_v", (F.col("bucket").cast("long") * tables + F.col("tab")).alias("_n"))
        # A vector comes once from each table at most.
        partial = _scan_candidates(candidates, ids, "_n", asked, names, matrix, k * tables, metric, _by_number(member))
        best = knn._ranked(partial.dropDuplicates(["query_id", *ids]), ids, metric, k)
        return best.select("query_id", "rank", *ids, "distance")

    return knn.by_slabs(data, asked, search, query_bytes)


def recall(approximate: DataFrame, exact: DataFrame, ids: Sequence[str] = ("vec_id",)) -> DataFrame:
    """Share of the exact hits that the approximate result found, per query."""
    keys = ["query_id", *ids]
    found = approximate.select(*keys, F.lit(1).alias("found"))
    return (
        exact.select(*keys)
        .join(found, keys, "left")
        .groupBy("query_id")
        .agg(F.avg(F.coalesce("found", F.lit(0))).alias("recall"))
    )
