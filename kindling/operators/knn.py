"""Exact nearest-vector search.

One query by squared L2 is a scan with generated code: distance, sort, limit. Other
metrics, long vectors and batches of queries run as matrix products on Arrow batches,
several times faster than folding arrays in the JVM. There every task of the scan
keeps only its own k nearest per query, so a pair of query and vector never becomes a
row and skew in the corpus only means more splits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from kindling.cluster import broadcast_if_small, is_plain_scan, new_folder, settle
from kindling.functions import vectors as vx

# A batch whose vectors exceed this many bytes is sent to the tasks slab by slab.
QUERY_BYTES = 32 << 20

# Partial results of all tasks together should stay near this many rows.
PARTIAL_ROWS = 200_000_000
# Below this many rows per task their number of tasks does not matter.
_FEW_ROWS = 2_000
_SLAB = 256


def _ranked(df: DataFrame, ids: Sequence[str], metric: str, k: int) -> DataFrame:
    """The k nearest per query over rows ``query_id, <ids>, distance``, ranked from 1."""
    near = vx.nearest_first(metric, F.col("distance"))
    order = W.partitionBy("query_id").orderBy(near, *ids)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn(
    corpus: DataFrame,
    query: Sequence[float],
    k: int,
    metric: str = "l2",
    ids: Sequence[str] = ("vec_id",),
    vector: str = "embedding",
    query_id: int = 0,
) -> DataFrame:
    """k nearest vectors to one query: ``query_id, rank, <ids>, distance``.

    ``l2`` is the squared distance. Rows without a vector are skipped; equal
    distances are ordered by the ids. Fewer than k vectors give fewer rows.
    """
    _check_k(k)
    _check_metric(metric)
    ids, query = list(ids), [float(v) for v in query]
    usable = corpus.filter(F.col(vector).isNotNull())
    if metric == "l2" and len(query) <= vx.UNROLL_DIMS:
        scored = usable.select(*ids, vx.l2_squared(vector, query).alias("distance"))
        best = scored.orderBy(F.asc_nulls_last("distance"), *ids).limit(k).withColumn("query_id", F.lit(query_id).cast("long"))
    else:
        data = usable.select(*ids, F.col(vector).alias("_v"))
        best = scan_topk(data, ids, T.LongType(), pa.array([query_id], pa.int64()), np.array([query]), k, metric)
        best = best.orderBy(vx.nearest_first(metric, F.col("distance")), *ids).limit(k)
    return _ranked(best, ids, metric, k).select("query_id", "rank", *ids, "distance")


def knn_batch(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "l2",
    ids: Sequence[str] = ("vec_id",),
    vector: str = "embedding",
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """k nearest vectors for each row ``query_id, <vector>`` of ``queries``.

    Queries within ``query_bytes`` travel to the tasks that scan the corpus. A larger
    batch is cut into slabs of that size by a hash of the query id; each slab is one scan
    of the corpus, whose result is written down at once. Neither side is copied.
    """
    _check_k(k)
    _check_metric(metric)
    ids = list(ids)
    data = corpus.filter(F.col(vector).isNotNull()).select(*ids, F.col(vector).alias("_v"))
    asked = queries.filter(F.col(vector).isNotNull()).select("query_id", F.col(vector).alias("_v"))
    kind = asked.schema["query_id"].dataType

    def search(data: DataFrame, names: pa.Array, matrix: np.ndarray) -> DataFrame:
        found = _ranked(scan_topk(data, ids, kind, names, matrix, k, metric), ids, metric, k)
        return found.select("query_id", "rank", *ids, "distance")

    return by_slabs(data, asked, search, query_bytes)


def by_slabs(data: DataFrame, asked: DataFrame, search, query_bytes: int, extra: Sequence[str] = ()) -> DataFrame:
    """``search(data, ids, matrix, *extra)`` for all queries, in one go or slab by slab.

    Queries are written down first, and so is the corpus if it is searched more than
    once and is more than a scan: a model behind either runs once per row.
    """
    asked = settle(asked, "queries")
    size = asked.agg(F.sum(F.size("_v").cast("long") * 8 + 64).alias("n")).first().n or 0
    slabs = -(-size // query_bytes) if query_bytes else 3
    if slabs <= 1:
        return search(data, *_collected(asked, extra))
    if not is_plain_scan(data):
        data = settle(data, "corpus")
    path = new_folder(data.sparkSession, "hits")
    schema = None
    for slab in range(slabs):
        own = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(slabs)) == slab)
        found = search(data, *_collected(own, extra))
        found.write.mode("append").parquet(path)
        schema = found.schema
    return data.sparkSession.read.schema(schema).parquet(path)


def knn_by_metrics(
    corpus: DataFrame, query: Sequence[float], k: int, metrics: Sequence[str], ids: Sequence[str] = ("vec_id",), vector: str = "embedding"
) -> DataFrame:
    """k nearest vectors to one query by each metric, in one scan: ``metric, rank, <ids>, distance``."""
    _check_k(k)
    for metric in metrics:
        _check_metric(metric)
    ids, matrix, name = list(ids), np.array([[float(v) for v in query]]), pa.array([0], pa.int64())
    data = corpus.filter(F.col(vector).isNotNull()).select(*ids, F.col(vector).alias("_v"))
    schema = T.StructType([T.StructField("metric", T.StringType()), *topk_schema(data, ids, T.LongType()).fields])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields[1:]])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, pa.Table] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys, rows = table.select(ids), _matrix(table.column("_v"))
            for metric in metrics:
                found = [t.cast(arrow) for t in block_topk(keys, rows, name, matrix, k, metric)]
                if found:
                    best[metric] = keep_nearest(pa.concat_tables([*([best[metric]] if metric in best else []), *found]), ids, k, metric)
        for metric, table in best.items():
            yield from table.add_column(0, "metric", pa.array([metric] * len(table))).combine_chunks().to_batches()

    partial = data.mapInArrow(nearest, schema)
    nearer = F.when(F.col("metric").isin(sorted(vx.DESCENDING)), -F.col("distance")).otherwise(F.col("distance"))
    order = W.partitionBy("metric").orderBy(nearer.asc_nulls_last(), *ids)
    ranked = partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("metric", "query_id", "rank", *ids, "distance")


def _check_k(k: int) -> None:
    if k < 1:
        raise ValueError("k must be at least 1")


def _check_metric(metric: str) -> None:
    if metric not in vx.METRICS:
        raise ValueError(f"unknown metric {metric!r}; choose from {sorted(vx.METRICS)}")


def _collected(asked: DataFrame, extra: Sequence[str] = ()) -> tuple:
    """Query ids, matrix and extra columns of one slab."""
    table = asked.select("query_id", "_v", *extra).toArrow()
    names = table.column("query_id").combine_chunks()
    matrix = _matrix(table.column("_v").combine_chunks())
    return (names, matrix, *[table.column(c).to_pylist() for c in extra])


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix of doubles; lengths must agree."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) == 0:
        return flat.reshape(0, 0)
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != lengths[0]).any():
        raise ValueError(vx.WRONG_LENGTH)
    return flat.reshape(len(column), int(lengths[0]))


def _in_order(terms: np.ndarray) -> np.ndarray:
    """Row sums added position by position, as the JVM does."""
    return np.add.accumulate(terms, axis=1)[:, -1] if terms.shape[1] else np.zeros(len(terms))


def _exact(metric: str, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    if metric == "l2":
        gap = rows - query
        return _in_order(gap * gap)
    if metric == "l1":
        return _in_order(np.abs(rows - query))
    dot = _in_order(rows * query)
    if metric == "inner_product":
        return dot
    lengths = np.sqrt(_in_order(rows * rows)) * np.sqrt(_in_order((query * query)[None, :]))[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(lengths == 0, np.nan, dot / lengths)


def _rough_keys(metric: str, rows: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Approximate sort keys (smaller is nearer) of all pairs and a bound on their error."""
    row_sq, query_sq = (rows * rows).sum(1), (queries * queries).sum(1)
    if metric == "l1":
        keys = np.stack([np.abs(rows - q).sum(1) for q in queries])
        scale = np.abs(rows).sum(1).max(initial=0.0) + np.abs(queries).sum(1)
    else:
        dots = queries @ rows.T
        if metric == "l2":
            keys = query_sq[:, None] + row_sq[None, :] - 2 * dots
            scale = query_sq + row_sq.max(initial=0.0)
        elif metric == "inner_product":
            keys = -dots
            scale = np.sqrt(query_sq * row_sq.max(initial=0.0))
        else:
            lengths = np.sqrt(query_sq)[:, None] * np.sqrt(row_sq)[None, :]
            keys = np.where(lengths == 0, np.inf, -dots / np.where(lengths == 0, 1.0, lengths))
            scale = np.ones(len(queries))
    return keys, 8 * (rows.shape[1] + 8) * np.finfo(float).eps * scale


def block_topk(
    ids: pa.Table, rows: np.ndarray, names: pa.Array, queries: np.ndarray, k: int, metric: str
) -> Iterator[pa.Table]:
    """k nearest of this block per query: ``query_id, <ids>, distance``.

    A matrix product ranks all pairs roughly; every pair that could be among the k
    nearest, given the error of that product, is then computed exactly.
    """
    if not len(rows) or not len(queries):
        return
    if rows.shape[1] != queries.shape[1]:
        raise ValueError(vx.WRONG_LENGTH)
    for lo in range(0, len(queries), _SLAB):
        slab = queries[lo : lo + _SLAB]
        keys, slack = _rough_keys(metric, rows, slab)
        for j, query in enumerate(slab):
            if len(rows) > k:
                kth = np.partition(keys[j], k - 1)[k - 1]
                near = np.flatnonzero(keys[j] <= kth + 2 * slack[j])
            else:
                near = np.arange(len(rows))
            found = _exact(metric, rows[near], query)
            order = pa.Table.from_arrays(
                [pa.array(-found if metric in vx.DESCENDING else found, from_pandas=True), *ids.take(near).columns],
                names=["_key", *ids.column_names],
            )
            by = [("_key", "ascending")] + [(c, "ascending") for c in ids.column_names]
            kept = near[pc.sort_indices(order, sort_keys=by).to_numpy()[:k]] if len(near) > k else near
            values = found[np.searchsorted(near, kept)]
            name = names[lo + j]
            yield pa.Table.from_arrays(
                [pa.array([name.as_py()] * len(kept), names.type), *ids.take(kept).columns, pa.array(values, from_pandas=True)],
                names=["query_id", *ids.column_names, "distance"],
            )


def topk_schema(corpus: DataFrame, ids: Sequence[str], query_type: T.DataType) -> T.StructType:
    fields = [T.StructField("query_id", query_type)]
    fields += [T.StructField(c, corpus.schema[c].dataType) for c in ids]
    return T.StructType(fields + [T.StructField("distance", T.DoubleType())])


def fewer_tasks(data: DataFrame, rows_per_task: int, total: int = PARTIAL_ROWS) -> DataFrame:
    """The scan with its tasks joined when their partial results would add up to too much.

    Every task returns up to k rows per query, so a large batch over very many splits
    could return more than it read. At least two tasks per core remain.
    """
    allowed = max(2 * data.sparkSession.sparkContext.defaultParallelism, total // max(rows_per_task, 1))
    # Asking for at least as many tasks as there are changes nothing.
    return data if rows_per_task < _FEW_ROWS else data.coalesce(allowed)


def scan_topk(
    data: DataFrame, ids: list[str], query_type: T.DataType, names: pa.Array, matrix: np.ndarray, k: int, metric: str
) -> DataFrame:
    """Each task's k nearest per query, in one pass and without a shuffle."""
    schema = topk_schema(data, ids, query_type)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            found = list(block_topk(table.select(ids), _matrix(table.column("_v")), names, matrix, k, metric))
            if found:
                merged = pa.concat_tables(([best] if best is not None else []) + [t.cast(arrow) for t in found])
                best = merged if best is None else keep_nearest(merged, ids, k, metric)
        if best is not None:
            yield from best.combine_chunks().to_batches()

    return fewer_tasks(data, len(names) * k).mapInArrow(nearest, schema)


def keep_nearest(table: pa.Table, ids: Sequence[str], k: int, metric: str) -> pa.Table:
    """The k nearest rows per query of an Arrow table of partial results."""
    direction = "descending" if metric in vx.DESCENDING else "ascending"
    keys = [("query_id", "ascending"), ("distance", direction)] + [(c, "ascending") for c in ids]
    table = table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_end"))
    query = table.column("query_id").combine_chunks().dictionary_encode().indices.to_numpy()
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    return table.filter(pa.array(place < k))


def cosine_topk(
    corpus: DataFrame, query: Sequence[float], k: int, ids: Sequence[str] = ("vec_id",), vector: str = "embedding"
) -> DataFrame:
    """k most similar vectors by cosine, zero vectors last: ``query_id, rank, <ids>, similarity``."""
    return knn(corpus, query, k, "cosine", ids, vector).withColumnRenamed("distance", "similarity")


def append_vectors(vectors: DataFrame, more: DataFrame) -> DataFrame:
    """Extend a vector set; columns are matched by name."""
    return vectors.unionByName(more)


def fetch_records(hits: DataFrame, records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the stored columns of each hit by key.

    Hits hold at most k rows per query; they are broadcast only if measured small.
    """
    return records.join(broadcast_if_small(hits), list(keys))
