"""Phrase search and the hybrid of phrase and nearest-vector search."""

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

from kindling.functions import vectors as vx
from kindling.functions.text import phrase_match
from kindling.operators import knn
from kindling.operators.knn import _check_k

# Scores of the two kinds of hit.
EXACT_SCORE = 1.0
SEMANTIC_SCORE = 0.5

POSITION = ("doc_id", "chunk_idx")


def phrase_topk(chunks: DataFrame, phrase: str, k: int, position: Sequence[str] = POSITION) -> DataFrame:
    """The first k chunks, by position, that contain the phrase: ``rank, <position>, text``."""
    _check_k(k)
    found = chunks.filter(phrase_match(F.col("text"), phrase)).select(*position, "text").orderBy(*position).limit(k)
    rank = F.row_number().over(W.orderBy(*position))
    return found.withColumn("rank", rank).select("rank", *position, "text")


def hybrid_search(
    chunks: DataFrame,
    query: str,
    query_vector: Sequence[float] | None,
    k: int,
    position: Sequence[str] = POSITION,
    vector: str = "embedding",
    query_id: int = 0,
) -> DataFrame:
    """Phrase hits first (score 1.0, by position), then nearest vectors (score 0.5): k rows.

    Taking the first k phrase hits, then the k nearest vectors that are not among
    them, then cutting to k, is the same as one sort by (is a phrase hit, position or
    distance): with fewer than k phrase hits, at most that many of the k nearest are
    phrase hits, and the rest are exactly the nearest others. So one scan and one
    bounded sort do it. A query without a vector has no hits.

    Output: ``query_id, rank, <position>, text, score, distance``.
    """
    _check_k(k)
    exact = F.coalesce(phrase_match(F.col("text"), query), F.lit(False))
    if query_vector is None:
        chunks, query_vector = chunks.limit(0), []
    scored = chunks.select(
        *position,
        "text",
        exact.alias("is_exact"),
        vx.l2_squared(vector, list(query_vector)).alias("distance"),
    )
    order = [
        F.col("is_exact").desc(),
        F.when(~F.col("is_exact"), F.col("distance")).asc_nulls_last(),
        *[F.col(c) for c in position],
    ]
    # Chunks without a vector sort last and are dropped from the k rows, not from the scan.
    best = scored.orderBy(*order).limit(k).filter(F.col("is_exact") | F.col("distance").isNotNull())
    return best.select(
        F.lit(query_id).cast("long").alias("query_id"),
        F.row_number().over(W.orderBy(*order)).alias("rank"),
        *position,
        "text",
        F.when(F.col("is_exact"), EXACT_SCORE).otherwise(SEMANTIC_SCORE).alias("score"),
        "distance",
    )


class _Holders:
    """Which rows of a string column hold a phrase: one search of the bytes of all rows, not one a row."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        first = texts.offset
        self.starts = np.frombuffer(texts.buffers()[1], np.int64)[first : first + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        self.data = texts.buffers()[2].to_pybytes() if len(texts) and texts.buffers()[2] is not None else b""
        self.valid = texts.is_valid().to_numpy(zero_copy_only=False)
        self.longest = int(np.diff(self.starts).max(initial=0))

    def rows(self, phrase: str) -> np.ndarray:
        wanted = phrase.encode()
        if not wanted:
            return np.flatnonzero(self.valid)
        found: list[int] = []
        if len(wanted) <= self.longest:
            at, end = self.data.find(wanted, self.starts[0]), int(self.starts[-1])
            while 0 <= at and at + len(wanted) <= end:
                row = int(np.searchsorted(self.starts, at, side="right")) - 1
                stop = int(self.starts[row + 1])
                if at + len(wanted) <= stop:
                    found.append(row)
                    at = self.data.find(wanted, stop)
                else:  # it lies across two rows
                    at = self.data.find(wanted, at + 1)
        return np.array(found, dtype=np.int64)


def hybrid_search_batch(
    chunks: DataFrame,
    queries: DataFrame,
    position: Sequence[str] = POSITION,
    vector: str = "embedding",
    query_bytes: int = knn.QUERY_BYTES,
) -> DataFrame:
    """``hybrid_search`` for every row ``query_id, text, k, <vector>`` of ``queries``, in one scan.

    A task keeps, per query, its first k phrase hits and its k nearest other chunks. Queries
    without a text or vector have no hits; those beyond ``query_bytes`` are taken slab by slab.
    """
    position = list(position)
    data = chunks.select(*position, "text", F.lower("text").alias("_lower"), F.col(vector).alias("_v"))
    asked = queries.filter(F.col(vector).isNotNull() & F.col("text").isNotNull() & (F.col("k") > 0))
    asked = asked.select("query_id", F.col(vector).alias("_v"), F.lower(F.trim("text")).alias("phrase"), F.col("k").cast("long").alias("k"))
    kind = asked.schema["query_id"].dataType
    fields = [T.StructField("query_id", kind), T.StructField("_k", T.LongType()), *[data.schema[c] for c in position]]
    fields += [data.schema["text"], T.StructField("is_exact", T.BooleanType()), T.StructField("distance", T.DoubleType())]
    schema = T.StructType(fields)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])
    by_place = [(c, "ascending") for c in position]

    def search(data: DataFrame, names: pa.Array, matrix: np.ndarray, phrases: list[str], ks: list[int]) -> DataFrame:
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[tuple[int, bool], pa.Table] = {}

            def keep(j: int, exact: bool, rows: pa.Table, distances: np.ndarray) -> None:
                rows = rows.append_column("distance", pa.array(distances, pa.float64(), from_pandas=True))
                if (j, exact) in best:
                    rows = pa.concat_tables([best[j, exact], rows])
                keys = by_place if exact else [("distance", "ascending"), *by_place]
                best[j, exact] = rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_end")[: ks[j]])

            for batch in batches:
                table = pa.Table.from_batches([batch])
                plain, texts = table.select([*position, "text"]), table.column("_lower").combine_chunks()
                present = table.column("_v").is_valid().to_numpy()
                spots = np.flatnonzero(present)
                rows = knn._matrix(table.column("_v").filter(pa.array(present)))
                if len(rows) and len(matrix) and rows.shape[1] != matrix.shape[1]:
                    raise ValueError(vx.WRONG_LENGTH)
                holds = _Holders(texts)
                for lo in range(0, len(phrases), knn._SLAB):
                    # Distances of all pairs, roughly, by a matrix product; those that may count are computed exactly.
                    keys, slack = knn._rough_keys("l2", rows, matrix[lo : lo + knn._SLAB]) if len(rows) else (None, None)
                    for j in range(lo, min(lo + knn._SLAB, len(phrases))):
                        found = holds.rows(phrases[j])
                        if len(found):
                            exact = np.full(len(found), np.nan)
                            own = present[found]
                            exact[own] = knn._exact("l2", rows[np.searchsorted(spots, found[own])], matrix[j])
                            keep(j, True, plain.take(pa.array(found)), exact)
                        if not len(rows):
                            continue
                        gaps, near = keys[j - lo], 2 * slack[j - lo]
                        if not np.isfinite(gaps).all():
                            gaps = ((rows - matrix[j]) ** 2).sum(1)
                            near = 1e-9 * (1 + np.abs(gaps[np.isfinite(gaps)]).max(initial=0.0))
                        others = np.ones(len(rows), bool)
                        if len(found):
                            others[np.searchsorted(spots, found[own])] = False
                        known = best.get((j, False))
                        edge = known.column("distance")[-1].as_py() if known is not None and len(known) == ks[j] else None
                        if edge is not None:
                            rest = np.flatnonzero(others & (gaps <= edge + near))
                        else:
                            rest = np.flatnonzero(others)
                        if len(rest) > ks[j]:
                            # Rounding can reorder only what is this close to the k-th.
                            rest = rest[gaps[rest] <= np.partition(gaps[rest], ks[j] - 1)[ks[j] - 1] + near]
                        if len(rest):
                            keep(j, False, plain.take(pa.array(spots[rest])), knn._exact("l2", rows[rest], matrix[j]))
            for (j, exact), rows in best.items():
                n = len(rows)
                columns = [pa.array([names[j].as_py()] * n, names.type), pa.array([ks[j]] * n), *(rows.column(c) for c in [*position, "text"])]
                out = pa.Table.from_arrays([*columns, pa.array([exact] * n), rows.column("distance")], names=arrow.names)
                yield from out.cast(arrow).combine_chunks().to_batches()

        order = [F.col("is_exact").desc(), F.when(~F.col("is_exact"), F.col("distance")).asc_nulls_last(), *[F.col(c) for c in position]]
        found = knn.fewer_tasks(data, 2 * sum(ks)).mapInArrow(find, schema)
        found = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= F.col("_k"))
        score = F.when(F.col("is_exact"), EXACT_SCORE).otherwise(SEMANTIC_SCORE)
        return found.select("query_id", "rank", *position, "text", score.alias("score"), "distance")

    return knn.by_slabs(data, asked, search, query_bytes, extra=["phrase", "k"])


def first_source_wins(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``first``, then those of ``second`` whose key ``first`` does not hold."""
    from kindling.operators.joins import anti_join

    return first.unionByName(anti_join(second, first.select(*keys), keys))
