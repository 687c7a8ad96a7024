"""Exact nearest neighbours between two tables that are both large.

Vectors are dealt into the cells of pivots. A query looks at the nearest cells first, whose k-th distance
bounds its search: by the triangle inequality a cell is out of reach if its ring of distances from
the pivot, or its side of the plane between two pivots, is further away. Only then is the
query sent to the cells in reach. Large cells are split into parts and a cell's queries into blocks, so a task
holds a bounded part of the corpus and queries stream past it, whatever share one cell has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kindling.cluster import settle
from kindling.operators import knn

# Pivots are taken from so many vectors with the least hashes, and there are at most so many.
SAMPLE, MOST_PIVOTS = 8192, 1024
# Vectors of a part of a cell, and queries that one task compares with a part.
PART_ROWS, BLOCK_QUERIES = 20_000, 50_000
# Above this share of all pairs in reach, cells are no longer told apart. A part then has so many times
# PART_ROWS, within so many bytes, and so many parts and blocks are made for each core.
DENSE, DENSE_PARTS, HELD_BYTES, TASKS_PER_CORE = 0.25, 5, 64 << 20, 4
# Queries whose distances to all pivots are held at once.
_ROWS = 2048
# Queries and vectors multiplied at once, and pairs whose exact distances are computed at once.
_QUERIES, _TILE, _PAIRS = 512, 2048, 1 << 16


@dataclass(frozen=True)
class Pivots:
    """Pivots as rows, and per cell the number of vectors and their least and largest distance from the pivot."""

    points: np.ndarray
    counts: np.ndarray
    least: np.ndarray
    most: np.ndarray

    def distances(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of rows to all pivots, and how far each may be off."""
        if rows.shape[1] != self.points.shape[1]:
            raise ValueError(knn.vx.WRONG_LENGTH)
        squares = (rows * rows).sum(1)[:, None] + (self.points * self.points).sum(1)[None] - 2 * rows @ self.points.T
        scale = np.sqrt((rows * rows).sum(1)) + np.sqrt((self.points * self.points).sum(1).max(initial=0.0))
        slack = 4 * np.sqrt(8 * (rows.shape[1] + 8) * np.finfo(float).eps) * scale
        return np.sqrt(np.maximum(squares, 0.0)), slack[:, None]

    def home(self, rows: np.ndarray, k: int) -> np.ndarray:
        """For each row, the nearest cells that hold k vectors together, as a mask."""
        far, _ = self.distances(rows)
        order = np.argsort(far, axis=1, kind="stable")
        held = np.cumsum(self.counts[order], axis=1)
        wanted = (held - self.counts[order] < k) & (self.counts[order] > 0)
        out = np.zeros(far.shape, bool)
        np.put_along_axis(out, order, wanted, axis=1)
        return out

    def in_reach(self, rows: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """For each row, the cells that may hold a vector within ``reach``, as a mask."""
        far, slack = self.distances(rows)
        limit = reach[:, None] + slack
        # What cannot be compared is in reach.
        near = ~(far - self.most > limit) & ~(self.least - far > limit) & (self.counts > 0)
        # Vectors of another cell lie beyond the plane between its pivot and the row's nearest one.
        first = far.argmin(axis=1)
        gaps, _ = self.distances(self.points)
        between = gaps[first]
        usable = between > 1e-3 * (slack / np.sqrt(np.finfo(float).eps))
        plane = (far**2 - (far[np.arange(len(rows)), first] ** 2)[:, None]) / np.where(usable, 2 * between, 1.0)
        return near & (~usable | ~(plane > limit))


class Part:
    """Vectors held by a task, in the order of their ids, with which queries are compared.

    A matrix product in single precision around their mean ranks pairs roughly; those that may be among
    the k nearest, given the error of that product, are computed exactly. Where many are that close, the product is made again in
    double precision. Vectors that are not finite, or copies of k others before them, stay out of the product.
    """

    @np.errstate(over="ignore", invalid="ignore")
    def __init__(self, table: pa.Table, ids: Sequence[str], k: int):
        order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ids], null_placement="at_start")
        self.ids, self.k = table.select(list(ids)).take(order).combine_chunks(), k
        self.rows = knn._matrix(table.column("_v").combine_chunks().take(order))
        finite = np.isfinite(self.rows).all(axis=1)
        self.odd = not finite.all()
        self.own = np.flatnonzero(finite & ~_copies(self.rows, k))
        some = self.rows[self.own]
        self.centre = some.mean(axis=0) if len(some) else np.zeros(self.rows.shape[1])
        some -= self.centre
        squares = (some * some).sum(axis=1)
        self.most = squares.max(initial=0.0)
        self.flat = np.concatenate([some, squares[:, None]], axis=1)
        self.small = self.flat.astype(np.float32)

    def nearest(self, names: pa.Array, queries: np.ndarray, reach: np.ndarray) -> Iterator[pa.Table]:
        """The k nearest for each query, less those beyond ``reach`` in squared distance: ``query_id, <ids>, distance``."""
        if queries.shape[1] != self.rows.shape[1]:
            raise ValueError(knn.vx.WRONG_LENGTH)
        for lo in range(0, len(queries), _QUERIES):
            some = queries[lo : lo + _QUERIES]
            which, row, far = self._slab(some, reach[lo : lo + _QUERIES].copy())
            found = [names.take(pa.array(which + lo)), *self.ids.take(pa.array(row)).columns, pa.array(far, from_pandas=True)]
            yield pa.Table.from_arrays(found, names=["query_id", *self.ids.column_names, "distance"])

    @np.errstate(over="ignore", invalid="ignore")
    def _slab(self, queries: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        whole = np.isfinite(queries).all(axis=1)
        near = np.where(whole[:, None], queries, self.centre) - self.centre
        squares = (near * near).sum(axis=1)
        asked = np.concatenate([-2 * near, np.ones((len(near), 1))], axis=1)
        scale, unit = squares + self.most, 8 * (queries.shape[1] + 8)
        rough = bool(scale.max(initial=0.0) < 1e36)
        kept = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        pool: list[np.ndarray] = []
        width = 0

        def close(lo: int, kind: type) -> np.ndarray:
            """Places of pairs that may be among the nearest, in a matrix of queries and vectors from ``lo`` on."""
            vectors = (self.small if kind is np.float32 else self.flat)[lo : lo + _TILE]
            keys = asked.astype(kind) @ vectors.T
            slack = unit * (np.finfo(kind).eps * scale + np.finfo(kind).tiny)
            bound = limit - squares + slack
            open_ = np.isinf(limit)
            if open_.any() and len(vectors) > self.k:
                bound[open_] = np.partition(keys[open_], self.k - 1, axis=1)[:, self.k - 1] + 2 * slack[open_]
            bound[~whole] = -np.inf
            return np.flatnonzero(~(keys > bound.astype(kind)[:, None]))

        tiles = range(0, len(self.own), _TILE)
        for number, lo in enumerate(tiles, 1):
            wide = min(_TILE, len(self.own) - lo)
            hit = close(lo, np.float32) if rough else None
            if hit is None or (len(hit) > len(queries) * wide // 16 and len(hit) > 2 * self.k * len(queries)):
                hit = close(lo, np.float64)
            pool.append(np.stack([hit // wide, hit % wide + lo]))
            width += len(hit)
            if number == len(tiles) or not number & (number - 1) or width > 4 * self.k * len(queries):
                kept = self._keep(queries, np.concatenate(pool, axis=1), kept, limit)
                pool, width = [], 0
        # Distances that are not finite come last.
        held = np.bincount(kept[0], minlength=len(queries))
        alone = np.flatnonzero(~whole | (self.odd & (held < self.k) & np.isinf(limit)))
        if len(alone):
            stay = ~np.isin(kept[0], alone)
            parts = [tuple(x[stay] for x in kept)]
            for q in alone:
                far = knn._exact("l2", self.rows, queries[q])
                row = np.lexsort((np.arange(len(far)), far))[: self.k]
                parts.append((np.full(len(row), q), row, far[row]))
            return tuple(np.concatenate(x) for x in zip(*parts))
        return kept

    def _keep(self, queries: np.ndarray, pairs: np.ndarray, kept: tuple, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest of those kept and further pairs, by distance and id; ``limit`` becomes the distance of the last."""
        some = [kept]
        for at in range(0, pairs.shape[1], _PAIRS):
            which, place = pairs[:, at : at + _PAIRS]
            row = self.own[place]
            gap = self.rows[row] - queries[which]
            far = knn._in_order(gap * gap)
            fits = ~(far > limit[which])
            some.append((which[fits], row[fits], far[fits]))
        which, row, far = (np.concatenate(x) for x in zip(*some))
        order = np.lexsort((row, far, which))
        which, row, far = which[order], row[order], far[order]
        starts = np.searchsorted(which, np.arange(len(queries)))
        rank = np.arange(len(which)) - starts[which]
        last = rank == self.k - 1
        limit[which[last]] = far[last]
        first = rank < self.k
        return which[first], row[first], far[first]


def _copies(rows: np.ndarray, k: int) -> np.ndarray:
    """Rows that at least k equal rows precede, as a mask; with some luck all of them."""
    if len(rows) <= k or not rows.shape[1]:
        return np.zeros(len(rows), bool)
    factors = np.random.default_rng(7).integers(1, 1 << 62, rows.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = (np.ascontiguousarray(rows).view(np.uint64) >> np.uint64(17)) ^ np.ascontiguousarray(rows).view(np.uint64)
    code = (mixed * factors).sum(axis=1, dtype=np.uint64)
    order = np.argsort(code, kind="stable")
    out = np.zeros(len(rows), bool)
    # Between two equal ones k apart all have the same code; the values decide.
    again = order[k:][code[order[k:]] == code[order[:-k]]]
    if len(again):
        place = np.empty(len(rows), np.int64)
        place[order] = np.arange(len(rows))
        same = np.ones(len(again), bool)
        for back in range(1, k + 1):
            same &= (rows[again] == rows[order[place[again] - back]]).all(axis=1)
        out[again[same]] = True
    return out


def choose_pivots(data: DataFrame, ids: Sequence[str], rows: int) -> np.ndarray:
    """Different vectors of a bounded sample, about one for half a part of ``rows`` vectors."""
    wanted = int(min(max(16, 2 * rows // PART_ROWS), MOST_PIVOTS))
    sample = data.select("_v", F.xxhash64(*ids).alias("_h")).orderBy("_h").limit(SAMPLE)
    points = knn._matrix(sample.select("_v").toArrow().column("_v"))
    points = points[np.isfinite(points).all(axis=1)] if len(points) else points
    _, first = np.unique(points, axis=0, return_index=True)
    return points[np.sort(first)[:wanted]]


def _with_cells(data: DataFrame, pivots: Pivots) -> DataFrame:
    """``data`` with the nearest pivot and the distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = knn._matrix(batch.column("_v"))
            cell = np.zeros(len(rows), np.int32)
            for at in range(0, len(rows), _ROWS):
                cell[at : at + _ROWS] = pivots.distances(rows[at : at + _ROWS])[0].argmin(axis=1)
            gap = rows - pivots.points[cell] if len(rows) else rows
            out = [*batch.columns, pa.array(cell), pa.array(np.sqrt((gap * gap).sum(axis=1)))]
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, "_cell", "_r"])

    return data.mapInArrow(run, T.StructType([*data.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_r", T.DoubleType())]))


def _visits(pivots: Pivots, k: int, second: bool):
    """A batch's cells to look at, as a mask: those at home, or those in reach but for these."""

    def of(batch: pa.RecordBatch) -> np.ndarray:
        rows = knn._matrix(batch.column("_v"))
        masks = [np.zeros((0, len(pivots.points)), bool)]
        for at in range(0, len(rows), _ROWS):
            some = rows[at : at + _ROWS]
            home = pivots.home(some, k)
            if second:
                reach = batch.column("_reach").slice(at, _ROWS).to_numpy(zero_copy_only=False).astype(float)
                home = pivots.in_reach(some, np.where(np.isnan(reach), np.inf, reach)) & ~home
            masks.append(home)
        return np.concatenate(masks)

    return of


def _count_visits(asked: DataFrame, visits, cells: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            total += visits(batch).sum(axis=0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["cell", "n"])

    out = np.zeros(cells, np.int64)
    for row in asked.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[row["cell"]] = row["n"]
    return out


def _compare(
    corpus: DataFrame, asked: DataFrame, counts: np.ndarray, visitors: np.ndarray, visits, ids: list[str], k: int, part_rows: int, block_queries: int
) -> DataFrame:
    """``query_id, <ids>, distance``: the k nearest for every query and part of a cell that it visits.

    ``counts`` and ``visitors`` are the vectors and the queries of each cell. Queries may tell a ``_reach``.
    """
    parts = np.maximum(1, -(-counts // part_rows))
    blocks = -(-visitors // block_queries)
    # Each part of a cell and block of its queries is a group with a number, and meets in one task.
    groups = np.concatenate([[0], np.cumsum(parts * blocks)])
    kind = asked.schema["query_id"].dataType
    group, side = T.StructField("_group", T.LongType()), T.StructField("_side", T.IntegerType())
    reach = T.StructField("_reach", T.DoubleType())
    own = [T.StructField("query_id", kind), *(corpus.schema[c] for c in ids), corpus.schema["_v"], reach]
    own = [T.StructField(f.name, f.dataType, True) for f in own]
    schema = T.StructType([group, side, *own])

    def of_cell(values: np.ndarray):
        return F.get(F.array(*[F.lit(int(v)) for v in values]), F.col("_cell")).cast("long")

    part = F.pmod(F.xxhash64(*ids), of_cell(parts))
    number = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), of_cell(blocks) - 1), lambda b: of_cell(groups[:-1]) + part * of_cell(blocks) + b))
    visited = corpus.filter(of_cell(blocks) > 0)
    left = visited.select(number.alias("_group"), F.lit(0).alias("_side"), F.lit(None).cast(kind).alias("query_id"), *ids, "_v", F.lit(None).cast("double").alias("_reach"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cell = np.nonzero(visits(batch))
            if not len(row):
                continue
            own_block = (batch.column("_h").to_numpy().view(np.uint64)[row] % np.maximum(blocks[cell], 1).astype(np.uint64)).astype(np.int64)
            again = parts[cell]
            number = np.arange(int(again.sum())) - np.repeat(np.cumsum(again) - again, again)
            row, cell, own_block = np.repeat(row, again), np.repeat(cell, again), np.repeat(own_block, again)
            place = groups[cell] + number * blocks[cell] + own_block
            told = batch.column("_reach") if "_reach" in batch.schema.names else pa.nulls(batch.num_rows, pa.float64())
            for at in range(0, len(row), 4096):
                take = pa.array(row[at : at + 4096])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place[at : at + 4096]), batch.column("query_id").take(take), batch.column("_v").take(take), told.take(take)],
                    ["_group", "query_id", "_v", "_reach"],
                )

    sent = asked.mapInArrow(send, T.StructType([group, own[0], own[-2], own[-1]]))
    right = sent.select("_group", F.lit(1).alias("_side"), "query_id", *[F.lit(None).cast(corpus.schema[c].dataType).alias(c) for c in ids], "_v", "_reach")
    total, cores = max(int(groups[-1]), 1), corpus.sparkSession.sparkContext.defaultParallelism
    tasks = min(total, max(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), cores * TASKS_PER_CORE))
    dealt = left.union(right).repartitionById(tasks, F.pmod(F.col("_group"), F.lit(tasks)).cast("int")).sortWithinPartitions("_group", "_side")
    out_schema = knn.topk_schema(corpus, ids, kind)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out_schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, part = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            key = np.stack([table.column(c).to_numpy() for c in ("_group", "_side")], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                if start == stop:
                    continue
                run_rows = table.slice(start, stop - start)
                if key[start, 0] != at:
                    at, held, part = key[start, 0], [], None
                if key[start, 1] == 0:
                    held.append(run_rows.select([*ids, "_v"]))
                elif held:
                    if part is None:
                        part, held = Part(pa.concat_tables(held), ids, k), [None]
                    reach = run_rows.column("_reach").to_numpy().astype(float)
                    # A root, squared, may be a little less than it was.
                    limit = np.where(np.isnan(reach), np.inf, reach * reach * (1 + 1e-12))
                    for found in part.nearest(run_rows.column("query_id").combine_chunks(), knn._matrix(run_rows.column("_v")), limit):
                        yield from found.cast(arrow).to_batches()

    return dealt.select(*[f.name for f in schema.fields]).mapInArrow(run, out_schema)


def knn_join(
    corpus: DataFrame, queries: DataFrame, k: int, ids: Sequence[str] = ("vec_id",), vector: str = "embedding",
    part_rows: int = PART_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """k nearest vectors by squared L2 for each row ``query_id, <vector>``: ``query_id, rank, <ids>, distance``.

    Neither side has to fit anywhere; results are those of ``knn_batch``, ties by id. Null vectors
    of either side are left out; another length than the corpus's is an error. ``query_id`` is unique.
    Where distances do not tell cells apart, as between random directions of many dimensions, every query
    is compared with every vector: it is then copied once for every large part of the corpus, and that once for every block.
    """
    knn._check_k(k)
    ids = list(ids)
    both = (corpus.schema[vector].dataType, queries.schema[vector].dataType)
    kind = "array<float>" if all(isinstance(t, T.ArrayType) and t.elementType == T.FloatType() for t in both) else "array<double>"
    data = corpus.filter(F.col(vector).isNotNull()).select(*ids, F.col(vector).cast(kind).alias("_v"))
    asked = queries.filter(F.col(vector).isNotNull()).select("query_id", F.col(vector).cast(kind).alias("_v"))
    asked = settle(asked.withColumn("_h", F.xxhash64("query_id")), "queries")
    data = settle(data, "vectors")
    points = choose_pivots(data, ids, data.count())
    empty = np.zeros(len(points))
    pivots = Pivots(points, empty.astype(np.int64), empty, empty)
    if not len(points):
        none = data.limit(0).withColumn("query_id", F.lit(None).cast(asked.schema["query_id"].dataType))
        return none.select("query_id", F.lit(None).cast("int").alias("rank"), *ids, F.lit(None).cast("double").alias("distance"))
    cells = settle(_with_cells(data, pivots), "cells")
    counts, least, most = np.zeros(len(points), np.int64), empty.copy(), empty.copy()
    for row in cells.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.min("_r").alias("least"), F.max("_r").alias("most")).collect():
        counts[row["_cell"]], least[row["_cell"]], most[row["_cell"]] = row["n"], row["least"], row["most"]
    # A vector that is not finite makes its cell's distances unknown.
    pivots = replace(pivots, counts=counts, least=np.where(np.isfinite(most), least, 0.0), most=np.where(np.isfinite(most), most, np.inf))

    visits = _visits(pivots, k, False)
    first = _compare(cells, asked, counts, _count_visits(asked, visits, len(points)), visits, ids, k, part_rows, block_queries)
    first = settle(knn._ranked(first, ids, "l2", k).drop("rank"), "first-hits")
    # Fewer than k hits: everything is in reach.
    reach = first.groupBy("query_id").agg(F.when(F.count("distance") >= k, F.sqrt(F.max("distance"))).alias("_reach"))
    further = settle(asked.join(reach, "query_id"), "reach")
    visits = _visits(pivots, k, True)
    visitors = _count_visits(further, visits, len(points))
    queries_asked = further.count()
    if visitors @ counts > DENSE * queries_asked * counts.sum():
        # The fewest copies are made by about as many parts as blocks.
        total, tasks = int(counts.sum()), TASKS_PER_CORE * data.sparkSession.sparkContext.defaultParallelism
        most = min(DENSE_PARTS * part_rows, HELD_BYTES // (8 * max(points.shape[1], 1)))
        rows = max(part_rows, min(most, -(-total // int(np.sqrt(tasks)))))
        block = min(block_queries, max(1, -(-queries_asked // -(-tasks // -(-total // rows)))))
        one, all_rows, everyone = cells.withColumn("_cell", F.lit(0)), np.array([total]), np.array([queries_asked])
        found = _compare(one, further, all_rows, everyone, lambda batch: np.ones((batch.num_rows, 1), bool), ids, k, rows, block)
    else:
        found = first.unionByName(_compare(cells, further, counts, visitors, visits, ids, k, part_rows, block_queries))
    return knn._ranked(found, ids, "l2", k).select("query_id", "rank", *ids, "distance")
