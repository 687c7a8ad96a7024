"""Near-duplicate vectors by a forest of random-projection trees.

A tree splits the vectors along a random direction per level, each node at the median of a
bounded sample; below the sample's reach, at a random point. Vectors within ``SPILL`` of a
split go to both sides, so that close pairs rarely part. Vectors are compared within leaves
of every tree, pairs are verified in double precision, and united to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindling.cluster import settle
from kindling.llm.components import components

TREES = 6
LEAF = 512
# Half-width of the overlap around a split, as a share of the allowed distance of two vectors.
SPILL = 0.15
# Vectors that the split points are fitted on, about; all vectors are indexed.
SAMPLE = 32_768
# A leaf of more rows, as close copies can make it, is compared by pairs of blocks of this size.
BLOCK = 2048
SEED = 20_240_611


class Forest:
    """Directions by tree and level, and split points by tree and node."""

    def __init__(self, sample: np.ndarray, dimensions: int, depth: int, spill: float, trees: int = TREES, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.depth, self.spill, self.seed = depth, spill, seed
        directions = rng.standard_normal((trees, dimensions, depth))
        self.directions = directions / np.linalg.norm(directions, axis=1, keepdims=True)
        self.scale = 1 / max(dimensions, 1) ** 0.5
        self.splits: list[np.ndarray] = []
        for tree in range(trees):
            projected = sample @ self.directions[tree] if len(sample) else np.zeros((0, depth))
            node = np.ones(len(sample), np.int64)
            splits = [np.zeros(0)]
            for level in range(depth):
                if len(sample) < 32 << level:
                    break
                own = np.full(2 << level, np.nan)
                order = np.argsort(node, kind="stable")
                for rows in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                    own[node[rows[0]]] = np.median(projected[rows, level])
                splits.append(own)
                node = 2 * node + (projected[:, level] > own[node])
            self.splits.append(splits[1:])

    def _split(self, tree: int, level: int, node: np.ndarray) -> np.ndarray:
        known = self.splits[tree]
        at = known[level][node] if level < len(known) else np.full(len(node), np.nan)
        unknown = np.isnan(at)
        if unknown.any():
            # A point that depends on the node alone, about normal like the projections.
            x = node[unknown].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.seed + tree)
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            parts = [(x >> np.uint64(16 * k) & np.uint64(0xFFFF)).astype(np.float64) / 65536 - 0.5 for k in range(4)]
            at[unknown] = sum(parts) * 3**0.5 * self.scale
        return at

    def leaves(self, tree: int, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaves; a row in an overlap has several."""
        projected = unit @ self.directions[tree]
        rows, node = np.arange(len(unit)), np.ones(len(unit), np.int64)
        for level in range(self.depth):
            offset = projected[rows, level] - self._split(tree, level, node)
            left, right = offset <= self.spill, offset >= -self.spill
            rows, node = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        return rows, node


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(len(column), dimensions).astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] if len(x) else x


def _usable(vector: Column, dimensions: int) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == dimensions) & finite & F.exists(vector, lambda v: v != 0)


_PAIRS = "a long, b long"


def _compare(threshold: float, dimensions: int):
    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids = group["id"].to_numpy()
        ids, first = np.unique(ids, return_index=True)
        side = group["side"].to_numpy()[first]
        unit = _matrix(group["vector"].chunk(0).take(pa.array(first)) if len(first) else pa.array([], pa.list_(pa.float64())), dimensions)
        a, b = [], []
        for at in range(0, len(ids), 512):
            near = unit[at : at + 512] @ unit.T
            i, j = np.nonzero(near >= threshold - 1e-9)
            i = i + at
            # Block pairs: only across the two blocks, unless they are one.
            keep = (i < j) & ((side[i] != side[j]) | (side[i] == 0) & (side[j] == 0))
            i, j = i[keep], j[keep]
            exact = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
            a.append(ids[i[exact]])
            b.append(ids[j[exact]])
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([*a, none]), "b": np.concatenate([*b, none])})

    return compare


def near_pairs(classes: DataFrame, dimensions: int, threshold: float) -> DataFrame:
    """(a, b), a < b: ids of different vectors of one label with cosine at or above the threshold.

    ``classes`` has id, label and vector, all valid. Every pair is verified; a pair that no
    tree puts into one leaf is missed, which the overlap makes rare.
    """
    largest = classes.groupBy("label").count().agg(F.max("count"), F.sum("count")).first()
    if not largest[0]:
        return classes.sparkSession.createDataFrame([], _PAIRS)
    depth = int(max(0, np.ceil(np.log2(largest[0] / LEAF))))
    chosen = classes.select("vector")
    if largest[1] > SAMPLE:
        steps = 1 << 30
        chosen = classes.filter(F.pmod(F.xxhash64("id"), F.lit(steps)) < int(SAMPLE / largest[1] * steps)).select("vector")
    # About SAMPLE vectors, whatever the table.
    sample = chosen.toArrow()["vector"].combine_chunks()
    sample = _matrix(sample.chunk(0) if isinstance(sample, pa.ChunkedArray) else sample, dimensions)
    distance = (2 - 2 * threshold) ** 0.5
    forest = classes.sparkSession.sparkContext.broadcast(Forest(sample, dimensions, depth, SPILL * distance))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _matrix(batch.column(2), dimensions)
            for tree in range(TREES):
                rows, node = forest.value.leaves(tree, unit)
                take = pa.array(rows)
                columns = [pa.array(np.full(len(rows), tree, np.int32)), pa.array(node), *(batch.column(k).take(take) for k in range(3))]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "node", "id", "label", "vector"])

    kind = classes.schema["label"].dataType.simpleString()
    placed = classes.select("id", "label", F.col("vector").cast("array<double>").alias("vector"))
    placed = placed.mapInArrow(place, f"tree int, node long, id long, label {kind}, vector array<double>")
    leaf = ["tree", "node", "label"]
    # Leaves that stay large: one row per block, few for each tree.
    sizes = placed.drop("vector").groupBy(*leaf).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sizes = settle(sizes.filter("blocks > 1"), "large-leaves").select(*[F.col(c).alias(f"of_{c}") for c in leaf], "blocks")
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in leaf]
    placed = placed.join(sizes, same[0] & same[1] & same[2], "left")
    blocks, own = F.coalesce("blocks", F.lit(1)), F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda k: F.struct(F.least(own, k).alias("low"), F.greatest(own, k).alias("high"), F.when(own == k, 0).when(own < k, 1).otherwise(2).alias("side")),
    )
    dealt = placed.select(*leaf, "id", "vector", F.explode(others).alias("at"))
    dealt = dealt.select(*leaf, "id", "vector", F.col("at.low").alias("low"), F.col("at.high").alias("high"), F.col("at.side").alias("side"))
    found = dealt.groupBy(*leaf, "low", "high").applyInArrow(_compare(threshold, dimensions), _PAIRS)
    return found.distinct()


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per vector: key, n_links, component_id (least key reachable by links) and kept.

    Vectors link when their labels are equal and not null and their cosine is at least the
    threshold. Null, zero, non-finite vectors, those with null components or of another length than
    most, and null labels link with nothing. Equal vectors of one label are one class and compared once. Keys are
    integers; null keys get no links and a null component and are kept. An empty table gives no rows.
    """
    own = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    most = own.filter("vector is not null").groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dimensions = most["d"] if most else 1
    valid = own.filter(_usable(F.col("vector"), dimensions) & F.col("label").isNotNull() & F.col("id").isNotNull())
    classes = valid.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"))
    classes = settle(classes, "vector-classes")
    links = settle(near_pairs(classes.select("id", "label", "vector"), dimensions, threshold), "vector-links")
    sizes = classes.select(F.col("id").alias("of"), "size")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(sizes, F.col("b") == F.col("of")).groupBy("a").agg(F.sum("size").alias("others"))
    found = components(links, "a", "b").withColumnRenamed("node", "member")
    told = classes.join(counted, F.col("id") == F.col("a"), "left").join(found, F.col("id") == F.col("member"), "left")
    told = told.select("label", "vector", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    # Both sides are plain shuffles, so that Spark can split a class of very many copies.
    told = settle(told, "vector-answers")
    out = valid.join(told, ["label", "vector"]).select("id", "n_links", "component_id")
    rest = own.filter(~(_usable(F.col("vector"), dimensions) & F.col("label").isNotNull() & F.col("id").isNotNull()) | F.col("vector").isNull())
    out = out.unionByName(rest.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return out.select(F.col("id").alias(key), "n_links", "component_id", kept.alias("kept"))
