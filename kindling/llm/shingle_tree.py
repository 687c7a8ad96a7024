"""Near-duplicate texts by an exact Jaccard join of word shingles over count-vector R-trees.

A text is its set of hashed word shingles. Hashing shingles into groups and counting them per
group makes it a point; the overlap of two sets is at most the sum of their points' smaller
coordinates. Points are packed into R-trees, whose boxes bound that sum for all below
them, and the surviving pairs are verified on the sets.

A tree holds the texts that share shingles, not the table: of a text's shingles, ordered by
an estimate of how common they are, only a beginning is looked at. Its length makes sure
that two similar texts share a certain number there (prefix filter). No estimate decides
about a pair; it only orders. Texts too few of whose first shingles occur elsewhere
are left out at once, so that most sets never leave the task that made them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindling.cluster import broadcast_if_small, settle
from kindling.llm.components import components
from kindling.llm.sizes import table_bytes
from kindling.llm.worker_memory import forget, tidy

SHINGLE = 5
PERCENT = 75  # texts link when 100 * intersection >= PERCENT * union

# Cells of the estimate of how common shingles are: a fixed table, whatever the corpus.
CELLS = 1 << 19
_CELL_SHIFT = np.uint64(64 - 19)
# Members that one task compares at a time with a group's leader and each other.
BLOCK = 512
# Bytes of documents for one bucket of first shingles.
BUCKET_BYTES = 8 << 20
_PIECE = 1 << 20

# --- sets ------------------------------------------------------------------------

_RNG = np.random.default_rng(7_031)
_BYTE = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 64)
        steps = np.full(size, _BASE, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word; A to Z count as a to z."""
    codes = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[codes]
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    lengths = ends - starts
    letters = codes[inside]
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    values = _BYTE[letters] * _power(int(lengths.max()))[place]
    return starts, _mix(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def _pieces(data: bytes) -> Iterator[bytes]:
    """A text in pieces of about 1 MB that end at white space."""
    at = 0
    while len(data) - at > 2 * _PIECE:
        end = at + _PIECE
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def _set_of(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct shingles, sorted; of fewer words than a shingle, all of them as one."""
    if not len(words):
        return words
    span = min(size, len(words))
    total = np.zeros(len(words) - span + 1, np.uint64)
    for k in range(span):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - span + 1 + k]
    return np.unique(_mix(total + np.uint64(span)))


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The set of every text, as a sorted array; texts without words have an empty one."""
    encoded = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    at = 0
    while at < len(encoded):
        end, n = at, 0
        while end < len(encoded) and (end == at or n + len(encoded[end]) < _PIECE):
            n += len(encoded[end]) + 1
            end += 1
        if end == at + 1:
            parts = [_word_hashes(p)[1] for p in _pieces(encoded[at])]
            yield _set_of(np.concatenate(parts), size)
        else:
            starts, words = _word_hashes(b" ".join(encoded[at:end]))
            edges = np.cumsum([0, *(len(e) + 1 for e in encoded[at:end])])
            cuts = np.searchsorted(starts, edges)
            for k in range(end - at):
                yield _set_of(words[cuts[k] : cuts[k + 1]], size)
        at = end


# --- what two similar sets have to share -----------------------------------------


def _least_overlap(n: Column | np.ndarray | int):
    """A set of n shares at least this many with any similar set."""
    return -(-PERCENT * n // 100)


def first_shingles(own: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The beginning of a set in order of level, then hash; and those shingles' levels.

    Of two similar sets of sizes n and m, at least min(n, m) // 10 + 1 common
    shingles are in the beginnings of both.
    """
    n = len(own)
    level = levels[own >> _CELL_SHIFT]
    order = np.lexsort((own, level))[: n - int(_least_overlap(n)) + n // 10 + 1]
    return own[order], level[order]


def _enough(n: Column) -> Column:
    """Shared first shingles that a set needs: a partner may be a quarter smaller."""
    return F.floor(n * 75 / 1000) + 1


def point_of(own: np.ndarray) -> np.ndarray:
    """Counts of a set's shingles by group: about as many groups as half its size."""
    groups = 64
    while groups * 4 <= len(own):
        groups *= 2
    return np.bincount((own >> np.uint64(8)).astype(np.int64) & (groups - 1), minlength=groups).astype(np.int32)


def _folded(point: np.ndarray, groups: int) -> np.ndarray:
    return point.reshape(-1, groups).sum(0)


class CountTree:
    """An R-tree of points, packed in order of size and coordinates."""

    FAN = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        order = np.lexsort((points[:, 0], sizes)) if len(sizes) else np.zeros(0, np.int64)
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        top, least = self.points, self.sizes
        self.levels = []
        while len(least) > 1:
            cuts = np.arange(0, len(least), self.FAN)
            top, least = np.maximum.reduceat(top, cuts, axis=0), np.minimum.reduceat(least, cuts)
            self.levels.append((top, least))

    def candidates(self, point: np.ndarray, size: int) -> np.ndarray:
        """Entries whose overlap with a set may be large enough, by the sum of smaller coordinates."""
        chosen = np.arange(1) if self.levels else np.arange(len(self.sizes))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, least = self.levels[depth]
            chosen = chosen[self._passes(np.minimum(top[chosen], point).sum(1), np.minimum(least[chosen], size), size, True)]
            below = self.levels[depth - 1][1] if depth else self.sizes
            chosen = (chosen[:, None] * self.FAN + np.arange(self.FAN)).ravel()
            chosen = chosen[chosen < len(below)]
        sums = np.minimum(self.points[chosen], point).sum(1)
        return self.order[chosen[self._passes(sums, self.sizes[chosen], size, False)]]

    @staticmethod
    def _passes(overlap: np.ndarray, other: np.ndarray, size: int, box: bool) -> np.ndarray:
        # 100 * overlap >= PERCENT * union, and union = both sizes - overlap.
        fits = (100 + PERCENT) * overlap >= PERCENT * (other + size)
        return fits if box else fits & (100 * np.minimum(other, size) >= PERCENT * np.maximum(other, size))


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def link_locally(sets: list[np.ndarray], points: list[np.ndarray], sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is similar: verified pairs, none inside a component that is already joined.

    With ``sides`` only pairs of different sides are looked at.
    """
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    groups = min((len(p) for p in points), default=64)
    grid = np.array([_folded(p, groups) for p in points]).reshape(len(points), groups)
    tree = CountTree(grid, np.array([len(s) for s in sets], np.int64))
    out = []
    for i in range(len(sets)):
        for j in tree.candidates(grid[i], len(sets[i])).tolist():
            if j < i and (sides is None or sides[i] != sides[j]):
                a, b = find(i), find(j)
                if a != b and _linked(sets[i], sets[j]):
                    root[max(a, b)] = min(a, b)
                    out.append((i, j))
    return out


# --- passes over the texts ---------------------------------------------------------


def _sizes_and_cells(size: int):
    """Per text: key, set size, digest; at a task's end, how many shingles fell into each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            n, digests = [], []
            for own in shingle_sets(batch.column(1).to_pylist(), size):
                n.append(len(own))
                digests.append(hashlib.md5(own.tobytes()).digest() if len(own) else None)
                np.add.at(cells, own >> _CELL_SHIFT, 1)
            none = pa.nulls(len(n), pa.binary())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.nulls(len(n), pa.int32()), none]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "digest", "part", "cells"])
        parts = cells.astype("<u4").reshape(32, -1)
        columns = [pa.nulls(32, pa.int64()), pa.nulls(32, pa.int64()), pa.nulls(32, pa.binary()), pa.array(range(32), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["key", "n", "digest", "part", "cells"])

    return run


def _add_cells(part: pa.Table) -> pa.Table:
    total = np.zeros(CELLS // 32, np.int64)
    for c in part["cells"].to_pylist():
        total += np.frombuffer(c, "<u4")
    return pa.table({"part": pa.array(part["part"].to_pylist()[:1], pa.int32()), "cells": pa.array([total.astype("<i8").tobytes()], pa.binary())})


def _levels(told: DataFrame) -> np.ndarray:
    """How common each cell's shingles are: 0 for an ordinary cell, then by doublings above."""
    # Tasks add up their cells by part first, many parts of few tasks each.
    rows = told.filter("part is not null").select("part", "cells").groupBy("part").applyInArrow(_add_cells, "part int, cells binary").collect()
    cells = np.zeros((32, CELLS // 32), np.int64)
    for row in rows:
        cells[row["part"]] = np.frombuffer(row["cells"], "<i8")
    cells = cells.ravel()
    usual = np.median(cells)
    beyond = np.maximum(cells - usual - 6 * usual**0.5, 0)
    return np.where(beyond < 16, 0, np.log2(np.maximum(beyond, 1))).astype(np.uint8)


_FIRST = "bucket int, shingles binary, places binary, keys binary, sizes binary"


def _deal_first_shingles(levels, size: int, buckets: int):
    """First shingles in binary blocks by bucket; common ones are dealt by text, too, so that none is hot."""

    def blocks(keys: list[int], sizes: list[int], firsts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        place = np.repeat(np.arange(len(keys)), [len(f) for f, _ in firsts])
        shingles = np.concatenate([f for f, _ in firsts])
        common = np.concatenate([c for _, c in firsts]) > 0
        bucket = (_mix(shingles) % np.uint64(buckets)).astype(np.int64)
        key = np.array(keys, np.int64)
        dealt = (_mix(shingles ^ _mix(key.view(np.uint64)[place])) % np.uint64(buckets)).astype(np.int64)
        bucket = np.where(common, buckets + dealt, bucket)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        rows = []
        for rows_of in np.split(order, cuts):
            used, own = np.unique(place[rows_of], return_inverse=True)
            rows.append((int(bucket[rows_of[0]]), shingles[rows_of].tobytes(), own.astype("<u2").tobytes(), key[used].tobytes(), np.array(sizes, np.int64)[used].astype("<u4").tobytes()))
        names = ["bucket", "shingles", "places", "keys", "sizes"]
        kinds = [pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(5)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        keys, sizes, firsts, held = [], [], [], 0
        for batch in batches:
            for key, own in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), size), strict=True):
                if key is None or not len(own):
                    continue
                keys.append(key)
                sizes.append(len(own))
                firsts.append(first_shingles(own, levels.value))
                held += len(firsts[-1][0])
                if held >= 1 << 20 or len(keys) == 1 << 16:
                    yield blocks(keys, sizes, firsts)
                    keys, sizes, firsts, held = [], [], [], 0
        if keys:
            yield blocks(keys, sizes, firsts)

    return run


def _repeated(buckets: int):
    """Shingles of a bucket that several texts have among their first; common ones all."""

    def run(part: pa.Table) -> pa.Table:
        shingles, keys, sizes = [], [], []
        for s, p, k, n in zip(*(part[c].to_pylist() for c in ("shingles", "places", "keys", "sizes")), strict=True):
            place = np.frombuffer(p, "<u2")
            shingles.append(np.frombuffer(s, np.uint64))
            keys.append(np.frombuffer(k, np.int64)[place])
            sizes.append(np.frombuffer(n, "<u4")[place])
        shingles, keys, sizes = np.concatenate(shingles), np.concatenate(keys), np.concatenate(sizes)
        if part["bucket"][0].as_py() < buckets:
            order = np.argsort(shingles, kind="stable")
            own = shingles[order]
            same = own[1:] == own[:-1]
            keep = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
            shingles, keys, sizes = shingles[keep], keys[keep], sizes[keep]
        return pa.table({"shingle": shingles.view(np.int64), "key": keys, "n": sizes.astype(np.int64)})

    return run


# Sets that leave a worker together.
_TOGETHER = 1000


def _points(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for at in range(0, len(batch), _TOGETHER):
                some = batch.slice(at, _TOGETHER)
                sets = list(shingle_sets(some.column(1).to_pylist(), size))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "own"])
            tidy()

    return run


def _link_group(group: pa.Table) -> pa.Table:
    keys = group["key"].to_numpy()
    keys, first = np.unique(keys, return_index=True)
    sets = [np.frombuffer(group["own"][int(i)].as_py(), np.uint64) for i in first]
    across = group["low"][0] != group["high"][0]
    found = link_locally(sets, [point_of(s) for s in sets], group["side"].to_numpy()[first] if across else None)
    a, b = ([int(keys[pair[k]]) for pair in found] for k in range(2))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


# --- the join ------------------------------------------------------------------------


def _shared_only(first: DataFrame) -> DataFrame:
    """First shingles that several texts have, of texts that have enough of those."""
    several = first.groupBy("shingle").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high").select("shingle")
    # Written down, so that both sides of the join are plain shuffles, whose hot keys Spark splits.
    first = first.join(settle(several, "several"), "shingle", "left_semi")
    enough = first.groupBy("key", "n").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= _enough(F.col("n"))).select("key")
    return settle(first.join(settle(enough, "enough"), "key", "left_semi"), "first-shingles")


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n) / F.log(F.lit(100 / PERCENT)))


def similar_texts(docs: DataFrame, key: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """Per row: key, n_shingles and component_id, the least key that links reach, itself included.

    Texts link when their sets of shingles of ``size`` words have a Jaccard similarity of at least
    0.75, exactly. Null and empty texts and those without words have no shingles and link
    with nothing. Keys are integers; rows that repeat a key are one node; a null key has a
    null component. An empty table gives no rows. Other columns are not looked at.
    """
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text_col}`").alias("text"))
    told = texts.mapInArrow(_sizes_and_cells(size), "key long, n long, digest binary, part int, cells binary")
    told = settle(told, "shingle-sizes")
    rows = told.filter("part is null").select("key", "n", "digest")
    # Equal sets are one class, which its least key stands for.
    classes = rows.filter("n > 0 and key is not null").groupBy("digest").agg(F.min("key").alias("key"))
    classes = settle(classes, "set-classes")

    sc = docs.sparkSession.sparkContext
    buckets = max(sc.defaultParallelism * 4, int(table_bytes(docs) // BUCKET_BYTES))
    levels = sc.broadcast(_levels(told))
    first = texts.mapInArrow(_deal_first_shingles(levels, size, buckets), _FIRST)
    first = settle(first.groupBy("bucket").applyInArrow(_repeated(buckets), "shingle long, key long, n long"), "repeated")
    first = _shared_only(first.join(classes.select("key"), "key", "left_semi").distinct())
    first = _shared_only(first)

    wanted = settle(first.select("key").distinct(), "wanted")
    sets = texts.join(broadcast_if_small(wanted), "key", "left_semi").mapInArrow(_points(size), "key long, own binary")
    sets = settle(sets.dropDuplicates(), "sets")

    found = components(_links_of_leaders(first, sets), "a", "b")

    named = classes.join(found, classes["key"] == found["node"], "left")
    named = settle(named.select("digest", F.coalesce("component", "key").alias("component_id")), "named")
    alike = rows.filter("n > 0 and key is not null").join(named, "digest").select("key", "n", "component_id")
    alone = rows.filter("n = 0 or key is null").select("key", "n", F.col("key").alias("component_id"))
    out = alike.unionByName(alone)
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def _links_of_leaders(first: DataFrame, sets: DataFrame) -> DataFrame:
    """Links within the groups of texts that share a shingle with a leader of about their size.

    Two similar texts share a first shingle, whose leader has both in its group. A group of
    several blocks is compared by pairs of blocks, each in a task of its own.
    """
    own = _size_class(F.col("n"))
    # Sizes that fit differ by one class at most.
    spread = first.withColumn("of", F.explode(F.array(own, own + 1)))
    leaders = settle(spread.groupBy("shingle", "of").agg(F.min("key").alias("leader")), "leaders")
    pairs = settle(spread.join(leaders, ["shingle", "of"]).filter("key != leader").select("leader", "key").distinct(), "candidates")
    counts = pairs.groupBy("leader").agg(F.ceil((F.count(F.lit(1)) + 1) / BLOCK).cast("int").alias("blocks"))
    counts = settle(counts, "group-sizes")
    members = pairs.join(counts, "leader").unionByName(counts.select("leader", F.col("leader").alias("key"), "blocks"))
    block = F.pmod(F.xxhash64("key"), "blocks").cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(block, k).alias("low"), F.greatest(block, k).alias("high"))
    )
    dealt = members.select("leader", "key", block.alias("side"), F.explode(others).alias("at"))
    grouped = dealt.select("leader", "key", "side", "at.low", "at.high").join(sets, "key")
    return settle(grouped.groupBy("leader", "low", "high").applyInArrow(_link_group, "a long, b long"), "leader-links")
