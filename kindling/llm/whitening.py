"""Whitening of vectors by singular values of a bidiagonal matrix.

Tasks reduce their centred rows to triangular factors, block by block; factors are joined by
sixteens until one is left, so no covariance is ever formed. That one matrix of
dimensions x dimensions is bidiagonalised by reflections, its singular values are found by
shifted quotient-difference steps (dqds), and every direction comes from a twisted
factorisation. All rows are read three times and nothing of them is shuffled.

An entry c counts as floor(64 c) + 1000000. A vector that is shorter than the longest one counts
as if zeros followed; entries beyond 2**34 either way count as that bound. A task holds a
square of doubles as wide as the longest vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, OFFSET, LIMIT = 64.0, 1_000_000, float(1 << 40)
COMPONENTS = 32
# Triangular factors that one task joins.
FAN_IN = 16
EXACT = T.DecimalType(38, 0)


# --- the matrix: singular values and directions ------------------------------------


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v and b so that (1 - b v v') x has zeros behind its first place."""
    v = x.copy()
    size = np.linalg.norm(x)
    if size == 0:
        return v, 0.0
    v[0] += math.copysign(size, x[0])
    return v, 2.0 / (v @ v)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and right basis W of a square matrix r = U B W'."""
    a, d = r.astype(float), r.shape[0]
    right = np.eye(d)
    for k in range(d - 1):
        v, b = _reflector(a[k:, k])
        a[k:, k:] -= b * np.outer(v, v @ a[k:, k:])
        if k < d - 2:
            v, b = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= b * np.outer(a[k:, k + 1 :] @ v, v)
            right[:, k + 1 :] -= b * np.outer(right[:, k + 1 :] @ v, v)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), right


def _safe_shift(q: list[float], e: list[float]) -> float:
    """One Newton step from zero towards the least eigenvalue; it never passes it."""
    p = q[-1]
    total = 1.0 / p
    for i in range(len(q) - 2, -1, -1):
        p *= q[i] / (e[i] + p)
        total += 1.0 / p
    return (1.0 - 1e-14 * len(q)) / total


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """A quotient-difference step with a shift; None where the shift was too large."""
    d = q[0] - shift
    new_q, new_e = [], []
    for i in range(len(e)):
        if d < 0:
            return None
        new_q.append(d + e[i])
        ratio = q[i + 1] / new_q[-1]
        new_e.append(e[i] * ratio)
        d = d * ratio - shift
    return (new_q + [d], new_e) if d >= 0 else None


def squared_values(q: list[float], e: list[float]) -> list[float]:
    """Squared singular values, falling, of the bidiagonal matrix with squares q beside e."""
    found, blocks = [], [(list(map(float, q)), list(map(float, e)), 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        while len(q) > 1:
            # What is far below the precision of the values cuts the matrix in two.
            for i in range(len(e) - 1, -1, -1):
                small = 1e-17 * (moved + min(q[i], q[i + 1]))
                if e[i] <= small and e[i] * q[i] <= small * small:
                    blocks.append((q[: i + 1], e[:i], moved))
                    q, e = q[i + 1 :], e[i + 1 :]
                    break
            else:
                if 4 * q[0] < q[-1]:
                    q, e = q[::-1], e[::-1]
                shift = _safe_shift(q, e) if min(q) > 0 else 0.0
                if shift < 1e-18 * moved:
                    shift = 0.0
                while (stepped := _step(q, e, shift)) is None:
                    shift = shift / 2 if shift > 1e-300 else 0.0
                q, e = stepped
                moved += shift
        found.append(moved + q[0])
    return sorted(found, reverse=True)


class _Twisted(NamedTuple):
    """Factors of B'B - value from above (lower, down) and from below (upper, up), and where they meet."""

    lower: list[float]
    down: list[float]
    upper: list[float]
    up: list[float]
    at: int
    gamma: float


def _twisted(a2: list[float], ratio: list[float], value: float) -> _Twisted:
    """Where a2 are squares of the diagonal and ratio the upper diagonal over the diagonal."""
    d = len(a2)
    tiny = 1e-32 * max(a2)
    lower, down, upper, up = [0.0] * d, [0.0] * d, [0.0] * d, [0.0] * d
    above, below = [0.0] * d, [0.0] * d
    s = -value
    for i in range(d):
        above[i] = s
        down[i] = s + a2[i] or tiny
        if i < d - 1:
            lower[i] = a2[i] * ratio[i] / down[i]
            s = lower[i] * ratio[i] * s - value
    p = a2[-1] - value
    for i in range(d - 1, -1, -1):
        below[i] = p
        if i:
            coupling = a2[i - 1] * ratio[i - 1] * ratio[i - 1]
            if coupling + p == 0:
                p += tiny
            up[i] = coupling + p or tiny
            t = a2[i - 1] / up[i]
            upper[i - 1] = ratio[i - 1] * t
            p = p * t - value
    gammas = [above[i] + below[i] + value for i in range(d)]
    at = min(range(d), key=lambda i: abs(gammas[i]) if gammas[i] == gammas[i] else math.inf)
    return _Twisted(lower, down, upper, up, at, gammas[at] or tiny)


def _solve(f: _Twisted, right_side: np.ndarray | None = None) -> np.ndarray:
    """The solution for a right side; without one the vector with 1 where the factors meet, nearest to null."""
    d, r = len(f.down), f.at
    w = [0.0] * d
    w[r] = 1.0
    if right_side is not None:
        w = [float(x) for x in right_side]
        for i in range(1, r + 1):
            w[i] -= f.lower[i - 1] * w[i - 1]
        for i in range(d - 2, r - 1, -1):
            w[i] -= f.upper[i] * w[i + 1]
        w = [x / (f.down[i] if i < r else f.up[i] if i > r else f.gamma) for i, x in enumerate(w)]
    for i in range(r - 1, -1, -1):
        w[i] -= f.lower[i] * w[i + 1]
    for i in range(r + 1, d):
        w[i] -= f.upper[i - 1] * w[i - 1]
    x = np.array(w)
    x /= np.abs(x).max()
    return x / np.linalg.norm(x)


def directions(diagonal: np.ndarray, upper: np.ndarray, values: list[float], count: int) -> np.ndarray:
    """Orthonormal eigenvectors of B'B as columns, for the largest ``count`` of its eigenvalues.

    Values nearer than a thousandth of their size form a cluster, whose vectors are made
    orthogonal by repeated solving.
    """
    a2 = [float(x) for x in diagonal * diagonal]
    ratio = [float(x) for x in upper / diagonal[:-1]]
    rng = np.random.default_rng(0)
    out = np.zeros((len(a2), count))
    first = 0
    for j in range(count):
        if j and values[j - 1] - values[j] > 1e-3 * values[j - 1]:
            first = j
        x = _solve(_twisted(a2, ratio, values[j]))
        if first < j:
            # A little beside the value, all that equal it grow alike and none is lost.
            cluster, beside = out[:, first:j], _twisted(a2, ratio, values[j] * (1 + 1e-13))
            for _ in range(6):
                for _ in range(2):
                    x -= cluster @ (cluster.T @ x)
                size = np.linalg.norm(x)
                if size > 1 - 1e-12:
                    break
                if size < 0.1:
                    x = rng.standard_normal(len(a2))
                    x -= cluster @ (cluster.T @ x)
                x = _solve(beside, x / np.linalg.norm(x))
            for _ in range(2):
                x -= cluster @ (cluster.T @ x)
        out[:, j] = x / np.linalg.norm(x)
    return out


def principal(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of r above its precision, falling, at most ``count``, and right vectors as columns."""
    d = r.shape[1]
    scale = np.abs(r).max() if r.size else 0.0
    if scale == 0:
        return np.zeros(0), np.zeros((d, 0))
    square = np.zeros((d, d))
    square[: r.shape[0]] = r / scale
    diagonal, upper, right = bidiagonal(square)
    # A zero on the diagonal has no quotients; this is far below the precision of the largest value.
    least = 1e-20 * max(np.abs(diagonal).max(), np.abs(upper).max() if d > 1 else 0.0)
    diagonal = np.where(np.abs(diagonal) < least, least, diagonal)
    values = squared_values(diagonal * diagonal, upper * upper)
    floor = values[0] * (d * np.finfo(float).eps) ** 2
    count = min(count, sum(v > floor for v in values))
    return np.array(values[:count]) * scale * scale, right @ directions(diagonal, upper, values, count)


# --- the rows ----------------------------------------------------------------------


def _is_usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    return vector.isNotNull() & finite


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Entries as whole numbers in a matrix as wide as the longest vector, and each vector's length."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(SCALE * flat), -LIMIT, LIMIT).astype(np.int64) + OFFSET
    width = int(lengths.max(initial=0))
    out = np.full((len(lengths), width), OFFSET, dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = whole
    return out, lengths


class Model(NamedTuple):
    """What whitening needs: rows and sums of the fit, directions as columns, and their eigenvalues."""

    n: int
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def deviations(self, column: pa.Array) -> np.ndarray:
        """n x - S as exact whole numbers: 64-bit ones where they fit, else Python's."""
        codes, _ = _codes(column)
        width = len(self.sums)
        if codes.shape[1] < width:
            codes = np.pad(codes, ((0, 0), (0, width - codes.shape[1])), constant_values=OFFSET)
        if codes.size and self.n * int(np.abs(codes).max()) + max(map(abs, self.sums)) >= 1 << 62:
            return codes.astype(object) * self.n - np.array(self.sums, dtype=object)
        return codes * self.n - np.array(self.sums, dtype=np.int64)

    def whiten(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations.astype(np.float64) / self.n) @ (self.directions / np.sqrt(self.values))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: list[int] = []
    counts: list[int] = []
    n = 0
    for batch in batches:
        codes, lengths = _codes(batch.column(0))
        n += len(lengths)
        more = codes.shape[1] - len(totals)
        totals += [0] * more
        counts += [0] * more
        for k in range(codes.shape[1]):
            inside = int((lengths > k).sum())
            totals[k] += int(codes[:, k].sum()) - OFFSET * (len(lengths) - inside)
            counts[k] += inside
    if n:
        dims = pa.array(range(-1, len(totals)), pa.int32())
        yield pa.RecordBatch.from_arrays([dims, pa.array([0, *totals], pa.decimal128(38, 0)), pa.array([n, *counts], pa.int64())], ["dim", "total", "n"])


def _as_row(part: int, r: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if r is not None and r.size:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([r.astype("<f8").tobytes()], pa.binary())], ["part", "r"])


def _factors(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        block = max(4 * len(model.sums), 1024)
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                rows = model.deviations(batch.column(0).slice(start, block)).astype(np.float64) / model.n
                r = np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")
        yield from _as_row(TaskContext.get().partitionId() // FAN_IN, r)

    return run


def _join_factors(width: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for raw in batch.column("r"):
                more = np.frombuffer(raw.as_py(), "<f8").reshape(-1, width)
                r = more if r is None else np.linalg.qr(np.vstack([r, more]), mode="r")
        yield from _as_row(key[0].as_py() // FAN_IN, r)

    return run


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Model:
    """The model of all usable vectors; without any, or where all are equal, it has no components.

    The driver gets one sum per dimension and one triangular matrix.
    """
    column = F.col(f"`{vector}`")
    vectors = df.filter(_is_usable(column)).select(column)
    sums = vectors.mapInArrow(_sums, "dim int, total decimal(38,0), n long").groupBy("dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    by_dim = {r["dim"]: r for r in sums.collect()}
    n = by_dim[-1]["n"] if by_dim else 0
    width = len(by_dim) - 1 if by_dim else 0
    totals = [int(by_dim[k]["total"]) + OFFSET * (n - by_dim[k]["n"]) for k in range(width)]
    model = Model(n, totals, np.zeros((width, 0)), np.zeros(0), np.zeros(0))
    if not width:
        return model
    factors = vectors.mapInArrow(_factors(model), "part int, r binary")
    left = -(-vectors.rdd.getNumPartitions() // FAN_IN)
    while True:
        factors = factors.groupBy("part").applyInArrow(_join_factors(width), "part int, r binary")
        if left == 1:
            break
        left = -(-left // FAN_IN)
    row = factors.first()
    r = np.frombuffer(row["r"], "<f8").reshape(-1, width)
    values, right = principal(r, components)
    return model._replace(directions=right, values=values / n, explained=values / max(float((r * r).sum()), 1e-300))


def transform(df: DataFrame, model: Model, vector: str = "embedding") -> DataFrame:
    """``df`` with deviation, the exact sum of squares of n x - S, and whitened, one double per component.

    Rows whose vector is null or holds null or non-finite entries go; repeated rows stay.
    Input columns named like the added ones are replaced.
    """
    own = [c for c in df.columns if c not in ("deviation", "whitened")]
    column, name = F.col(f"`{vector}`"), "__vector"
    while name in own:
        name += "_"
    kept = df.filter(_is_usable(column)).select(column.alias(name), *(F.col(f"`{c}`") for c in own))
    schema = T.StructType([*kept.schema.fields[1:], T.StructField("deviation", EXACT), T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = pa.decimal128(38, 0)
        for batch in batches:
            deviations = model.deviations(batch.column(0))
            white = model.whiten(deviations)
            if deviations.size and deviations.dtype != object and float(np.abs(deviations).max()) ** 2 * deviations.shape[1] < 2**62:
                squares = pa.array((deviations * deviations).sum(axis=1)).cast(exact)
            else:
                squares = pa.array([sum(int(x) ** 2 for x in row) for row in deviations], exact)
            offsets = np.arange(len(white) + 1, dtype=np.int32) * white.shape[1]
            whitened = pa.ListArray.from_arrays(offsets, np.ascontiguousarray(white).reshape(-1))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], squares, whitened], names=schema.names)

    return kept.mapInArrow(run, schema)


def _products(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        total = np.zeros((k + 1, k))
        for batch in batches:
            white = model.whiten(model.deviations(batch.column(0)))
            total[0] += white.sum(axis=0)
            total[1:] += white.T @ white
        i, j = np.indices(total.shape).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.reshape(-1))], ["i", "j", "v"])

    return run


def identity_error(df: DataFrame, model: Model, vector: str = "embedding") -> float:
    """The largest entry of the whitened vectors' covariance minus the identity; 0 without components."""
    k = len(model.values)
    if not k:
        return 0.0
    column = F.col(f"`{vector}`")
    rows = df.filter(_is_usable(column)).select(column).mapInArrow(_products(model), "i int, j int, v double")
    total = np.zeros((k + 1, k))
    for row in rows.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[row["i"], row["j"]] = row["v"]
    mean = total[0] / model.n
    return float(np.abs(total[1:] / model.n - np.outer(mean, mean) - np.eye(k)).max())
