"""Vector functions on ``array<float>`` columns, computed in double.

Every sum runs over the positions in order, so the JVM forms and the block form
in ``operators.knn`` give identical bits and break ties alike.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Squared L2 from a named column to a constant of at most this many dimensions becomes
# straight-line code, about four times as fast per row as the fold that all other
# forms use. Beyond it the generated method grows too large for the JIT compiler.
UNROLL_DIMS = 128

# Metrics where a larger value is a nearer vector.
DESCENDING = {"inner_product", "cosine"}


def literal_vector(values: Sequence[float]) -> Column:
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")").cast("array<double>")


WRONG_LENGTH = "vectors of different dimensions"


def _of_length(vec: Column, length: Column | int, value: Column) -> Column:
    """``value``, or an error where the vector is there and has another length."""
    wrong = vec.isNotNull() & (F.size(vec) != length)
    return F.when(wrong, F.raise_error(F.lit(WRONG_LENGTH)).cast("double")).otherwise(value)


def _fold(vec: Column, other: Column | Sequence[float] | None, term) -> Column:
    """Sum of ``term(x, y)`` over positions; ``other`` is a column or constants of the same length."""
    if other is None:
        return F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + term(x.cast("double"), None))
    length = F.size(other) if isinstance(other, Column) else len(other)
    if not isinstance(other, Column):
        other = literal_vector(other)
    pairs = F.zip_with(vec, other, lambda x, y: term(x.cast("double"), y.cast("double")))
    return _of_length(vec, length, F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x))


def l2_squared(vec: Column | str, other) -> Column:
    """Squared L2 distance; give ``vec`` by name to use the fast form for a constant."""
    if isinstance(vec, str):
        if not isinstance(other, Column) and 0 < len(other) <= UNROLL_DIMS:
            return _unrolled_l2(vec, other)
        vec = F.col(vec)
    return _fold(vec, other, lambda x, y: (x - y) * (x - y))


def _unrolled_l2(name: str, values: Sequence[float]) -> Column:
    """The sum written out. Each difference occurs twice, so code generation puts it into
    a method of its own, which keeps the main method small. It does so only for what every
    row computes: the length is checked in the vector, as a condition around the sum would
    put all of it into one method, too large for the JIT compiler."""
    wrong = f"`{name}` is not null and size(`{name}`) <> {len(values)}"
    checked = f"if({wrong}, cast(raise_error('{WRONG_LENGTH}') as array<float>), `{name}`)"
    gaps = [f"(get({checked}, {i}) - {float(v)!r}D)" for i, v in enumerate(values)]
    return F.expr(" + ".join(f"{g} * {g}" for g in gaps))


def l1(vec: Column, other) -> Column:
    return _fold(vec, other, lambda x, y: F.abs(x - y))


def inner_product(vec: Column, other) -> Column:
    return _fold(vec, other, lambda x, y: x * y)


def norm(vec) -> Column:
    """Euclidean length of a column or of constants."""
    if isinstance(vec, Column):
        return F.sqrt(_fold(vec, None, lambda x, _: x * x))
    total = 0.0
    for v in vec:
        total += float(v) * float(v)
    return F.lit(math.sqrt(total))


def cosine(vec: Column, other, vec_norm: Column | None = None) -> Column:
    """Cosine similarity; null when either vector is all zeros.

    Pass a stored norm as ``vec_norm`` to skip recomputing it per query.
    """
    length = norm(vec) if vec_norm is None else vec_norm
    return F.try_divide(inner_product(vec, other), length * norm(other))


METRICS = {"l2": l2_squared, "l1": l1, "inner_product": inner_product, "cosine": cosine}


def metric_column(metric: str, vec: Column, other: Column | Sequence[float]) -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; choose from {sorted(METRICS)}")
    return METRICS[metric](vec, other)


def nearest_first(metric: str, value: Column) -> Column:
    """Sort key that puts the nearest vector first and nulls last."""
    return value.desc_nulls_last() if metric in DESCENDING else value.asc_nulls_last()


def to_float32(vec: Column) -> Column:
    return vec.cast("array<float>")


def flatten_matrix(matrix: Column) -> Column:
    """Two-dimensional to one-dimensional."""
    return F.flatten(matrix)


def as_matrix(vec: Column) -> Column:
    """One-dimensional to a matrix of one row."""
    return F.array(vec)


def fit_dimension(vec: Column, dim: int) -> Column:
    """Pad with zeros or cut to exactly ``dim`` entries."""
    padded = F.concat(vec, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(dim) - F.size(vec), F.lit(0))))
    return F.slice(padded, 1, dim)
