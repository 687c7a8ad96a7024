"""Whitening against dense eigenvectors, and against whole-number arithmetic in Python."""

import math

import numpy as np
import pytest

from kindling.llm import whitening as wh


def triangular(rows):
    return np.linalg.qr(np.asarray(rows, dtype=float), mode="r")


RNG = np.random.default_rng(3)
Q = np.linalg.qr(RNG.standard_normal((300, 40)))[0]
WILKINSON = np.diag(np.abs(np.arange(-10.0, 11)) + 3) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
MATRICES = {
    "one": RNG.standard_normal((5, 1)),
    "random": RNG.standard_normal((200, 64)),
    "fewer rows": RNG.standard_normal((20, 64)),
    "identity": np.eye(40),
    "equal values": Q * np.repeat([5.0, 1.0, 0.1, 1e-5], 10),
    "graded": Q * np.logspace(0, -11, 40),
    "twin columns": np.hstack([Q, Q]),
    "close pairs": np.linalg.cholesky(WILKINSON).T,
    "empty columns": Q * (np.arange(40) % 3 == 0),
}


@pytest.mark.parametrize("name", MATRICES)
def test_values_and_directions(name):
    r = triangular(MATRICES[name])
    values, right = wh.principal(r, 32)
    exact = np.linalg.svd(r, compute_uv=False) ** 2
    k = min(32, int((exact > exact[0] * 1e-26).sum()))
    assert len(values) == k and np.allclose(values, exact[:k], rtol=1e-9 if name == "graded" else 1e-12)
    assert np.abs(right.T @ right - np.eye(k)).max() < 1e-10
    white = r @ right / np.sqrt(values)
    assert np.abs(white.T @ white - np.eye(k)).max() < (1e-4 if name == "graded" else 1e-9)


def test_without_any_spread():
    assert wh.principal(np.zeros((3, 3)), 32)[1].shape == (3, 0)


def table(spark, rows, kind="array<float>", parts=5):
    return spark.createDataFrame([(i, None if r is None else [None if x is None else float(x) for x in r]) for i, r in enumerate(rows)], f"id int, v {kind}").repartition(parts, "id")


def test_as_dense_eigenvectors(spark):
    rows = (RNG.standard_normal((400, 12)) @ RNG.standard_normal((12, 12))).astype(np.float32)
    df = table(spark, rows, parts=40)
    model = wh.fit(df, "v", components=5)
    x = np.floor(64 * rows.astype(float)).astype(int) + 1_000_000
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    assert model.n == 400 and model.sums == list(x.sum(axis=0))
    assert np.allclose(model.values, values[::-1][:5], rtol=1e-10)
    assert np.allclose(model.explained, values[::-1][:5] / values.sum(), rtol=1e-10)
    assert np.allclose(np.abs((vectors[:, ::-1][:, :5] * model.directions).sum(axis=0)), 1, atol=1e-10)
    out = {r["id"]: r for r in wh.transform(df, model, "v").collect()}
    white = np.array([out[i]["whitened"] for i in range(400)])
    assert np.abs(white.T @ white / 400 - np.eye(5)).max() < 1e-10
    assert [int(out[i]["deviation"]) for i in range(400)] == [sum((400 * int(a) - int(s)) ** 2 for a, s in zip(r, x.sum(axis=0))) for r in x]
    assert wh.identity_error(df, model, "v") < 1e-10


def test_unusable_rows_go_and_others_do_not_change(spark):
    good = [[1, 2], [3, 5], [-1, 0.5], [3, 5]]
    mixed = [*good, None, [1, None], [math.nan, 1], [math.inf, 0], [0, -math.inf]]
    a, b = wh.fit(table(spark, good), "v"), wh.fit(table(spark, mixed), "v")
    assert (a.n, a.sums) == (b.n, b.sums) == (4, b.sums)
    out = wh.transform(table(spark, mixed), b, "v").collect()
    assert sorted(r["id"] for r in out) == [0, 1, 2, 3]
    assert len({(r["deviation"], tuple(r["whitened"])) for r in out}) == 3


def test_short_vectors_count_as_if_zeros_followed(spark):
    short = wh.fit(table(spark, [[1, 2, 3], [4], [], [2, 2, 2]]), "v")
    padded = wh.fit(table(spark, [[1, 2, 3], [4, 0, 0], [0, 0, 0], [2, 2, 2]]), "v")
    assert short.n == padded.n and short.sums == padded.sums and np.allclose(short.values, padded.values)


def test_huge_entries_stay_exact(spark):
    rows = [[3e38, 1], [-3e38, 2], [0, 0]]
    df = table(spark, rows)
    model = wh.fit(df, "v")
    x = [[(1 << 40) + 10**6, 10**6 + 64], [-(1 << 40) + 10**6, 10**6 + 128], [10**6, 10**6]]
    sums = [sum(c) for c in zip(*x)]
    assert model.sums == sums
    got = {r["id"]: int(r["deviation"]) for r in wh.transform(df, model, "v").collect()}
    assert got == {i: sum((3 * a - s) ** 2 for a, s in zip(r, sums)) for i, r in enumerate(x)}


@pytest.mark.parametrize("rows", [[], [None], [[]], [[1, 2]], [[1, 2]] * 5])
def test_nothing_to_whiten(spark, rows):
    df = table(spark, rows)
    model = wh.fit(df, "v")
    assert len(model.values) == 0 and wh.identity_error(df, model, "v") == 0
    out = wh.transform(df, model, "v").collect()
    assert len(out) == sum(r is not None for r in rows)
    assert all(r["whitened"] == [] and r["deviation"] == 0 for r in out)


def test_clashing_columns(spark):
    df = table(spark, [[1, 2], [3, 4], [5, 1]]).selectExpr("id", "v", "'a' AS whitened", "1 AS n", "'__' AS __vector")
    out = wh.transform(df, wh.fit(df, "v"), "v")
    assert out.columns == ["id", "v", "n", "__vector", "deviation", "whitened"]
    assert {len(r["whitened"]) for r in out.collect()} == {2}
