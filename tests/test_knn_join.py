"""The pivot join against all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from kindling.operators import knn, knn_join


def frame(spark, rows, name):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], f"{name} bigint, embedding array<float>").repartition(4)


def brute(corpus, queries, k):
    out = {}
    for q, v in queries:
        if v is not None:
            far = sorted((float(((np.float64(w) - np.float64(v)) ** 2).sum()), i) for i, w in corpus if w is not None)
            out[q] = [(i, round(d, 6)) for d, i in far[:k]]
    return {q: hits for q, hits in out.items() if hits}


def joined(spark, corpus, queries, k, **options):
    df = knn_join.knn_join(frame(spark, corpus, "vec_id"), frame(spark, queries, "query_id"), k, **options)
    assert df.columns == ["query_id", "rank", "vec_id", "distance"]
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], round(r["distance"], 6)))
        assert r["rank"] == len(out[r["query_id"]])
    return out


RNG = np.random.default_rng(8)
CENTRES = RNG.integers(-40, 40, (12, 4)).astype(float)
CLUSTERS = [(i, (CENTRES[i % 12] + RNG.integers(-2, 3, 4)).tolist()) for i in range(700)]
# A third of all vectors are one and the same, some are missing.
HOT = [(i, None if i % 60 == 7 else [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else v) for i, v in CLUSTERS]


@pytest.mark.parametrize("corpus", [CLUSTERS, HOT], ids=["clusters", "hot"])
@pytest.mark.parametrize("options", [{}, {"part_rows": 30, "block_queries": 25}])
def test_as_all_pairs(spark, corpus, options):
    queries = [(i, v if v is None else [x + 0.25 for x in v]) for i, v in corpus[:180]] + [(999, [500.0, 0.0, 0.0, 0.0])]
    assert joined(spark, corpus, queries, 9, **options) == brute(corpus, queries, 9)


@pytest.mark.parametrize("k", [1, 40])
def test_few_vectors_and_ties(spark, k):
    corpus = [(i, [float(i % 3), 0.0]) for i in range(25)] + [(90, None)]
    queries = [(1, [1.0, 0.0]), (2, [0.5, 0.0]), (3, None), (4, [1e6, 1e6])]
    assert joined(spark, corpus, queries, k) == brute(corpus, queries, k)


def test_nothing(spark):
    some = [(1, [1.0, 2.0])]
    assert joined(spark, [], some, 3) == joined(spark, some, [], 3) == joined(spark, [(1, None)], some, 3) == {}
    with pytest.raises(ValueError):
        joined(spark, some, some, 0)


def test_bounds_leave_cells_out():
    points = CENTRES[:6]
    cell = np.array([np.argmin(((points - v) ** 2).sum(1)) for _, v in CLUSTERS])
    rows = np.array([v for _, v in CLUSTERS])
    far = np.sqrt(((rows - points[cell]) ** 2).sum(1))
    per = [far[cell == j] for j in range(6)]
    pivots = knn_join.Pivots(points, np.array([len(p) for p in per]), np.array([p.min() for p in per]), np.array([p.max() for p in per]))
    reach = np.full(50, 6.0)
    mask = pivots.in_reach(rows[:50], reach)
    assert mask.mean() < 0.6
    gaps = np.sqrt(((rows[:50, None] - rows[None]) ** 2).sum(2))
    for i in range(50):
        assert mask[i][np.unique(cell[gaps[i] <= 6.0])].all()


def test_same_as_the_scan(spark):
    rng = np.random.default_rng(2)
    corpus = frame(spark, [(i, rng.standard_normal(16)) for i in range(400)], "vec_id")
    queries = frame(spark, [(i, rng.standard_normal(16)) for i in range(60)], "query_id")
    assert sorted(map(tuple, knn_join.knn_join(corpus, queries, 5).collect())) == sorted(map(tuple, knn.knn_batch(corpus, queries, 5).collect()))


def test_size_of_nested_values(spark):
    from kindling.cluster import byte_size

    flat = spark.createDataFrame([([1, 2, 3],)], "a array<long>")
    nested = spark.createDataFrame([([(1, "x" * 1000)] * 3, {"k": "y" * 500}, ("z",), None)], "a array<struct<n:long,s:string>>, m map<string,string>, s struct<t:string>, e array<string>")
    assert byte_size(flat) == 24 + 24
    assert 3500 < byte_size(nested) < 4000


def nearest_of(rows, queries, k):
    out = []
    for q, v in enumerate(queries):
        with np.errstate(all="ignore"):
            far = np.add.accumulate((rows - v) ** 2, axis=1)[:, -1]
        for row in np.lexsort((np.arange(len(rows)), far))[:k]:
            out.append((q, int(row), None if np.isnan(far[row]) else float(far[row])))
    return out


def part_of(rows, k):
    vectors = pa.array(rows.tolist(), pa.list_(pa.float64()))
    # Ids that are not in the order of the rows.
    shuffled = np.random.default_rng(5).permutation(len(rows))
    return knn_join.Part(pa.table({"vec_id": pa.array(shuffled), "_v": vectors.take(pa.array(shuffled))}), ["vec_id"], k)


WIDE = np.random.default_rng(11).standard_normal((5000, 12))
PARTS = {
    "plain": WIDE,
    "far from zero": WIDE + 1e6,
    "small": WIDE * 1e-30,
    "large": WIDE * 1e25,
    "too large": np.where(np.arange(5000)[:, None] % 7 == 0, 1e200, WIDE),
    "hot": np.where(np.arange(5000)[:, None] % 3 == 0, 1.0, WIDE),
    "whole numbers": np.round(WIDE[:, :2] * 3),
    "one": np.ones((5000, 3)),
    "not finite": np.where((np.arange(5000) % 5 > 0)[:, None] & (np.arange(12) == 4), np.nan, WIDE),
    "hardly finite": np.where((np.arange(5000) > 3)[:, None] & (np.arange(12) == 4), np.inf, WIDE),
    "few": WIDE[:4],
}


@pytest.mark.parametrize("kind", PARTS)
def test_part(kind):
    rows, k = PARTS[kind], 7
    queries = np.concatenate([rows[:40], rows[-3:] + 0.1])
    part = part_of(rows, k)
    wanted = nearest_of(rows, queries, k)

    def found(reach):
        tables = list(part.nearest(pa.array(range(len(queries))), queries, reach))
        got = [(r["query_id"], r["vec_id"], r["distance"]) for t in tables for r in t.to_pylist()]
        return sorted(got, key=lambda r: (r[0], r[2] is None, r[2], r[1]) if r[2] is not None else (r[0], True, 0, r[1]))

    assert found(np.full(len(queries), np.inf)) == wanted
    # A bound leaves out what is beyond it and nothing else.
    last = np.array([max((d for q, _, d in wanted if q == i and d is not None), default=np.nan) for i in range(len(queries))])
    held = np.array([sum(q == i and d is not None for q, _, d in wanted) for i in range(len(queries))])
    assert found(np.where((held == k) & np.isfinite(last), last, np.inf)) == wanted


def test_copies_beyond_k_are_told():
    rows = np.concatenate([np.ones((6, 2)), np.zeros((2, 2)), np.ones((1, 2))])
    assert knn_join._copies(rows, 3).tolist() == [False] * 3 + [True] * 3 + [False, False, True]
    assert not knn_join._copies(np.arange(20.0).reshape(10, 2), 3).any()


def test_cells_are_joined_where_all_are_in_reach(spark, monkeypatch):
    """Queries are copied once for every large part, not for every cell."""
    cells, compare = [], knn_join._compare
    monkeypatch.setattr(knn_join, "_compare", lambda corpus, asked, counts, *a: cells.append(len(counts)) or compare(corpus, asked, counts, *a))
    rng = np.random.default_rng(4)
    apart = [(i, rng.standard_normal(40).astype(np.float32).tolist()) for i in range(300)]
    assert joined(spark, apart, apart[:90], 5, part_rows=40) == brute(apart, apart[:90], 5)
    assert cells == [16, 1]
    cells.clear()
    lines = [(i, [float(i), 0.0]) for i in range(300)]
    assert joined(spark, lines, lines[:90], 5, part_rows=40) == brute(lines, lines[:90], 5)
    assert cells == [16, 16]


def test_vectors_that_are_not_finite_come_last(spark):
    lost = float("nan")
    corpus = [(i, [float(i), lost if i % 10 else 1.0]) for i in range(60)]
    got = joined_nulls(spark, corpus, [(1, [0.0, 1.0]), (2, [lost, 0.0])], 8)
    assert got[1] == [(0, 0.0), (10, 100.0), (20, 400.0), (30, 900.0), (40, 1600.0), (50, 2500.0), (1, None), (2, None)]
    assert got[2] == [(i, None) for i in range(8)]


def joined_nulls(spark, corpus, queries, k):
    rows = knn_join.knn_join(frame(spark, corpus, "vec_id"), frame(spark, queries, "query_id"), k).collect()
    return {q: [(r["vec_id"], r["distance"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q] for q, _ in queries}
