import numpy as np
import pytest
from pyspark.sql import functions as F

from kindling.functions import vectors as vx
from kindling.operators import ann, knn
from kindling.operators.embedding import mean_pool

SCHEMA = "vec_id bigint, embedding array<float>"


def value(metric, v, q):
    v, q = v.astype(float), q.astype(float)
    if metric == "l2":
        return ((v - q) ** 2).sum()
    if metric == "l1":
        return np.abs(v - q).sum()
    if metric == "inner_product":
        return v @ q
    n = np.linalg.norm(v) * np.linalg.norm(q)
    return None if n == 0 else v @ q / n


def brute(rows, query, k, metric):
    scored = [(i, value(metric, v, query)) for i, v in rows if v is not None]
    sign = -1 if metric in vx.DESCENDING else 1
    return sorted(scored, key=lambda s: (s[1] is None, 0 if s[1] is None else sign * round(s[1], 9), s[0]))[:k]


@pytest.fixture(scope="module")
def corpus(spark):
    """A third of the vectors are one and the same; some are zero, some missing."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        v = np.ones(6, np.float32) if i % 3 == 0 else rng.integers(-3, 4, 6).astype(np.float32)
        rows.append((i, None if i % 50 == 7 else np.zeros(6, np.float32) if i % 50 == 8 else v))
    df = spark.createDataFrame([(i, None if v is None else v.tolist()) for i, v in rows], SCHEMA).repartition(5)
    return rows, df.cache()


@pytest.fixture(scope="module")
def questions(spark):
    rng = np.random.default_rng(6)
    asked = [(i, rng.normal(size=6).astype(np.float32)) for i in range(12)] + [(12, np.ones(6, np.float32)), (13, np.zeros(6, np.float32))]
    return asked, spark.createDataFrame([(i, q.tolist()) for i, q in asked], "query_id bigint, embedding array<float>")


def check(got, rows, asked, k, metric):
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.distance))
        assert r.rank == len(found[r.query_id])
    for i, q in asked:
        expected = brute(rows, q, k, metric)
        assert [e[0] for e in expected] == [f[0] for f in found[i]], (metric, i)
        for (_, e), (_, f) in zip(expected, found[i]):
            assert f is None if e is None else abs(e - f) < 1e-9


@pytest.mark.parametrize("metric", sorted(vx.METRICS))
def test_batch_matches_brute_force(corpus, questions, metric):
    rows, df = corpus
    asked, queries = questions
    check(knn.knn_batch(df, queries, 20, metric), rows, asked, 20, metric)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_blocked_route_matches_brute_force(corpus, questions, metric):
    rows, df = corpus
    asked, queries = questions
    check(knn.knn_batch(df, queries, 20, metric, query_bytes=200), rows, asked, 20, metric)


@pytest.mark.parametrize("metric", sorted(vx.METRICS))
def test_single_query_matches_brute_force(corpus, metric):
    rows, df = corpus
    query = np.array([1, -2, 0.5, 0, 3, 1], np.float32)
    check(knn.knn(df, query, 15, metric), rows, [(0, query)], 15, metric)


def test_large_batches_use_fewer_tasks(spark):
    df = spark.range(0, 1000, 1, 60)
    assert knn.fewer_tasks(df, 100).rdd.getNumPartitions() == 60
    assert knn.fewer_tasks(df, 10_000, total=300_000).rdd.getNumPartitions() == 30
    assert knn.fewer_tasks(df, 10_000, total=1).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_fewer_vectors_than_k(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], SCHEMA)
    assert [r.vec_id for r in knn.knn(df, [0.0, 0.0], 5).collect()] == [1]
    assert knn.knn(df.limit(0), [0.0, 0.0], 5).count() == 0
    queries = spark.createDataFrame([(0, [0.0, 0.0])], "query_id bigint, embedding array<float>")
    assert [r.vec_id for r in knn.knn_batch(df, queries, 5).collect()] == [1]
    assert knn.knn_batch(df.limit(0), queries, 5).count() == 0
    assert knn.knn_batch(df, queries.limit(0), 5).count() == 0


def test_rejected_arguments(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0])], SCHEMA)
    with pytest.raises(ValueError):
        knn.knn(df, [0.0, 0.0], 0)
    with pytest.raises(ValueError):
        knn.knn_batch(df, df, 1, "hamming")


def test_text_keys_and_composite_ids(spark):
    rows = [("b", 1, [0.0]), ("a", 2, [0.0]), ("a", 1, [0.0]), ("c", 1, [5.0])]
    df = spark.createDataFrame(rows, "doc_id string, chunk_idx int, embedding array<float>")
    queries = spark.createDataFrame([("q", [0.0])], "query_id string, embedding array<float>")
    got = knn.knn_batch(df, queries, 3, ids=["doc_id", "chunk_idx"]).orderBy("rank").collect()
    assert [(r.doc_id, r.chunk_idx) for r in got] == [("a", 1), ("a", 2), ("b", 1)]


def test_fetch_and_append(corpus, spark):
    rows, df = corpus
    more = spark.createDataFrame([([9.0] * 6, -1)], "embedding array<float>, vec_id bigint")
    hits = knn.knn(knn.append_vectors(df, more), [9.0] * 6, 1)
    assert hits.first().vec_id == -1
    labelled = df.select("vec_id", (F.col("vec_id") % 2).alias("odd"))
    assert knn.fetch_records(knn.knn(df, [1.0] * 6, 4), labelled, ["vec_id"]).count() == 4


def clustered(spark, n=4000, dim=16):
    """A third of the vectors lie around one centre."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, dim)) * 2
    home = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, 12, n))
    vectors = (centres[home] + rng.normal(size=(n, dim)) * 0.5).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA).repartition(6).cache()
    picks = [(i, (centres[i % 12] + rng.normal(size=dim) * 0.5).astype(np.float32).tolist()) for i in range(20)]
    return df, spark.createDataFrame(picks, "query_id bigint, embedding array<float>").cache()


@pytest.fixture(scope="module")
def cells(spark):
    df, queries = clustered(spark)
    return df, queries, knn.knn_batch(df, queries, 10).cache()


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_cell_index(cells, spark, tmp_path):
    df, queries, exact = cells
    index = ann.train_cells(df, cells=16)
    assigned = ann.assign_cells(df, index)
    ann.write_cells(assigned, str(tmp_path / "cells"))
    ann.save_centroids(spark, index, str(tmp_path / "centroids"))
    loaded = ann.load_centroids(spark, str(tmp_path / "centroids"))
    assert (loaded.centroids == index.centroids).all()
    stored = spark.read.parquet(str(tmp_path / "cells"))
    assert stored.count() == df.count()
    assert same(ann.ivf_search(stored, loaded, queries, 10, probes=16), exact)
    near = ann.ivf_search(stored, loaded, queries, 10, probes=4)
    assert ann.recall(near, exact).agg(F.min("recall"), F.avg("recall")).first()[1] >= 0.9
    assert same(ann.ivf_search(stored, loaded, queries, 10, probes=4, query_bytes=0), near)
    more = spark.createDataFrame([(-5, df.first().embedding)], SCHEMA)
    ann.write_cells(ann.assign_cells(more, loaded), str(tmp_path / "cells"))
    assert spark.read.parquet(str(tmp_path / "cells")).count() == df.count() + 1
    plan = stored.filter(F.col("cell").isin([1, 2]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan


def test_all_rows_are_trained_on(spark):
    rows = [(i, [0.0]) for i in range(3000)] + [(9000, [1000.0])]
    index = ann.train_cells(spark.createDataFrame(rows, SCHEMA), cells=2)
    assert sorted(index.centroids.ravel().tolist()) == [0.0, 1000.0]


@pytest.mark.parametrize("dim", [8, 128, 129])
def test_wrong_lengths_are_an_error_everywhere(spark, dim):
    rows = [(1, [1.0] * dim, "a"), (2, [1.0] * (dim - 1), "b"), (3, None, "c")]
    df = spark.createDataFrame(rows, f"{SCHEMA}, text string").withColumn("chunk_idx", F.lit(0)).withColumnRenamed("vec_id", "doc_id")
    asked = spark.createDataFrame([(0, [1.0] * dim)], "query_id bigint, embedding array<float>")
    from kindling.operators.search import hybrid_search

    searches = [knn.knn(df, [1.0] * dim, 2, m, ids=["doc_id"]) for m in ("l2", "cosine")]
    searches += [knn.knn_batch(df, asked, 2, ids=["doc_id"]), hybrid_search(df, "zzz", [1.0] * dim, 2)]
    for found in searches:
        with pytest.raises(Exception, match=vx.WRONG_LENGTH):
            found.collect()


def test_metrics_in_one_scan(corpus):
    rows, df = corpus
    query = np.array([1, -2, 0.5, 0, 3, 1], np.float32)
    got = knn.knn_by_metrics(df, query, 15, sorted(vx.METRICS))
    for metric in vx.METRICS:
        check(got.filter(F.col("metric") == metric), rows, [(0, query)], 15, metric)


def test_every_text_reaches_the_model_once(spark, tmp_path):
    from kindling.functions.embedder import Embedder
    from kindling.operators.embedding import embed

    calls = str(tmp_path / "calls")

    def load():
        def run(texts):
            with open(calls, "a") as f:
                f.writelines(t + "\n" for t in texts)
            return np.array([[len(t), ord(t[-1])] for t in texts], float)

        return run

    texts = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "vec_id bigint, text string").repartition(4)
    asked = texts.filter("vec_id < 7").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("query "), "text").alias("text"))
    model = Embedder("counting-once", load)
    hits = knn.knn_batch(embed(texts, model), embed(asked, model), 3, query_bytes=200)
    assert hits.count() == 21
    seen = open(calls).read().splitlines()
    assert len(seen) == len(set(seen)) == 67


def test_cell_of_missing_vector(cells, spark):
    index = ann.Cells(np.eye(2))
    got = ann.assign_cells(spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], SCHEMA), index)
    assert {r.vec_id: r.cell for r in got.collect()} == {1: 1, 2: None}


def test_hash_index(cells, spark, tmp_path):
    df, queries, exact = cells
    model = ann.fit_lsh(16, bucket_length=4.0, tables=8)
    ann.write_buckets(ann.bucket_rows(df, model), str(tmp_path / "buckets"))
    stored = spark.read.parquet(str(tmp_path / "buckets"))
    assert stored.count() == 8 * df.count()
    near = ann.lsh_search_batch(stored, model, queries, 10)
    assert ann.recall(near, exact).agg(F.avg("recall")).first()[0] >= 0.9
    assert same(ann.lsh_search_batch(stored, model, queries, 10, query_bytes=300), near)
    plan = stored.filter(ann._wanted(model.buckets(np.zeros((1, 16)))))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    first = queries.filter("query_id = 1").first()
    single = ann.lsh_search(stored, model, first.embedding, 10).collect()
    found = {r.vec_id for r in exact.filter("query_id = 1").collect()}
    assert len(found & {r.vec_id for r in single}) >= 8


def test_masked_mean(spark):
    rows = [("a", [1.0, 2.0], 1), ("a", [3.0, 6.0], 1), ("a", [99.0, 99.0], 0), ("b", [5.0, 5.0], 1), ("b", None, 1)]
    df = spark.createDataFrame(rows, "t string, embedding array<float>, mask int")
    assert {r.t: r.embedding for r in mean_pool(df, ["t"], mask="mask").collect()} == {"a": [2.0, 4.0], "b": [5.0, 5.0]}
