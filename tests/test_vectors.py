import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindling.functions import embedder
from kindling.functions import vectors as vx
from kindling.functions.text import regex_literal


def reference(metric, a, b):
    a, b = np.array(a, float), np.array(b, float)
    if metric == "l2":
        return float(((a - b) ** 2).sum())
    if metric == "l1":
        return float(np.abs(a - b).sum())
    if metric == "inner_product":
        return float(a @ b)
    lengths = np.linalg.norm(a) * np.linalg.norm(b)
    return None if lengths == 0 else float(a @ b / lengths)


@pytest.mark.parametrize("dim", [1, 7, 200])
def test_metrics_with_columns_and_constants(spark, dim):
    rng = np.random.default_rng(dim)
    pairs = [(rng.normal(size=dim).tolist(), rng.normal(size=dim).tolist()) for _ in range(5)]
    pairs.append(([0.0] * dim, pairs[0][1]))
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>")
    query = pairs[0][1]
    for metric in vx.METRICS:
        got = df.select(
            "a", "b", vx.metric_column(metric, F.col("a"), F.col("b")).alias("m"), vx.metric_column(metric, F.col("a"), query).alias("q")
        ).collect()
        for r in got:
            for value, other in ((r.m, r.b), (r.q, query)):
                expected = reference(metric, r.a, other)
                assert value is None if expected is None else math.isclose(value, expected, abs_tol=1e-9)


def test_unrolled_and_folded_sums_are_identical(spark):
    rng = np.random.default_rng(0)
    query = rng.normal(size=100).tolist()
    df = spark.createDataFrame([(rng.normal(size=100).tolist(),) for _ in range(50)], "a array<double>")
    both = df.select(vx.l2_squared("a", query).alias("x"), vx.l2_squared(F.col("a"), query).alias("y")).collect()
    assert all(r.x == r.y for r in both)
    for vec in ("a", F.col("a")):
        with pytest.raises(Exception, match=vx.WRONG_LENGTH):
            df.select(vx.l2_squared(vec, query[:50])).collect()


def test_unknown_metric():
    with pytest.raises(ValueError):
        vx.metric_column("hamming", None, None)


def test_shapes(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "a array<double>")
    r = df.select(
        vx.fit_dimension(F.col("a"), 5).alias("longer"),
        vx.fit_dimension(F.col("a"), 2).alias("shorter"),
        vx.as_matrix(F.col("a")).alias("matrix"),
        vx.flatten_matrix(vx.as_matrix(F.col("a"))).alias("flat"),
        vx.to_float32(F.col("a")).alias("small"),
    )
    assert dict(r.dtypes)["small"] == "array<float>"
    assert r.first() == ([1.0, 2.0, 3.0, 0.0, 0.0], [1.0, 2.0], [[1.0, 2.0, 3.0]], [1.0, 2.0, 3.0], [1.0, 2.0, 3.0])


def test_regex_literal(spark):
    for text in ("a.b*c", "x\\Ey", "(["):
        df = spark.createDataFrame([(f"..{text}..",), ("other",)], "t string")
        assert df.filter(F.regexp_like("t", F.lit(regex_literal(text)))).count() == 1


def test_distance_to_a_constant_stays_within_methods_that_the_jit_compiles(spark):
    df = spark.createDataFrame([([float(i) for i in range(64)],), (None,)], "a array<float>")
    out = df.select(vx.l2_squared("a", [0.5] * 64).alias("x"))
    stages = out._jdf.queryExecution().debug().codegenToSeq()
    # HotSpot interprets methods above 8000 bytes.
    assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000
    assert [r.x for r in out.collect()] == [sum((i - 0.5) ** 2 for i in range(64)), None]


def test_word_counts_do_not_depend_on_how_texts_are_grouped(monkeypatch):
    texts = ["", "b7 cK_a A,É1", "x " * 9, "..."]
    whole = embedder.hashed_words(8).load()(texts)
    monkeypatch.setattr(embedder, "_SLOTS", 2)
    assert (embedder.hashed_words(8).load()(texts) == whole).all()
    words = [["b7", "ck", "a", "a", "1"], ["x"] * 9]
    for row, own in zip((1, 2), words):
        counts = np.bincount([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 8 for w in own], minlength=8)
        assert np.allclose(whole[row], counts / np.sqrt((counts * counts).sum()))
    assert not whole[0].any() and not whole[3].any()
