import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindling.llm import toxicity as tx

WORDS = "the house stands near river and people walk along its green banks every morning while birds sing softly".split()
BAD = ["idiot", "moron", "scum"]


def make(n, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(40)]
        toxic = int(i % 4 == 0)
        if toxic:
            words[rng.randrange(40)] = rng.choice(BAD)
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = make(400)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    return rows, docs, tx.train(docs, labels)


def test_hidden_words_are_read(trained):
    costs = trained[2].costs.tolist()
    for hidden, word in {"1d10t": "idiot", "m0r0n": "moron", "$cum": "scum", "s.c.u.m": "scum", "idiooooot": "idiot"}.items():
        assert tx.restore(hidden, costs) == word
    assert tx.restore("house", costs) == "house"


def test_hidden_words_are_read_in_texts(trained):
    reader = tx.Reader(trained[2].costs)
    long = "idi" + "o" * 60 + "t"
    texts = {"a $cum,": "scum", "(m0r0n)": "moron", "the (scum": None, "$cum!": "scum", f"x {long} y": "idiot", "idi*t": "idiot", "*idiot*": "idiot"}
    texts |= {" ".join("scum") + " walks": "scum", "$ c u m": "scum", "i d i o t  m o r o n": "idiot", "b a n k s i d i o t": "idiot"}
    texts |= {"i.d.i.o.t-m.o.r.o.n": "moron", ".".join("i" * 30 + "diot"): "idiot"}
    for text, word in texts.items():
        assert word is None or word in reader.words(text), (text, reader.words(text))
    assert reader.words("a house") == {"a", "house"}
    assert len(tx.restore("x1" * 2_000, trained[2].costs.tolist())) >= 2_000


def test_held_out_rows(trained, spark):
    rows, docs, model = trained
    out = tx.score(docs, model).withColumn("held", tx.held_out(F.col("doc_id"))).collect()
    toxic = dict((r[0], r[2]) for r in rows)
    for r in out:
        assert r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    wrong = [r for r in out if (r["score"] >= 0.5) != bool(toxic[r["doc_id"]])]
    assert not wrong
    assert model.score("you are such an 1d1ot my friend") >= 0.5
    assert model.score("an i d i o t walks along") >= 0.5


def test_nulls_empty_and_clashing_columns(trained, spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (2, "a " * 200_000 + "moron", "x"), (2, "a", "x")], "doc_id long, text string, score string")
    out = tx.score(docs, trained[2])
    assert out.columns == docs.columns
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    assert out.filter("score >= 0.5").count() == 1


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, None)], [(None, 1)], [(1, 0)]):
        model = tx.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert 0 < model.score("a b") <= 0.5
    empty = tx.train(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert tx.score(docs.limit(0), empty).count() == 0


def test_sample_is_bounded(trained, spark):
    rows, docs, _ = trained
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    assert tx.train(docs, labels, rows=100).weights


def test_language_model_is_a_distribution(trained):
    assert np.allclose(np.exp(-trained[2].costs).sum(2), 1)
