"""Planted cases on a small table, one stage at a time and in a row."""

import random

import pytest

import corpus_pipeline as cp

WORDS = "the house stands near river and people walk along its green banks every morning while birds sing softly under old trees".split()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng, path = random.Random(9), tmp_path_factory.mktemp("tables")
    text = lambda n: "\n".join(" ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(9)) for _ in range(n))
    item = " ".join(f"question{i}" for i in range(20))
    rows = [(i, text(8)) for i in range(60)]
    labels = [(i, 0) for i in range(60)]
    for i in range(60, 90):
        rows.append((i, text(4) + rng.choice([" idiot ", " moron "]) + text(3)))
        labels.append((i, 1))
    near = text(1).split()
    rows += [(100, " ".join(near * 3)), (101, " ".join([*near * 3, "end"])), (102, rows[3][1]), (103, f"{text(2)} {item} {text(2)}"), (104, None), (105, ""), (None, text(3))]
    kept = "\n".join(rows[5][1].split("\n")[2:6])
    rows.append((106, text(3) + "\n" + kept + "\n" + text(2)))
    docs = [(i, t, "en", "s", None if t is None else len(t), "more") for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, extra string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), dict(rows)


def test_planted_cases(spark, sf_dir):
    path, texts = sf_dir
    out = {r["doc_id"]: r for r in cp.run(spark, path).collect()}
    assert not {i for i in range(60, 90)} & set(out)  # toxic
    assert set(range(60)) <= set(out)  # clean
    assert 100 in out and 101 not in out  # near copy
    assert 102 not in out and 3 in out  # copy of which no line is left
    assert 103 not in out  # leak
    assert {104, 105, None} <= set(out)
    assert out[104]["n_tokens"] == out[105]["n_tokens"] == 0
    assert 106 in out and out[106]["n_chars"] < len(texts[106])


def test_stages_on_an_empty_table(spark, sf_dir):
    path, _ = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, docs, path).count() == 0, name
