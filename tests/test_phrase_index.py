import random

import pytest
from pyspark.sql import functions as F

from kindling.functions.text import phrase_match
from kindling.operators.phrase_index import build_phrase_index, find_phrases, phrase_by_index

RANDOM = random.Random(7)
WORDS = ["Alpha", "beta", "Straße", "ÉTÉ", "x", "log-in", "failed", "😀ok", "the", "thesis", "100%"]
TEXTS = [" ".join(RANDOM.choices(WORDS, k=RANDOM.randint(1, 60))) for _ in range(300)]
TEXTS += [None, "", "ab", "a" * 5000 + "b", "needle in a haystack", "needle in a haystack", "ab" * 100 + "ca", "İstanbul ΑΣ"]
PHRASES = ["beta x", " THE THESIS ", "straße été", "😀OK the", "aaab", "abca", "bca", "needle in a haystack", "ab", "x", "", "  ", "nowhere at all",
           "Needle  in", "the thesis 100%\n", "i̇stanbul", "ας", None, "a" * 4000]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("phrase index"))
    rows = [(i, t, "own" if i % 7 else "other one") for i, t in enumerate(TEXTS)]
    frame = spark.createDataFrame(rows, "id long, text string, gram string")
    frame.repartitionByRange(6, "id").write.partitionBy("gram").parquet(f"{root}/table")
    assert build_phrase_index(spark, f"{root}/table", f"{root}/index") == len(frame.sparkSession.read.parquet(f"{root}/table").inputFiles())
    return f"{root}/table", f"{root}/index"


def scanned(spark, table, phrases):
    found = []
    for k, p in enumerate(phrases):
        if p is not None:
            found += [(k, r.id) for r in spark.read.parquet(table).filter(phrase_match(F.col("text"), p)).select("id").collect()]
    return sorted(found)


@pytest.mark.parametrize("lookups", [1, 4])
def test_same_rows_as_a_scan(spark, table, lookups):
    asked = spark.createDataFrame(list(enumerate(PHRASES)) + [(0, "beta x"), (None, "beta")], "phrase_id int, phrase string")
    out = find_phrases(spark, *table, asked, lookups=lookups)
    assert out.columns == ["phrase_id", "id", "text", "gram"]
    found = sorted((r.phrase_id, r.id) for r in out.collect())
    assert found == scanned(spark, table[0], PHRASES) and len(found) > 300


def test_only_files_of_candidates_are_read(spark, table):
    out = phrase_by_index(spark, *table, " Needle in a HAYSTACK")
    assert out.count() == 2
    assert len(out.inputFiles()) <= 2 < len(spark.read.parquet(table[0]).inputFiles())
    assert phrase_by_index(spark, *table, "no such phrase").count() == 0
    # Every trigram occurs, the phrase does not: the positions tell.
    assert phrase_by_index(spark, *table, "bcab").count() == 0


def test_later_files_and_repeated_builds(spark, tmp_path):
    where = f"{tmp_path}/t", f"{tmp_path}/i"
    schema = "id long, text string"
    spark.createDataFrame([(1, "one needle"), (2, "hay")], schema).coalesce(1).write.parquet(where[0])
    assert build_phrase_index(spark, *where) == 1
    assert build_phrase_index(spark, *where) == 0
    spark.createDataFrame([(3, "new needle")], schema).coalesce(1).write.mode("append").parquet(where[0])

    def found():
        return sorted(r.id for r in phrase_by_index(spark, *where, "NEEDLE").collect())

    assert found() == [1, 3]
    assert build_phrase_index(spark, *where) == 1
    assert found() == [1, 3]


def test_many_trigrams_and_files_take_the_joined_way(spark, table, monkeypatch):
    monkeypatch.setattr("kindling.operators.phrase_index.NAMED", 1)
    monkeypatch.setattr("kindling.operators.phrase_index.SCANNED_PHRASES", 2)
    asked = spark.createDataFrame(list(enumerate(PHRASES)), "phrase_id int, phrase string")
    assert sorted((r.phrase_id, r.id) for r in find_phrases(spark, *table, asked).collect()) == scanned(spark, table[0], PHRASES)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "id long, text string").write.parquet(f"{tmp_path}/t")
    build_phrase_index(spark, f"{tmp_path}/t", f"{tmp_path}/i")
    assert phrase_by_index(spark, f"{tmp_path}/t", f"{tmp_path}/i", "any thing").count() == 0
