import random

import numpy as np
import pytest

from kindling.functions.embedder import Embedder, hashed_words
from kindling.operators import documents, embedding, search

EMBEDDER = hashed_words(16)


def model(rows, query, vector, k):
    """Hybrid search in plain steps: phrase hits, nearest vectors, union, cut."""
    phrase = query.strip().lower()
    exact = sorted(r for r in rows if phrase in r[2].lower())[:k]
    gap = lambda r: float(((np.array(r[3], np.float32).astype(float) - np.array(vector)) ** 2).sum())
    near = sorted((r for r in rows if r[3] is not None), key=lambda r: (round(gap(r), 9), r[0], r[1]))[:k]
    taken = {r[:2] for r in exact}
    return ([(r[0], r[1], 1.0) for r in exact] + [(r[0], r[1], 0.5) for r in near if r[:2] not in taken])[:k]


def test_hybrid_matches_plain_steps(spark):
    rng = random.Random(4)
    words = ["disk", "error", "Error 5.1", "(ok)", "net", "up", "down"]
    rows = []
    for d in range(12):
        for c in range(5):
            rows.append((f"d{d:02}", c, " ".join(rng.choice(words) for _ in range(6)), [rng.gauss(0, 1) for _ in range(16)]))
    rows.append(("z", 0, "no vector but an error 5.1", None))
    df = spark.createDataFrame(rows, "doc_id string, chunk_idx int, text string, embedding array<float>").cache()
    for query in ("error 5.1", " (OK) ", "5.1 (", "absent", "", "disk"):
        vector = EMBEDDER.one(query)
        for k in (1, 7, 30, 100):
            got = sorted(search.hybrid_search(df, query, vector, k).collect(), key=lambda r: r.rank)
            assert [(r.doc_id, r.chunk_idx, r.score) for r in got] == model(rows, query, vector, k), (query, k)
            assert [r.rank for r in got] == list(range(1, len(got) + 1))


def test_failed_query_embedding_has_no_hits(spark):
    df = spark.createDataFrame([("a", 0, "x", [1.0])], "doc_id string, chunk_idx int, text string, embedding array<float>")
    assert search.hybrid_search(df, "x", None, 3).count() == 0
    with pytest.raises(ValueError):
        search.hybrid_search(df, "x", [1.0], 0)


def test_phrase_topk_order_and_null_text(spark):
    df = spark.createDataFrame([("b", 0, "Hit"), ("a", 1, "hit"), ("a", 0, "miss"), ("c", 0, None)], "doc_id string, chunk_idx int, text string")
    assert [(r.rank, r.doc_id) for r in search.phrase_topk(df, "\thit\n", 5).collect()] == [(1, "a"), (2, "b")]


def test_first_source_wins(spark):
    a = spark.createDataFrame([(1, "a"), (2, "a")], "id int, src string")
    b = spark.createDataFrame([(2, "b"), (3, "b")], "id int, src string")
    got = search.first_source_wins(a, b, ["id"])
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "a"), (3, "b")]


def test_failing_model_gives_null_and_is_called_in_batches(spark):
    def load():
        def run(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("model failed")
            return np.ones((len(texts), 3))

        return run

    df = spark.createDataFrame([(1, "fine"), (2, "bad"), (3, None)], "id int, text string").coalesce(1)
    got = {r.id: r.embedding for r in embedding.embed(df, Embedder("flaky", load)).collect()}
    assert got == {1: [1.0, 1.0, 1.0], 2: None, 3: None}


def test_model_runs_once_when_its_result_is_filtered(spark):
    df = spark.createDataFrame([(1, "a b")], "id int, text string")
    plan = embedding.embed(df, EMBEDDER).filter("embedding is not null and size(embedding) > 1")
    assert plan._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_render_lines_and_prompt(spark):
    docs = documents.with_metadata(spark.createDataFrame([("d", "body {key}")], "doc_id string, text string"), documents.F.col("doc_id"), author="x")
    assert documents.render(docs).first().rendered == "Metadata: category=>log::author=>x\n-----\nContent: body {key}"
    custom = documents.render(docs, [], "<{value}/{key}>", "", "{content}|{metadata_str}").first().rendered
    assert custom == "body {key}|<d/file_name><log/category><x/author>"
    hits = spark.createDataFrame([(0, 2, "b", "second"), (0, 1, "a", "first")], "query_id long, rank int, doc_id string, text string")
    assert documents.prompt_context(hits).first().context == "first\n\nsecond"
    assert {r.line for r in documents.hit_lines(hits).collect()} == {"a: first", "b: second"}


def test_phrases_are_found_in_the_bytes_of_all_rows():
    """Also with nulls, empty rows, a slice, a blank phrase, and phrases that lie across two rows."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(7)
    for _ in range(50):
        rows = [None if rng.random() < 0.2 else "".join(rng.choice(list("ab é"), rng.integers(0, 12))) for _ in range(30)]
        column = pa.array([*rows, "ab"], pa.string())[3:30]
        holds = search._Holders(column)
        for phrase in ("", "a", "ab", "é", "b é", "aab", "abababababababab", "zz"):
            assert holds.rows(phrase).tolist() == [i for i, t in enumerate(rows[3:30]) if t is not None and phrase in t]
    assert search._Holders(pa.array([], pa.string())).rows("a").tolist() == []
