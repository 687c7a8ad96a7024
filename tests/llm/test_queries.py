"""The registered queries on the smallest tables."""

import hashlib
import zlib
from pathlib import Path

import numpy as np
import pytest

import __spark_entry__ as registered
import corpus_pipeline
from kindling.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS FROM '{table}'")
    return con


def test_all_are_registered():
    names = {n.partition("_")[0] for n in queries.queries()}
    assert names == {f"op{n}" for n in range(1, 14)}
    assert set(queries.queries()) | {"pipeline"} <= set(registered.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, con, name):
    df = queries.queries()[name](spark, str(DATA))
    result = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(result.fetchall())


CONTRACTS = {
    "op1_token_store": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op2_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op4_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op5_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op6_suffix_groups": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op7_shingle_join": ["doc_id", "n_shingles", "component_id"],
    "op12_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op10_vector_forest": ["vec_id", "n_links", "component_id", "kept"],
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_contract(spark, con, name):
    rows = queries.queries()[name](spark, str(DATA)).collect()
    assert rows[0].__fields__ == CONTRACTS[name]
    table, key = {"p": ("pages", "page_id"), "v": ("embeddings", "vec_id"), "d": ("documents", "doc_id")}[CONTRACTS[name][0][0]]
    assert sorted(r[key] for r in rows) == [x for (x,) in con.execute(f"SELECT {key} FROM {table} ORDER BY 1").fetchall()]
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    if name == "op2_byte_bpe":
        assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows)
    if name == "op4_toxicity":
        toxic = dict(con.execute("SELECT doc_id, toxic FROM labels").fetchall())
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
        right = [r["predicted"] == toxic[r["doc_id"]] for r in rows if r["doc_id"] in toxic]
        assert sum(right) >= 0.9 * len(right)


def test_pipeline_stages(spark, con):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(DATA))
        assert out.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(out.toArrow())
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(now) <= set(kept) and len(now) > 0.6 * len(kept)
        if name != "line_dedup":
            assert all(kept[i] == t for i, t in now.items())
        kept = now
    name, stage = corpus_pipeline.STAGES[-1]
    from kindling.llm.queries import BYTE_BPE
    from kindling.llm import byte_bpe
    import public_tokenizers

    encoder = byte_bpe.Encoder(byte_bpe.read_ranks(BYTE_BPE), public_tokenizers.PATTERN)
    for r in stage(spark, docs, str(DATA)).collect():
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["n_tokens"] and encoder.decode(ids).decode() == kept[r["doc_id"]]
