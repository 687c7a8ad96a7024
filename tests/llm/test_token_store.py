import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from kindling.cluster import new_folder
from kindling.llm import token_store as ts

PATH = public_tokenizers.path("word_bpe_49k.json")


def table_for(ids):
    return ts.Frequencies(*np.unique(ids, return_counts=True))


@pytest.mark.parametrize("n", [1, 63, 64, 65, ts.LANES * ts.STRIDE, ts.LANES * ts.STRIDE + 1, ts.BLOCK])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    blocks = [np.minimum(rng.geometric(0.01, n), 49_407).astype(np.uint32), np.full(n, 3, np.uint32)]
    table = table_for(np.concatenate(blocks))
    coded = ts.encode_blocks(blocks, table)
    for got, want in zip(ts.decode_blocks(coded, table), blocks, strict=True):
        assert (got == want).all()
    if n == ts.BLOCK:
        assert len(coded[0]) < 2 * n


def test_decoding_starts_at_any_checkpoint():
    ids = np.random.default_rng(2).integers(0, 900, ts.BLOCK).astype(np.uint32)
    table = table_for(ids)
    n, spots, states, words, _ = ts._parts(ts.encode_blocks([ids], table)[0])
    part = ts.decode_stretches([(states[2], words[spots[2] : spots[3]])], ts.STRIDE, table)[0]
    start = 2 * ts.STRIDE * ts.LANES
    assert (part == ids[start : start + len(part)]).all()


@pytest.mark.parametrize("at", [0, 40, -20, -1])
def test_damage_is_noticed(at):
    ids = np.arange(5000, dtype=np.uint32) % 77
    coded = bytearray(ts.encode_blocks([ids], table_for(ids))[0])
    coded[at] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        ts.decode_blocks([bytes(coded)], table_for(ids))


def test_joined_crc32():
    a, b = b"some bytes", bytes(range(256)) * 9
    assert ts.joined_crc32(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert ts.joined_crc32(0, zlib.crc32(b), len(b)) == zlib.crc32(b)


def test_words_as_the_library():
    encoder, fresh, rng = ts.WordEncoder(PATH, memory=50), Tokenizer.from_file(PATH), random.Random(2)
    parts = [*"abS'. ,!|%\n\té\x1c\x85Ⅷ½中1́ΣİA", "'s", "'re", "<|endoftext|>", "\u1ac1", "\u1aca", "e\u0301", "\u0323\u0301", "ﬁ", "Ω", "ǅ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x300, 0x3000)])) for _ in range(6)) for _ in range(6000)]
    texts += ["A" + chr(c) + "b" for c in range(0x1AB0, 0x1AFF)]
    want = fresh.encode_batch(texts, add_special_tokens=False)
    for text, got, one in zip(texts, encoder.encode(texts), want, strict=True):
        assert np.frombuffer(got, encoder.dtype).tolist() == one.ids, repr(text)


def test_added_tokens_as_loaded():
    encoder, tokenizer = ts.WordEncoder(PATH), Tokenizer.from_file(PATH)
    assert tokenizer.encode("hello <|endoftext|> world", add_special_tokens=False).ids == [3306, 49407, 1002]
    parts = ["hello", " ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|", "|>", "World", ".", "É", "endoftext", "\n", "|"]
    rng = random.Random(3)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(2000)]
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(got, encoder.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_store(spark):
    long_text = " ".join(f"w{i % 977} x" for i in range(60_000))  # reaches over several blocks
    rows = [(5, "five words are in here", 1), (3, None, 1), (4, "", 1), (9, long_text, 1), (-2, "minus", 1), (5, "five again", 1), (None, "no id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    path = new_folder(spark, "store-test")
    ts.write_store(docs, PATH, path, file_bytes=1 << 14)
    got = ts.read_documents(spark, path).collect()
    tokenizer = Tokenizer.from_file(PATH)
    own = [(i is not None, i or 0, tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, _ in rows]
    own.sort(key=lambda r: (r[0], r[1], np.array(r[2], "<u2").tobytes()))
    start, want = 0, set()
    for known, i, ids in own:
        want.add((i if known else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert {(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want and len(got) == len(rows)
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.filter("n = 65536").count() >= 1


def test_empty_store(spark):
    path = new_folder(spark, "store-test")
    ts.write_store(spark.createDataFrame([], "doc_id long, text string"), PATH, path)
    assert ts.read_documents(spark, path).count() == 0


def test_texts_are_cut_and_folded_as_by_the_library():
    """Every character that Arrow handles, between words and at the ends, beside nulls and other texts."""
    encoder, fresh = ts.WordEncoder(PATH, memory=300), Tokenizer.from_file(PATH)
    chars = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), 0x20AC, 0x3000]]
    texts = [None, "", " ", *chars, *(f"Ab{c}Cd e" for c in chars), *(f"{c} x{c}" for c in chars), "Same same SAME", "ΑΣ Same", None]
    want = [e.ids for e in fresh.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for got in (encoder.encode(texts), [encoder.encode([t])[0] for t in texts]):
        assert [np.frombuffer(b, encoder.dtype).tolist() for b in got] == want


def test_a_word_is_looked_up_once_for_many_texts(monkeypatch):
    encoder, asked = ts.WordEncoder(PATH), []
    known = encoder._word_ids
    monkeypatch.setattr(encoder, "_word_ids", lambda words: asked.extend(words) or known(words))
    texts = ["the house, the river", "The river the house,"] * 50
    encoder.encode(texts)
    assert sorted(asked) == ["house,", "river", "the"]


def test_counts_of_many_documents(monkeypatch):
    rng, counted = np.random.default_rng(8), []
    own = [(w, rng.integers(0, 60_000, n).astype(f"<u{w}")) for w, n in [(2, 5), (4, 300), (2, 1)] * 300]
    batch = pa.RecordBatch.from_arrays([pa.array([w for w, _ in own], pa.int32()), pa.array([x.tobytes() for _, x in own], pa.binary())], ["width", "ids"])
    bincount = np.bincount
    monkeypatch.setattr(np, "bincount", lambda x: counted.append(len(x)) or bincount(x))
    (got,) = ts._token_counts(iter([batch, batch.slice(0, 0)]))
    ids, n = np.unique(np.concatenate([x.astype("<u4") for _, x in own]), return_counts=True)
    assert got.column(0).to_pylist() == ids.tolist() and got.column(1).to_pylist() == n.tolist()
    assert len(counted) < 10
