import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from kindling.llm import byte_bpe, worker_memory

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(byte_bpe.read_ranks(PATH), PATTERN)


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), encoder.dtype).tolist()


def test_random_texts_as_the_library(encoder, reference):
    rng = random.Random(5)
    parts = [*"ab cd  \n\t'sS\xa0 é\x1c\x85٣½Ⅷ中文🙂́.,!0179", "'re", "the", "ing", " the", "\r\n", "   ", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert ids(encoder, text) == reference.encode_ordinary(text), repr(text)


@pytest.mark.parametrize("text", ["a" * 50_001, "ab" * 30_000, "".join(random.Random(1).choice("abcde") for _ in range(60_000))])
def test_very_long_pretokens(encoder, reference, text):
    assert ids(encoder, text) == reference.encode_ordinary(text)


def test_queue_is_empty_after_every_pretoken(encoder):
    ids(encoder, "unbelievablyuncommonword xyzzyqqq")
    assert not encoder.buckets and not any(encoder.bitmap)


def test_memory_stays_bounded(reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMORY", 6)
    small = byte_bpe.Encoder(byte_bpe.read_ranks(PATH), PATTERN)
    text = " ".join(f"word{i} other{i}, plain {'ab'[i % 2] * i}." for i in range(50))
    for _ in range(2):
        assert ids(small, text) == reference.encode_ordinary(text)
    assert len(small.pieces) <= 4 and len(small.units) <= 8


def test_merging_together_is_merging_alone(encoder):
    rng = random.Random(4)
    parts = ["an", "th", "en", "a", "n", "é", "zz", "0", "the", "aaa"]
    pieces = [(" " * rng.randrange(2) + "".join(rng.choice(parts) for _ in range(rng.randrange(12)))).encode() for _ in range(4000)]
    pieces += [b"", b"a" * 5000, b"an" * 3000, pieces[0]]
    for at in range(0, len(pieces), 700):
        some = pieces[at : at + 700]
        assert [np.frombuffer(b, encoder.dtype).tolist() for b in encoder.merge_all(some)] == [encoder.merge(p) for p in some]


def test_order_within_a_bucket():
    """Ranks under which a merge makes a pair of a lower rank, which has to come next."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 260, b"cab": 270, b"bb": 280, b"abab": 259, b"ba": 310}
    odd = byte_bpe.Encoder(ranks, PATTERN)
    rng = random.Random(6)
    pieces = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))).encode() for _ in range(3000)]

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    want = [[ranks[p]] if p in ranks else plain(p) for p in pieces]
    assert [odd.merge(p) for p in pieces] == want
    assert [np.frombuffer(b, odd.dtype).tolist() for b in odd.merge_all(pieces)] == want


def test_tables(spark, reference):
    rows = [(1, "Hello there, world.", 7), (2, None, 7), (3, "", 7), (1, "Hello there, world.", 7), (None, "naïve  \n x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(2)
    out = byte_bpe.tokenize(docs, PATH, PATTERN)
    assert out.columns == ["doc_id", "text", "ids"]
    back = out.withColumn("bytes", byte_bpe.decode(out["ids"], PATH, PATTERN)).collect()
    assert len(back) == 5
    for r in back:
        assert np.frombuffer(r["ids"], "<u4").tolist() == reference.encode_ordinary(r["text"] or "")
        assert bytes(r["bytes"]).decode() == (r["text"] or "")
    told = {(r["key_"], r["ids_sha256"]): r for r in byte_bpe.round_trip(docs, PATH, PATTERN).withColumnRenamed("doc_id", "key_").collect()}
    want = hashlib.sha256(np.array(reference.encode_ordinary("Hello there, world."), "<u4").tobytes()).hexdigest()
    assert told[1, want]["n_tokens"] == 5
    assert told[1, want]["decoded_sha256"] == hashlib.sha256(b"Hello there, world.").hexdigest()
    assert byte_bpe.round_trip(docs.limit(0), PATH, PATTERN).count() == 0


def test_many_texts_share_one_queue(encoder, reference, monkeypatch):
    column = pa.array(["ab cd" * 200] * 6_000 + [None])
    # A queue costs a step for every rank in it, however few texts it serves.
    assert [len(some) for some in byte_bpe._texts(column)] == [6_001]
    made = random.Random(5)
    texts = ["".join(made.choices("abcdé ,\n", k=made.randrange(60))) for _ in range(300)]
    expected = [reference.encode_ordinary(t) for t in texts]
    for pieces in (7, byte_bpe.PIECES):
        monkeypatch.setattr(byte_bpe, "PIECES", pieces)
        own = byte_bpe.Encoder(encoder.ranks, PATTERN)
        assert [np.frombuffer(b, own.dtype).tolist() for b in own.encode_all(texts)] == expected


def test_ids_leave_in_small_batches(spark, reference, monkeypatch):
    """As many ids as texts' bytes may come out of a batch; they do not wait for each other in the worker."""
    monkeypatch.setattr(byte_bpe, "OUT", 50)
    rows = [(i, None if i % 7 == 3 else f"text {i} of some words\n\n and  more {'x' * i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for output, columns in (("ids", ["doc_id", "text", "ids"]), ("text", ["doc_id", "text"])):
        out = byte_bpe.tokenize(docs, PATH, PATTERN, output=output)
        assert out.columns == columns
        got = {r["doc_id"]: np.frombuffer(r[output], "<u4").tolist() for r in out.collect()}
        assert got == {i: reference.encode_ordinary(t or "") for i, t in rows}
    column = pa.array([t for _, t in rows])
    slices = list(byte_bpe.some_texts(column, byte_bpe.OUT))
    assert pa.concat_arrays(slices).equals(column) and max(map(len, slices)) <= 3


def test_where_ids_are_kept_fewer_words_are_remembered():
    own = byte_bpe._encoder(PATH, PATTERN, byte_bpe.FEW)
    assert own.units.room + own.pieces.room <= byte_bpe.FEW // 2 + 1 and byte_bpe.FEW < byte_bpe.MEMORY // 4
    worker_memory.forget()


def test_forget_drops_what_is_held():
    worker_memory.remembered("large", lambda: bytearray(10))
    worker_memory.forget()
    made = []
    worker_memory.remembered("large", lambda: made.append(1) or made)
    assert made == [1]
    worker_memory.forget()
