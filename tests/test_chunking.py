import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kindling.operators import chunking
from kindling.sources import large


def windows(text, size, overlap):
    return [text[i : i + size] for i in range(0, len(text), size - overlap)]


def chunks_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.doc_id, r.chunk_idx)):
        out.setdefault(r.doc_id, []).append(r.text)
        assert r.chunk_idx == len(out[r.doc_id]) - 1
    return out


def sample_texts():
    rng = random.Random(1)
    alphabet = "ab .\n\r\té中\U0001f600́"
    lengths = [0, 1, 19, 20, 21, 279, 280, 281, 300, 301, 559, 560, 561, 5000]
    return ["".join(rng.choice(alphabet) for _ in range(n)) for n in lengths]


@pytest.mark.parametrize("size,overlap", [(300, 20), (10, 0), (10, 7), (5, 4)])
def test_fixed_windows_match_slicing(spark, size, overlap):
    texts = sample_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = chunks_of(chunking.chunk_fixed(docs, size, overlap))
    assert got == {i: windows(t, size, overlap) for i, t in enumerate(texts) if t}
    stride = size - overlap
    assert all("".join(c[:stride] for c in got[i]) == t for i, t in enumerate(texts) if t)
    counts = {r.doc_id: r.n_chunks for r in chunking.chunk_counts(docs, size, overlap).collect()}
    assert counts == {i: -(-len(t) // stride) for i, t in enumerate(texts)}


def test_keep_empty_and_batches(spark):
    docs = spark.createDataFrame([(1, ""), (2, "x" * 900), (3, None)], "doc_id int, text string")
    rows = chunking.chunk_fixed(docs, keep_empty=True).collect()
    assert {(r.doc_id, r.chunk_idx) for r in rows} == {(1, None), (2, 0), (2, 1), (2, 2), (2, 3), (3, None)}
    numbered = chunking.number_batches(chunking.chunk_fixed(docs), rows=3).collect()
    assert sorted((r.chunk_idx, r.batch_idx) for r in numbered) == [(0, 0), (1, 0), (2, 0), (3, 1)]


def test_bad_sizes(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    for size, overlap in ((5, 5), (5, -1)):
        with pytest.raises(ValueError):
            chunking.chunk_fixed(docs, size, overlap)
        with pytest.raises(ValueError):
            chunking.chunk_sentences(docs, size, overlap)


def packed(text, size, overlap):
    """Sentence chunks by plain loops over the definition."""
    units = []
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        words = [m.span() for m in re.finditer(r"\S+", sentence)]
        for i in range(0, len(words), size):
            run = words[i : i + size]
            units.append((sentence[run[0][0] : run[-1][1]], len(run)))
    chunks, start = [], 0
    while start < len(units):
        stop, used = start, 0
        while stop < len(units) and used + units[stop][1] <= size:
            used += units[stop][1]
            stop += 1
        chunks.append(" ".join(u for u, _ in units[start:stop]))
        if stop == len(units):
            break
        back, held = stop, 0
        while (
            back > start
            and held + units[back - 1][1] <= overlap
            and held + units[back - 1][1] + units[stop][1] <= size
        ):
            back -= 1
            held += units[back][1]
        start = back
    return chunks


def test_sentence_chunks_match_plain_loops(spark):
    rng = random.Random(2)
    texts = ["", "   ", "One. Two! Three? Four", "word " * 50]
    for _ in range(60):
        texts.append("".join(rng.choice(["a", "bb", ".", "! ", "? ", ".\n", " ", "\n"]) for _ in range(rng.randint(1, 200))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for size, overlap in ((8, 3), (5, 0), (3, 2)):
        got = chunks_of(chunking.chunk_sentences(docs, size, overlap))
        assert got == {i: packed(t, size, overlap) for i, t in enumerate(texts) if t.split()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 10), min_size=1, max_size=40), st.integers(10, 25), st.integers(0, 9))
def test_spans_cover_everything_in_order(counts, size, overlap):
    import numpy as np

    spans = chunking._spans(np.array(counts), size, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(counts)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d
        assert sum(counts[c:b]) <= overlap
    assert all(sum(counts[a:b]) <= size for a, b in spans)


@pytest.mark.parametrize("range_bytes", [1000, 1 << 20])
def test_large_files_give_the_same_chunks(spark, tmp_path, range_bytes):
    rng = random.Random(3)
    bodies = [
        b"",
        b"\n",
        b"no end",
        b"ends\n",
        b"ends with return\r",
        b"mixed\r\nends\rhere\r\r\nand\n\r\n",
        b"bad \xff byte\nnext",
        b"\xff",
        b"last is bad\n\xff",
        b"\xef\xbb\xbfmarked \xef\xbf\xbd and bad \xff",
        b"\r" * 5000,
        ("plain words with \u00e9 " * 900).encode(),
        ("x" * 20000 + "é" * 3000).encode(),
        "\n".join("中" * rng.randint(0, 300) + "b" for _ in range(200)).encode(),
        "".join(rng.choice(["a", "\n", "\r", "\r\n", "\U0001f600"]) for _ in range(9000)).encode(),
    ]
    for i, body in enumerate(bodies):
        (tmp_path / f"{i}.log").write_bytes(body)
    got = chunks_of(chunking.chunk_large_files(spark, str(tmp_path), range_bytes=range_bytes))
    expected = {}
    for i, body in enumerate(bodies):
        text = body.removeprefix(b"\xef\xbb\xbf").decode(errors="ignore").replace("\r\n", "\n").replace("\r", "\n")
        if text:
            expected[f"file:{tmp_path}/{i}.log"] = windows(text, 300, 20)
    assert got == expected


def test_pieces_of_any_size_read_the_same(monkeypatch, tmp_path):
    rng = random.Random(5)
    for charset in ("utf-8", "utf-16-le", "latin-1", "shift_jis"):
        text = "".join(rng.choice(["a", "\r", "\n", "\r\n", "z z"]) for _ in range(400))
        (tmp_path / "f").write_bytes(text.encode(charset))
        for size in (1, 2, 3, 7, 5000):
            monkeypatch.setattr(large, "PIECE_BYTES", size)
            got = "".join(large._texts(str(tmp_path / "f"), charset, 0))
            assert got == text.replace("\r\n", "\n").replace("\r", "\n")


def test_streamed_sentences_as_the_column_form(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["word ", "end. ", "stop!\n", "no?", " ", "x" * 30 + " "]) for _ in range(rng.randint(0, 400))) for _ in range(30)]
    texts += ["", " \n", "one", "a. b", " lead. trail. "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = chunking.chunk_sentences(docs, 12, 4).collect()
    for i, text in enumerate(texts):
        want = [r.text for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.chunk_idx)]
        for cut in (1, 7, 1000):
            pieces = iter([text[k : k + cut] for k in range(0, len(text), cut)])
            assert list(large._sentence_chunks(large._units(pieces, 12), 12, 4)) == want, (i, cut)


def test_only_files_of_several_ranges_are_counted(spark, tmp_path):
    texts = {"small.log": "small é. " * 50, "large.log": "large é. " * 400, "mark.log": "﻿"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    listed = [(str(tmp_path / n), (tmp_path / n).stat().st_size, "utf-8") for n in texts]
    told = spark.createDataFrame(listed, "file_path string, file_size long, charset string")
    found = large.ranges(told, 1000)
    assert {r.file_path.rsplit("/", 1)[1] for r in found.filter("chars is null").collect()} == {"small.log", "mark.log"}
    got = sorted((r.doc_id.rsplit("/", 1)[1], r.chunk_idx, r.text) for r in large.window_rows(found, 300, 20, keep_empty=True).collect())
    cut = [(n, i, texts[n][s : s + 300]) for n in ("large.log", "small.log") for i, s in enumerate(range(0, len(texts[n]), 280))]
    assert got == sorted([*cut, ("mark.log", None, None)])
