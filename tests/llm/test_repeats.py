import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as some

from kindling.llm import repeats


@settings(deadline=None, max_examples=300)
@given(some.lists(some.integers(0, 3), max_size=60))
def test_suffix_array(codes):
    want = sorted(range(len(codes)), key=lambda i: codes[i:])
    assert repeats.suffix_array(np.array(codes, np.int64)).tolist() == want


def test_suffix_array_of_long_runs():
    for codes in ([1] * 5000, [1, 2] * 2500, list(range(300)) * 9, [2, 1, 1] * 1500):
        want = sorted(range(len(codes)), key=lambda i: codes[i : i + 3000])
        got = repeats.suffix_array(np.array(codes, np.int64)).tolist()
        assert [codes[i : i + 50] for i in got] == [codes[i : i + 50] for i in want]
        assert sorted(got) == list(range(len(codes)))


def brute(rows, length=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b) + 1)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((i, len(b), sum(gone), bytes(gone).replace(b"\0", b" ").split().__len__(), kept))
    return sorted(map(repr, out))


def made(rng):
    letters = "abcdefgh é\n"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passage, base = text(330), text(900)
    rows = [(i, text(rng.randint(0, 700))) for i in range(40)]
    rows += [(100 + i, text(rng.randint(0, 300)) + passage + text(rng.randint(0, 300))) for i in range(30)]
    for i in range(25):  # near copies
        at = rng.randrange(900)
        rows.append((200 + i, base[:at] + rng.choice(["", "#", "##"]) + base[at + 1 :]))
    rows += [(300, base), (301, base), (302, None), (303, ""), (None, base[:400]), (304, "z" * 3000), (305, "xy" * 900), (306, "z" * 199), (300, base)]
    rows += [(307, passage[:199]), (308, passage[10:210]), (309, text(250) * 2)]
    return rows


@pytest.mark.parametrize("group", [repeats.GROUP, 3])
def test_removal(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = made(random.Random(group))
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string").repartition(4)
    out = repeats.remove_repeats(docs).collect()
    assert sorted(repr((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))) for r in out) == brute(rows)


def test_stretches_of_long_texts(monkeypatch):
    monkeypatch.setattr(repeats, "_CHUNK", 1500)
    data = np.frombuffer(random.Random(4).randbytes(9000), np.uint8)
    _, _, first, last, _ = repeats.contexts(data)
    assert [s for a, b in zip(first, last, strict=True) for s in range(a, b + 1)] == list(range(9000 - 199))


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("group", [1, 10])
def test_crowded_cores(spark, monkeypatch, group):
    """Copies of a cell are at one place each, also where every string is hashed."""
    monkeypatch.setattr(repeats, "GROUP", group)
    for seed in (3, 5):
        rows = made(random.Random(seed))
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        out = repeats.remove_repeats(docs).collect()
        assert sorted(repr((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))) for r in out) == brute(rows)


def test_cells_are_written_once(spark, monkeypatch):
    """Bytes of cells are settled once, not again by class; texts are compressed before they are shuffled."""
    settled = []
    settle = repeats.settle
    monkeypatch.setattr(repeats, "settle", lambda df, name: settled.append((name, settle(df, name))) or settled[-1][1])
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    rng = random.Random(6)
    passage = " ".join(rng.choice(words) for _ in range(80))
    rows = [(i, " ".join(rng.choice(words) for _ in range(50 + i)) + passage + " ".join(rng.choice(words) for _ in range(90))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = repeats.remove_repeats(docs)
    cells = {name: df.count() for name, df in settled if "before" in df.columns}
    assert cells["cells"] > 0
    assert sum(cells.values()) == cells["cells"]
    packed = [pa.RecordBatch.from_pydict({"key": [1, 2], "text": [rows[0][1].encode(), b""]})]
    (batch,) = repeats._pack(iter(packed))
    assert [repeats._unpack(t, n) for t, n in zip(batch["text"].to_pylist(), batch["size"].to_pylist(), strict=True)] == packed[0]["text"].to_pylist()
    assert len(batch["text"][0].as_py()) * 2 < len(rows[0][1])
