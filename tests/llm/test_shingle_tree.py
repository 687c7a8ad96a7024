import random
import re

import numpy as np
import pytest

from kindling.llm import shingle_tree as sh


def sets_of(text, size=5):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b]:
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(rows[a][0]), find(rows[b][0])
                    root[max(x, y)] = min(x, y)
    return sorted(repr((i, len(s), None if i is None else find(i))) for (i, _), s in zip(rows, sets, strict=True))


def made(rng):
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstuv")
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 120)))) for i in range(120)]
    passage = [word() for _ in range(30)]
    rows += [(200 + i, " ".join([word() for _ in range(rng.randint(0, 40))] + passage + [word() for _ in range(rng.randint(0, 20))])) for i in range(60)]
    for family in range(6):
        base = [word() for _ in range(rng.choice([8, 60, 250]))]
        for i in range(30):
            own = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 40)):
                own[rng.randrange(len(own))] = word()
            rows.append((1000 + 100 * family + i, " ".join(own)))
    rows += [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "One two"), (5004, "ONE  TWO"), (5005, "one two three"), (None, "One two"), (5003, "One two")]
    rows += [(5006, "É one two three four five"), (5007, "é one two three four five")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [sh.BLOCK, 4])
def test_components(spark, monkeypatch, block):
    monkeypatch.setattr(sh, "BLOCK", block)
    rows = made(random.Random(block))
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string").repartition(4)
    out = sh.similar_texts(docs).collect()
    assert sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in out) == brute(rows)


def test_sets_of_long_and_short_texts(monkeypatch):
    monkeypatch.setattr(sh, "_PIECE", 500)
    rng = random.Random(1)
    texts = [None, "", " ".join(str(rng.randrange(50)) for _ in range(3000)), "a b", "x" * 4000, "A\x0bB\x0cC D e f"]
    for text, own in zip(texts, sh.shingle_sets(texts), strict=True):
        assert len(own) == len(sets_of(text))


def test_tree_loses_no_pair():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 60, 400).astype(np.uint64)
    sets = []
    for _ in range(150):
        own = base.copy()
        own[rng.integers(0, 400, rng.integers(0, 90))] = rng.integers(0, 1 << 60, 1).astype(np.uint64)
        sets.append(np.unique(own))
    points = np.array([sh._folded(sh.point_of(s), 64) for s in sets])
    tree = sh.CountTree(points, np.array(list(map(len, sets))))
    for i, s in enumerate(sets):
        found = set(tree.candidates(points[i], len(s)).tolist())
        assert {j for j, t in enumerate(sets) if sh._linked(s, t)} <= found


def test_similar_sets_share_enough_first_shingles():
    rng, levels = np.random.default_rng(2), np.zeros(sh.CELLS, np.uint8)
    levels[::3] = 2
    for n in (1, 3, 4, 20, 333):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: len(a) - len(a) // 8], rng.integers(0, 1 << 63, n // 8).astype(np.uint64)]))
        if sh._linked(a, b):
            common = set(sh.first_shingles(a, levels)[0].tolist()) & set(sh.first_shingles(b, levels)[0].tolist())
            assert len(common) >= min(len(a), len(b)) // 10 + 1


def test_empty_table(spark):
    assert sh.similar_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = spark.createDataFrame([(1, None), (2, "only one text")], "doc_id long, text string")
    assert {tuple(r) for r in sh.similar_texts(alone).collect()} == {(1, 0, 1), (2, 1, 2)}
