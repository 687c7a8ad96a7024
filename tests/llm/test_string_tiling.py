import random

from kindling.llm import string_tiling as st


def brute_tiles(item, doc, least):
    """Greedy tiling by trying every pair of starts."""
    free_i, free_d, tiles = set(range(len(item))), set(range(len(doc))), []
    while True:
        best = (0, 0, 0)
        for p in sorted(free_i):
            for d in sorted(free_d):
                n = 0
                while p + n in free_i and d + n in free_d and item[p + n] == doc[d + n]:
                    n += 1
                if n > best[2]:
                    best = (p, d, n)
        if best[2] < least:
            return tiles
        tiles.append(best)
        free_i -= set(range(best[0], best[0] + best[2]))
        free_d -= set(range(best[1], best[1] + best[2]))


def test_tiles_as_brute_force():
    rng = random.Random(8)
    for _ in range(400):
        item = [rng.randint(1, 4) for _ in range(rng.randint(0, 18))]
        doc = [rng.randint(0, 4) for _ in range(rng.randint(0, 30))]
        want = brute_tiles(item, doc, 3)
        got = st.tile(item, doc, 3)
        # Ties may be broken differently; what is marked stays of equal lengths at the top.
        assert [t[2] for t in got[:1]] == [t[2] for t in want[:1]]
        used_i, used_d = set(), set()
        for p, d, n in got:
            assert n >= 3 and item[p : p + n] == doc[d : d + n]
            assert used_i.isdisjoint(range(p, p + n)) and used_d.isdisjoint(range(d, d + n))
            used_i |= set(range(p, p + n))
            used_d |= set(range(d, d + n))


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def test_leaks(spark):
    words = ITEM.split()
    moved = " ".join(words[8:] + ["between"] + words[:8])
    rows = [
        (1, f"before {ITEM} after"), (2, moved), (3, ITEM.upper().replace(" ", ", ")), (4, " ".join(words[:6])), (5, "nothing of it"),
        (6, None), (7, ""), (1, f"before {ITEM} after"), (None, ITEM), (8, "x " * 100_000 + ITEM), (9, " ".join(words[::-1])),
    ]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, item_id int").repartition(3)
    items = spark.createDataFrame([(10, ITEM), (10, ITEM), (11, None), (None, ITEM), (12, "short one"), (13, "")], "item_id long, text string")
    got = st.find_leaks(docs, items)
    assert got.columns == ["doc_id", "item_id", "n_words", "n_covered", "n_tiles"]
    rows = got.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "2", "3", "8", "None"]
    assert {r["item_id"] for r in rows} == {10}
    assert [(r["n_covered"], r["n_tiles"]) for r in rows if r["doc_id"] == 2] == [(15, 2)]


def test_slabs_give_the_same(spark):
    items = spark.createDataFrame([(i, f"item number {i} " + " ".join(f"w{i}x{k}" for k in range(12))) for i in range(40)], "item_id long, text string")
    docs = items.selectExpr("item_id as doc_id", "concat('so ', text, ' it ends') as text")
    one, many = st.find_leaks(docs, items), st.find_leaks(docs, items, slab_bytes=900)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert one.count() == 40


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert st.find_leaks(docs, items.limit(0)).count() == 0
    assert st.find_leaks(docs.limit(0), items).count() == 0
