import numpy as np
import pytest

from kindling.llm import vector_forest as vf


def brute(rows, threshold=0.98):
    usable = {}
    for k, (i, v, label) in enumerate(rows):
        if i is None or v is None or label is None or len(v) != 16 or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        usable[k] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, va in usable.items():
        for b, vb in usable.items():
            if a != b and rows[a][2] == rows[b][2] and va @ vb >= threshold:
                n[a] += 1
                x, y = find(a), find(b)
                if rows[x][0] <= rows[y][0]:
                    root[y] = x
                else:
                    root[x] = y
    out = []
    for k, (i, *_) in enumerate(rows):
        component = rows[find(k)][0]
        out.append((i, n[k], component, i is None or i == component))
    return sorted(map(repr, out))


@pytest.mark.parametrize("leaf, block", [(vf.LEAF, vf.BLOCK), (8, 16)])
def test_links(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(vf, "LEAF", leaf)
    monkeypatch.setattr(vf, "BLOCK", block)
    rng = np.random.default_rng(leaf)
    rows = [(i, rng.standard_normal(16).astype("f4").tolist(), i % 3) for i in range(150)]
    for family in range(5):
        base = rng.standard_normal(16)
        for i in range(30):
            rows.append((1000 + 100 * family + i, (base + rng.standard_normal(16) * 0.12).astype("f4").tolist(), family % 2))
    rows += [(2000 + i, rows[0][1], 0) for i in range(40)]  # copies
    rows += [(3000, rows[0][1], None), (3001, None, 1), (3002, [0.0] * 16, 1), (3003, [float("nan")] + [1.0] * 15, 1), (3004, [None] + [1.0] * 15, 1)]
    rows += [(3005, [float("inf")] + [1.0] * 15, 1), (3006, [1.0] * 3, 1), (3007, [], 1), (None, rows[0][1], 0), (3008, [x * 2 for x in rows[0][1]], 0)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, kept string").repartition(4)
    out = vf.near_duplicates(docs).collect()
    assert sorted(repr((r["vec_id"], r["n_links"], r["component_id"], r["kept"])) for r in out) == brute(rows)


def test_forest_keeps_close_pairs_together():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x + rng.standard_normal(x.shape) * 0.02
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    close = np.einsum("ij,ij->i", x, near) >= 0.98
    forest = vf.Forest(x[:1000], 64, 6, vf.SPILL * 0.2)
    met = np.zeros(2000, bool)
    for tree in range(vf.TREES):
        own, other = (set(zip(*map(np.ndarray.tolist, forest.leaves(tree, v)), strict=True)) for v in (x, near))
        for row, _ in own & other:
            met[row] = True
    assert close.sum() > 500 and met[close].mean() >= 0.999


def test_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vf.near_duplicates(empty).count() == 0
    alone = spark.createDataFrame([(4, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in vf.near_duplicates(alone).collect()] == [(4, 0, 4, True)]
