import random

from kindling.llm.components import components


def test_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    edges += [(1000 + i, 1001 + i) for i in range(60)]  # a long chain
    edges += [(5000, 5001 + i) for i in range(100)]  # a star
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    links = spark.createDataFrame([*edges, edges[0], (None, 4), (5, None)], "a long, b long").repartition(3)
    got = components(links, "a", "b").collect()
    assert {r["node"]: r["component"] for r in got} == {n: find(n) for e in edges for n in e}
    assert len(got) == len({n for e in edges for n in e})


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
