import random

from kindling.llm.line_windows import line_dedup


def brute(rows, window=3):
    first, later = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        lines = t.split("\n")
        for p in range(len(lines) - window + 1):
            w = tuple(lines[p : p + window])
            if first.setdefault(w, (i, p)) != (i, p):
                later.setdefault(i, set()).update(range(p, p + window))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        gone = later.get(i, set()) if i is not None else set()
        out.append((i, "\n".join(x for p, x in enumerate(lines) if p not in gone), len(lines), len(gone)))
    return sorted(map(repr, out))


def test_against_plain_python(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice("abcd") * rng.randint(0, 2) for _ in range(rng.randint(1, 14)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "one\ntwo"), (None, "a\nb\nc"), (903, "\n\n\n\n\n"), (904, "x\ny\nz\nx\ny\nz\n"), (905, "\n".join(f"l{i % 50}" for i in range(5000)))]
    rows.append(rows[7])  # a repeated row
    docs = spark.createDataFrame([(*r, "other") for r in rows], "doc_id long, text string, n_lines string").repartition(4)
    got = line_dedup(docs)
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed"]
    assert sorted(repr((r[0], r[1], r[2], r[3])) for r in got.collect()) == brute(rows)


def test_empty_table_and_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = line_dedup(docs)
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()
