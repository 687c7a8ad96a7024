"""Counts and ranks against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindling.llm import phrase_graph as pg

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def plain_counts(rows, longest=5):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(longest, len(words) - i) + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    return counts, total


def plain(rows, longest=5, least=3, per_lang=2000, share=100):
    counts, total = plain_counts(rows, longest)
    found = {p: n for p, n in counts.items() if len(p[1]) > 1 and n >= least}
    inside = set()
    for (lang, words), n in found.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                part = (lang, words[i : i + k])
                if part in found and 100 * n >= share * found[part]:
                    inside.add(part)
    by_lang = defaultdict(list)
    for (lang, words), a in found.items():
        if (lang, words) not in inside:
            scores = []
            for k in range(1, len(words)):
                left, right = counts[lang, words[:k]], counts[lang, words[k:]]
                scores.append((1000 * a * total[lang] // (left * right), k, left, right))
            score, _, left, right = min(scores)
            by_lang[lang].append((-score, -a, " ".join(words).encode(), left, right))
    out = []
    for lang, listed in by_lang.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(listed)[:per_lang], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def found(spark, rows, parts=3, **options):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(parts)
    return sorted(map(tuple, pg.collocations(df, **{"min_count": 3, **options}).collect()))


def random_rows(seed, n=120, vocab=25):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocab)] + ["É", "ß", "Word", "wORD", "日本"]
    fixed = [" ".join(rng.choice(words) for _ in range(rng.choice([4, 9, 30]))) for _ in range(4)]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "; "]) for _ in range(rng.randrange(40)))
        if rng.random() < 0.5:
            text += rng.choice(fixed) + rng.choice(["", ".", " " + rng.choice(words)])
        rows.append((text, rng.choice(["en", "en", "de", None])))
    return rows


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"bits": 11}), (3, {"longest": 3, "per_lang": 7}), (4, {"longest": 2, "share": 60}), (5, {"block": 64})])
def test_as_plain_python(spark, seed, options):
    rows = random_rows(seed) + [("a b c d e f g h", "en")] * 4
    expected = {k: v for k, v in options.items() if k not in ("bits", "block")}
    assert found(spark, rows, **options) == plain(rows, **expected)


def test_nothing_special_is_lost(spark):
    rows = [
        (None, "en"), ("", None), (" . , \n\t", "en"), *[("one two", "a\nb c")] * 3, *[("x" * 3000 + " y", "")] * 3, *[("a a a a a a a a a", "en")] * 2,
        *[("cut. Here cut! here", None)] * 4, *[("b c d e\x00f", "en")] * 3, ("Never Again", "en"),
    ]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == [] and found(spark, [(None, None)]) == []


def test_scores_beyond_64_bits_are_exact(spark):
    df = spark.createDataFrame([(10**15 + 7, 10**15 + 1, 10**8 + 1, 10**9 + 7)], "a long, n long, l long, r long")
    sql = "(cast(1000 as decimal(4,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    assert df.select(F.expr(sql)).first()[0] == 1000 * (10**15 + 7) * (10**15 + 1) // ((10**8 + 1) * (10**9 + 7))


def test_counts_and_paths(spark):
    rows = random_rows(7, 80) + [(" ".join(f"p{i}" for i in range(200)), "en")] * 5
    df = spark.createDataFrame(rows, "text string, lang string")
    windows = pg.window_counts(df, 5, 3, pg.LEAST_BITS)
    got = {(k.rpartition("\n")[0], tuple(k.rpartition("\n")[2].split(" "))): n for k, _, n in pg.phrase_counts(windows, 5, 3).collect()}
    assert got == {p: n for p, n in plain_counts(rows)[0].items() if n >= 3}
    paths = {r["key"]: r for r in pg.compact_paths(pg.graph_nodes(windows, 5)).collect()}
    whole = paths["en\n" + " ".join(f"p{i}" for i in range(200))]
    assert (whole["n"], whole["inner"]) == (5, 195)


def test_blocks_end_where_pieces_end():
    texts = [b"aa bb. cc dd\n" * 9, b"", b"x" * 100, b"y. " + b"z" * 70 + b"." + b"w" * 5]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    ranges = list(pg._blocks(data, offsets, 16))
    assert ranges[0][0] == 0 and ranges[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    assert all(e in offsets or bytes(data[e - 1 : e]) in (b".", b"\n") for _, e in ranges)


def test_clashing_columns(spark):
    rows = [("one two three", "en")] * 4
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("text", "lang", "1 AS key", "2 AS n", "3 AS size", "4 AS rank", "text AS phrase")
    assert sorted(map(tuple, pg.collocations(df, min_count=3).collect())) == plain(rows)
