"""Counts and verdicts against plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kindling.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text, lang):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    stop = sum(w.rstrip(".,;:!?").lower() in qr.STOP_WORDS.get(lang, ()) for w in words)
    n = len(words)
    counts = (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
    letters = sum(any(c.isalpha() for c in w) for w in words)
    bullets = sum(bool(re.match(r"[ \t]*[-*•●▪‣◦][ \t]", x)) for x in lines)
    dots = sum(bool(re.search(r"(…|\.\.\.)[\x20\x09-\x0D]*\Z", x)) for x in lines)
    base = n < 20 or 100 * counts[4] > 30 * n
    good = (
        200 * n <= 100 * counts[1] <= 1200 * n and 100 * counts[2] <= 10 * n and 100 * letters >= 80 * n
        and (lang not in qr.STOP_WORDS or 100 * stop >= 2 * n)
        and 100 * counts[3] <= 30 * len(lines) and 100 * bullets <= 90 * len(lines) and 100 * dots <= 30 * len(lines)
    )
    return *counts, base, good and not base


def judged(spark, rows):
    df = spark.createDataFrame(rows, "id int, text string, lang string")
    out = qr.apply_rules(df).select("id", "quality.*")
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return {r["id"]: tuple(r[f] for f in fields) for r in out.collect()}


SENTENCE = "The house of the man was at the end of a long road, and it is hard to find from here"
CASES = [
    None, "", " \n\t\x0b\x0c\r ", "one", SENTENCE, SENTENCE + ".\n" + SENTENCE + ".", " ".join(["a"] * 7), " ".join(["a"] * 8), " ".join(["a"] * 9),
    " ".join(f"w{i % 9}" for i in range(40)), " ".join(f"the{i}" for i in range(30)), SENTENCE + " ### $$$ &&&", "😀 " * 30, "x" * 5000 + " the of",
    "\n".join(["- " + f"item{i} of the list" for i in range(20)]), "\n".join(f"go on{i}..." for i in range(20)), "a\x0bb\x0cc\r\nd\n\n e f g\u0085h",
    "same line of the text\n" * 9, "\n".join(f"{i} | {i}" for i in range(30)),
]


def test_counts_as_plain_python(spark):
    rng = random.Random(5)
    texts = list(CASES)
    for _ in range(150):
        vocab = [rng.choice(["the", "and", "of", "und", "a1", "##", "...", "é", "12", "long" * 4]) for _ in range(rng.choice([2, 6, 40]))]
        texts.append("".join(rng.choice(vocab) + rng.choice([" ", " ", "  ", "\n", "\t", ", "]) for _ in range(rng.randrange(120))))
    rows = [(i, t, rng.choice(["en", "de", "xx", None])) for i, t in enumerate(texts)]
    got = judged(spark, rows)
    for i, text, lang in rows:
        assert got[i] == plain(text, lang), (text, lang)


def test_long_text_is_linear(spark):
    words = [f"w{i}" for i in range(200_000)]
    got = judged(spark, [(1, " ".join(words), "xx"), (2, " ".join(words + words[500:520]), "xx")])
    assert got[1][4] == 0 and got[2][4] == 40


def test_a_rule_decides_by_its_threshold(spark):
    df = spark.createDataFrame([(SENTENCE + " #", "en")], "text string, lang string")

    def kept(at_most):
        rules = (qr.Rule("symbols", "n_symbols", "n_words", at_most=at_most),)
        return qr.apply_rules(df, rules=rules, output="q").first()["q"]

    assert kept(4)["broken"] == ["symbols"] and not kept(4)["kept"]
    assert kept(5)["kept"]


@pytest.mark.parametrize("lang, kept", [("en", False), ("de", False), (None, True), ("xx", True)])
def test_stop_words_count_in_their_language_only(spark, lang, kept):
    text = " ".join(f"house{i}" for i in range(25))
    assert judged(spark, [(1, text, lang)])[1][-1] is kept


def test_clashing_columns_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, SENTENCE, "en", "mine")] * 2, "id int, text string, lang string, quality string")
    out = qr.apply_rules(df.withColumn("n_words", F.lit(-1)))
    assert out.columns == ["id", "text", "lang", "n_words", "quality"]
    assert [(r["n_words"], r["quality"]["n_words"]) for r in out.collect()] == [(-1, 21)] * 2
    assert qr.apply_rules(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("a", "en")], "text string, lang string")
    plan = qr.apply_rules(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
