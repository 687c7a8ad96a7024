"""Rules on the quality of a text, as one projection compiled from a table of thresholds.

A measure counts something in a text. A rule bounds one measure in hundredths of another, for all
languages or for some; a text is kept if it breaks none. Counts and thresholds are integers
and are compared by products, so no verdict depends on rounding. Only DataFrame functions
are used, in one pass without a shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindling.functions.text import evaluate_once

# --- fixed values: characters and words that the measures count ---------------------
WORD = r"[^\x20\x09-\x0D]+"
BETWEEN_WORDS = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
BULLET_LINE = r"^[\x20\x09]*[-*•●▪‣◦][\x20\x09]"
ELLIPSIS_LINE = r"(?:…|\.\.\.)[\x20\x09-\x0D]*\z"
ENDS_OF_WORDS = ".,;:!?"
STOP_WORDS = {
    "de": ["auch", "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "im", "in", "ist", "mit", "nicht", "sich", "und", "von", "zu"],
    "en": ["a", "and", "are", "as", "at", "be", "by", "for", "from", "have", "in", "is", "of", "on", "or", "that", "the", "to", "was", "with"],
    "es": ["al", "con", "de", "del", "el", "en", "es", "la", "las", "los", "no", "para", "por", "que", "se", "su", "un", "una", "y"],
    "fr": ["au", "avec", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une"],
}
# -----------------------------------------------------------------------------------

REPEAT_WINDOW = 8


class Rule(NamedTuple):
    """``at_least <= 100 * measure / per <= at_most``; a side that is None is open, ``langs`` None means all."""

    name: str
    measure: str
    per: str
    at_least: int | None = None
    at_most: int | None = None
    langs: tuple[str, ...] | None = None


# Texts that break one of these are not worth judging further.
BASE = (
    Rule("few_words", "n_words", "one", at_least=2000),
    Rule("repeated_words", "n_repeat_words", "n_words", at_most=30),
)
# Mean length of words, symbols, words with a letter, stop words, then shares of lines.
RULES = (
    Rule("word_length", "word_chars", "n_words", at_least=200, at_most=1200),
    Rule("symbols", "n_symbols", "n_words", at_most=10),
    Rule("letters", "n_letter_words", "n_words", at_least=80),
    *(Rule("stop_words", f"n_stop_words_{lang}", "n_words", at_least=2, langs=(lang,)) for lang in STOP_WORDS),
    Rule("equal_lines", "n_dup_lines", "n_lines", at_most=30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", at_most=90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", at_most=30),
)


def _repeated(words: Column, window: int) -> Column:
    """Words that lie in a window of words that occurs at least twice.

    A window is told by a 64-bit and a 32-bit hash over its words' 64-bit hashes. They are
    sorted only where there is a repetition, so the work is linear for any other text.
    """

    def covered(windows: Column) -> Column:
        def of_sorted(at: Column) -> Column:
            def same(x: Column, y: Column) -> Column:
                return F.coalesce((x["w"] == y["w"]) & (x["v"] == y["v"]), F.lit(False))

            twice = F.filter(at, lambda x, i: same(x, F.get(at, i - 1)) | same(x, F.get(at, i + 1)))
            starts = F.sort_array(F.transform(twice, lambda x: x["pos"]))
            return evaluate_once(starts, lambda p: F.aggregate(F.transform(p, lambda s, i: F.coalesce(F.least(F.get(p, i + 1) - s, F.lit(window)), F.lit(window))), F.lit(0), lambda a, x: a + x))

        return evaluate_once(F.sort_array(windows), of_sorted)

    def of_hashes(hashes: Column) -> Column:
        def at(i: Column) -> list[Column]:
            return [F.get(hashes, i + k) for k in range(window)]

        places = F.sequence(F.lit(0), F.size(hashes) - window)
        # A first look by one number for a window; equal numbers are a repetition or a chance.
        plain = F.transform(places, lambda i: F.xxhash64(*at(i)))
        repeats = evaluate_once(plain, lambda p: F.size(F.array_distinct(p)) < F.size(p))
        windows = F.transform(places, lambda i: F.struct(F.xxhash64(*at(i)).alias("w"), F.hash(*at(i)).alias("v"), i.alias("pos")))
        return F.when(F.size(hashes) < window, 0).when(repeats, covered(windows)).otherwise(0)

    return evaluate_once(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def _count(items: Column, test) -> Column:
    return F.size(F.filter(items, test))


def _is_one_of(listed: list[str]):
    return lambda w: F.lower(F.rtrim(w, F.lit(ENDS_OF_WORDS))).isin(listed)


def measure(text: Column, lang: Column, stop_words: dict[str, list[str]] = STOP_WORDS, repeat_window: int = REPEAT_WINDOW) -> Column:
    """All counts of a text as one struct of longs; a null text counts as an empty one.

    Stop words are counted in texts of their language only, elsewhere the count is 0.
    """

    def of_words_and_lines(known: Column) -> Column:
        words, lines = known["words"], known["lines"]
        counts = {
            "n_words": F.size(words),
            "word_chars": F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
            "n_symbols": F.regexp_count(known["text"], F.lit(SYMBOL)),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": _repeated(words, repeat_window),
            "n_lines": F.size(lines),
            "n_letter_words": _count(words, lambda w: w.rlike(r"\p{L}")),
            "n_bullet_lines": _count(lines, lambda x: x.rlike(BULLET_LINE)),
            "n_ellipsis_lines": _count(lines, lambda x: x.rlike(ELLIPSIS_LINE)),
            "one": F.lit(1),
        }
        for name, listed in stop_words.items():
            counts[f"n_stop_words_{name}"] = F.when(known["lang"] == name, _count(words, _is_one_of(listed))).otherwise(0)
        return F.struct(*(c.cast("long").alias(n) for n, c in counts.items()))

    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(whole, BETWEEN_WORDS, -1), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(WORD))
    return evaluate_once(F.struct(whole.alias("text"), lang.alias("lang"), words.alias("words"), lines.alias("lines")), of_words_and_lines)


def broken(counts: Column, lang: Column, rules: tuple[Rule, ...]) -> Column:
    """Names of the rules that a text breaks, in the order of the table."""

    def one(rule: Rule) -> Column:
        value, per = 100 * counts[rule.measure], counts[rule.per]
        wrong = F.lit(False)
        if rule.at_least is not None:
            wrong = wrong | (value < rule.at_least * per)
        if rule.at_most is not None:
            wrong = wrong | (value > rule.at_most * per)
        if rule.langs is not None:
            wrong = wrong & F.coalesce(lang.isin(*rule.langs), F.lit(False))
        return F.when(wrong, rule.name)

    return F.array_compact(F.array(*map(one, rules))) if rules else F.array().cast("array<string>")


def apply_rules(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str | None = "lang",
    base: tuple[Rule, ...] = BASE,
    rules: tuple[Rule, ...] = RULES,
    output: str = "quality",
) -> DataFrame:
    """``docs`` with a struct: the counts, base_failed, kept, and the names of broken rules.

    Every row stays. A null or empty text has no words, hence fails the base rules. A language
    that is null or has no row in the table is judged by the rules for all languages. An input
    column named like the output is replaced; no other name is used.
    """
    lang = F.col(f"`{lang_col}`").cast("string") if lang_col else F.lit(None).cast("string")
    text = F.col(f"`{text_col}`")
    named = {r.langs for r in (*base, *rules) if r.langs is not None}
    stop_words = {k: v for k, v in STOP_WORDS.items() if any(k in langs for langs in named)}

    def judge(known: Column) -> Column:
        counts, own = known["counts"], known["lang"]
        fields = [counts[n].alias(n) for n in ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_bullet_lines", "n_ellipsis_lines"]]
        failed = broken(counts, own, base)
        both = broken(counts, own, (*base, *rules))
        return F.struct(*fields, (F.size(failed) > 0).alias("base_failed"), (F.size(both) == 0).alias("kept"), both.alias("broken"))

    known = F.struct(measure(text, lang, stop_words).alias("counts"), lang.alias("lang"))
    own = [F.col(f"`{c}`") for c in docs.columns if c != output]
    return docs.select(*own, evaluate_once(known, judge).alias(output))
