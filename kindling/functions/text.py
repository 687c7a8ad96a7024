"""String functions: newlines, phrase match, fixed windows, sentence units, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_newlines(text: Column) -> Column:
    """``\\r\\n`` and lone ``\\r`` become ``\\n``."""
    return F.regexp_replace(text, "\r\n?", "\n")


def phrase_match(text: Column, phrase: str) -> Column:
    """Case-insensitive literal containment of the stripped phrase.

    No pattern is involved, so nothing needs escaping; a blank phrase matches
    every non-null text.
    """
    return F.contains(F.lower(text), F.lower(F.lit(phrase.strip())))


def regex_literal(phrase: str) -> str:
    """A Java pattern that matches ``phrase`` character by character."""
    return "\\Q" + phrase.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def evaluate_once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    A column mentioned inside a lambda is otherwise recomputed per element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """Overlapping character windows of ``text`` as an array, in one pass.

    The text is cut once into consecutive pieces of ``size - overlap`` characters;
    a window is its piece plus the head of the following ones. Calling
    ``substring`` per window instead would walk the text from its start each
    time, which is quadratic on long files.
    """
    stride = size - overlap
    if stride <= 0 or overlap < 0:
        raise ValueError("need 0 <= overlap < size")
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{stride}}}"), F.lit(0))
    if overlap == 0:
        return pieces
    following = -(-overlap // stride)

    def windows(all_pieces: Column) -> Column:
        def window(piece: Column, i: Column) -> Column:
            rest = F.array_join(F.slice(all_pieces, i + 2, F.lit(following)), "")
            return F.concat(piece, F.substring(rest, 1, overlap))

        return F.transform(all_pieces, window)

    return evaluate_once(pieces, windows)


def sentence_units(text: Column, max_words: int) -> Column:
    """Sentences as an array; one longer than ``max_words`` is cut into word runs.

    A sentence ends at ``.``, ``!`` or ``?`` followed by white space.
    """
    run = f"\\S++(?:\\s++\\S++){{0,{max_words - 1}}}+"
    sentences = F.split(text, "(?<=[.!?])\\s+")
    return F.flatten(F.transform(sentences, lambda s: F.regexp_extract_all(s, F.lit(run), F.lit(0))))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("\\S+"))
