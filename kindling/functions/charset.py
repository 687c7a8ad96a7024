"""Bytes to text.

Rule, in this order: a byte order mark names the encoding; bytes that are valid
UTF-8 are UTF-8; anything else is read in the declared fallback (UTF-8 by default), which
may be ``GUESS``. Bytes the encoding cannot read are dropped. UTF-16 without a mark is
found by a guess only, as its ASCII text is valid UTF-8 with zero bytes.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindling.functions import charset_guess

# As a fallback: tell the encoding from the bytes.
GUESS = "guess"

# Byte order marks in hex, longest first, and the codec each one names.
BYTE_ORDER_MARKS = [
    ("FFFE0000", "utf-32-le"),
    ("0000FEFF", "utf-32-be"),
    ("EFBBBF", "utf-8"),
    ("FFFE", "utf-16-le"),
    ("FEFF", "utf-16-be"),
]


def check_fallback(fallback: str) -> None:
    if fallback != GUESS:
        codecs.lookup(fallback)


@F.arrow_udf(T.StringType())
def _guessed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for contents in batches:
        yield pa.array([None if raw is None else charset_guess.guess(raw) for raw in contents.to_pylist()], pa.string())


def detect_charset(content: Column, fallback: str = "utf-8") -> Column:
    """Name of the encoding under the rule above; only bytes that need a guess reach Python."""
    check_fallback(fallback)
    head = F.hex(F.substring(content, 1, 4))
    rule = None
    for mark, codec in BYTE_ORDER_MARKS:
        hit = F.startswith(head, F.lit(mark))
        rule = F.when(hit, codec) if rule is None else rule.when(hit, codec)
    valid = F.is_valid_utf8(content.cast("string"))
    if fallback != GUESS:
        return rule.when(valid, "utf-8").otherwise(fallback)
    valid = valid & ~F.contains(content, F.lit(b"\0"))
    known = rule.when(valid, "utf-8")
    return F.coalesce(known, _guessed(F.when(known.isNull(), content)))


@F.arrow_udf(T.StringType())
def _decode_lossy(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for contents, charsets in batches:
        yield pa.array(
            [
                None if raw is None else raw.decode(charset, errors="ignore").encode("utf-8", "ignore").decode("utf-8")
                for raw, charset in zip(contents.to_pylist(), charsets.to_pylist())
            ],
            pa.string(),
        )


def decode_text(content: Column, fallback: str = "utf-8") -> Column:
    """Decoded text. Valid UTF-8 stays in the JVM; only other files reach Python."""
    charset = detect_charset(content, fallback)
    head = F.hex(F.substring(content, 1, 4))
    skip = F.lit(0)
    for mark, _ in reversed(BYTE_ORDER_MARKS):
        skip = F.when(F.startswith(head, F.lit(mark)), len(mark) // 2).otherwise(skip)
    body = F.when(skip == 0, content).otherwise(F.substring(content, skip + 1, F.octet_length(content)))
    plain = (charset == "utf-8") & F.is_valid_utf8(content.cast("string"))
    rest = F.when(~plain, body)
    return F.when(plain, body.cast("string")).otherwise(_decode_lossy(rest, charset))
