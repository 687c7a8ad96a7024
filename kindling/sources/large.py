"""Texts of files too large for one row: read in pieces, with the rule of ``functions.charset``.

UTF-8 files are read by many tasks, each from a place where any reader may start: between
two printable ASCII bytes, so neither a character nor a line end is cut. Files in other
encodings are read by one task each. No task holds more than a few pieces.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kindling.cluster import settle
from kindling.functions import charset_guess
from kindling.functions.charset import BYTE_ORDER_MARKS, GUESS, check_fallback
from kindling.sources import files as fl

PIECE_BYTES = 4 << 20
# A task reads about this much of a UTF-8 file.
RANGE_BYTES = 256 << 20

_START = re.compile(rb"[ -~](?=[ -~])")


def _mark_of(head: bytes) -> tuple[bytes, str | None]:
    for mark, codec in BYTE_ORDER_MARKS:
        if head.startswith(bytes.fromhex(mark)):
            return bytes.fromhex(mark), codec
    return b"", None


def inspect(fallback: str = "utf-8"):
    """For ``visit_files``: a file's SHA-256 and encoding, told in one pass."""
    check_fallback(fallback)

    def run(path: str) -> str:
        system, inner = fl.open_filesystem(path)
        digest, strict = hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("strict")
        head, valid, at = b"", True, 0
        summary = charset_guess.summarize(b"")
        with system.open_input_stream(inner) as stream:
            while piece := stream.read(PIECE_BYTES):
                digest.update(piece)
                head = head or piece[:4]
                if valid:
                    try:
                        strict.decode(piece)
                    except UnicodeDecodeError:
                        valid = False
                if fallback == GUESS:
                    valid = valid and b"\0" not in piece
                    summary = charset_guess.join(summary, charset_guess.summarize(piece, at))
                    at += len(piece)
        if valid:
            try:
                strict.decode(b"", True)
            except UnicodeDecodeError:
                valid = False
        charset = _mark_of(head)[1] or ("utf-8" if valid else charset_guess.decide(summary) if fallback == GUESS else fallback)
        return f"{digest.hexdigest()} {charset}"

    return run


def _texts(path: str, charset: str, start: int, stop: int | None = None) -> Iterator[str]:
    """Decoded text from byte ``start`` on, line ends as ``\\n``; without the byte order mark."""
    system, inner = fl.open_filesystem(path)
    decoder, held = codecs.getincrementaldecoder(charset)("ignore"), ""
    with system.open_input_file(inner) as stream:
        if start == 0:
            mark, codec = _mark_of(stream.read(4))
            start = len(mark) if codec == charset else 0
        stream.seek(start)
        while True:
            size = PIECE_BYTES if stop is None else min(PIECE_BYTES, stop - stream.tell())
            piece = stream.read(size) if size > 0 else b""
            text = held + decoder.decode(piece, not piece).encode("utf-8", "ignore").decode()
            # A carriage return may be half of a line end.
            held = "\r" if text.endswith("\r") and piece else ""
            if held:
                text = text[:-1]
            if text:
                yield text.replace("\r\n", "\n").replace("\r", "\n")
            if not piece:
                return


def _boundary(path: str, nominal: int) -> int | None:
    """The first place at or after ``nominal`` where reading may start; None if none is near."""
    if nominal == 0:
        return 0
    system, inner = fl.open_filesystem(path)
    with system.open_input_file(inner) as stream:
        stream.seek(nominal)
        found = _START.search(stream.read(1 << 16))
    return nominal + found.end() if found else None


def ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Byte ranges of ``file_path, file_size, charset``: with ``start``, ``stop`` and ``at``, the characters before.

    A file of one range is not read for it: its ``chars`` are null.
    """
    nominal = F.when(F.col("charset") == "utf-8", F.sequence(F.lit(0).cast("long"), F.greatest(F.col("file_size") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    places = files.select("file_path", "file_size", "charset", F.explode(F.coalesce(nominal, F.array(F.lit(0).cast("long")))).alias("nominal"))

    def starts(batches):
        for batch in batches:
            batch["start"] = [_boundary(p, int(n)) for p, n in zip(batch["file_path"], batch["nominal"], strict=True)]
            batch["start"] = batch["start"].astype("Int64")
            yield batch[["file_path", "file_size", "charset", "start"]]

    def counts(batches):
        for batch in batches:
            rows = zip(batch["file_path"], batch["charset"], batch["start"], batch["stop"], batch["file_size"], strict=True)
            batch["chars"] = [None if a == 0 and b == n else sum(map(len, _texts(p, c, int(a), int(b)))) for p, c, a, b, n in rows]
            batch["chars"] = batch["chars"].astype("Int64")
            yield batch

    kind = "file_path string, file_size long, charset string, start long"
    cores = files.sparkSession.sparkContext.defaultParallelism
    found = places.repartition(cores * 4).mapInPandas(starts, kind).filter("start is not null").distinct()
    # One row per range: few for each file.
    by_file = W.partitionBy("file_path").orderBy("start")
    found = settle(found.withColumn("stop", F.coalesce(F.lead("start").over(by_file), "file_size")), "ranges")
    counted = settle(found.repartition(cores * 4, "file_path", "start").mapInPandas(counts, f"{kind}, stop long, chars long"), "range-sizes")
    before = F.coalesce(F.sum("chars").over(by_file.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counted.withColumn("at", before)


def _windows(path: str, charset: str, start: int, at: int, chars: int | None, size: int, stride: int) -> Iterator[tuple[int, str]]:
    """Windows that start among ``chars`` characters, or all, from character ``at``, which is byte ``start``."""
    i, end = -(-at // stride), float("inf") if chars is None else at + chars
    if i * stride >= end:
        return
    text, base = "", at
    for piece in _texts(path, charset, start):
        text += piece
        while i * stride < end and base + len(text) >= i * stride + size:
            yield i, text[i * stride - base : i * stride - base + size]
            i += 1
        if i * stride >= end:
            return
        cut = max(0, i * stride - base)
        text, base = text[cut:], base + min(cut, len(text))
    while i * stride < min(end, base + len(text)):
        yield i, text[i * stride - base : i * stride - base + size]
        i += 1


def window_rows(found: DataFrame, size: int, overlap: int, keep_empty: bool = False) -> DataFrame:
    """``doc_id, chunk_idx, text``: the character windows of all ``ranges``, without a shuffle of text.

    With ``keep_empty`` a file without text gives one row of nulls.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for path, charset, start, at, chars in zip(*(batch.column(c).to_pylist() for c in ("file_path", "charset", "start", "at", "chars")), strict=True):
                any_row = False
                for i, text in _windows(path, charset, start, at, chars, size, size - overlap):
                    rows.append((path, i, text))
                    any_row, held = True, held + len(text)
                    if len(rows) == 4096 or held >= PIECE_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                if keep_empty and chars is None and not any_row:
                    rows.append((path, None, None))
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        paths, places, texts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(places, pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "chunk_idx", "text"])

    cores = found.sparkSession.sparkContext.defaultParallelism
    dealt = found.repartition(cores * 4, "file_path", "start")
    out = dealt.mapInArrow(run, "doc_id string, chunk_idx int, text string")
    if not keep_empty:
        return out
    textless = found.groupBy("file_path").agg(F.sum("chars").alias("n")).filter("n = 0")
    nothing = textless.select(F.col("file_path").alias("doc_id"), F.lit(None).cast("int").alias("chunk_idx"), F.lit(None).cast("string").alias("text"))
    return out.unionByName(nothing)


def sentence_rows(files: DataFrame, size: int, overlap: int) -> DataFrame:
    """``doc_id, chunk_idx, text``: sentence chunks as of ``chunk_sentences``, one task per file.

    Where a chunk starts depends on all before it, so a file is one stream; a chunk and a piece of
    text are all that is held. A file without words gives one row of nulls.
    """
    import pandas as pd

    def run(batches):
        for batch in batches:
            for path, charset in zip(batch["file_path"], batch["charset"], strict=True):
                rows, any_row = [], False
                for row in enumerate(_sentence_chunks(_units(_texts(path, charset, 0), size), size, overlap)):
                    rows.append((path, *row))
                    if len(rows) == 1024:
                        yield pd.DataFrame(rows, columns=["doc_id", "chunk_idx", "text"])
                        rows, any_row = [], True
                if rows or not any_row:
                    out = pd.DataFrame(rows or [(path, None, None)], columns=["doc_id", "chunk_idx", "text"])
                    out["chunk_idx"] = out["chunk_idx"].astype("Int32")
                    yield out

    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(cores * 4, "file_path").mapInPandas(run, "doc_id string, chunk_idx int, text string")


# White space as the patterns of ``functions.text`` see it.
_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


def _units(texts: Iterator[str], max_words: int) -> Iterator[tuple[str, int]]:
    """Sentences or word runs, with their numbers of words, from text in pieces."""
    rest, unit, words = "", [], 0
    ended = False
    while not ended:
        piece = next(texts, None)
        ended = piece is None
        rest += piece or ""
        at = 0
        for m in _WORD.finditer(rest):
            if m.end() == len(rest) and not ended:
                break  # the word may go on
            if words:
                unit.append(rest[at : m.start()])
            unit.append(m[0])
            words += 1
            at = m.end()
            if m[0][-1] in ".!?" and m.end() < len(rest) or words == max_words:
                yield "".join(unit), words
                unit, words = [], 0
        rest = rest[at:]
    if words:
        yield "".join(unit), words


def _sentence_chunks(units: Iterator[tuple[str, int]], size: int, overlap: int) -> Iterator[str]:
    """Units packed greedily up to ``size`` words; a chunk starts with the last units of at most ``overlap`` words."""
    held: list[tuple[str, int]] = []
    total = 0
    for unit in units:
        if held and total + unit[1] > size:
            yield " ".join(u for u, _ in held)
            floor = max(total - overlap, total + unit[1] - size)
            skipped = 0
            while held and skipped < floor:
                skipped += held.pop(0)[1]
            total -= skipped
        held.append(unit)
        total += unit[1]
    if held:
        yield " ".join(u for u, _ in held)
