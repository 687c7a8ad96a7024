"""Encodings of files, guessed from pieces of their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindling.functions import charset_guess as cg


def cut_pieces(files: DataFrame, key: str, content: str, piece_bytes: int) -> DataFrame:
    """``key, start, piece``: consecutive pieces of every content; an empty one has one empty piece."""
    data = F.coalesce(F.col(content), F.lit(b""))
    places = F.sequence(F.lit(0), F.greatest(F.octet_length(data) - 1, F.lit(0)), F.lit(piece_bytes))
    cut = F.transform(places, lambda at: F.struct(at.cast("long").alias("start"), F.substring(data, at + 1, F.lit(piece_bytes)).alias("piece")))
    return files.select(key, F.explode(cut).alias("p")).select(key, "p.*")


@F.arrow_udf(T.BinaryType())
def _encode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, names in batches:
        yield pa.array([None if t is None or n is None else t.encode(n, "ignore") for t, n in zip(texts.to_pylist(), names.to_pylist())], pa.binary())


def encode_text(text: Column, charset: Column) -> Column:
    """The bytes of a text in any encoding that Python knows; characters without a place in it are left out."""
    return _encode(text, charset)


@F.arrow_udf(T.BinaryType())
def _summaries(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for pieces, starts in batches:
        yield pa.array([cg.summarize(p or b"", s or 0).tobytes() for p, s in zip(pieces.to_pylist(), starts.to_pylist())], pa.binary())


_GUESS = T.StructType([T.StructField("charset", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_high", T.LongType())])


@F.arrow_udf(_GUESS)
def _decisions(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("charset", pa.string()), ("n_bytes", pa.int64()), ("n_high", pa.int64())])
    for batch in batches:
        out = []
        for parts in batch.to_pylist():
            whole = cg.summarize(b"")
            for part in parts:
                whole = cg.join(whole, np.frombuffer(part["summary"], np.int64))
            out.append({"charset": cg.decide(whole), "n_bytes": int(whole[0]), "n_high": int(whole[1])})
        yield pa.array(out, kind)


def guess_charsets(pieces: DataFrame, key: str = "file_path", start: str = "start", piece: str = "piece") -> DataFrame:
    """``key, charset, n_bytes, n_high`` from pieces in any order, which together are each file once.

    Only sums of about 2 KB a piece are shuffled. A file's guess does not depend on where it was cut.
    """
    told = pieces.select(key, F.col(start).alias("start"), _summaries(F.col(piece), F.col(start)).alias("summary"))
    joined = told.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "summary"))).alias("parts"))
    return joined.select(key, _decisions("parts").alias("g")).select(key, "g.*")
