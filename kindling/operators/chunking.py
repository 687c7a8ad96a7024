"""Cut documents into chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindling.cluster import settle
from kindling.functions import text as tx
from kindling.sources import files as fl
from kindling.sources import large

# Window length and overlap in characters, sentence chunk size and
# overlap in words, rows per batch.
CHUNK_SIZE = 300
CHUNK_OVERLAP = 20
SENTENCE_CHUNK_WORDS = 280
SENTENCE_OVERLAP_WORDS = 30
BATCH_ROWS = 600


def chunk_fixed(
    docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, keep_empty: bool = False
) -> DataFrame:
    """Replace ``text`` by ``chunk_idx, text``: overlapping character windows.

    No shuffle. An empty document yields no chunk, or one null chunk with ``keep_empty``.
    """
    explode = F.posexplode_outer if keep_empty else F.posexplode
    others = [c for c in docs.columns if c != "text"]
    return docs.select(*others, explode(tx.fixed_windows(F.col("text"), size, overlap)).alias("chunk_idx", "text"))


def chunk_counts(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks per document from its length alone."""
    return docs.select("doc_id", F.ceil(F.length("text") / (size - overlap)).cast("long").alias("n_chunks"))


def number_batches(chunks: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """Add ``batch_idx``: consecutive runs of ``rows`` chunks within a document.

    ``chunk_idx`` already counts from zero, so no window is needed.
    """
    return chunks.withColumn("batch_idx", F.floor(F.col("chunk_idx") / rows).cast("int"))


def _spans(counts: np.ndarray, size: int, overlap: int) -> list[tuple[int, int]]:
    """Unit ranges of the chunks: as many units as fit ``size`` words, the next chunk
    starting with the trailing units that hold at most ``overlap`` words."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    n, start, spans = len(counts), 0, []
    while start < n:
        stop = int(np.searchsorted(ends, ends[start] + size, side="right")) - 1
        spans.append((start, stop))
        if stop == n:
            break
        floor = max(ends[stop] - overlap, ends[stop + 1] - size)
        start = int(np.searchsorted(ends, floor, side="left"))
    return spans


def _span_column(size: int, overlap: int):
    kind = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))

    @F.arrow_udf("array<struct<first:int,stop:int>>")
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [
                None if counts is None else [{"first": a, "stop": b} for a, b in _spans(np.asarray(counts, dtype=np.int64), size, overlap)]
                for counts in batch.to_pylist()
            ]
            yield pa.array(rows, kind)

    return spans


def chunk_sentences(
    docs: DataFrame,
    size: int = SENTENCE_CHUNK_WORDS,
    overlap: int = SENTENCE_OVERLAP_WORDS,
    keep_empty: bool = False,
) -> DataFrame:
    """Replace ``text`` by ``chunk_idx, text``: whole sentences packed up to ``size`` words.

    Words are runs of non-space characters and sentences are joined by one space.
    Where each chunk starts depends on where the last one ended, which no built-in
    expresses in linear time; only the sentence word counts go to Python for that.
    """
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    explode = F.posexplode_outer if keep_empty else F.posexplode
    others = [c for c in docs.columns if c != "text"]
    cut = docs.select(*others, tx.sentence_units(F.col("text"), size).alias("_units"))
    packed = cut.withColumn("_spans", _span_column(size, overlap)(F.transform("_units", tx.word_count)))
    chunk = F.transform(
        "_spans", lambda s: F.array_join(F.slice("_units", s["first"] + 1, s["stop"] - s["first"]), " ")
    )
    return packed.select(*others, explode(chunk).alias("chunk_idx", "text"))


def chunk_large_files(
    spark: SparkSession,
    root: str,
    glob: str | None = "*.log",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    fallback_charset: str = "utf-8",
    range_bytes: int = large.RANGE_BYTES,
) -> DataFrame:
    """Character windows of files of any size: ``doc_id, chunk_idx, text``.

    The same windows as ``chunk_fixed`` of the decoded files, but a file is never held whole,
    and a UTF-8 file is read by many tasks. Only byte ranges and their lengths are shuffled.
    """
    if size <= overlap or overlap < 0:
        raise ValueError("need 0 <= overlap < size")
    listing = fl.list_files(spark, root, glob)
    told = inspected(listing, fallback_charset).select("file_path", "file_size", "charset")
    return large.window_rows(large.ranges(told, range_bytes), size, overlap)


def inspected(listing: DataFrame, fallback_charset: str = "utf-8") -> DataFrame:
    """The listing with ``content_hash`` and ``charset``, from one pass over each file, written down."""
    seen = fl.visit_files(listing, large.inspect(fallback_charset))
    seen = seen.select(F.col("file_path").alias("_path"), F.split("result", " ").alias("_told"))
    seen = settle(seen, "inspected")
    joined = listing.join(seen, F.col("file_path") == F.col("_path"))
    return joined.select(*listing.columns, F.get("_told", F.lit(0)).alias("content_hash"), F.get("_told", F.lit(1)).alias("charset"))
