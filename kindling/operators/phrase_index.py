"""Phrase search through an index of character trigrams over a Parquet table.

Every position of a lower-cased text starts a trigram; two marks stand behind the text's end.
A posting holds a trigram, a file of the table, the rows of that file which have the trigram,
and for each row a mask of 64 bits: bit p is set where the trigram starts at a position p
modulo 64. A phrase can only occur at position s of a row if the mask of its i-th trigram has
bit s + i, so masks turned back by i must have a bit in common. The rarest trigrams of a phrase
are looked up, what is left is read from its files and compared with the phrase itself.

The table is not copied: rows are known by their file and their number in it. Files are
written once and never changed, as all of this library's tables are. Files newer than the
index are searched in full until ``build_phrase_index`` is run again, which reads only those.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from kindling.cluster import TASK_BYTES, broadcast_if_small, scan_bytes, settle
from kindling.sources.store import read_rows

# Trigrams of a phrase that are looked up, the rarest first.
LOOKUPS = 4
# Up to this many files or trigrams are named one by one; beyond it the whole table or index is scanned and joined.
NAMED = 10_000
# Phrases that one scan compares with every text, where no trigram tells.
SCANNED_PHRASES = 1_000
# Text characters whose postings a task holds at a time.
BATCH_CHARS = 4 << 20

_END = 0x1FFFFF  # no code point
_BITS = 21
_FILES = "path string, file long"
_GRAMS = "gram long, n_rows long"
_POSTINGS = "file long, gram long, n int, rows array<long>, masks array<long>"


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _grams(codes: np.ndarray) -> np.ndarray:
    """The trigram that starts at each position, as one number."""
    ends = np.full(2, _END, np.int64)
    long = np.concatenate([codes, ends])
    return long[:-2] << 2 * _BITS | long[1:-1] << _BITS | long[2:]


def _row_postings(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different trigrams of a text and the masks of their positions."""
    grams = _grams(_codes(text))
    bits = np.uint64(1) << (np.arange(len(grams), dtype=np.uint64) & np.uint64(63))
    order = np.argsort(grams, kind="stable")
    grams, bits = grams[order], bits[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[first], np.bitwise_or.reduceat(bits, first).view(np.int64)


def _lists(found: list[tuple[int, int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Postings of (file, row, trigrams, masks), one row per file and trigram."""
    sizes = [len(x[2]) for x in found]
    if not sum(sizes):
        return
    files = np.repeat(np.array([x[0] for x in found], np.int64), sizes)
    rows = np.repeat(np.array([x[1] for x in found], np.int64), sizes)
    grams, masks = np.concatenate([x[2] for x in found]), np.concatenate([x[3] for x in found])
    order = np.lexsort((rows, grams, files))
    files, rows, grams, masks = files[order], rows[order], grams[order], masks[order]
    first = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]) | (files[1:] != files[:-1])]))
    ends = np.append(first, len(grams)).astype(np.int32)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(files[first]), pa.array(grams[first]), pa.array(np.diff(ends)),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(rows)), pa.ListArray.from_arrays(pa.array(ends), pa.array(masks)),
        ],
        ["file", "gram", "n", "rows", "masks"],
    )


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, chars = [], 0
    for batch in batches:
        for file, row, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if text:
                found.append((file, row, *_row_postings(text)))
                chars += len(text)
            if chars > BATCH_CHARS:
                yield from _lists(found)
                found, chars = [], 0
    yield from _lists(found)


def _files(spark: SparkSession, table: str, paths: list[str]) -> DataFrame:
    """The table with only the files named as in ``_metadata``."""
    return spark.read.schema(spark.read.parquet(table).schema).option("basePath", table).parquet(*map(unquote, paths))


def _paths(table: DataFrame) -> DataFrame:
    return table.select(F.col("_metadata.file_path").alias("path")).distinct()


def _files_after(spark: SparkSession, table: str, files: DataFrame) -> list[str]:
    """Paths of the table's files that the index does not know; no column of them is read."""
    return [r.path for r in _paths(spark.read.parquet(table)).join(files, "path", "left_anti").collect()]


def _placed(table: DataFrame) -> DataFrame:
    """The table with where each row stands: ``__file``, a hash of its file's path, and ``__row``."""
    return table.withColumns({"__file": F.xxhash64("_metadata.file_path"), "__row": F.col("_metadata.row_index")})


def build_phrase_index(spark: SparkSession, table: str, index: str, text_col: str = "text") -> int:
    """Index column ``text_col`` of the Parquet folder ``table``; returns how many files were added.

    Files that the index has already are left alone. Folders below ``index``: ``postings``,
    sorted by trigram and cut so that a common trigram takes several files; ``ranges``, the
    trigrams each of these spans; ``grams``, rows per trigram; ``files``, the files covered,
    written last, so that a failed run is repeated safely. Two files whose paths have one hash
    only cost reading both. One writer at a time.
    """
    late = _files_after(spark, table, read_rows(spark, f"{index}/files", T.StructType.fromDDL(_FILES)))
    if not late:
        return 0
    texts = _files(spark, table, late)
    lowered = _placed(texts.select(F.col(f"`{text_col}`").alias("text"), "_metadata")).select("__file", "__row", F.lower("text").alias("text"))
    raw = settle(lowered.mapInArrow(_postings, _POSTINGS), "postings")
    tasks = max(1, -(-scan_bytes(raw) // TASK_BYTES))
    raw.repartitionByRange(tasks, "gram", "file").sortWithinPartitions("gram", "file").write.mode("append").parquet(f"{index}/postings")
    written = spark.read.schema(_POSTINGS).parquet(f"{index}/postings")
    spans = written.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min("gram").alias("low"), F.max("gram").alias("high"))
    spans.write.mode("overwrite").parquet(f"{index}/ranges")
    counts = written.groupBy("gram").agg(F.sum("n").alias("n_rows"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{index}/grams")
    paths = _paths(texts).withColumn("file", F.xxhash64("path"))
    paths.write.mode("append").parquet(f"{index}/files")
    return len(late)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _phrase_grams(phrases: pa.Array) -> pa.Array:
    # A phrase may stand anywhere, so only trigrams within it count.
    return pa.array([None if p is None else _grams(_codes(p))[:-2].tolist() for p in phrases.to_pylist()], pa.list_(pa.int64()))


def _turned(mask: Column, by: Column) -> Column:
    """A mask of 64 bits turned right by ``by`` modulo 64."""
    k = (by % 64).cast("int")
    return F.when(k == 0, mask).otherwise(
        F.call_function("shiftrightunsigned", mask, k).bitwiseOR(F.call_function("shiftleft", mask, 64 - k))
    )


def _rarest(spark: SparkSession, index: str, phrases: DataFrame, lookups: int) -> DataFrame:
    """``__id, gram, at`` of the trigrams to look up; none of a phrase with a trigram that no text has."""
    own = phrases.select("__id", F.posexplode(_phrase_grams("__phrase")).alias("at", "gram"))
    own = settle(own.groupBy("__id", "gram").agg(F.min("at").alias("at")), "phrase-grams")
    counts = read_rows(spark, f"{index}/grams", T.StructType.fromDDL(_GRAMS))
    known = counts.join(broadcast_if_small(own.select("gram").distinct()), "gram", "left_semi")
    told = own.join(known, "gram", "left")
    ranked = told.withColumn("place", F.row_number().over(W.partitionBy("__id").orderBy("n_rows", "at")))
    ranked = ranked.withColumn("unknown", F.max(F.col("n_rows").isNull()).over(W.partitionBy("__id")))
    return settle(ranked.filter((F.col("place") <= lookups) & ~F.col("unknown")).select("__id", "gram", "at"), "lookups")


def _candidates(spark: SparkSession, index: str, asked: DataFrame) -> DataFrame:
    """``__id, __file, __row`` of the rows whose masks leave room for the phrase."""
    grams = [r.gram for r in asked.select("gram").distinct().limit(NAMED + 1).collect()]
    if not grams:
        return spark.createDataFrame([], "__id long, __file long, __row long")
    postings = spark.read.schema(_POSTINGS).parquet(f"{index}/postings")
    if len(grams) <= NAMED:
        # Only files whose span holds a trigram that is asked for are read.
        asked_for = F.array(*map(F.lit, grams))
        spans = spark.read.parquet(f"{index}/ranges").filter(F.exists(asked_for, lambda g: g.between(F.col("low"), F.col("high"))))
        paths = [unquote(r.path) for r in spans.select("path").limit(NAMED + 1).collect()]
        if len(paths) <= NAMED:
            postings = spark.read.schema(_POSTINGS).parquet(*paths)
        postings = postings.filter(F.col("gram").isin(grams))
    met = postings.join(broadcast_if_small(asked), "gram")
    turned = met.select("__id", "gram", F.col("file").alias("__file"), "at", F.explode(F.arrays_zip("rows", "masks")).alias("p"))
    turned = turned.select("__id", "gram", "__file", F.col("p.rows").alias("__row"), _turned(F.col("p.masks"), F.col("at")).alias("mask"))
    left = turned.groupBy("__id", "__file", "__row").agg(F.bit_and("mask").alias("mask"), F.count_distinct("gram").alias("n"))
    wanted = asked.groupBy("__id").agg(F.count(F.lit(1)).alias("wanted"))
    return left.join(broadcast_if_small(wanted), "__id").filter("n = wanted and mask != 0").select("__id", "__file", "__row")


def find_phrases(spark: SparkSession, table: str, index: str, phrases: DataFrame, text_col: str = "text", key: str = "phrase_id", phrase_col: str = "phrase", lookups: int = LOOKUPS) -> DataFrame:
    """Every row of ``table`` and phrase it contains: ``key`` and the columns of the table.

    Containment is that of ``phrase_match``: stripped, case-insensitive, literal. Keys of
    phrases are integers; null keys and null phrases find nothing, repeated rows count once.
    Only files that hold a candidate are read. Phrases of fewer than three characters have no
    trigram; they, and files newer than the index, are answered by a scan. Null texts match nothing.
    """
    stripped = F.lower(F.regexp_replace(F.col(f"`{phrase_col}`"), r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", ""))
    own = phrases.select(F.col(f"`{key}`").cast("long").alias("__id"), stripped.alias("__phrase")).filter("__id is not null and __phrase is not null")
    own = settle(own.distinct(), "phrases")
    schema = spark.read.parquet(table).schema
    long = own.filter(F.length("__phrase") >= 3)
    found = settle(_candidates(spark, index, _rarest(spark, index, long, lookups)), "candidates")
    files = read_rows(spark, f"{index}/files", T.StructType.fromDDL(_FILES))
    chosen = files.join(found.select(F.col("__file").alias("file")).distinct(), "file", "left_semi").select("path")
    paths = [r.path for r in chosen.limit(NAMED + 1).collect()]
    parts = []

    def out(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("__id").alias(key), *[F.col(f"`{c}`") for c in schema.names])

    if paths:
        rows = _placed(_files(spark, table, paths) if len(paths) <= NAMED else spark.read.parquet(table))
        asked = found.join(broadcast_if_small(long), "__id")
        parts.append(out(rows.join(broadcast_if_small(asked), ["__file", "__row"]).filter(F.contains(F.lower(f"`{text_col}`"), "__phrase"))))
    parts += map(out, _by_scan(spark.read.parquet(table), own.filter(F.length("__phrase") < 3), text_col))
    late = _files_after(spark, table, files)
    if late:
        parts += map(out, _by_scan(_files(spark, table, late), long, text_col))
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField(key, T.LongType()), *schema.fields]))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _by_scan(rows: DataFrame, phrases: DataFrame, text_col: str) -> list[DataFrame]:
    """Rows and ids of the phrases they contain, by a scan for every block of phrases."""
    blocks = -(-phrases.count() // SCANNED_PHRASES)
    lowered = rows.withColumn("__lower", F.lower(f"`{text_col}`"))
    parts = []
    for k in range(blocks):
        asked = [tuple(r) for r in phrases.filter(F.pmod(F.xxhash64("__id", "__phrase"), F.lit(blocks)) == k).select("__id", "__phrase").collect()]
        if asked:
            every = F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.lit(p).alias("phrase")) for i, p in asked])
            hits = F.filter(every, lambda e: F.contains(F.col("__lower"), e["phrase"]))
            parts.append(lowered.withColumn("__hit", F.explode(hits)).withColumn("__id", F.col("__hit.id")))
    return parts


def phrase_by_index(spark: SparkSession, table: str, index: str, phrase: str, text_col: str = "text") -> DataFrame:
    """The rows of ``table`` that contain the phrase."""
    asked = spark.createDataFrame([(0, phrase.strip())], "phrase_id long, phrase string")
    return find_phrases(spark, table, index, asked, text_col).drop("phrase_id")
