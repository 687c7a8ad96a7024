"""Line dedup by overlapping windows of three lines, in DataFrame operations only.

Every run of three consecutive lines is a window. A window that occurs more than once
keeps its first occurrence, by document id, then by position; the lines that any later
occurrence covers are removed. Covered positions merge, as a line goes once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindling.cluster import settle
from kindling.functions.text import evaluate_once

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(text: Column, window: int) -> Column:
    """Position and digest of every window; texts of fewer lines have none.

    A digest is a 64-bit and a 32-bit hash of the lines' hashes and lengths.
    """

    def of_hashes(hashes: Column) -> Column:
        def digest(i: Column) -> Column:
            own = [F.get(hashes, i + k) for k in range(window)]
            return F.struct(i.alias("pos"), F.xxhash64(*own).alias("w"), F.hash(*own).alias("v"))

        enough = F.size(hashes) >= window
        return F.when(enough, F.transform(F.sequence(F.lit(0), F.size(hashes) - window), digest))

    hashes = F.transform(_lines(text), lambda line: F.struct(F.xxhash64(line), F.hash(line), F.length(line)))
    return evaluate_once(hashes, of_hashes)


def _without(text: Column, starts: Column, window: int) -> Column:
    """Kept text and number of removed lines, in time linear in the lines."""

    def keep(lines: Column) -> Column:
        everything = F.sequence(F.lit(0), F.size(lines) - 1)
        gone = F.flatten(F.transform(starts, lambda p: F.sequence(p, p + (window - 1))))
        places = F.array_except(everything, gone)
        kept = F.transform(places, lambda i: F.get(lines, i))
        return F.struct(F.array_join(kept, "\n").alias("text"), (F.size(lines) - F.size(places)).alias("n"))

    return evaluate_once(_lines(text), keep)


def line_dedup(docs: DataFrame, key: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated lines removed from its texts; adds n_lines and n_removed.

    Every row stays. Null texts stay null; the lines of a null key neither remove others
    nor go. An empty text is one empty line. Input columns named like the added ones are
    replaced. Rows that repeat a key and a text are further occurrences of its windows at
    the same positions, and all rows of that key keep the first one.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    text, ident = F.col(f"`{text_col}`"), F.col(f"`{key}`")
    found = docs.filter(ident.isNotNull() & text.isNotNull())
    found = found.select(ident.alias("__key"), F.explode(_windows(text, window)).alias("__at"))
    found = found.select("__key", F.col("__at.pos").alias("__pos"), F.col("__at.w").alias("__w"), F.col("__at.v").alias("__v"))

    first = found.groupBy("__w", "__v").agg(F.min(F.struct("__key", "__pos")).alias("__first"), F.count(F.lit(1)).alias("__n"))
    # Written down, so that both sides of the join are plain shuffles, whose hot keys Spark splits.
    first = settle(first.filter("__n > 1").drop("__n"), "windows")
    later = found.join(first, ["__w", "__v"]).filter(F.struct("__key", "__pos") > F.col("__first"))
    covered = later.groupBy("__key").agg(F.collect_set("__pos").alias("__starts"))

    joined = docs.join(covered, ident == F.col("__key"), "left")
    change = F.when(F.col("__starts").isNotNull(), _without(text, F.col("__starts"), window))
    joined = joined.withColumn("__change", change)
    columns = [F.coalesce("__change.text", text).alias(c) if c == text_col else F.col(f"`{c}`") for c in own]
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(_lines(text)))
    return joined.select(*columns, n_lines.alias("n_lines"), F.coalesce("__change.n", F.lit(0)).alias("n_removed"))
