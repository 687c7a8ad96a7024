"""Phrases whose words occur together more than by chance, from a weighted de Bruijn graph.

Words of a piece of text form windows of ``longest`` words, cut where the piece ends. Whole
windows are edges between the two overlapping phrases of one word less, the nodes; their
weights are counts. Cut windows are the corrections at ends of pieces. A node's count is what flows
out of it plus what ends there; nodes with one way in and one way out are drawn
together to paths, each held once with its weight; counts of shorter phrases are sums
over nodes, paths and ends.

Before the windows are built, words and pairs of neighbours are counted in hashed buckets, and
a window ends where a pair's bucket stays below ``min_count``. A bucket holds at least what each of its
pairs counts, and every part of a frequent phrase is frequent, so all counts that
matter are exact whatever shares a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindling.cluster import broadcast_if_small, settle
from kindling.llm.sizes import table_bytes
from kindling.operators.joins import lookup

LONGEST, MIN_COUNT, PER_LANG = 5, 100, 2000
# A longer phrase with this many hundredths of a phrase's count takes its place.
INSIDE_SHARE = 100

# --- fixed values: bytes that end pieces and words ----------------------------------
BREAKS = b".,;:!?\n\x0b\x0c\r"
SPACES = b" \t"
# -----------------------------------------------------------------------------------

# Bytes of text that a task works on at once; a longer piece without any break is one block.
BLOCK = 4 << 20
# Buckets of pairs: about one for 8 bytes of the table, between these powers of two. A bit for each is sent to the tasks, 32 MB at most.
LEAST_BITS, MOST_BITS = 20, 28
RANGE_BITS = 8
# Tasks whose counts of one range are added up together before the last sum.
TASKS_AT_ONCE = 512

_KIND = np.zeros(256, np.uint8)
_KIND[list(SPACES)] = 1
_KIND[list(BREAKS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words(NamedTuple):
    """Words of a block of texts: distinct ones, each place's word and language, and whether the next place follows in the same piece."""

    distinct: pa.Array
    word: np.ndarray
    lang: np.ndarray
    follows: np.ndarray


def _blocks(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``size`` that end where a text or a piece ends."""
    start, end = int(offsets[0]), int(offsets[-1])
    while start < end:
        stop = min(start + size, end)
        if stop < end:
            text_end = int(offsets[np.searchsorted(offsets, stop, "right") - 1])
            if text_end > start:
                stop = text_end
            else:
                own_end = int(offsets[np.searchsorted(offsets, start, "right")])
                inside = np.flatnonzero(_KIND[data[start:stop]] == 2)
                if len(inside):
                    stop = start + int(inside[-1]) + 1
                else:
                    later = next((p + int(np.argmax(_KIND[data[p : p + size]] == 2)) + 1 for p in range(stop, own_end, size) if (_KIND[data[p : p + size]] == 2).any()), own_end)
                    stop = min(later, own_end)
        yield start, stop
        start = stop


def _words(batch: pa.RecordBatch, block: int) -> Iterator[tuple[Words, pa.Array]]:
    """The words of a batch of (text, lang), block by block, with the batch's languages."""
    texts = pc.fill_null(batch.column(0), "").cast(pa.large_binary())
    langs = pc.fill_null(batch.column(1), "und").dictionary_encode()
    lang_of = langs.indices.to_numpy(zero_copy_only=False)
    _, raw_offsets, raw = texts.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    for start, stop in _blocks(data, offsets, block):
        part = _LOWER[data[start:stop]]
        kind = _KIND[part]
        inside = kind == 0
        firsts, lasts = inside.copy(), inside.copy()
        firsts[1:] &= ~inside[:-1]
        lasts[:-1] &= ~inside[1:]
        bounds = offsets[(offsets > start) & (offsets < stop)] - start
        firsts[bounds] |= inside[bounds]
        lasts[bounds - 1] |= inside[bounds - 1]
        begin, end = np.flatnonzero(firsts), np.flatnonzero(lasts) + 1
        if not len(begin):
            continue
        text = np.searchsorted(offsets, begin + start, "right") - 1
        breaks = np.searchsorted(np.flatnonzero(kind == 2), begin)
        places = np.zeros(len(begin) + 1, np.int64)
        np.cumsum(end - begin, out=places[1:])
        spelled = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(places), pa.py_buffer(part[inside])]).dictionary_encode()
        follows = np.zeros(len(begin), bool)
        follows[:-1] = (text[1:] == text[:-1]) & (breaks[1:] == breaks[:-1])
        yield Words(spelled.dictionary, spelled.indices.to_numpy(zero_copy_only=False), lang_of[text], follows), langs.dictionary


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _buckets(words: Words, langs: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every place's word, and of every place and the next one."""
    of_word = np.array([xxhash.xxh3_64_intdigest(w.as_buffer()) for w in words.distinct], np.uint64)[words.word]
    of_lang = np.array([xxhash.xxh3_64_intdigest(x.as_buffer(), 1) for x in langs], np.uint64)[words.lang]
    one = _mix(of_word ^ of_lang)
    two = _mix(one[:-1] * np.uint64(0xD6E8FEB86659FD93) + of_word[1:])
    shift = np.uint64(64 - bits)
    return _mix(one) >> shift, two >> shift


def _count_buckets(bits: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId() // TASKS_AT_ONCE
        for batch in batches:
            for words, langs in _words(batch, block):
                one, two = _buckets(words, langs, bits)
                found, counts = np.unique(np.concatenate([one, two[words.follows[:-1]]]).astype(np.uint32), return_counts=True)
                yield from _as_ranges(group, found, counts, bits)

    return run


def _as_ranges(group: int, found: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Sorted buckets and their counts, one row for each range of buckets."""
    cuts = np.searchsorted(found, np.arange((1 << RANGE_BITS) + 1, dtype=np.int64) << (bits - RANGE_BITS))
    small = (found & np.uint32((1 << (bits - RANGE_BITS)) - 1)).astype("<u4")
    many = np.minimum(counts, (1 << 32) - 1).astype("<u4")
    ranges = [r for r in range(1 << RANGE_BITS) if cuts[r] < cuts[r + 1]]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(ranges, pa.int32()),
            pa.array([group] * len(ranges), pa.int32()),
            pa.array([small[cuts[r] : cuts[r + 1]].tobytes() for r in ranges], pa.binary()),
            pa.array([many[cuts[r] : cuts[r + 1]].tobytes() for r in ranges], pa.binary()),
        ],
        ["range", "part", "buckets", "counts"],
    )


def _sum(batches: Iterator[pa.RecordBatch], size: int) -> np.ndarray:
    total = np.zeros(size, np.int64)
    for batch in batches:
        for buckets, counts in zip(batch.column("buckets"), batch.column("counts")):
            # The buckets of a row are distinct.
            total[np.frombuffer(buckets.as_buffer(), "<u4")] += np.frombuffer(counts.as_buffer(), "<u4")
    return np.minimum(total, (1 << 32) - 1)


def _add_counts(bits: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _sum(batches, 1 << (bits - RANGE_BITS))
        found = np.flatnonzero(total)
        row = [pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32())]
        row += [pa.array([found.astype("<u4").tobytes()], pa.binary()), pa.array([total[found].astype("<u4").tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(row, ["range", "part", "buckets", "counts"])

    return run


def _heavy_ranges(bits: int, least: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = np.packbits(_sum(batches, 1 << (bits - RANGE_BITS)) >= least)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([heavy.tobytes()], pa.binary())], ["range", "heavy"])

    return run


def heavy_buckets(texts: DataFrame, bits: int, least: int, block: int = BLOCK) -> np.ndarray:
    """One bit for each bucket of words and pairs, set where at least ``least`` fall into it."""
    counted = texts.mapInArrow(_count_buckets(bits, block), "range int, part int, buckets binary, counts binary")
    summed = counted.groupBy("range", "part").applyInArrow(_add_counts(bits), counted.schema)
    ranges = summed.groupBy("range").applyInArrow(_heavy_ranges(bits, min(least, (1 << 32) - 1)), "range int, heavy binary")
    out = np.zeros((1 << RANGE_BITS, (1 << (bits - RANGE_BITS)) // 8), np.uint8)
    for r in ranges.collect():
        out[r["range"]] = np.frombuffer(r["heavy"], np.uint8)
    return out.reshape(-1)


def _is_heavy(bitmap: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (bitmap[buckets >> np.uint64(3)] >> (7 - (buckets & np.uint64(7))).astype(np.uint8)) & 1 == 1


def _emit(keys: pa.Array, size: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys.cast(pa.string()), pa.array(np.full(len(keys), size, np.int32)), pa.array(counts.astype(np.int64))], ["key", "size", "n"])


def _count_windows(bitmap, bits: int, longest: int, block: int):
    """Windows of a block with their counts; size 0 holds the words of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = bitmap.value
        for batch in batches:
            for words, langs in _words(batch, block):
                per_lang = np.bincount(words.lang, minlength=len(langs))
                yield _emit(langs.cast(pa.large_string()), 0, per_lang)
                one, two = _buckets(words, langs, bits)
                follows = words.follows.copy()
                follows[:-1] &= _is_heavy(heavy, two)
                length = np.ones(len(follows), np.int8)
                onward = follows
                for _ in range(longest - 1):
                    length += onward
                    onward = follows & np.append(onward[1:], False)
                length[~_is_heavy(heavy, one)] = 0
                # Equal windows get equal numbers, one word more at a time.
                places = np.flatnonzero(length > 0)
                number = pd.factorize(words.lang[places].astype(np.int64) * len(words.distinct) + words.word[places])[0]
                for size in range(1, longest + 1):
                    ends = length[places] == size
                    here, same = places[ends], number[ends]
                    if len(here):
                        counts = np.bincount(same)
                        example = np.zeros(len(counts), np.int64)
                        example[same] = here
                        some = np.flatnonzero(counts)
                        at = example[some]
                        spelled = [words.distinct.take(pa.array(words.word[at + k])) for k in range(size)]
                        phrase = pc.binary_join_element_wise(*spelled, pa.scalar(" ", pa.large_string())) if size > 1 else spelled[0]
                        lang = langs.cast(pa.large_string()).take(pa.array(words.lang[at]))
                        yield _emit(pc.binary_join_element_wise(lang, phrase, pa.scalar("\n", pa.large_string())), size, counts[some])
                    places, number = places[~ends], number[~ends]
                    if not len(places):
                        break
                    number = pd.factorize(number.astype(np.int64) * len(words.distinct) + words.word[places + size])[0]

    return run


# --- the graph: keys are a language, a line feed, and words with a space between ----


def _phrase(key: Column) -> Column:
    return F.substring_index(key, "\n", -1)


def _lang(key: Column) -> Column:
    return F.substring(key, F.lit(1), F.length(key) - F.length(_phrase(key)) - 1)


def _last(key: Column) -> Column:
    return F.substring_index(key, " ", -1)


def _without_last(key: Column) -> Column:
    return F.substring(key, F.lit(1), F.length(key) - F.length(_last(key)) - 1)


def _first(key: Column) -> Column:
    return F.substring_index(_phrase(key), " ", 1)


def _without_first(key: Column) -> Column:
    return F.concat(_lang(key), F.lit("\n"), F.substring(_phrase(key), F.length(_first(key)) + 2, F.length(key)))


def window_counts(texts: DataFrame, longest: int, min_count: int, bits: int, block: int = BLOCK) -> DataFrame:
    """(key, size, n) of all windows that may hold a frequent phrase; size 0 counts a language's words."""
    heavy = heavy_buckets(texts, bits, min_count, block)
    bitmap = texts.sparkSession.sparkContext.broadcast(heavy)
    found = texts.mapInArrow(_count_windows(bitmap, bits, longest, block), "key string, size int, n long")
    return settle(found.groupBy("key", "size").agg(F.sum("n").alias("n")), "windows")


def graph_nodes(windows: DataFrame, longest: int) -> DataFrame:
    """Every node with its count, ways in and out, and whether it lies inside a path."""
    key, none = F.col("key"), F.lit(None)
    edges = windows.filter(F.col("size") == longest)
    out = edges.select(_without_last(key).alias("node"), none.cast("string").alias("first"), _last(key).alias("last"), F.lit(0).cast("long").alias("into"), F.col("n").alias("out"), F.lit(0).cast("long").alias("ends"))
    into = edges.select(_without_first(key), _first(key), none.cast("string"), F.col("n"), F.lit(0).cast("long"), F.lit(0).cast("long"))
    ends = windows.filter(F.col("size") == longest - 1).select("key", none.cast("string"), none.cast("string"), F.lit(0).cast("long"), F.lit(0).cast("long"), "n")
    flows = out.union(into).union(ends).groupBy("node").agg(
        F.count("first").alias("ways_in"), F.count("last").alias("ways_out"), F.min("first").alias("first"), F.min("last").alias("last"),
        F.sum("into").alias("into"), F.sum("out").alias("out"), F.sum("ends").alias("ends"),
    )
    unary = (F.col("ways_in") == 1) & (F.col("ways_out") == 1) & (F.col("into") == F.col("out")) & (F.col("ends") == 0)
    # A node that only runs reach and none leaves or ends in cannot be: runs end as windows of its size.
    nodes = flows.select("node", (F.col("out") + F.col("ends")).alias("n"), unary.alias("unary"), "first", "last")
    return settle(nodes, "nodes")


def compact_paths(nodes: DataFrame) -> DataFrame:
    """Paths (head, key, n, inner): phrases along nodes of one way in and out, each node in one path.

    Every such node learns the first of its run by doubling the steps back: as many
    rounds as the longest run has doublings, and a run is never longer than a piece of one text.
    """
    node = F.col("node")
    back = F.concat(_lang(node), F.lit("\n"), F.col("first"), F.when(F.instr(_phrase(node), " ") > 0, F.concat(F.lit(" "), _phrase(_without_last(node)))).otherwise(""))
    inner = nodes.filter("unary").select("node", "n", "first", "last", back.alias("back"))
    known = inner.select(node.alias("back"), F.lit(True).alias("found"))
    steps = inner.join(known, "back", "left").select(
        "node", F.coalesce(F.when(F.col("found"), F.col("back")), node).alias("to"), F.when(F.col("found"), 1).otherwise(0).cast("long").alias("steps"), F.col("found").isNull().alias("done")
    )
    steps = settle(steps, "steps")
    while not steps.filter("NOT done").isEmpty():
        far = steps.select(node.alias("to"), F.col("to").alias("far"), F.col("steps").alias("more"), F.col("done").alias("there"))
        moved = steps.filter("NOT done").join(far, "to").select("node", F.col("far").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("there").alias("done"))
        steps = settle(steps.filter("done").unionByName(moved), "steps")
    placed = inner.join(steps.select("node", F.col("to").alias("head"), "steps"), "node")
    runs = placed.groupBy("head").agg(
        F.sort_array(F.collect_list(F.struct("steps", "last"))).alias("lasts"), F.min(F.when(F.col("steps") == 0, F.col("first"))).alias("first"), F.min("n").alias("n")
    )
    head = F.col("head")
    key = F.concat(_lang(head), F.lit("\n"), F.col("first"), F.lit(" "), _phrase(head), F.lit(" "), F.array_join(F.transform("lasts", lambda x: x["last"]), " "))
    return settle(runs.select("head", key.alias("key"), "n", F.size("lasts").alias("inner")), "paths")


def _prefixes(sizes: int) -> Column:
    """Keys of the phrases that a key begins with, of 1 to ``sizes`` words but for the whole."""
    words = F.split(_phrase(F.col("key")), " ", -1)
    lang = F.concat(_lang(F.col("key")), F.lit("\n"))
    cut = F.transform(F.sequence(F.lit(1), F.lit(sizes)), lambda k: F.struct(k.alias("size"), F.concat(lang, F.array_join(F.slice(words, 1, k), " ")).alias("key")))
    return F.filter(cut, lambda x: x["size"] <= F.size(words))


def phrase_counts(windows: DataFrame, longest: int, min_count: int) -> DataFrame:
    """(key, size, n) of every phrase of up to ``longest`` words that occurs ``min_count`` times or more."""
    counts = windows.filter((F.col("size") == longest) & (F.col("n") >= min_count)).select("key", "size", "n")
    if longest == 1:
        return settle(counts, "counts")
    nodes = graph_nodes(windows, longest)
    whole = nodes.filter(F.col("n") >= min_count).select(F.col("node").alias("key"), F.lit(longest - 1).alias("size"), "n")
    counts = counts.unionByName(whole)
    if longest > 2:
        paths = compact_paths(nodes)
        # The phrases of a path's inner nodes begin one word after its first and all have its count.
        words = F.split(_phrase(F.col("key")), " ", -1)
        lang = F.concat(_lang(F.col("key")), F.lit("\n"))
        at = F.explode(F.sequence(F.lit(2), F.col("inner") + 1))
        inside = paths.select("n", lang.alias("lang"), words.alias("words"), at.alias("at"))
        inside = inside.select(F.concat("lang", F.array_join(F.slice("words", F.col("at"), F.lit(longest - 1)), " ")).alias("key"), "n")
        others = nodes.filter("NOT unary").select(F.col("node").alias("key"), "n")
        ends = windows.filter((F.col("size") > 0) & (F.col("size") < longest - 1)).select("key", "n")
        shorter = inside.unionByName(others).unionByName(ends).select("n", F.explode(_prefixes(longest - 2)).alias("p"))
        shorter = shorter.groupBy("p.key", "p.size").agg(F.sum("n").alias("n"))
        counts = counts.unionByName(shorter.filter(F.col("n") >= min_count).select("key", "size", "n"))
    return settle(counts, "counts")


def _parts(size: int) -> list[tuple[int, int]]:
    """Place and size of the shorter phrases of two words or more in a phrase of ``size``."""
    return [(i, k) for k in range(2, size) for i in range(1, size - k + 2)]


def without_contained(counts: DataFrame, longest: int, share: int = INSIDE_SHARE) -> DataFrame:
    """Phrases of two words or more that lie in no longer one with ``share`` hundredths of their count."""
    key = F.col("key")
    words, lang = F.split(_phrase(key), " ", -1), F.concat(_lang(key), F.lit("\n"))
    several = counts.filter("size > 1")

    def part(x: Column) -> Column:
        return F.concat(lang, F.array_join(F.slice(words, x["i"], x["k"]), " "))

    by_size = F.lit(None).cast("array<struct<i:int,k:int>>")
    for size in range(3, longest + 1):
        places = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in _parts(size)))
        by_size = F.when(F.col("size") == size, places).otherwise(by_size)
    inside = several.filter("size > 2").select(F.explode(F.transform(by_size, part)).alias("key"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("long").alias("a"), F.col("n").alias("longer"))
    own = several.select("key", "size", F.col("n").alias("a"), F.lit(None).cast("long").alias("longer"))
    both = own.unionByName(inside).groupBy("key").agg(F.max("size").alias("size"), F.max("a").alias("a"), F.max("longer").alias("longer"))
    exact = "decimal(38,0)"
    taken = F.coalesce(100 * F.col("longer").cast(exact) >= share * F.col("a").cast(exact), F.lit(False))
    return both.filter(F.col("a").isNotNull() & ~taken).select("key", "size", "a")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = LONGEST,
    min_count: int = MIN_COUNT,
    per_lang: int = PER_LANG,
    share: int = INSIDE_SHARE,
    bits: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """The ``per_lang`` best phrases of every language: lang, rank, phrase, a, l, r, n, score.

    Letters A to Z are lowered; pieces end at marks and line ends, words at spaces and tabs. A null
    text has no words and a null language is ``und``; repeated rows count as often as they stand
    there, other columns are not read. A phrase of 2 to ``longest`` words with a count a of
    ``min_count`` or more is cut into two parts with counts l and r; its score is the least
    floor(1000 a n / (l r)) over its cuts, for n words of the language, in whole numbers of 38
    digits. Ranks go by score, then a, both falling, then by the phrase's bytes.
    """
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    if bits is None:
        bits = min(max((table_bytes(texts) // 8).bit_length(), LEAST_BITS), MOST_BITS)
    windows = window_counts(texts, longest, min_count, bits, block)
    counts = phrase_counts(windows, longest, min_count)
    kept = without_contained(counts, longest, share)

    words, lang = F.split(_phrase(F.col("key")), " ", -1), F.concat(_lang(F.col("key")), F.lit("\n"))
    k = F.col("k")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select(
        "key", "a", "k", F.concat(lang, F.array_join(F.slice(words, 1, k), " ")).alias("head"), F.concat(lang, F.array_join(F.slice(words, k + 1, F.col("size")), " ")).alias("tail")
    )
    cuts = lookup(settle(cuts, "cuts"), counts.select(F.col("key").alias("head"), F.col("n").alias("l")), "head")
    cuts = lookup(settle(cuts, "cuts"), counts.select(F.col("key").alias("tail"), F.col("n").alias("r")), "tail")
    totals = windows.filter("size = 0").select(F.col("key").alias("lang"), "n")
    cuts = cuts.withColumn("lang", _lang(F.col("key"))).join(broadcast_if_small(totals), "lang")
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cuts.withColumn("score", score).groupBy("key").agg(F.min(F.struct("score", "k", "a", "l", "r", "n", "lang")).alias("s")).select("key", "s.*")
    scored = scored.withColumn("phrase", _phrase(F.col("key")))

    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    scored = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).filter(F.col("rank") <= per_lang)
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= per_lang)
    return scored.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
