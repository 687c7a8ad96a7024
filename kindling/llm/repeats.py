"""Exact removal of repeated byte strings with suffix arrays by linear grouping construction.

A string of ``LENGTH`` bytes is looked up at its anchor, its byte position with the least hash
of ``GRAM`` bytes: equal strings have equal anchors at equal offsets. Strings that start in a row
and share an anchor form a context, the text from the first one's start to the last one's
end. Contexts whose anchor bytes occur once hold nothing repeated; equal contexts
are repeated altogether. What is left, contexts that are equal in part at best, is cut into
cells of ``CELL`` offsets from the anchor. All strings of a cell share its core, the bytes that every
one of them covers. Cells of equal anchor, offsets and core go to one task, where
a core is one symbol between the bytes that differ, and a suffix array brings equal strings side by
side.

The suffix array groups suffixes by their longest Lyndon prefix. Groups are visited in
descending order; each suffix of a group moves the suffix its previous-smaller pointer names to
a new group behind that one's old group. A second sweep then emits every group's order by
following the pointers; nothing is renamed or sorted recursively.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindling.cluster import broadcast_if_small, settle
from kindling.llm.sizes import table_bytes
from kindling.llm.worker_memory import tidy

LENGTH = 200
GRAM = 32
# Offsets from an anchor in one cell.
CELL = 24
# Cells of one core that go to one task as they are; of more, equal ones are counted first, and if more
# different ones than this are left, every string is hashed.
GROUP = 4096
# Symbols for one suffix array, and bytes of documents for one bucket of anchors.
SORT_SYMBOLS = 1 << 19
BUCKET_BYTES = 8 << 20
# Rows of texts that a worker has open at once.
SLICE = 512
_CHUNK = 1 << 19

# --- suffix arrays ---------------------------------------------------------------


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in ascending order; a suffix that ends first is smaller."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if n else np.zeros(0, bool)
    starts = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    group_of = np.empty(n, np.int64)
    group_of[order] = starts
    place_of = np.empty(n, np.int64)
    place_of[order] = np.arange(n)
    sizes = np.bincount(starts, minlength=n).tolist()
    group, members, place = group_of.tolist(), order.tolist(), place_of.tolist()
    smaller = _group_by_lyndon_prefix(group, members, place, sizes)
    return np.array(_emit(group, smaller), np.int64)


def _group_by_lyndon_prefix(group: list[int], members: list[int], place: list[int], sizes: list[int]) -> list[int]:
    """Refine groups in place; returns each suffix's previous smaller one, or -1."""
    smaller = [-1] * len(group)
    end = len(group)
    while end > 0:
        start = group[members[end - 1]]
        own = members[start:end]
        end = start
        own.sort()
        runs: dict[int, int] = {}
        for s in own:
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                runs[p] = runs.get(p, 0) + 1
        if not runs:
            continue
        # Followed by more copies of this group's prefix is larger: those move first, to the very end.
        most = max(runs.values())
        by_count = [list(runs)] if most == 1 else [[p for p, c in runs.items() if c == k] for k in sorted(set(runs.values()), reverse=True)]
        for moving in by_count:
            moved: dict[int, int] = {}
            for p in moving:
                g = group[p]
                sizes[g] -= 1
                to, at = g + sizes[g], place[p]
                other = members[to]
                members[at], members[to] = other, p
                place[other], place[p] = at, to
                moved[g] = moved.get(g, 0) + 1
            new_of = {g: g + sizes[g] for g in moved}
            for p in moving:
                group[p] = new_of[group[p]]
            for g, count in moved.items():
                sizes[new_of[g]] = count
    return smaller


def _emit(group: list[int], smaller: list[int]) -> list[int]:
    n = len(group)
    out, head, done = [0] * n, list(range(n)), bytearray(n)
    j = n - 1
    for k in range(n + 1):
        while j >= 0 and not done[j]:
            done[j] = 1
            g = group[j]
            out[head[g]] = j
            head[g] += 1
            j = smaller[j]
        if k < n:
            j = out[k] - 1
    return out


def repeated_starts(texts: list[np.ndarray], length: int) -> list[np.ndarray]:
    """Per text of positive symbols, the starts of its strings of ``length`` that start elsewhere, too."""
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.cumsum(sizes + 1) - sizes - 1
    codes = np.zeros(int((sizes + 1).sum()), np.int64)  # 0 ends a text
    valid = np.zeros(len(codes), bool)
    for t, at in zip(texts, offsets.tolist(), strict=True):
        codes[at : at + len(t)] = t
        valid[at : at + max(len(t) - length + 1, 0)] = True
    order = suffix_array(codes)
    order = order[valid[order]]
    same = np.zeros(len(order) + 1, bool)
    reach = np.arange(length)
    for at in range(0, len(order) - 1, 4096):
        b = order[at + 1 : at + 4097]
        a = order[at : at + len(b)]
        same[at + 1 : at + 1 + len(b)] = (codes[a[:, None] + reach] == codes[b[:, None] + reach]).all(1)
    found = np.zeros(len(codes), bool)
    found[order[same[1:] | same[:-1]]] = True
    return [np.flatnonzero(found[at : at + size]) for at, size in zip(offsets.tolist(), sizes.tolist(), strict=True)]


# --- anchors ----------------------------------------------------------------------

_RNG = np.random.default_rng(90_017)
_BYTE = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = np.uint64((1 << 20) - 1)
_tables: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(_CHUNK + 4096, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["up"], _tables["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class _Hashes:
    """Hashes of any strings of a stretch of text."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _powers()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:-size]) * self.down[:n] + np.uint64(size))


def _window_least(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def contexts(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, first start, last start, anchor) of the contexts of one text, by start.

    A long text is taken in overlapping stretches; a context that a stretch's end cuts in
    two stays two, which costs a comparison and changes no result.
    """
    out = []
    for begin in range(0, max(len(data) - length + 1, 0), _CHUNK - length):
        part = data[begin : begin + _CHUNK - 1]
        if len(part) < length:
            break
        hashes = _Hashes(part)
        grams = hashes.grams(gram)
        ranked = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        anchor = (_window_least(ranked, length - gram + 1) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.concatenate([first[1:], [len(anchor)]]) - 1
        at = anchor[first]
        whole = _mix(hashes.of(first, last + length) + (at - first).astype(np.uint64))
        out.append((grams[at], whole, first + begin, last + begin, at + begin))
    if not out:
        return tuple(np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


# --- finding ------------------------------------------------------------------------

_DEALT = "bucket int, anchors binary, wholes binary, counts binary, keys binary, firsts binary, lasts binary, places binary"
_SPANS = "key long, first long, last long, anchor long, place int, kind int"
_REPEATED, _OPEN, _KNOWN = 0, 1, 2  # kinds of contexts: repeated; to be sorted; repeated and to be sorted with


def _deal(buckets: int, length: int):
    """Contexts in binary blocks by bucket of their anchor; equal ones of a block only once.

    A block's further copies are repeated for sure. They are passed on aside, spread evenly.
    """

    def block(keys: list[np.ndarray], parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key = np.concatenate(keys)
        anchor, whole, first, last, at = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((whole, anchor))
        new = np.concatenate([[True], (anchor[order][1:] != anchor[order][:-1]) | (whole[order][1:] != whole[order][:-1])])
        run = np.cumsum(new) - 1
        count = np.zeros(len(order), np.int64)
        count[order] = np.bincount(run)[run]
        fresh = np.zeros(len(order), bool)
        fresh[order] = new
        aside = buckets + (_mix(key.view(np.uint64) ^ first.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        bucket = np.where(fresh, (anchor % np.uint64(buckets)).astype(np.int64), aside)
        order = np.argsort(bucket, kind="stable")
        rows = []
        for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            values = (anchor[own], whole[own], np.minimum(count[own], 2).astype(np.uint8), key[own], first[own], (last - first)[own].astype("<u2"), (at - first)[own].astype("<u2"))
            rows.append((int(bucket[own[0]]), *(v.tobytes() for v in values)))
        kinds = [pa.int32(), *[pa.binary()] * 7]
        names = ["bucket", "anchors", "wholes", "counts", "keys", "firsts", "lasts", "places"]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(8)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, parts, held = [], [], 0
        for batch in _slices(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = contexts(np.frombuffer(text, np.uint8), length)
                if not len(found[0]):
                    continue
                keys.append(np.full(len(found[0]), key, np.int64))
                parts.append(found)
                held += len(found[0])
                if held >= 1 << 19:
                    yield block(keys, parts)
                    keys, parts, held = [], [], 0
        if parts:
            yield block(keys, parts)

    return run


def _classify(buckets: int):
    def run(part: pa.Table) -> pa.Table:
        def joined(name: str, kind: str) -> np.ndarray:
            return np.concatenate([np.frombuffer(b, kind) for b in part[name].to_pylist()])

        anchor, whole, count = joined("anchors", "<u8"), joined("wholes", "<u8"), joined("counts", "u1").astype(np.int64)
        key, first, extent = joined("keys", "<i8"), joined("firsts", "<i8"), joined("lasts", "<u2").astype(np.int64)
        place = joined("places", "<u2").astype(np.int32)
        if part["bucket"][0].as_py() >= buckets:
            kind = np.full(len(key), _REPEATED)
            keep = np.ones(len(key), bool)
        else:
            order = np.lexsort((whole, anchor))
            anchor, whole, count, key, first, extent, place = (a[order] for a in (anchor, whole, count, key, first, extent, place))
            new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
            new = new_anchor | np.concatenate([[True], whole[1:] != whole[:-1]])
            run_of = np.cumsum(new) - 1
            several = np.bincount(run_of, weights=count)[run_of] > 1
            group = np.cumsum(new_anchor) - 1
            classes = np.bincount(group, weights=new)[group]
            # A group of one class has nothing to compare; without an open context, neither.
            some_open = np.bincount(group, weights=new & ~several)[group] > 0
            mixed = (classes > 1) & some_open
            kind = np.where(~several, _OPEN, np.where(mixed & new, _KNOWN, _REPEATED))
            keep = several | mixed
        columns = {"key": key, "first": first, "last": first + extent, "anchor": anchor.view(np.int64), "place": place, "kind": kind.astype(np.int32)}
        return pa.table({n: c[keep] for n, c in columns.items()})

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time: what a worker makes of a text takes more memory than the text."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)
    tidy()  # for the stages after this one


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, in the last column, compressed and with their length: shuffles of texts are most of what is written."""
    for batch in _slices(batches):
        texts = batch.column(batch.num_columns - 1).to_pylist()
        packed = pa.array([pa.compress(t, "zstd", asbytes=True) for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed, pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names, "size"])


def _unpack(packed: bytes, size: int) -> bytes:
    return pa.decompress(packed, size, "zstd", asbytes=True) if size else b""


_CELLS = "core binary, before binary, after binary, key long, first long, n int"


def _cut(length: int, cell: int):
    """The cells of every context that has to be compared: digest of core, bytes before and after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = []
            for key, packed, size, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = _unpack(packed, size)
                for s in own:
                    at = s["first"] + s["place"]
                    for low in range((at - s["last"]) // cell * cell, s["place"] + 1, cell):
                        # Strings that start low to low + cell - 1 bytes before the anchor.
                        first, last = max(s["first"], at - low - cell + 1), min(s["last"], at - low)
                        begin, end = at - low, at - low - cell + 1 + length
                        core = hashlib.blake2b(text[begin:end] + s["anchor"].to_bytes(8, "little", signed=True) + bytes([low]), digest_size=16).digest()
                        rows.append((core, text[first:begin], text[end : last + length], key, first, last - first + 1))
            kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
            names = ["core", "before", "after", "key", "first", "n"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names)

    return run


def _symbols(before: bytes, core: int, after: bytes) -> np.ndarray:
    out = np.empty(len(before) + 1 + len(after), np.int64)
    out[: len(before)] = np.frombuffer(before, np.uint8)
    out[len(before) + 1 :] = np.frombuffer(after, np.uint8)
    out += 1
    out[len(before)] = 257 + core
    return out


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate([[0], breaks + 1])].tolist(), starts[np.concatenate([breaks, [len(starts) - 1]])].tolist(), strict=True))


def _sort_group(cell: int):
    """Runs of repeated strings of the cells of a task, which has all cells of its cores."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("core").combine_chunks()
        ids = pc.rank(part["core"], tiebreaker="min").to_numpy().astype(np.int64)
        alone = np.bincount(ids)[ids] == 1
        part = part.filter(pa.array(~alone))  # nothing to compare with
        cores, before, after = (part[n].to_pylist() for n in ("core", "before", "after"))
        keys, firsts, ns, copies = (part[n].to_pylist() for n in ("key", "first", "n", "copies"))
        texts, owners, core, cuts, held, rows = [], [], 0, [0], 0, []
        bounds = [i for i in range(len(cores) + 1) if i in (0, len(cores)) or cores[i] != cores[i - 1]]
        for low, high in itertools.pairwise(bounds):
            classes: dict[tuple[bytes, bytes], list[int]] = {}
            for i in range(low, high):
                classes.setdefault((before[i], after[i]), []).append(i)
            several = [len(own) > 1 or copies[own[0]] > 1 for own in classes.values()]
            for own in classes.values():
                if len(own) > 1:  # repeated altogether
                    rows += [(keys[i], firsts[i], firsts[i] + ns[i] - 1) for i in own]
            if len(classes) == 1 or all(several):
                continue
            for own, repeated in zip(classes.values(), several, strict=True):
                texts.append(_symbols(before[own[0]], core, after[own[0]]))
                owners.append(-1 if repeated else own[0])
                held += len(texts[-1])
            core += 1
            if held >= SORT_SYMBOLS:  # whole groups together until there is enough for one suffix array
                cuts.append(len(texts))
                held = 0
        for a, b in zip(cuts, [*cuts[1:], len(texts)], strict=True):
            if a == b:
                continue
            for i, starts in zip(owners[a:b], repeated_starts(texts[a:b], cell), strict=True):
                if i >= 0:
                    rows += [(keys[i], firsts[i] + x, firsts[i] + y) for x, y in _runs(starts)]
        return pa.table({n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(("key", "first", "last"))})

    return run


def _every_string(cell: int):
    """A digest of every string of cells whose group is too large to sort."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for core, before, after, key, first in zip(*(batch.column(n).to_pylist() for n in ("core", "before", "after", "key", "first")), strict=True):
                codes = _symbols(before, 0, after)
                for i in range(len(codes) - cell + 1):
                    rows.append((key, first + i, hashlib.blake2b(core + codes[i : i + cell].tobytes(), digest_size=16).digest()))
            kinds = [pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(3)], ["key", "at", "digest"])

    return run


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, first, last): starts, in rows, of strings of ``length`` bytes that start elsewhere, too.

    ``texts`` has key, a long that only equal rows may share, and text, not null.
    """
    sc = texts.sparkSession.sparkContext
    buckets = max(sc.defaultParallelism * 4, int(table_bytes(texts) // BUCKET_BYTES))
    binary = texts.select("key", F.col("text").cast("binary").alias("text"))
    dealt = binary.mapInArrow(_deal(buckets, length), _DEALT)
    told = settle(dealt.groupBy("bucket").applyInArrow(_classify(buckets), _SPANS), "contexts")
    done = told.filter(F.col("kind") != _OPEN).select("key", "first", "last")

    open_ones = told.filter(F.col("kind") != _REPEATED).groupBy("key").agg(F.collect_set(F.struct("first", "last", "anchor", "place")).alias("own"))
    # Not broadcast while small: what is shuffled should follow the input at every size.
    packed = binary.mapInArrow(_pack, "key long, text binary, size long")
    chosen = packed.join(open_ones.withColumnRenamed("key", "of"), F.col("key") == F.col("of")).select("key", "text", "size", "own")
    # Rows that are equal throughout share a key: their contexts are repeated and none of them is open twice.
    cells = settle(chosen.mapInArrow(_cut(length, CELL), _CELLS), "cells")
    tasks = max(sc.defaultParallelism, int(table_bytes(cells) // (SORT_SYMBOLS * 2)))

    def sort_groups(rows: DataFrame) -> DataFrame:
        dealt = rows.select("core", "before", "after", "key", "first", "n", "copies", F.pmod(F.xxhash64("core"), F.lit(tasks)).alias("task"))
        return dealt.groupBy("task").applyInArrow(_sort_group(CELL), "key long, first long, last long")

    # At most one core in GROUP cells is crowded, so that all others are dealt out at once.
    crowded = settle(cells.groupBy("core").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > GROUP).select("core"), "crowded-cores")
    crowded = broadcast_if_small(crowded)
    found = sort_groups(cells.join(crowded, "core", "left_anti").withColumn("copies", F.lit(1)))
    return done.unionByName(found).unionByName(_crowded_spans(cells.join(crowded, "core", "left_semi"), sort_groups))


def _crowded_spans(cells: DataFrame, sort_groups: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Spans in cells of cores that have too many for one task: equal cells are counted by a shuffle."""
    cells = settle(cells.withColumn("whole", F.xxhash64("core", "before", "after", "n")), "crowded-cells")
    same = ["core", "whole"]
    classes = cells.groupBy(*same).agg(*[F.min(c).alias(c) for c in ("before", "after", "n")], F.min(F.struct("key", "first")).alias("at"), F.count(F.lit(1)).alias("copies"))
    classes = settle(classes.select(*same, "before", "after", "at.key", "at.first", "n", "copies"), "cell-classes")
    # Cells with a copy are repeated altogether.
    copied = settle(classes.filter("copies > 1").select(*same), "copied-cells")
    whole = cells.join(copied, same, "left_semi").select("key", "first", (F.col("first") + F.col("n") - 1).alias("last"))

    groups = classes.groupBy("core").agg(F.count(F.lit(1)).alias("classes"), F.min("copies").alias("least"))
    groups = settle(groups.filter("classes > 1 and least = 1").select("core", "classes"), "cell-groups")
    mixed = settle(classes.join(groups, "core"), "mixed-classes")
    sorted_ones = sort_groups(mixed.filter(F.col("classes") <= GROUP))
    strings = settle(mixed.filter(F.col("classes") > GROUP).mapInArrow(_every_string(CELL), "key long, at long, digest binary"), "strings")
    several = settle(strings.groupBy("digest").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("digest"), "repeated-strings")
    hashed = strings.join(several, "digest", "left_semi").select("key", F.col("at").alias("first"), F.col("at").alias("last"))
    return whole.unionByName(sorted_ones).unionByName(hashed)


def _keep(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ids, texts, sizes, spans = batch.columns
            kept, removed, runs = [], [], []
            for packed, size, own in zip(texts.to_pylist(), sizes.to_pylist(), spans.to_pylist(), strict=True):
                text = _unpack(packed, size)
                gone, pieces, at, count = 0, [], 0, 0
                end = -1
                for first, last in sorted((s["first"], s["last"] + length) for s in own or ()):
                    if first > end:
                        if end >= 0:
                            gone += end - at
                            at = end
                        count += 1
                        pieces.append(text[at:first])
                        at = first
                    end = max(end, last)
                if end >= 0:
                    gone += end - at
                    at = end
                pieces.append(text[at:])
                kept.append(b"".join(pieces))
                removed.append(gone)
                runs.append(count)
            columns = [ids, sizes, pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans (removed runs) and kept, the bytes that stay.

    A byte goes when any string of ``length`` bytes over it starts at another place, too, in
    the same row or another one; all copies go. Texts are taken as UTF-8, null ones as empty;
    shorter ones keep everything. Rows that repeat key and text are copies of each other. Null keys
    are keys like others. An empty table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("id"), text.alias("text"))
    # Equal rows share this key, different ones do not.
    rows = rows.withColumn("key", F.xxhash64("id", "text"))
    spans = repeated_spans(rows.select("key", "text"), length)
    spans = spans.groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("__spans")).withColumnRenamed("key", "of")
    kind = docs.schema[key].dataType.simpleString()
    packed = rows.select("id", "key", F.col("text").cast("binary").alias("text")).mapInArrow(_pack, f"id {kind}, key long, text binary, size long")
    joined = packed.join(spans, F.col("key") == F.col("of"), "left").select("id", "text", "size", "__spans")
    out = joined.mapInArrow(_keep(length), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", key)
