"""Benchmark decontamination by greedy string tiling.

Documents that share a run of ``SEED`` words with a test item are joined to it. Such a pair is
tiled: the longest common runs of words that no tile covers yet are marked, again and again,
found by Karp-Rabin hashes of runs of falling length, until none of at least ``SEED`` words
is left. The share of the item's words under tiles does not depend on the order in which
passages stand, so moved passages are caught.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindling.llm.worker_memory import forget

SEED = 5
COVERAGE = 0.5
# Test items sent to the tasks at a time; more are taken in further passes over the documents.
SLAB_BYTES = 8 << 20

_WORD = re.compile(r"[^\W_]+")
_BASE = 1_000_003
_MODULUS = (1 << 61) - 1


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, lower case."""
    return _WORD.findall(text.lower()) if text else []


def _hashes(ids: list[int], length: int) -> Iterator[int]:
    """Karp-Rabin hashes of all runs of ``length`` ids."""
    top, h = pow(_BASE, length - 1, _MODULUS), 0
    for i, x in enumerate(ids):
        if i >= length:
            h = (h - ids[i - length] * top) % _MODULUS
        h = (h * _BASE + x) % _MODULUS
        if i >= length - 1:
            yield h


def _free_runs(marked: bytearray, least: int) -> list[tuple[int, int]]:
    runs, start = [], None
    for i, m in enumerate([*marked, 1]):
        if not m and start is None:
            start = i
        elif m and start is not None:
            if i - start >= least:
                runs.append((start, i))
            start = None
    return runs


def tile(item: list[int], doc: list[int], least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (item start, doc start, length): maximal matches, longest first, leftmost on ties."""
    done_item, done_doc = bytearray(len(item)), bytearray(len(doc))
    tiles: list[tuple[int, int, int]] = []
    search = least
    while True:
        found: dict[int, list[tuple[int, int]]] = {}
        spots: dict[int, list[int]] = {}
        for a, b in _free_runs(done_doc, search):
            for i, h in enumerate(_hashes(doc[a:b], search)):
                spots.setdefault(h, []).append(a + i)
        longest = 0
        for a, b in _free_runs(done_item, search):
            for i, h in enumerate(_hashes(item[a:b], search)):
                for d in spots.get(h, ()):
                    p = a + i
                    if p and d and not done_item[p - 1] and not done_doc[d - 1] and item[p - 1] == doc[d - 1]:
                        continue  # starts further left
                    n = 0
                    while p + n < b and d + n < len(doc) and not done_doc[d + n] and item[p + n] == doc[d + n]:
                        n += 1
                    if n >= search:
                        found.setdefault(n, []).append((p, d))
                        longest = max(longest, n)
        if longest >= 2 * search:  # look for longer ones first, as Karp-Rabin tiling does
            search = longest
            continue
        if not longest:
            if search == least:
                return tiles
            search = max(least, search // 2)
            continue
        for n in sorted(found, reverse=True):
            for p, d in found[n]:
                if not any(done_item[p : p + n]) and not any(done_doc[d : d + n]):
                    tiles.append((p, d, n))
                    done_item[p : p + n] = done_doc[d : d + n] = b"\1" * n
        if search > least:
            search = max(least, search // 2)


class Items:
    """Test items with a table of their seeds."""

    def __init__(self, ids: list[int], texts: list[str | None], seed: int) -> None:
        self.ids, self.seed = ids, seed
        self.vocabulary: dict[str, int] = {}
        self.words = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(t)] for t in texts]
        self.seeds: dict[tuple[int, ...], list[int]] = {}
        for k, words in enumerate(self.words):
            for i in range(len(words) - seed + 1):
                own = self.seeds.setdefault(tuple(words[i : i + seed]), [])
                if not own or own[-1] != k:
                    own.append(k)

    def matches(self, text: str | None, coverage: float) -> list[tuple[int, int, int]]:
        """(item, words under tiles, tiles) of every item that the text covers enough of."""
        if not text:
            return []
        get = self.vocabulary.get
        doc = [get(w, 0) for w in _WORD.findall(text.lower())]
        n = self.seed
        known = np.array(doc) > 0
        if len(doc) < n:
            return []
        # Places where a run of n known words starts.
        count = np.concatenate([[0], np.cumsum(known)])
        starts = np.flatnonzero(count[n:] - count[:-n] == n).tolist()
        seeds, pairs = self.seeds, set()
        for i in starts:
            own = seeds.get(tuple(doc[i : i + n]))
            if own:
                pairs.update(own)
        out = []
        for k in sorted(pairs):
            tiles = tile(self.words[k], doc, n)
            covered = sum(t[2] for t in tiles)
            if covered >= coverage * len(self.words[k]):
                out.append((self.ids[k], covered, len(tiles)))
        return out


def _slabs(items: DataFrame, key: str, text_col: str, slab_bytes: int) -> Iterator[tuple[list[int], list[str | None]]]:
    """Items in blocks of about ``slab_bytes``, one block on the driver at a time."""
    own = items.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("id is not null and text is not null")
    size = own.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-size // slab_bytes)
    for k in range(blocks):
        rows = own.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).distinct().orderBy("id", "text").collect()
        if rows:
            yield [r["id"] for r in rows], [r["text"] for r in rows]


def find_leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text_col: str = "text", item_key: str = "item_id", item_text: str = "text",
    seed: int = SEED, coverage: float = COVERAGE, slab_bytes: int = SLAB_BYTES,
) -> DataFrame:
    """One row per document and item it covers: key, item key, n_words, n_covered, n_tiles.

    Items of fewer than ``seed`` words cannot be found. Null and empty texts match nothing; null
    item keys are left out; repeated item rows count once, repeated document rows each.
    Without items there are no rows. Documents are never shuffled.
    """
    kind = docs.schema[key].dataType.simpleString()
    chosen = docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    schema = f"doc {kind}, item long, n_words long, n_covered long, n_tiles long"
    parts = []
    for ids, texts in _slabs(items, item_key, item_text, slab_bytes):
        shared = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            forget()
            table = Items(*shared.value, seed)
            n_words = dict(zip(table.ids, map(len, table.words), strict=True))
            for batch in batches:
                rows = [(i, *m) for i, text in enumerate(batch.column(1)) for m in table.matches(text.as_py(), coverage)]
                at, item, covered, tiles = ([r[k] for r in rows] for k in range(4))
                columns = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in (item, [n_words[k] for k in item], covered, tiles))]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "item", "n_words", "n_covered", "n_tiles"])

        parts.append(chosen.mapInArrow(search, schema))
    if not parts:
        parts = [docs.sparkSession.createDataFrame([], schema)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.col("doc").alias(key), F.col("item").alias(item_key), "n_words", "n_covered", "n_tiles")
