"""Byte-level BPE: encoding with a hierarchical-bitmap rank queue, and decoding.

A pre-token is a linked list of parts. Every mergeable pair waits in the bucket of its
merge rank; a bitmap over the ranks, with a bitmap over its words above it, finds the
lowest rank that waits by two find-first-set steps. A bucket holds list positions.
Positions whose pair has changed meanwhile are stale and skipped. A merge costs
constant time whatever the pre-token's length, so very long ones stay linear.
"""

from __future__ import annotations

import base64
import hashlib
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindling.llm.word_values import join_values, listed, some_texts
from kindling.llm.worker_memory import Recent, remembered, tidy

# Encoded words that a worker remembers, at about 200 bytes each.
MEMORY = 1_200_000
# Characters of texts that are encoded together, and different pieces merged in one queue. A queue
# costs a step for every rank that occurs in it, so one for many texts is cheaper than many.
CHARACTERS = 9_000_000
PIECES = 150_000
# Where ids are kept, workers have less room: words remembered, and characters of texts whose ids leave together.
FEW, OUT = 150_000, 2_000_000
# Neighbours looked up at a time.
_STEP = 1 << 16
# Beside it no part has a pair: keys with it are negative.
NO_PART = -(1 << 42)
# Marks that the shortcut for plain words looks for behind them.
_MARKS = ".,;:!?%&$#*|"
# Letters up to here are letters in every version of Unicode.
_LAST_LATIN = "\u024f"

# A word of the lower bitmap holds 256 ranks.
_BIT = [1 << i for i in range(256)]

# White space as the pattern's \s sees it: fixed values of Unicode's White_Space.
_SPACE = "\t-\r \x85\xa0  -     　"
_RUN = re.compile(f"[{_SPACE}]{{2}}")
_BETWEEN = re.compile(f" (?<=[^{_SPACE}] )(?=[^{_SPACE}])")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Encodes and decodes by a table of merge ranks, each match of ``pattern`` separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int | None = None) -> None:
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.size = max(ranks.values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        # The rank queue, empty between two pre-tokens.
        self.buckets: dict[int, list[int]] = {}
        self.bitmap = [0] * ((self.size >> 8) + 1)
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        # The rank of two neighbours' union, by their own ranks: every way to cut a token in two tokens.
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left * self.size + right] = rank
        keys = np.array([*self.pairs, np.iinfo(np.int64).max], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([*self.pairs.values(), self.size], np.int64)[order]
        self.single = [ranks.get(bytes([b])) for b in range(256)]
        self.singles = np.array([NO_PART if r is None else r for r in self.single], np.int64)
        # Words after one space, and whole pieces of the pattern.
        memory = memory or MEMORY
        self.units, self.pieces = Recent(memory * 2 // 3), Recent(memory // 3)
        # Whether the pattern takes a space with Latin letters as one piece and marks behind as another.
        sample = " " + string.ascii_letters
        self.plain_words = self.pattern.findall(sample) == [sample] and self.pattern.findall(f" a{_MARKS}") == [" a", _MARKS]

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if not n:
            return []
        size, rank_of = self.size, self.pairs.get
        parts = [self.single[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # The rank under which a position's pair waits, if it can be merged.
        waiting = [rank_of(a * size + b) for a, b in zip(parts, parts[1:])]
        waiting.append(None)
        buckets, bitmap, bit = self.buckets, self.bitmap, _BIT
        live, top = 0, 0
        for i, rank in enumerate(waiting):
            if rank is not None:
                live += 1
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    bitmap[rank >> 8] |= bit[rank & 255]
                    top |= 1 << (rank >> 8)
        while live:
            lowest = top & -top
            word = lowest.bit_length() - 1
            bits = bitmap[word]
            first = bits & -bits
            rank = (word << 8) + first.bit_length() - 1
            bitmap[word] = bits = bits ^ first
            if not bits:
                top ^= lowest
            positions = buckets.pop(rank)
            if len(positions) > 1:
                positions.sort()
            for at, i in enumerate(positions):
                if waiting[i] != rank:
                    continue  # stale: merged away, or its pair has changed
                j = after[i]
                # Ids are ranks: the merged part is the rank itself.
                parts[i] = rank
                live -= 1 if waiting[j] is None else 2
                waiting[j] = None
                k = after[i] = after[j]
                least = size
                if k < n:
                    before[k] = i
                    new = waiting[i] = rank_of(rank * size + parts[k])
                    if new is not None:
                        live += 1
                        least = new
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            buckets[new] = [i]
                            bitmap[new >> 8] |= bit[new & 255]
                            top |= 1 << (new >> 8)
                else:
                    waiting[i] = None
                h = before[i]
                if h >= 0:
                    if waiting[h] is not None:
                        live -= 1
                    new = waiting[h] = rank_of(parts[h] * size + rank)
                    if new is not None:
                        live += 1
                        if new < least:
                            least = new
                        if new in buckets:
                            buckets[new].append(h)
                        else:
                            buckets[new] = [h]
                            bitmap[new >> 8] |= bit[new & 255]
                            top |= 1 << (new >> 8)
                if least <= rank:  # a lower rank, or this rank again, has to come next
                    rest = [p for p in positions[at + 1 :] if waiting[p] == rank]
                    if rest:
                        buckets.setdefault(rank, []).extend(rest)
                        bitmap[rank >> 8] |= bit[rank & 255]
                        top |= 1 << (rank >> 8)
                    break
        for rank in buckets:  # what is left is stale
            bitmap[rank >> 8] = 0
        buckets.clear()
        out, i = [], 0
        while i < n:
            out.append(parts[i])
            i = after[i]
        return out

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each two neighbours' union; the size of the table where they have none."""
        out = np.empty(len(left), np.int32)
        for start in range(0, len(left), _STEP):
            keys = left[start : start + _STEP] * self.size + right[start : start + _STEP]
            at = np.searchsorted(self.pair_keys, keys)
            out[start : start + _STEP] = np.where(self.pair_keys[at] == keys, self.pair_ranks[at], self.size)
        return out

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many pre-tokens as bytes, in one rank queue over all of their lists.

        A rank's whole bucket is merged at once. Pre-tokens in which a merge makes a pair of the
        same or a lower rank need the order within a bucket; those are merged one by one.
        """
        known = self.ranks
        out = [known.get(p) for p in pieces]
        out = [b"" if r is None else np.array([r], self.dtype).tobytes() for r in out]
        open_pieces = [i for i, p in enumerate(pieces) if p and not out[i]]
        if not open_pieces:
            return out
        ends = np.cumsum([len(pieces[i]) for i in open_pieces])
        n, size = int(ends[-1]), self.size
        # Place n stands for no neighbour; no pair holds its part.
        parts = np.append(self.singles[np.frombuffer(b"".join([pieces[i] for i in open_pieces]), np.uint8)], NO_PART)
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[ends - 1], before[0], before[ends[:-1]] = n, n, n
        waiting = self._ranks_of(parts, parts[after.clip(max=n)])
        waiting[n] = size
        alive = np.ones(n + 1, bool)
        buckets: dict[int, list[np.ndarray]] = {}
        bitmap, bit, top = self.bitmap, _BIT, 0
        redo: list[np.ndarray] = []

        def push(places: np.ndarray, ranks: np.ndarray) -> None:
            nonlocal top
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            start = 0
            for stop in [*cuts.tolist(), len(ranks)]:
                rank = int(ranks[start])
                if rank in buckets:
                    buckets[rank].append(places[start:stop])
                else:
                    buckets[rank] = [places[start:stop]]
                    bitmap[rank >> 8] |= bit[rank & 255]
                    top |= 1 << (rank >> 8)
                start = stop

        first_places = np.flatnonzero(waiting < size)
        if len(first_places):
            push(first_places, waiting[first_places])
        while top:
            lowest = top & -top
            word = lowest.bit_length() - 1
            bits = bitmap[word]
            first = bits & -bits
            rank = (word << 8) + first.bit_length() - 1
            bitmap[word] = bits = bits ^ first
            if not bits:
                top ^= lowest
            held = buckets.pop(rank)
            i = held[0] if len(held) == 1 else np.concatenate(held)
            i = i[waiting[i] == rank]  # the others are stale
            if not len(i):
                continue
            j = after[i]
            overlap = waiting[j] == rank
            if overlap.any():
                # Of pairs that share parts, every second one from the left is merged.
                i = np.unique(i)
                linked = np.append(False, after[i[:-1]] == i[1:])
                run_start = np.maximum.accumulate(np.where(linked, 0, np.arange(len(i))))
                i = i[(np.arange(len(i)) - run_start) % 2 == 0]
                j = after[i]
            k = after[j]
            # What a pair to the right would be before its other part is merged, too.
            early = self._ranks_of(np.full(len(i), rank), parts[k]) <= rank
            parts[i] = rank
            alive[j] = False
            waiting[j] = size
            after[i] = k
            before[k] = i
            before[n] = n
            h = before[i]
            right, left = self._ranks_of(parts[i], parts[k]), self._ranks_of(parts[h], parts[i])
            waiting[i] = right
            waiting[h] = left
            waiting[n] = size
            early |= (right <= rank) | (left <= rank)
            if early.any():
                redo.append(i[early])
            places, ranks = np.concatenate([i, h]), np.concatenate([right, left])
            some = ranks < size
            if some.any():
                push(places[some], ranks[some])
        ids = parts[:n][alive[:n]].astype(self.dtype).tobytes()
        stops = (np.cumsum(alive[:n])[ends - 1] * self.dtype.itemsize).tolist()
        start = 0
        for i, stop in zip(open_pieces, stops, strict=True):
            out[i], start = ids[start:stop], stop
        if redo:
            for at in np.unique(np.searchsorted(ends, np.concatenate(redo), "right")).tolist():
                out[open_pieces[at]] = np.array(self.merge(pieces[open_pieces[at]]), self.dtype).tobytes()
        return out

    def _learn_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        found = {p: self.pieces.get(p) for p in pieces}
        new = [p for p, ids in found.items() if ids is None]
        for at in range(0, len(new), PIECES):
            some = new[at : at + PIECES]
            for p, ids in zip(some, self.merge_all([p.encode() for p in some]), strict=True):
                found[p] = ids
                if len(p) < 100:
                    self.pieces.put(p, ids)
        return found

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of a space and a word, for words that the recent units do not hold."""
        found, plain, marked, others = {}, [], [], {}
        older = self.units.before.get
        for word in words:
            ids = older(word)
            if ids is not None:
                found[word] = ids
                continue
            letters = word.rstrip(_MARKS)
            if self.plain_words and letters.isalpha() and max(letters) <= _LAST_LATIN:
                plain.append(letters)
                if letters != word:
                    marked.append(word)
            else:
                others[word] = self.pattern.findall(f" {word}")
        ids_of = self._learn_pieces({p for own in others.values() for p in own}.union([w[len(w.rstrip(_MARKS)) :] for w in marked]))
        for word, own in others.items():
            found[word] = b"".join([ids_of[p] for p in own])
        known = self.units.get
        letters_of = {w: known(w) for w in set(plain)}
        new = [w for w, ids in letters_of.items() if ids is None]
        for at in range(0, len(new), PIECES):
            some = new[at : at + PIECES]
            letters_of.update(zip(some, self.merge_all([f" {w}".encode() for w in some]), strict=True))
        found |= letters_of
        for word in marked:
            letters = word.rstrip(_MARKS)
            found[word] = letters_of[letters] + ids_of[word[len(letters) :]]
        self.units.put_all({w: ids for w, ids in found.items() if len(w) < 100})
        return found

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """The ids of a space and a word, for different words."""
        found = list(map(self.units.now.get, words))
        new = self._learn([w for w, ids in zip(words, found, strict=True) if ids is None])
        return [new[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]

    def encode_all(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """The ids of texts as little-endian integers of ``dtype``; null is empty.

        No match of the pattern reaches over a space between two characters that are not
        white space. Texts are cut there; all but the first part of each have that space before them.
        """
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        has_runs = pc.match_substring_regex(column, _RUN.pattern)
        out: list[bytes] = [b""] * len(column)
        for mask in (pc.invert(has_runs), has_runs):
            some = column.filter(mask)
            if not len(some):
                continue
            if mask is has_runs:
                words, sizes = [], [0]
                for text in some:
                    parts = _BETWEEN.split(text.as_py())
                    words.append(pa.array(parts, column.type))
                    sizes.append(len(parts))
                words, offsets = pa.concat_arrays(words), np.cumsum(sizes)
            else:
                words, offsets = listed(pc.split_pattern(some, " "))
            own = [self.pattern.findall(first) for first in words.take(pa.array(offsets[:-1])).to_pylist()]
            ids_of = self._learn_pieces({p for pieces in own for p in pieces})
            rest = join_values(words, offsets, self._word_ids, skip=1)
            for k, pieces, ids in zip(np.flatnonzero(mask.to_numpy(zero_copy_only=False)).tolist(), own, rest, strict=True):
                out[k] = b"".join([*(ids_of[p] for p in pieces), ids])
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def _encoder(path: str, pattern: str, memory: int | None = None) -> Encoder:
    return remembered(("byte_bpe", path, pattern, memory), lambda: Encoder(read_ranks(path), pattern, memory))


def _texts(column: pa.Array) -> Iterator[pa.Array]:
    """Texts in slices of about ``CHARACTERS``."""
    return some_texts(column, CHARACTERS)


def _wide_ids(encoder: Encoder, column: pa.Array) -> pa.Array:
    return pa.array([np.frombuffer(b, encoder.dtype).astype("<u4").tobytes() for b in encoder.encode_all(column)], pa.binary())


def encode(text: Column, ranks_path: str, pattern: str) -> Column:
    """Ids of each text as little-endian unsigned 32-bit integers; null and empty texts have none."""

    @F.arrow_udf("binary")
    def ids(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(ranks_path, pattern, FEW)
        for batch in column:
            yield pa.concat_arrays([pa.array([], pa.binary()), *(_wide_ids(encoder, some) for some in some_texts(batch, OUT))])
            tidy()

    return ids(text)


def decode(ids: Column, ranks_path: str, pattern: str) -> Column:
    """The bytes that ids stand for; null ids stand for none."""

    @F.arrow_udf("binary")
    def texts(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(ranks_path, pattern, FEW)
        for batch in column:
            yield pa.array([encoder.decode(np.frombuffer(b or b"", "<u4")) for b in batch.to_pylist()], pa.binary())

    return texts(ids)


def tokenize(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", output: str = "ids") -> DataFrame:
    """``docs`` with the ids of its texts, bytes of unsigned 32-bit integers, in ``output``.

    Every row stays; an input column of that name is replaced.
    """
    kept = [c for c in docs.columns if c.lower() != output.lower()]

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path, pattern, FEW)
        for batch in batches:
            at = 0
            # Ids leave slice by slice: those of a whole batch, with the copies on their way, take more room than its texts.
            for some in some_texts(batch.column(0), OUT):
                rows = batch.slice(at, len(some))
                yield pa.RecordBatch.from_arrays([*rows.columns[1:], _wide_ids(encoder, some)], [*kept, output])
                at += len(some)
            tidy()

    chosen = docs.select(F.col(f"`{text_col}`").alias("__text"), *(F.col(f"`{c}`") for c in kept))
    out = chosen.mapInArrow(ids, T.StructType([*(docs.schema[c] for c in kept), T.StructField(output, T.BinaryType())]))
    # In the place of a column that is replaced, else last.
    return out.select(*(F.col(f"`{c}`") if c in kept else F.col(f"`{output}`") for c in docs.columns), *([f"`{output}`"] if len(kept) == len(docs.columns) else []))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Key, number of ids, and digests of the ids and of the bytes decoded from them.

    One pass: encoding and decoding happen in the same task, the ids never leave it.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path, pattern)
        for batch in batches:
            n, ids_digest, text_digest = [], [], []
            for found in (ids for some in _texts(batch.column(1)) for ids in encoder.encode_all(some)):
                ids = np.frombuffer(found, encoder.dtype)
                n.append(len(ids))
                ids_digest.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_digest.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    chosen = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text_col}`").alias("text"))
    kind = chosen.schema["key"].dataType.simpleString()
    out = chosen.mapInArrow(digests, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)
