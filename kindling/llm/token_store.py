"""Token ids in a binary store, coded by a static range asymmetric numeral system.

A store is a folder of Parquet tables, so that Spark commits, reads and repeats its
tasks like those of any table:

* ``ids``: key and ids of every document, the uncoded working copy
* ``frequencies``: the shared frequency table, one row per token id in use
* ``blocks``: one row per block of ``BLOCK`` ids, in ascending key order within a file and
  over files. A block is coded on its own; it names the documents it holds parts of.

A block's bytes, little endian: magic, ids, lanes, checkpoints, words (four unsigned 32-bit
integers after the 4-byte magic), the position among the words of every checkpoint (32-bit),
the states of all lanes at every checkpoint (64-bit), the words (32-bit), and the crc32 of
the ids as 32-bit integers and of all bytes before it. Id number i belongs to lane
i mod ``LANES``. Lanes of all blocks of a task are coded side by side in NumPy vectors,
and decoding may start at any checkpoint.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindling.cluster import scan_bytes
from kindling.llm.word_values import join_values, listed, some_texts
from kindling.llm.worker_memory import Recent, remembered

LANES = 64
BLOCK = 1 << 16
# Ids per lane between two checkpoints.
STRIDE = 256
# Blocks coded side by side.
SIDE = 32

# --- the coder ---------------------------------------------------------------

SCALE = 20  # frequencies add up to 1 << SCALE
_LOW = np.uint64(1 << 31)  # states stay in [_LOW, _LOW << 32)
_MAGIC = b"RAN1"
_HEAD = struct.Struct("<4s4I")


class Frequencies:
    """A frequency for every id in use, each at least 1, with sum 1 << SCALE."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(ids)
        self.ids, counts = ids[order].astype(np.int64), counts[order].astype(np.float64)
        whole = 1 << SCALE
        if len(ids) > whole // 2:
            raise ValueError(f"more than {whole // 2} different ids")
        share = np.maximum(1, np.floor(counts / max(counts.sum(), 1) * (whole - len(ids)))).astype(np.int64)
        if len(ids):
            share[np.argmax(share)] += whole - share.sum()
        top = int(self.ids.max()) + 1 if len(ids) else 1
        self.freq = np.zeros(top, np.uint64)
        self.start = np.zeros(top, np.uint64)
        self.freq[self.ids] = share
        self.start[self.ids] = np.cumsum(share) - share
        self.symbol = np.repeat(self.ids, share).astype(np.uint32)
        self.common = int(self.ids[np.argmax(share)]) if len(ids) else 0


def encode_blocks(blocks: list[np.ndarray], table: Frequencies) -> list[bytes]:
    """Code blocks of at most BLOCK ids each; blocks of equal length are coded side by side."""
    out: list[bytes] = [b""] * len(blocks)
    by_steps: dict[int, list[int]] = {}
    for k, ids in enumerate(blocks):
        by_steps.setdefault(-(-len(ids) // LANES), []).append(k)
    for steps, chosen in by_steps.items():
        for at in range(0, len(chosen), SIDE):
            part = chosen[at : at + SIDE]
            for k, coded in zip(part, _encode_side_by_side([blocks[k] for k in part], steps, table), strict=True):
                out[k] = coded
    return out


def _encode_side_by_side(blocks: list[np.ndarray], steps: int, table: Frequencies) -> list[bytes]:
    n = len(blocks)
    grid = np.full((n, steps * LANES), table.common, np.int64)
    for row, ids in zip(grid, blocks, strict=True):
        row[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(n, steps, LANES).transpose(1, 0, 2))
    words = np.zeros((steps, n, LANES), np.uint32)
    put = np.zeros((steps, n, LANES), bool)
    state = np.full((n, LANES), _LOW)
    states = []
    for t in range(steps - 1, -1, -1):
        f, c = table.freq[grid[t]], table.start[grid[t]]
        full = state >= f << np.uint64(63 - SCALE)
        words[t], put[t] = state, full
        state = np.where(full, state >> np.uint64(32), state)
        q = state // f
        state = (q << np.uint64(SCALE)) + (state - q * f) + c
        if t % STRIDE == 0:
            states.append(state)
    states = states[::-1]
    before = np.zeros((steps + 1, n), np.int64)
    np.cumsum(put.sum(2), axis=0, out=before[1:])
    out = []
    for k, ids in enumerate(blocks):
        own = words[:, k][put[:, k]]
        spots = before[0:steps:STRIDE, k].astype("<u4")
        body = b"".join(
            [
                _HEAD.pack(_MAGIC, len(ids), LANES, len(spots), len(own)),
                spots.tobytes(),
                b"".join(s[k].astype("<u8").tobytes() for s in states),
                own.astype("<u4").tobytes(),
                struct.pack("<I", zlib.crc32(ids.astype("<u4").tobytes())),
            ]
        )
        out.append(body + struct.pack("<I", zlib.crc32(body)))
    return out


def _parts(coded: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, int]:
    if len(coded) < _HEAD.size + 8 or zlib.crc32(memoryview(coded)[:-4]) != struct.unpack("<I", coded[-4:])[0]:
        raise ValueError("damaged block")
    magic, n, lanes, marks, n_words = _HEAD.unpack_from(coded)
    if magic != _MAGIC or lanes != LANES:
        raise ValueError("not a block of this format")
    at = _HEAD.size
    spots = np.frombuffer(coded, "<u4", marks, at)
    at += 4 * marks
    states = np.frombuffer(coded, "<u8", marks * LANES, at).reshape(marks, LANES)
    at += 8 * marks * LANES
    words = np.frombuffer(coded, "<u4", n_words, at)
    return n, spots, states, words, struct.unpack_from("<I", coded, at + 4 * n_words)[0]


def decode_stretches(stretches: list[tuple[np.ndarray, np.ndarray]], steps: int, table: Frequencies) -> np.ndarray:
    """Ids of stretches of ``steps`` steps, each given by its lanes' states and its words."""
    n = len(stretches)
    state = np.array([s for s, _ in stretches], np.uint64).reshape(n, LANES)
    sizes = np.array([len(w) for _, w in stretches], np.int64)
    words = np.concatenate([*(w for _, w in stretches), np.zeros(1, "<u4")]).astype(np.uint64)
    at = np.cumsum(sizes) - sizes
    out = np.zeros((n, steps, LANES), np.uint32)
    mask = np.uint64((1 << SCALE) - 1)
    for t in range(steps):
        slot = state & mask
        ids = table.symbol[slot]
        out[:, t] = ids
        state = table.freq[ids] * (state >> np.uint64(SCALE)) + slot - table.start[ids]
        short = state < _LOW
        rank = np.cumsum(short, axis=1)
        # A lane that is short takes the next word; another's index may be the last one's.
        index = np.minimum(at[:, None] + rank - 1, len(words) - 1)
        state = np.where(short, (state << np.uint64(32)) | words[index], state)
        at += rank[:, -1]
    return out.reshape(n, steps * LANES)


def decode_blocks(coded: list[bytes], table: Frequencies) -> list[np.ndarray]:
    """The ids of every block; all stretches between checkpoints are decoded side by side."""
    parts = [_parts(c) for c in coded]
    by_steps: dict[int, list[tuple[int, int]]] = {}
    for k, (n, spots, *_) in enumerate(parts):
        steps = -(-n // LANES)
        for mark in range(len(spots)):
            by_steps.setdefault(min(STRIDE, steps - mark * STRIDE), []).append((k, mark))
    pieces: dict[tuple[int, int], np.ndarray] = {}
    for steps, chosen in by_steps.items():
        for at in range(0, len(chosen), 4 * SIDE):
            some = chosen[at : at + 4 * SIDE]
            stretches = []
            for k, mark in some:
                _, spots, states, words, _ = parts[k]
                end = spots[mark + 1] if mark + 1 < len(spots) else len(words)
                stretches.append((states[mark], words[spots[mark] : end]))
            pieces |= dict(zip(some, decode_stretches(stretches, steps, table), strict=True))
    out = []
    for k, (n, spots, _, _, crc) in enumerate(parts):
        ids = np.concatenate([*(pieces[k, mark] for mark in range(len(spots))), np.zeros(0, np.uint32)])[:n]
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("ids do not match their checksum")
        out.append(ids.astype("<u4"))
    return out


# --- crc32 of joined pieces ----------------------------------------------------

_POLY = 0xEDB88320  # fixed value: the reflected polynomial of crc32


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo crc32's, bits reflected."""
    product = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            product ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return product


@lru_cache(maxsize=100_000)
def _shift(n_bytes: int) -> int:
    """x to the power of 8 * n_bytes."""
    power, square, n = 1 << 31, 1 << 23, n_bytes
    while n:
        if n & 1:
            power = _times(power, square)
        square = _times(square, square)
        n >>= 1
    return power


def joined_crc32(first: int, second: int, second_bytes: int) -> int:
    """The crc32 of two strings' concatenation, from their own."""
    return _times(_shift(second_bytes), first) ^ second


# --- the store -----------------------------------------------------------------


class WordEncoder:
    """Ids by a tokenizer of the tokenizers library, which is asked once per different word.

    Holds for tokenizers whose pre-tokens end at white space and that drop white space: a
    text's ids are then those of its words. Texts with control characters that only Python
    takes for white space, or that hold an added token in any case, go to the tokenizer whole. ``memory`` words are remembered.
    """

    def __init__(self, path: str, memory: int = 600_000) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        # Added tokens are looked for in the whole text, before it is folded.
        self._added = sorted({t.content.lower() for t in self.whole.get_added_tokens_decoder().values()})
        # A mark that every added token begins with, if there is one, is looked for first.
        starts = {t[:2] for t in self._added}
        self._start = starts.pop() if len(starts) == 1 and not any(c.isalpha() for c in min(starts)) else ""
        self.known = Recent(memory)
        self.marks: dict[str, bytes] = {}
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        # Whether a word of letters is one piece whose bytes the model gets as letters.
        sample = ["a", "the", "abcxyz", "qzjx", "é", "größe", "señor", "œuvre", "ł"]
        self._direct = False
        expected, self._direct = self._ids(sample), True
        try:
            self._direct = self._letters_ids(sample) == expected
        except Exception:  # the model has no such method, or not these letters
            self._direct = False

    # Marks that never join the letters before them to one pre-token.
    _MARKS = ".,!?;:%&$#*|"

    def _ids(self, words: list[str]) -> list[bytes]:
        encoded = self.whole.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in encoded]

    def _letters_ids(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case Latin words, from the tokenizer's model alone where that gives the same."""
        if not self._direct:
            return self._ids(words)
        tokens, of_bytes = self.whole.model.tokenize, _BYTE_LETTERS
        spelled = [w if w.isascii() else w.encode().decode("latin-1").translate(of_bytes) for w in words]
        return [array(self._code, [t.id for t in tokens(w)]).tobytes() for w in spelled]

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids of texts; null is empty. Different words are looked up once, unknown ones learned together."""
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        # Texts that Arrow folds and cuts like the tokenizer; the others are looked at one by one.
        special = pc.match_substring_regex(column, _CONTROLS.pattern)
        if self._added:
            special = pc.or_(special, pc.match_substring(column, self._start))
        special = pc.or_(special, pc.match_substring_regex(column, _BEYOND_LATIN))
        usual = column.filter(pc.invert(special))
        out: list[bytes] = [b""] * len(column)
        found = join_values(*listed(pc.utf8_split_whitespace(pc.utf8_lower(usual))), self._word_ids) if len(usual) else []
        special = special.to_numpy(zero_copy_only=False)
        for k, ids in zip(np.flatnonzero(~special).tolist(), found, strict=True):
            out[k] = ids
        if special.any():
            places, words, sizes = [], [], [0]
            for k in np.flatnonzero(special).tolist():
                text = column[k].as_py()
                if self._is_odd(text):
                    out[k] = self._ids([text])[0]
                else:
                    places.append(k)
                    own = self._folded(text).split()
                    words.append(pa.array(own, column.type))
                    sizes.append(len(own))
            if places:
                found = join_values(pa.concat_arrays(words), np.cumsum(sizes), self._word_ids)
                for k, ids in zip(places, found, strict=True):
                    out[k] = ids
        return out

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of different words; an empty one has none."""
        found = list(map(self.known.now.get, words))
        new = self._learn([w for w, ids in zip(words, found, strict=True) if ids is None])
        return [new[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]

    def _is_odd(self, text: str) -> bool:
        if _CONTROLS.search(text):
            return True
        if self._start not in text:
            return False
        lower = text.lower()
        return any(t in lower for t in self._added)

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words not known yet: those of the letters and those of the marks after them."""
        out, plain, marked, others, older = {}, [], [], [], self.known.before.get
        for word in words:
            ids = older(word)
            if ids is not None:
                out[word] = ids
            elif word.isalpha() and (word.isascii() or max(word) <= _LAST_LATIN):
                plain.append(word)
            else:
                letters = word.rstrip(self._MARKS)
                if letters.isalpha() and (letters.isascii() or max(letters) <= _LAST_LATIN):
                    marked.append((word, letters))
                else:
                    others.append(word)
        out.update(zip(plain, self._letters_ids(plain), strict=True))
        now = self.known.now.get
        bare = {letters: now(letters) or older(letters) for _, letters in marked if letters not in out}
        unknown = [letters for letters, ids in bare.items() if ids is None]
        out |= bare
        out.update(zip(unknown, self._letters_ids(unknown), strict=True))
        marks = self.marks
        for word, letters in marked:
            behind = word[len(letters) :]
            ids = marks.get(behind)
            if ids is None:
                if len(marks) >= 10_000:
                    marks.clear()
                ids = self._ids([behind])[0]
                if len(behind) < 100:
                    marks[behind] = ids
            out[word] = out[letters] + ids
        out.update(zip(others, self._ids(others), strict=True))
        self.known.put_all(out if max(map(len, out), default=0) < 100 else {w: b for w, b in out.items() if len(w) < 100})
        return out

    def _folded(self, text: str) -> str:
        """Lower case, so that more words are equal; the tokenizer does the same to each character.

        Texts with characters beyond Latin are folded by the tokenizer's own Unicode tables.
        """
        if text.isascii() or _LATIN.match(text):
            return text.lower()
        return self.whole.normalizer.normalize_str(text) if self.whole.normalizer else text


# A byte's letter where bytes are spelled as letters: printable ones are their own, the others follow from U+0100 on.
_BYTE_LETTERS = {}
for _byte in range(256):
    if not (33 <= _byte <= 126 or 161 <= _byte <= 172 or 174 <= _byte <= 255):
        _BYTE_LETTERS[_byte] = 256 + len(_BYTE_LETTERS)
_LAST_LATIN = "\u017f"
# Texts that are folded and cut together.
_CHARACTERS = 12_000_000

# Control characters that only Python takes for white space.
_CONTROLS = re.compile("[\x1c-\x1f\x85]")
# Letters here are composed already, and every version of Unicode lowers them alike but for the dotted capital I.
_BEYOND_LATIN = "[^\x00-\u012f\u0131-\u017f\u2010-\u201f\u2026\u20ac]"
_LATIN = re.compile("[\x00-\u012f\u0131-\u017f\u2010-\u201f\u2026\u20ac]*\\Z")


def _encoder(path: str) -> WordEncoder:
    return remembered(("token_store", path), lambda: WordEncoder(path))


def _write_ids(docs: DataFrame, tokenizer_path: str, end_id: int, key: str, text_col: str, path: str) -> None:
    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        end = np.array([end_id], encoder.dtype).tobytes()
        width = encoder.dtype.itemsize
        for batch in batches:
            found = [b + end for some in some_texts(batch.column(1), _CHARACTERS) for b in encoder.encode(some)]
            columns = [batch.column(0), pa.array([width] * len(found), pa.int32()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "width", "ids"])

    chosen = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text_col}`").alias("text"))
    chosen.mapInArrow(ids, "key long, width int, ids binary").write.parquet(path)


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1, np.int64)
    for batch in batches:
        # Many documents at once, as each count is an array as long as the vocabulary.
        for at in range(0, len(batch), 256):
            some = batch.slice(at, 256)
            by_width: dict[int, list[pa.Buffer]] = {}
            for width, ids in zip(some.column(0).to_pylist(), some.column(1), strict=True):
                by_width.setdefault(width, []).append(ids.as_buffer())
            for width, own in by_width.items():
                more = np.bincount(np.frombuffer(b"".join(own), f"<u{width}"))
                if len(more) > len(counts):
                    counts = np.pad(counts, (0, len(more) - len(counts)))
                counts[: len(more)] += more
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], ["id", "n"])


_BLOCK_SCHEMA = (
    "file int, block int, n long, coded binary,"
    " parts array<struct<row:long, piece:int, key:long, start:long, n_tokens:long, n:int>>"
)
_PART_TYPE = pa.list_(
    pa.struct([("row", pa.int64()), ("piece", pa.int32()), ("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("n", pa.int32())])
)


def _blocks_of(table: Frequencies):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number, row, start = TaskContext.get().partitionId(), 0, 0, 0
        held: list[np.ndarray] = []  # whole blocks
        open_ids: list[np.ndarray] = []
        parts: list[list[dict]] = [[]]
        room = BLOCK

        def flush(all_of_it: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, parts, open_ids, number, room
            if all_of_it and parts[-1]:
                held.append(np.concatenate(open_ids))
                open_ids, room = [], BLOCK
                parts.append([])
            if not held:
                return
            columns = [
                pa.array([file] * len(held), pa.int32()),
                pa.array(range(number, number + len(held)), pa.int32()),
                pa.array([len(b) for b in held], pa.int64()),
                pa.array(encode_blocks(held, table), pa.binary()),
                pa.array(parts[: len(held)], _PART_TYPE),
            ]
            number += len(held)
            parts = parts[len(held) :]
            held = []
            yield pa.RecordBatch.from_arrays(columns, ["file", "block", "n", "coded", "parts"])

        for batch in batches:
            for key, width, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = np.frombuffer(ids.as_buffer(), f"<u{width}")
                at = piece = 0
                while at < len(ids):
                    own = ids[at : at + room]
                    parts[-1].append({"row": row, "piece": piece, "key": key, "start": start, "n_tokens": len(ids), "n": len(own)})
                    open_ids.append(own)
                    room -= len(own)
                    at += len(own)
                    piece += 1
                    if not room:
                        held.append(np.concatenate(open_ids))
                        open_ids, room = [], BLOCK
                        parts.append([])
                        if len(held) == SIDE:
                            yield from flush(False)
                row += 1
                start += len(ids)
        yield from flush(True)

    return encode


def write_store(
    docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1, key: str = "doc_id", text_col: str = "text", file_bytes: int = 16 << 20
) -> None:
    """Tokenize texts, append ``end_id`` to each, and write the store in ascending key order.

    Null keys come first, equal keys in the order of their ids. Null and empty texts hold
    the end id alone. An empty table gives a store without blocks. ``file_bytes`` is about
    how many bytes of ids one file, and so one task, gets.
    """
    spark = docs.sparkSession
    _write_ids(docs, tokenizer_path, end_id, key, text_col, f"{path}/ids")
    ids = spark.read.schema("key long, width int, ids binary").parquet(f"{path}/ids")
    counts = ids.select("width", "ids").mapInArrow(_token_counts, "id long, n long")
    # One row per token id in use, at most the vocabulary.
    counts.groupBy("id").agg(F.sum("n").alias("n")).write.parquet(f"{path}/frequencies")
    encode = _blocks_of(read_frequencies(spark, path))
    files = max(spark.sparkContext.defaultParallelism, scan_bytes(ids) // file_bytes)
    ordered = ids.repartitionByRange(files, F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), "ids")
    ordered.mapInArrow(encode, _BLOCK_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")


def read_frequencies(spark: SparkSession, path: str) -> Frequencies:
    rows = spark.read.parquet(f"{path}/frequencies").toPandas()
    return Frequencies(rows["id"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))


_PIECES = "file int, row long, piece int, key long, start long, n_tokens long, n int, crc long"


def read_documents(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Per document of a store: key, start (ids of all documents before it), n_tokens, ids_crc32.

    Blocks are decoded by many tasks in any order. Only the checksums of documents that
    reach over several blocks are brought together.
    """
    table = read_frequencies(spark, path)
    blocks = spark.read.schema(_BLOCK_SCHEMA).parquet(f"{path}/blocks")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, parts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for at in range(0, len(files), SIDE):
                rows = []
                coded = [b.as_py() for b in batch.column(1).slice(at, SIDE)]
                for file, ids, own in zip(files[at : at + SIDE], decode_blocks(coded, table), parts[at : at + SIDE], strict=True):
                    ids, where = memoryview(ids.tobytes()), 0
                    for part in own:
                        end = where + 4 * part["n"]
                        rows.append(part | {"file": file, "crc": zlib.crc32(ids[where:end])})
                        where = end
                yield pa.RecordBatch.from_pylist(rows, _PIECES_TYPE)

    pieces = blocks.select("file", "coded", "parts").mapInArrow(decode, _PIECES)
    ids_before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file.
    files = blocks.groupBy("file").agg(F.sum("n").alias("in_file"))
    files = files.select(F.col("file").alias("of"), F.coalesce(F.sum("in_file").over(ids_before), F.lit(0)).alias("before"))

    @F.arrow_udf("long")
    def join_crcs(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in column:
            out = []
            for own in batch.to_pylist():
                crc = 0
                for piece in own:
                    crc = joined_crc32(crc, piece["crc"], 4 * piece["n"])
                out.append(crc)
            yield pa.array(out, pa.int64())

    columns = ["file", "key", "start", "n_tokens"]
    whole = pieces.filter("n = n_tokens").select(*columns, F.col("crc").alias("ids_crc32"))
    broken = pieces.filter("n < n_tokens").groupBy("file", "row", "key", "start", "n_tokens")
    broken = broken.agg(F.sort_array(F.collect_list(F.struct("piece", "n", "crc"))).alias("own"))
    joined = whole.unionByName(broken.select(*columns, join_crcs("own").alias("ids_crc32")))
    joined = joined.join(F.broadcast(files), F.col("file") == F.col("of"))
    return joined.select(F.col("key").alias(key), (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


_PIECES_TYPE = pa.schema(
    [("file", pa.int32()), ("row", pa.int64()), ("piece", pa.int32()), ("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("n", pa.int32()), ("crc", pa.int64())]
)
