"""Text to vector.

An embedder is any callable that takes a list of texts and returns one vector per
text, as a 2-D array or a list whose failed entries are None. It is created by a
factory that runs once per Python worker, so a model is loaded once, and Spark
batches and distributes the calls. The name identifies the model: in the worker's
memory as in the vector cache.

The default, ``hashed_words``, is a lexical stand-in that needs no model files:
words are hashed into ``dim`` buckets and the counts scaled to length one. It does
not capture meaning; plug a model in for that.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_DIM = 64


@dataclass(frozen=True)
class Embedder:
    """A named model: ``load`` returns the callable that embeds a list of texts."""

    name: str
    load: Callable[[], Callable[[list[str]], Sequence]]

    def column(self, text: Column) -> Column:
        """``array<float>`` column; null where the text is null or the model failed.

        Marked nondeterministic so that the optimizer never runs the model a second
        time to evaluate a filter on its result. Filter rows before embedding them.
        """
        name, load = self.name, self.load

        @F.arrow_udf("array<float>")
        def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = _loaded(name, load)
            for texts in batches:
                yield _embed_batch(model, texts.to_pylist())

        return embed.asNondeterministic()(text)

    def one(self, text: str) -> list[float] | None:
        """Vector of a single query text, as 32-bit values, or None when it failed."""
        return _embed_batch(self.load(), [text]).to_pylist()[0]


_models: dict = {}


def _loaded(name: str, load):
    """The model of this Python process; workers serve many tasks."""
    if name not in _models:
        _models[name] = load()
    return _models[name]


def _embed_batch(model, texts: list[str | None]) -> pa.Array:
    present = [i for i, text in enumerate(texts) if text is not None]
    wanted = [texts[i] for i in present]
    try:
        vectors = model(wanted) if wanted else []
    except Exception:
        vectors = [_or_none(model, text) for text in wanted]
    if len(present) == len(texts) and isinstance(vectors, np.ndarray) and vectors.ndim == 2:
        rows, dim = vectors.shape
        flat = pa.array(np.ascontiguousarray(vectors, dtype=np.float32).ravel())
        return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * dim), flat)
    out: list = [None] * len(texts)
    for i, vector in zip(present, vectors):
        out[i] = None if vector is None else np.asarray(vector, dtype=np.float32)
    return pa.array(out, pa.list_(pa.float32()))


def _or_none(model, text: str):
    try:
        return model([text])[0]
    except Exception:
        return None


class _Buckets(dict):
    """The bucket of each word seen, in bounded memory."""

    def __init__(self, dim: int) -> None:
        self.dim = dim

    def __missing__(self, token: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        slot = self[token] = int(hashlib.md5(token).hexdigest()[:8], 16) % self.dim
        return slot


_WORD_BYTES = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))

# Words of texts that are counted together.
_SLOTS = 1 << 18


def hashed_words(dim: int = DEFAULT_DIM) -> Embedder:
    """Hashed bag of words: lower-cased runs of a-z and 0-9, bucket from MD5."""

    def load():
        bucket = _Buckets(dim).__getitem__

        def counted(slots: array, sizes: list[int]) -> np.ndarray:
            rows = np.repeat(np.arange(len(sizes)) * dim, sizes)
            return np.bincount(rows + np.frombuffer(slots, np.uint32), minlength=len(sizes) * dim).reshape(-1, dim)

        def embed(texts: list[str]) -> np.ndarray:
            counts, done = np.zeros((len(texts), dim)), 0
            slots, sizes = array("I"), []
            for text in texts:
                before = len(slots)
                # All but a-z and 0-9 becomes white space, which splits faster than a pattern finds.
                slots.extend(map(bucket, text.lower().encode("ascii", "replace").translate(_WORD_BYTES).split()))
                sizes.append(len(slots) - before)
                if len(slots) >= _SLOTS:
                    counts[done : done + len(sizes)] = counted(slots, sizes)
                    done += len(sizes)
                    slots, sizes = array("I"), []
            if slots:
                counts[done:] = counted(slots, sizes)
            lengths = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            return counts / np.where(lengths == 0, 1.0, lengths)

        return embed

    return Embedder(f"hashed-words-{dim}", load)
