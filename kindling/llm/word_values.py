"""Texts as the joined values of their words, with every different word looked at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def some_texts(column: pa.Array, characters: int) -> Iterator[pa.Array]:
    """Slices of at least ``characters``, or what is left."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = before = 0
    while at < len(column):
        stop = min(int(np.searchsorted(ends, before + characters)) + 1, len(column))
        yield column.slice(at, stop - at)
        at, before = stop, int(ends[stop - 1])


def join_values(words: pa.Array, offsets: np.ndarray, values: Callable[[list[str]], list[bytes]], skip: int = 0) -> list[bytes]:
    """Per text, the values of its words joined; the first ``skip`` words of each are left out.

    Text k has the words from ``offsets[k]`` to before ``offsets[k + 1]``. ``values`` gets
    different words and gives one value for each.
    """
    coded = words.dictionary_encode()
    # Offsets of 64 bits, as the values of one text may take more room than its words.
    joined = pa.array(values(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
    if not len(joined):
        return [b""] * (len(offsets) - 1)
    _, places, data = joined.buffers()
    places, data = np.frombuffer(places, np.int64), memoryview(data or b"")
    starts, stops = places[np.minimum(offsets[:-1] + skip, offsets[1:])].tolist(), places[offsets[1:]].tolist()
    return [bytes(data[a:b]) for a, b in zip(starts, stops, strict=True)]


def listed(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of a column of lists without nulls, and where each list's begin."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten(), offsets - offsets[0]
