"""What a Python worker remembers between tasks, held by one operator at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_held: dict[Hashable, Any] = {}


def tidy() -> None:
    """Give memory that was freed back to the machine, where the allocators keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def forget() -> None:
    """Drop what is held; for operators that hold nothing themselves."""
    if _held:
        _held.clear()
        tidy()


def remembered(name: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` made under this name in this worker; whatever else was held is dropped first.

    Workers outlive tasks and jobs, so without this each stage would add to what those before it left.
    """
    found = _held.get(name)
    if found is None:
        forget()
        found = _held[name] = make()
    return found


class Recent:
    """A dictionary of bounded size: when full, what was not asked for since the last time goes.

    ``now`` may be read directly; ``get`` also finds entries of the generation before.
    """

    def __init__(self, entries: int) -> None:
        self.room = max(entries // 2, 1)
        self.now: dict = {}
        self.before: dict = {}

    def get(self, key):
        found = self.now.get(key)
        if found is None and (found := self.before.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.now) >= self.room:
            # Emptied in place, as others may hold ``now`` itself.
            self.before = dict(self.now)
            self.now.clear()
        self.now[key] = value

    def put_all(self, new: dict) -> None:
        if len(self.now) + len(new) > self.room:
            self.before = dict(self.now)
            self.now.clear()
        # More than there is room for would stay a generation too long.
        self.now.update(new if len(new) <= self.room else list(new.items())[-self.room :])

    def __len__(self) -> int:
        return len(self.now) + len(self.before)
