"""Caches of a Python worker: workers are used again by later operators, and only the one at work keeps its cache.

What the others held goes back to the system, freed memory of the allocators included: an executor's workers count against its memory.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_at_work: dict[str, Callable[[], None]] = {}


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def use(name: str, clear: Callable[[], None]) -> None:
    """Say that `name` is at work; what others hold is let go."""
    if name not in _at_work:
        for other in _at_work.values():
            other()
        _at_work.clear()
        _at_work[name] = clear
        _give_back()


class Hashes(dict):
    """Word to 64-bit hash; emptied when its entries, about 200 bytes each besides their words, come to `most_bytes`."""

    def __init__(self, most_bytes: int = 16 << 20):
        super().__init__()
        self.most_bytes, self.held = most_bytes, 0

    def __missing__(self, word: str | bytes) -> int:
        import xxhash

        self.held += 200 + len(word)
        if self.held > self.most_bytes:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def clear(self) -> None:
        super().clear()
        self.held = 0
