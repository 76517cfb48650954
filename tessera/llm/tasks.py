"""What the Python tasks of this package do beside their work: they give memory back when they end.

Spark reuses a Python worker for one stage after the other, and what a stage leaves there (Arrow's pool, freed
numpy arrays that the allocator keeps, tables for hashing, a vocabulary) would pile up under the next one."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

#: What workers keep between tasks of one kind, by the kind's name.
caches: dict[str, dict] = {}


def begin(keeps: str | None) -> None:
    """Drops what tasks of another kind left."""
    for name, cache in caches.items():
        if name != keeps:
            cache.clear()


def give_back() -> None:
    caches.get("powers", {}).clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def lean(run: Callable, keeps: str | None = None) -> Callable:
    """``run`` for mapInArrow, giving memory back at its end. ``keeps`` names the cache that its next task uses again."""

    def task(batches):
        begin(keeps)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
