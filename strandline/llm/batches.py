"""Arrow batches in bounded pieces."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa

ROWS = 512  # of which Python objects exist at a time
#: How to forget what operators keep in a worker from one task to the next.
KEPT: dict[str, Callable[[], None]] = {}


def small(batches: Iterator[pa.RecordBatch], rows: int = ROWS, keeps: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in slices, without copying.  Unused memory goes back to the
    system at the end, since the worker lives on for other operators; what others than
    ``keeps`` have kept in it is forgotten at the start."""
    others = [name for name in KEPT if name != keeps]
    for name in others:
        KEPT.pop(name)()
    if others:
        gc.collect()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def refuse_clash(keep: Sequence[str], schema: str) -> None:
    """An error if a kept column has the name of one that is added (names as Spark
    compares them, without case)."""
    added = {part.split()[0].lower() for part in schema.split(",")}
    clash = sorted(name for name in keep if name.lower() in added)
    if clash:
        raise ValueError(f"columns to keep have names of results: {', '.join(clash)}")


def give_back() -> None:
    """Unused memory of a worker back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library keeps it
