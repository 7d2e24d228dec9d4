"""The base's shared tables and shipping, and the memory of workers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

from terrasample.sources import shared

#: Rows of an Arrow batch in the eager passes over texts: some megabytes for usual texts.
TEXT_ROWS = 1000

shared_folder, cut, discard, ship = shared.shared_folder, shared.cut, shared.discard, shared.ship


def give_back() -> None:
    """Return a worker's freed memory to the system: workers are reused, and what one task held would stay with them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with the worker's memory given back when its task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
