"""Memory of Spark's Python workers.

An executor keeps its workers from stage to stage, as many as ever ran at once, and deals tasks to
them in turn; what a worker holds, in use or not, it holds beside whatever runs next.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa

ROWS = 250  # rows handed on at once


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    """The C library's ``malloc_trim``; other libraries than glibc's have none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return lambda pad: 0


def give_back() -> None:
    """Memory that is free, but still held by Arrow's pool or the C library, goes back to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], rows: int = ROWS):
    """``run`` (for ``mapInArrow``) over all its rows, at most ``rows`` of them a batch; free memory is given back before, between and after Spark's batches."""
    def parts(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                yield whole.slice(start, rows)
            del whole
            give_back()

    def steps(batches):
        give_back()
        yield from run(parts(batches))
        give_back()
    return steps
