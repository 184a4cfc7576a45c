"""Memory of Python workers: what a task let go returns to the machine, as workers live on beside a full JVM heap."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa


@cache
def _trim() -> Callable[[], object]:
    try:
        libc = ctypes.CDLL("libc.so.6")
        return lambda: libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return lambda: None


def release() -> None:
    """Give unused memory of Arrow's pool and of the C heap back."""
    pa.default_memory_pool().release_unused()
    _trim()()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], each: bool = False):
    """``run``, a function for ``mapInArrow``, with a release at its end; with ``each`` after every batch too, which
    costs time (memory is touched anew) and spares a worker what its batches leave in the C heap."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for out in run(batches):
                yield out
                if each:
                    release()
        finally:
            release()

    return inner
