"""Memory of Python workers, which stay from stage to stage beside the JVM."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Return freed memory to the system: of Arrow's pool, and of the C library where it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def gives_back(f: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """f for mapInArrow; what it frees is returned after each batch it takes and at its end, else an idle worker holds it while other stages need the room."""

    @wraps(f)
    def run(batches: Batches) -> Batches:
        def taken() -> Batches:
            for b in batches:
                yield b
                del b
                give_back()

        yield from f(taken())
        give_back()

    return run
