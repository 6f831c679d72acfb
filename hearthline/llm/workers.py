"""Memory of Python workers, which Spark keeps for the tasks of later stages."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator
from typing import TypeVar

import pyarrow as pa

X = TypeVar("X")


def release() -> None:
    """Give freed memory back to the system, so that a worker that is used again does not
    keep the peak of the stage before on top of its own.  Arrow's memory is in a pool beside the C library's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def released(parts: Iterable[X]) -> Iterator[X]:
    """The parts, with ``release`` before the first, for what a worker's last task has left, and after them."""
    release()
    try:
        yield from parts
    finally:
        release()
