"""Python workers are used again by other tasks and operators, so a task gives back what it freed, and first
what another operator still holds there."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

#: What this worker holds for later tasks of an operator, by its name: how to give it back.
_held: dict[str, Callable[[], None]] = {}


def release() -> None:
    """Free memory that the allocators hold goes back to the system (glibc's too, where it is used)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def hold(operator: str, give_back: Callable[[], None]) -> None:
    """Something stays in this worker for the operator's next task, until another operator's task begins."""
    _held[operator] = give_back


def begin(operator: str | None) -> None:
    """A task begins: what other operators hold in this worker is given back."""
    others = [name for name in _held if name != operator]
    for name in others:
        _held.pop(name)()
    if others:
        release()


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], operator: str | None = None):
    """A mapInArrow function that ends with `release`; operator: the name under which it holds something."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(operator)
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
