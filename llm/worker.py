"""State that a Python worker keeps between tasks, of one operator at a time.

Workers are reused, and one that served a pipeline would otherwise hold what every stage left.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

_STATE: dict[str, object] = {}


def trim() -> None:
    """Gives freed memory back to the system, Arrow's too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass  # another C library: the memory stays with the process


def release() -> None:
    """Frees what another operator kept."""
    if _STATE:
        _STATE.clear()
        trim()


def keep(name: str, make: Callable[[], object]) -> object:
    """The state of this name, made if the worker does not have it; all else is freed."""
    if name not in _STATE:
        release()
        _STATE[name] = make()
    return _STATE[name]


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that leaves no freed memory with the worker when its task ends."""

    def own(batches: Iterator) -> Iterator:
        release()
        try:
            yield from run(batches)
        finally:
            trim()

    return own
