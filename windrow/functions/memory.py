"""Memory of Python workers, which live on from task to task."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def _trimmer():
    """The C library's call that gives freed memory back, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


_trim = _trimmer()


def give_back() -> None:
    """Return memory that is not in use; a worker keeps its high-water mark else."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)
