"""Memory of Python workers, which serve one operator after the other."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa


def give_back() -> None:
    """Returns freed memory of this worker to the system, of which both allocators would keep much between blocks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)
