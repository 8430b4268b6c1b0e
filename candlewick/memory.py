"""Memory of Python workers."""

from __future__ import annotations


def give_back() -> None:
    """Memory that isn't in use goes back to the machine."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
