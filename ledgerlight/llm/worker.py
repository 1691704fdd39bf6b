"""Memory of Python workers, which Spark reuses from one operator to the next.

Tables an operator remembers between tasks live in :func:`table`; they go when a task of another
operator begins. Every task also returns what the allocators hold without using it.
"""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa

_TABLES: dict[str, dict] = {}


def table(operator: str) -> dict:
    """The remembered table of an operator in this worker."""
    return _TABLES.setdefault(operator, {})


def enter(operator: str) -> None:
    """Begin a task of ``operator``: forget other operators' tables and return unused memory."""
    others = [t for name, t in _TABLES.items() if name != operator and t]
    for t in others:
        t.clear()
    if others:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
