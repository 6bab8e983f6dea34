"""What the functions that run in Python workers share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle

STATE = "crossweave_worker_state"


def by_value(module: str) -> None:
    """Ship a module's functions with their jobs, so that workers need not have it installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def kept(name: str, key: Any, make: Callable[[], Any]) -> Any:
    """An object that a worker process builds once and keeps for its later tasks.

    One object is kept per ``name``; another ``key`` replaces it.
    """
    state = sys.modules.setdefault(STATE, types.ModuleType(STATE)).__dict__
    held = state.get(name)
    if held is None or held[0] != key:
        held = state[name] = (key, make())
    return held[1]


@contextlib.contextmanager
def uncollected() -> Iterator[None]:
    """No garbage collection inside, for code that makes many objects to keep and lets go of none in circles:
    each collection would look at all of them again."""
    before = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if before:
            gc.enable()


def trim() -> None:
    """Give memory that a task has freed back to the system, for the stages that come after it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def columns_named(df, *names: str) -> None:
    """Fail early, with a clear message, if an input column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {', '.join(missing)}; there are {', '.join(df.columns)}")
