"""Values that a Python worker keeps from one task to the next."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable

import pyarrow as pa

_HOME = "_rewardframe_kept"


def kept(key: Hashable, make: Callable[[], object]) -> object:
    """The value of ``key`` in this Python worker, made at its first use.

    This package travels by value, so its own modules are new in every task; the values hang on a
    module of the worker instead.  They must not depend on the data of a task.
    """
    home = sys.modules.setdefault(_HOME, types.ModuleType(_HOME))
    values = home.__dict__.setdefault("values", {})
    if key not in values:
        values[key] = make()
    return values[key]


def forget() -> None:
    """Drops all kept values, for tasks that need the memory themselves."""
    home = sys.modules.pop(_HOME, None)
    if home is not None:
        home.__dict__.clear()
        pa.default_memory_pool().release_unused()
