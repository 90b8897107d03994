"""What a Python worker keeps from task to task."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable


def kept(key: tuple, make: Callable, limit: int = 8):
    """``make()``, made once in each worker process; the oldest of over ``limit`` are dropped.

    Functions reach a worker anew with every task, and so do their globals; a module of its
    own stays.
    """
    home = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker"))
    store = home.__dict__.setdefault("store", {})
    if key not in store:
        while len(store) >= limit:
            del store[next(iter(store))]
        store[key] = make()
    return store[key]
