"""What reused Python workers keep from task to task, so that one operator does not hold another's memory."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

_current = ""
_drops: list[Callable[[], None]] = []


def on_change(drop: Callable[[], None]) -> None:
    """Have ``drop`` called in a worker before the tasks of another operator begin there."""
    _drops.append(drop)


def begin(operator: str) -> None:
    """Called first in a task: where the worker last served another operator, its caches are given back."""
    global _current
    if operator == _current:
        return
    if _current:
        for drop in _drops:
            drop()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
    _current = operator
