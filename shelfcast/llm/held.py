"""The model that a Python worker holds from one task to the next: the last one that a task asked for."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

from shelfcast.llm import hashing

_held: dict[Hashable, Any] = {}


def model(key: Hashable, make: Callable[[], Any]) -> Any:
    """The model of this key, made where the worker does not hold it. Any other is let go."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """For tasks that need no model: what an earlier stage left would add to their own memory."""
    if _held:
        _held.clear()
        hashing.trim()
