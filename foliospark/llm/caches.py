"""Caches of Python workers, which outlive their task: those of other operators go when one begins."""

from __future__ import annotations

from collections.abc import Callable

_CLEAR: dict[str, Callable[[], None]] = {}


def register(owner: str, clear: Callable[[], None]) -> None:
    _CLEAR[owner] = clear


def only(owner: str | None = None) -> None:
    """Clear the caches of all but one operator in this worker."""
    for name, clear in _CLEAR.items():
        if name != owner:
            clear()
