"""UDF7. Models that a Python worker loads once and shares among its tasks, counted by their users."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

_models: dict[str, list] = {}
_lock = threading.RLock()


@contextmanager
def shared(name: str, load: Callable[[], Any], *, keep: bool = True) -> Iterator[Any]:
    """The model of that name, loaded by its first user in this process; used by one thread at a time. Without keep, it
    goes with its last user. A pandas UDF over an iterator of batches holds it for its partition."""
    with _lock:
        if name not in _models:
            _models[name] = [load(), 0, threading.RLock()]
        entry = _models[name]
        entry[1] += 1
    try:
        with entry[2]:
            yield entry[0]
    finally:
        with _lock:
            entry[1] -= 1
            if not keep and not entry[1]:
                _models.pop(name, None)


def users(name: str) -> int:
    with _lock:
        return _models[name][1] if name in _models else 0


def release(name: str | None = None) -> None:
    """Forgets the model, or all, that nobody uses."""
    with _lock:
        for n in [name] if name else list(_models):
            if n in _models and not _models[n][1]:
                del _models[n]
