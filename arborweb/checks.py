"""Pre- and postconditions that cost nothing unless ``ARBORWEB_CHECKS`` is set when a module loads."""

from __future__ import annotations

import inspect
import os
from collections.abc import Callable
from functools import wraps


def enabled() -> bool:
    return bool(os.environ.get("ARBORWEB_CHECKS"))


def _asked(test: Callable, values: dict) -> bool:
    return bool(test(**{k: values[k] for k in inspect.signature(test).parameters}))


def require(test: Callable[..., bool], what: str) -> Callable:
    """The decorated function's arguments, by name, must pass ``test``."""

    def mark(fn: Callable) -> Callable:
        if not enabled():
            return fn

        @wraps(fn)
        def checked(*args: object, **kwargs: object) -> object:
            given = inspect.signature(fn).bind(*args, **kwargs)
            given.apply_defaults()
            if not _asked(test, given.arguments):
                raise AssertionError(f"precondition of {fn.__name__}: {what}")
            return fn(*args, **kwargs)

        return checked

    return mark


def ensure(test: Callable[..., bool], what: str) -> Callable:
    """The function's ``result``, and its arguments by name, must pass ``test``."""

    def mark(fn: Callable) -> Callable:
        if not enabled():
            return fn

        @wraps(fn)
        def checked(*args: object, **kwargs: object) -> object:
            result = fn(*args, **kwargs)
            given = inspect.signature(fn).bind(*args, **kwargs)
            given.apply_defaults()
            if not _asked(test, {**given.arguments, "result": result}):
                raise AssertionError(f"postcondition of {fn.__name__}: {what}")
            return result

        return checked

    return mark
