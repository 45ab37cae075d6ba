"""Wrappers for Python functions that are used in UDFs."""

from __future__ import annotations

import functools
import importlib
import inspect
import math
import os
import pkgutil
import re
import socket
import warnings
from collections.abc import Callable
from typing import Any


def skipna(f: Callable) -> Callable:
    """A missing argument gives null without a call."""

    @functools.wraps(f)
    def inner(x: Any, *args: Any, **kwargs: Any) -> Any:
        return None if x is None or isinstance(x, float) and math.isnan(x) else f(x, *args, **kwargs)

    return inner


def skiperror(f: Callable, return_x: bool = False, return_val: Any = None) -> Callable:
    """A call that fails gives its argument or a fixed value."""

    @functools.wraps(f)
    def inner(x: Any, *args: Any, **kwargs: Any) -> Any:
        try:
            return f(x, *args, **kwargs)
        except Exception:
            return x if return_x else return_val

    return inner


def deprecated_alias(**aliases: str) -> Callable:
    """Old names of keywords, with a warning."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def inner(*args: Any, **kwargs: Any) -> Any:
            for old, new in aliases.items():
                if old in kwargs:
                    if new in kwargs:
                        raise TypeError(f"{f.__name__} got {old} and {new}")
                    warnings.warn(f"{old} is now {new}", DeprecationWarning, stacklevel=2)
                    kwargs[new] = kwargs.pop(old)
            return f(*args, **kwargs)

        return inner

    return wrap


def deprecated_kwargs(*names: str, message: str = "{func_name} no longer takes {argument}", error: bool = True) -> Callable:
    """Keywords that are gone: an error or a warning."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def inner(*args: Any, **kwargs: Any) -> Any:
            for n in names:
                if n in kwargs:
                    text = message.format(func_name=f.__name__, argument=n)
                    if error:
                        raise ValueError(text)
                    warnings.warn(text, DeprecationWarning, stacklevel=2)
            return f(*args, **kwargs)

        return inner

    return wrap


def idempotent(func: Callable, df: Any, *args: Any, **kwargs: Any) -> None:
    """``AssertionError`` unless a second application changes nothing."""
    once = func(df, *args, **kwargs)
    twice = func(once, *args, **kwargs)
    if once.columns != twice.columns or not once.exceptAll(twice).isEmpty() or not twice.exceptAll(once).isEmpty():
        raise AssertionError(f"{func.__name__} is not idempotent")


def refactored_function(message: str, category: type[Warning] = FutureWarning) -> Callable:
    """A warning at each call."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def inner(*args: Any, **kwargs: Any) -> Any:
            warnings.warn(message, category, stacklevel=find_stack_level())
            return f(*args, **kwargs)

        return inner

    return wrap


def rename_kwargs(func_name: str, kwargs: dict[str, Any], aliases: dict[str, str]) -> None:
    """Old keywords in ``kwargs`` become new ones, with a warning; both at once are an error."""
    for old in kwargs.keys() & aliases.keys():
        if aliases[old] in kwargs:
            raise TypeError(f"{func_name} got {old} and {aliases[old]}")
        warnings.warn(f"{old} is now {aliases[old]}", DeprecationWarning, stacklevel=find_stack_level())
        kwargs[aliases[old]] = kwargs.pop(old)


def import_message(submodule: str, package: str, conda_channel: str | None = None, pip_install: bool = False) -> str:
    """How a missing package can be had; printed, and given back."""
    ways = [f"conda install -c {conda_channel} {package}"] if conda_channel else []
    ways += [f"pip install {package}"] if pip_install else []
    text = f"{submodule} needs {package}, which is not there" + (": " + " or ".join(ways) if ways else "; it can't be installed by conda or pip here")
    print(text)
    return text


def find_stack_level() -> int:
    """How far up the first frame outside this package is, for warnings."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    frame, n = inspect.currentframe(), 0
    while frame is not None and os.path.abspath(frame.f_code.co_filename).startswith(here):
        frame, n = frame.f_back, n + 1
    return max(n, 1)


def dynamic_import(package: str) -> list[str]:
    """Imports every module of a package; gives their names."""
    top = importlib.import_module(package)
    names = [m.name for m in pkgutil.iter_modules(top.__path__, package + ".")]
    for n in names:
        importlib.import_module(n)
    return names


def is_connected(url: str, port: int = 80, timeout: float = 2.0) -> bool:
    """Whether a host answers."""
    host = re.sub(r"^[a-z]+://|/.*$", "", url)
    try:
        with socket.create_connection((host, port), timeout):
            return True
    except OSError:
        return False


def patterns(regex_pattern: str | re.Pattern) -> re.Pattern:
    """A compiled expression; old name of re.compile."""
    warnings.warn("patterns is old: use re.compile", DeprecationWarning, stacklevel=2)
    if not isinstance(regex_pattern, (str, re.Pattern)):
        raise TypeError(f"a pattern is text or compiled, not {type(regex_pattern).__name__}")
    return re.compile(regex_pattern)
