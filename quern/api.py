"""All operators in one place, and their registration as DataFrame methods."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame

from .core import DropLabel, check, check_column, is_boolean, is_datetime, is_float, is_integer, is_numeric, is_string, resolve
from .functions.guards import deprecated_alias, deprecated_kwargs, dynamic_import, find_stack_level, idempotent, import_message, is_connected, patterns, refactored_function, rename_kwargs, skiperror, skipna
from .functions.mathx import ecdf, exp, log, logit, normal_cdf, probit, sigmoid, softmax, z_score
from .functions.text import process_text
from .operators import domain, filters, joins, reshape, scalar, select, stats
from .operators.stats import DataDescription
from .sources.files import join_fasta, read_commandline, read_csvs, read_fasta, xlsx_cells, xlsx_table

OPERATORS: dict[str, Callable] = {"process_text": process_text, "join_fasta": join_fasta}
for _m in (select, filters, joins, scalar, stats, reshape, domain):
    OPERATORS |= {n: f for n, f in vars(_m).items() if callable(f) and not isinstance(f, type) and not n.startswith("_") and getattr(f, "__module__", "") == _m.__name__}
globals().update(OPERATORS)


def register_dataframe_method(method: Callable) -> Callable:
    """Makes a function of a table a method of DataFrame; names that DataFrame has already are refused."""
    name = method.__name__
    there = getattr(DataFrame, name, None)
    if there is not None and getattr(there, "__wrapped__", None) is not method:
        raise ValueError(f"DataFrame has {name} already")

    @functools.wraps(method)
    def bound(self: DataFrame, *args, **kwargs):
        return method(self, *args, **kwargs)

    setattr(DataFrame, name, bound)
    return method


def register_all() -> list[str]:
    """Registers every operator whose name is free; gives those names."""
    done = []
    for name, f in OPERATORS.items():
        try:
            register_dataframe_method(f)
            done.append(name)
        except ValueError:
            continue
    return done


__all__ = [*OPERATORS, "DataDescription", "DropLabel", "check", "check_column", "deprecated_alias", "deprecated_kwargs", "dynamic_import", "ecdf", "exp", "find_stack_level", "idempotent", "import_message", "is_connected", "patterns", "refactored_function", "rename_kwargs", "is_boolean", "is_datetime", "is_float", "is_integer", "is_numeric", "is_string", "log", "logit", "normal_cdf", "probit", "read_commandline", "read_csvs", "read_fasta", "register_all", "register_dataframe_method", "resolve", "sigmoid", "skiperror", "skipna", "softmax", "xlsx_cells", "xlsx_table", "z_score"]
