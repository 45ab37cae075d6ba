"""What all operators share: checks, missing values, row order, category metadata, column selectors.

Missing is one notion: null, and NaN in float and double columns. Operators that depend on the order
of rows take ``order_by`` (a column or list of columns, best a unique key); without it they use the
order in which Spark scans the rows.
"""

from __future__ import annotations

import atexit
import fnmatch
import re
import shutil
import tempfile
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FLOATS = (T.FloatType, T.DoubleType)
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def check(name: str, value: Any, kinds: Iterable[type]) -> None:
    """``TypeError`` unless ``value`` is of one of ``kinds`` (``callable`` counts as one)."""
    kinds = list(kinds)
    if not any(callable(value) if k is callable else isinstance(value, k) for k in kinds):
        raise TypeError(f"{name} must be one of {[getattr(k, '__name__', str(k)) for k in kinds]}, not {type(value).__name__}")


def check_column(df: DataFrame, names: Iterable[str] | str, present: bool = True) -> None:
    """``ValueError`` if a column is absent (or, with ``present=False``, there already)."""
    for n in [names] if isinstance(names, str) else names:
        if (n in df.columns) != present:
            raise ValueError(f"column {n!r} {'is not' if present else 'is already'} in the table")


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def kind(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def missing(df: DataFrame, name: str) -> Column:
    c = col(name)
    return c.isNull() | F.isnan(c) if isinstance(kind(df, name), FLOATS) else c.isNull()


def known(df: DataFrame, name: str) -> Column:
    """The column with NaN as null."""
    c = col(name)
    return F.when(~F.isnan(c), c) if isinstance(kind(df, name), FLOATS) else c


def listed(x: Any) -> list:
    return [] if x is None else [x] if isinstance(x, (str, Column)) else list(x)


def order_keys(order_by: str | Column | list | None) -> list[Column]:
    keys = [col(k) if isinstance(k, str) else k for k in listed(order_by)]
    return keys or [F.monotonically_increasing_id()]


def free(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that none of ``df``'s columns has."""
    taken, out = {c.lower() for c in df.columns}, []
    for w in wanted:
        while w.lower() in taken:
            w = "_" + w
        taken.add(w.lower())
        out.append(w)
    return out


def no_stream(df: DataFrame, what: str) -> None:
    if df.isStreaming:
        raise ValueError(f"{what} needs all rows and is not supported on a streaming table")


_own: list[str] = []


def stable(df: DataFrame) -> DataFrame:
    """``df`` computed once, into the folder of ``spark.checkpoint.dir`` that all executors share, so that later branches of a plan see the same rows, row numbers and partitions.

    Where the setting is unset, a local master gets a folder of its own; a cluster is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="quern-checkpoint-")
            _own.append(named)
            atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    return df.checkpoint()


def numbered(df: DataFrame, name: str, keys: list[Column] | None = None) -> DataFrame:
    """``df`` with each row's place, from 0, in the order of ``keys`` (as scanned without any).

    Rows are sorted by ranges; each range's number of rows gives the place where the next begins, so no task sees them all.
    """
    m, p, o = free(df, "m_", "p_", "o_")
    s = stable((df.orderBy(*keys) if keys else df).withColumn(m, F.monotonically_increasing_id()))
    counts = s.groupBy(F.shiftright(m, 33).alias(p)).agg(F.count(F.lit(1)).alias(o))
    # a row a partition
    begins = counts.select(p, (F.sum(o).over(Window.partitionBy(F.lit(0)).orderBy(p)) - F.col(o)).alias(o))
    out = s.join(F.broadcast(begins), F.shiftright(m, 33) == F.col(p))
    return out.withColumn(name, F.col(o) + F.col(m).bitwiseAND(F.lit((1 << 33) - 1))).drop(m, p, o)


def given(order_by: str | Column | list | None) -> list[Column]:
    """The keys of an order, none if none is given."""
    return [col(k) if isinstance(k, str) else k for k in listed(order_by)]


#: Distinct values that may become columns or metadata.
MOST_VALUES = 100_000


def bounded(rows: DataFrame, what: str, most: int = MOST_VALUES) -> list:
    """All rows, on the driver; more than ``most`` are an error, never cut."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"{what} would take more than {most} distinct values to the driver")
    return got


def categories(df: DataFrame, name: str) -> list | None:
    return (df.schema[name].metadata or {}).get("categories")


def with_metadata(df: DataFrame, name: str, **more: Any) -> DataFrame:
    return df.withMetadata(name, {**(df.schema[name].metadata or {}), **more})


# -- column selectors ------------------------------------------------------------------------


class DropLabel:
    """All columns but those that ``label`` selects."""

    def __init__(self, label: Any):
        self.label = label


def is_numeric(f: T.StructField) -> bool:
    return isinstance(f.dataType, NUMERIC)


def is_integer(f: T.StructField) -> bool:
    return isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_float(f: T.StructField) -> bool:
    return isinstance(f.dataType, FLOATS)


def is_string(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.StringType)


def is_boolean(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.BooleanType)


def is_datetime(f: T.StructField) -> bool:
    return isinstance(f.dataType, TIMES)


def _label_slice(names: list[str], start: Any, stop: Any, step: Any) -> list[str]:
    for x in (start, stop):
        if x is not None and x not in names:
            raise KeyError(x)
        if x is not None and names.count(x) > 1:
            raise ValueError(f"label {x!r} stands more than once")
    i = 0 if start is None else names.index(start)
    j = len(names) - 1 if stop is None else names.index(stop)
    return names[i : j + 1][:: step or 1] if i <= j else names[j : i + 1][::-1][:: step or 1]


def _select(df: DataFrame, spec: Any) -> list[str]:
    names = df.columns
    if isinstance(spec, DropLabel):
        gone = set(_select(df, spec.label))
        return [n for n in names if n not in gone]
    if isinstance(spec, str):
        if spec in names:
            return [spec]
        found = [n for n in names if fnmatch.fnmatchcase(n, spec)]
        if not found:
            raise KeyError(f"no column is or matches {spec!r}")
        return found
    if isinstance(spec, re.Pattern):
        found = [n for n in names if spec.search(n)]
        if not found:
            raise KeyError(f"no column matches {spec.pattern!r}")
        return found
    if isinstance(spec, (slice, range)):
        return _label_slice(names, spec.start, spec.stop, spec.step)
    if isinstance(spec, dict):
        return _select(df, list(spec))
    if callable(spec):
        try:
            got = [spec(f) for f in df.schema.fields]
        except (AttributeError, TypeError):  # a function of the table: names, a mask or a selector
            return _select(df, spec(df))
        if any(not isinstance(x, bool) for x in got):
            raise TypeError("a selecting function must give True or False for a field")
        return [n for n, x in zip(names, got) if x]
    if isinstance(spec, (list, tuple, set)):
        spec = list(spec)
        if spec and all(isinstance(x, bool) for x in spec):
            if len(spec) != len(names):
                raise IndexError(f"a mask of {len(spec)} for {len(names)} columns")
            return [n for n, x in zip(names, spec) if x]
        drops = [x for x in spec if isinstance(x, DropLabel)]
        if drops:
            gone = {n for d in drops for n in _select(df, d.label)}
            kept = [x for x in spec if not isinstance(x, DropLabel)]
            base = resolve(df, *kept) if kept else names
            return [n for n in base if n not in gone]
        return [n for x in spec for n in _select(df, x)]
    raise KeyError(spec)


def resolve(df: DataFrame, *specs: Any, invert: bool = False) -> list[str]:
    """Names of the columns that the selectors name, in their order, each once."""
    drops = [s for s in specs if isinstance(s, DropLabel)]
    if len(drops) > 1 or (drops and len(specs) > 1):
        specs = (list(specs),)
    found = list(dict.fromkeys(n for s in specs for n in _select(df, s)))
    if invert:
        return [n for n in df.columns if n not in set(found)]
    return found


Selector = str | re.Pattern | slice | list | dict | DropLabel | Callable
