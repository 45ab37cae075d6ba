"""Columns: selection, order, names. Nothing here reads a row but row_to_names and the constant and empty checks."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import check, check_column, col, free, given, known, listed, missing, no_stream, numbered, resolve


def select(df: DataFrame, *args: Any, index: Any = None, columns: Any = None, axis: str = "columns", invert: bool = False, order_by=None) -> DataFrame:
    """Columns by selectors (``args`` or ``columns``), rows by ``index``: a condition, a list of places or a slice of places in ``order_by``."""
    if args and (index is not None or columns is not None):
        raise ValueError("give either selectors or index/columns")
    if axis not in ("columns", "index"):
        raise ValueError("axis is columns or index")
    if args and axis == "index":
        index, args = args[0] if len(args) == 1 else list(args), ()
    out = df
    if index is not None:
        out = select_rows(df, index, invert=invert, order_by=order_by)
    if args or columns is not None:
        out = out.select(*[col(c) for c in resolve(df, *(args or (columns,)), invert=invert)])
    return out


def select_columns(df: DataFrame, *args: Any, invert: bool = False) -> DataFrame:
    return select(df, *args, invert=invert)


def select_rows(df: DataFrame, *args: Any, invert: bool = False, order_by=None) -> DataFrame:
    """Rows that meet conditions, or that stand at places counted from 0 in ``order_by``."""
    if all(isinstance(a, Column) for a in args):
        cond = F.lit(True)
        for a in args:
            cond = cond & a
        return df.where(~F.coalesce(cond, F.lit(False)) if invert else cond)
    no_stream(df, "selection of rows by place")
    (pos,) = free(df, "pos")
    spec = [x for a in args for x in (a if isinstance(a, (list, tuple)) else [a])]
    p, cond = F.col(pos), F.lit(False)
    for s in spec:
        if isinstance(s, slice):
            step = s.step or 1
            own = (p >= (s.start or 0)) & ((p - (s.start or 0)) % step == 0)
            cond = cond | (own & (p < s.stop) if s.stop is not None else own)
        else:
            cond = cond | (p == s)
    placed = numbered(df, pos, given(order_by))
    return placed.where(~cond if invert else cond).drop(pos)


def get_index_labels(df: DataFrame, arg: Any) -> list[str]:
    return resolve(df, arg)


def get_columns(df: DataFrame, by: Any, label: Any) -> tuple[list[str], list[str]]:
    """(grouping columns, selected other columns) for ``df.groupBy(...).agg(...)``."""
    keys = resolve(df, *listed(by))
    return keys, [c for c in resolve(df, label) if c not in keys]


def remove_columns(df: DataFrame, column_names: Any) -> DataFrame:
    names = listed(column_names)
    check_column(df, names)
    return df.drop(*names)


def reorder_columns(df: DataFrame, column_order: list[str]) -> DataFrame:
    check("column_order", column_order, [list, tuple])
    if any(c not in df.columns for c in column_order):
        raise IndexError("a column of the order is not in the table")
    first = list(dict.fromkeys(column_order))
    return df.select(*[col(c) for c in first + [c for c in df.columns if c not in first]])


def move(df: DataFrame, source: Any, target: Any = None, position: str = "before", axis: int = 1, order_by=None) -> DataFrame:
    """Columns (axis 1) or rows (axis 0, by place in ``order_by``) before or after the target, or to the start or end without one."""
    if position not in ("before", "after") or axis not in (0, 1):
        raise ValueError("position is before or after, axis is 0 or 1")
    if axis == 1:
        src = resolve(df, source)
        rest = [c for c in df.columns if c not in src]
        if target is None:
            names = src + rest if position == "before" else rest + src
        else:
            t = resolve(df, target)
            if set(t) & set(src):
                raise ValueError("source and target overlap")
            at = rest.index(t[0]) if position == "before" else rest.index(t[-1]) + 1
            names = rest[:at] + src + rest[at:]
        return df.select(*[col(c) for c in names])
    no_stream(df, "move of rows")
    (pos,) = free(df, "pos")
    src = listed(source) if not isinstance(source, int) else [source]
    p = F.col(pos)
    at = (-1.0 if position == "before" else float("inf")) if target is None else target + (-0.5 if position == "before" else 0.5)
    placed = numbered(df, pos, given(order_by))
    return placed.orderBy(F.when(p.isin(src), F.lit(at)).otherwise(p.cast("double")), p).drop(pos)


def rename_column(df: DataFrame, old_column_name: str, new_column_name: str) -> DataFrame:
    check_column(df, old_column_name)
    return df.withColumnRenamed(old_column_name, new_column_name)


def rename_columns(df: DataFrame, new_column_names: dict[str, str] | None = None, function: Callable[[str], str] | None = None) -> DataFrame:
    if new_column_names is None and function is None:
        raise ValueError("give new names or a function")
    if new_column_names is not None:
        check_column(df, list(new_column_names))
        return df.withColumnsRenamed(new_column_names)
    return df.toDF(*[function(c) for c in df.columns])


def limit_column_characters(df: DataFrame, column_length: int, col_separator: str = "_") -> DataFrame:
    """Names cut to a length; repeats get a number, the first one none."""
    check("column_length", column_length, [int])
    check("col_separator", col_separator, [str])
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        short = c[:column_length]
        n = seen.get(short, 0)
        seen[short] = n + 1
        names.append(short if not n else f"{short}{col_separator}{n}")
    return df.toDF(*names)


_CASES = ("lower", "upper", "preserve", "snake")


def clean_name(name: str, strip_underscores: str | bool | None = None, case_type: str = "lower", remove_special: bool = False, strip_accents: bool = True, truncate_limit: int | None = None) -> str:
    if case_type not in _CASES:
        raise ValueError(f"case_type is one of {_CASES}")
    if strip_underscores not in (None, "left", "right", "both", "l", "r", True, False):
        raise ValueError("strip_underscores is left, right, both, l, r or True")
    if case_type == "snake":
        name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name)
    if case_type in ("lower", "snake"):
        name = name.lower()
    elif case_type == "upper":
        name = name.upper()
    name = re.sub(r"[ /:,?()\\.\-\xa0]", "_", name)
    name = re.sub("['’]", "", name)
    if remove_special:
        name = re.sub(r"[^A-Za-z_\d]", "", name)
    if strip_accents:
        name = "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c))
    name = re.sub("_+", "_", name)
    if strip_underscores in ("left", "l", "both", True):
        name = name.lstrip("_")
    if strip_underscores in ("right", "r", "both", True):
        name = name.rstrip("_")
    return name[:truncate_limit]


def clean_names(df: DataFrame, axis: str | None = "columns", column_names: Any = None, preserve_original_labels: bool = True, enforce_string: bool = True, **how: Any) -> DataFrame:
    """Tidy labels; with ``axis=None`` and ``column_names`` the values of string columns. The old label stays in a field's metadata (``original_label``)."""
    if axis is None:
        if column_names is None:
            raise ValueError("give the columns whose values are to be cleaned")
        return df.withColumns({c: make_clean_names(col(c), **how) for c in resolve(df, column_names)})
    new = [clean_name(c, **how) for c in df.columns]
    out = df.toDF(*new)
    if preserve_original_labels and len(set(new)) == len(new):
        for old, n in zip(df.columns, new):
            if old != n:
                out = out.withMetadata(n, {**(df.schema[old].metadata or {}), "original_label": old})
    return out


#: Letters with accents of Latin-1 and Latin Extended-A that NFD takes apart.
_ACCENTS = {chr(i): unicodedata.normalize("NFD", chr(i))[0] for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(unicodedata.normalize("NFD", chr(i))) > 1}


def make_clean_names(c: Column, strip_underscores: str | bool | None = None, case_type: str = "lower", remove_special: bool = False, strip_accents: bool = True, enforce_string: bool = True, truncate_limit: int | None = None) -> Column:
    """The same rules on values, all in the JVM."""
    clean_name("", strip_underscores, case_type)
    c = c.cast("string") if enforce_string else c
    if case_type == "snake":
        c = F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_")
    c = F.lower(c) if case_type in ("lower", "snake") else F.upper(c) if case_type == "upper" else c
    c = F.regexp_replace(c, r"[ /:,?()\\.\- ]", "_")
    c = F.regexp_replace(c, "['’]", "")
    if remove_special:
        c = F.regexp_replace(c, r"[^A-Za-z_\d]", "")
    if strip_accents:
        c = F.regexp_replace(F.translate(c, "".join(_ACCENTS), "".join(_ACCENTS.values())), r"\p{Mn}", "")
    c = F.regexp_replace(c, "_+", "_")
    if strip_underscores in ("left", "l", "both", True):
        c = F.regexp_replace(c, "^_+", "")
    if strip_underscores in ("right", "r", "both", True):
        c = F.regexp_replace(c, "_+$", "")
    return F.substring(c, 1, truncate_limit) if truncate_limit is not None else c


def collapse_labels(labels: list[tuple], sep: str | None = None, glue: str | None = None, level_names: list[str] | None = None) -> list[str]:
    """One name for each tuple of labels, joined by ``sep`` or filled into ``glue``; empty parts are left out."""
    if sep is not None and glue is not None:
        raise ValueError("give sep or glue, not both")
    if glue is not None:
        keys = level_names or [f"level_{i}" for i in range(len(labels[0]) if labels else 0)]
        return [glue.format(**dict(zip(keys, x))) for x in labels]
    return [("_" if sep is None else sep).join(str(p) for p in x if str(p) != "") for x in labels]


def collapse_levels(df: DataFrame, sep: str | None = None, glue: str | None = None) -> DataFrame:
    """Struct columns become flat columns named by their path; a table without them is returned as it is."""
    if not any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        return df
    found: list[tuple[Column, tuple[str, ...]]] = []

    def walk(c: Column, kind: T.DataType, path: tuple[str, ...]) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(c.getField(f.name), f.dataType, (*path, f.name))
        else:
            found.append((c, path))

    for f in df.schema.fields:
        walk(col(f.name), f.dataType, (f.name,))
    depth = max(len(p) for _, p in found)
    labels = [p + ("",) * (depth - len(p)) for _, p in found]
    return df.select(*[c.alias(n) for (c, _), n in zip(found, collapse_labels(labels, sep, glue))])


def explode_index(df: DataFrame, names_sep: str | None = None, names_pattern: str | None = None) -> DataFrame:
    """Flat names taken apart into nested structs: a level for each part of a name (or each group of the pattern)."""
    if (names_sep is None) == (names_pattern is None):
        raise ValueError("give names_sep or names_pattern")
    tree: dict = {}
    for c in df.columns:
        m = re.search(names_pattern, c) if names_pattern else None
        path = [x for x in (m.groups() if m else c.split(names_sep) if names_sep else [c]) if x] or [c]
        at = tree
        for x in path[:-1]:
            at = at.setdefault(x, {})
            if not isinstance(at, dict):
                raise ValueError(f"{x!r} is a column and a level")
        if path[-1] in at:
            raise ValueError(f"{c!r} is a column and a level")
        at[path[-1]] = c

    def made(x: Any, name: str) -> Column:
        return col(x).alias(name) if isinstance(x, str) else F.struct(*[made(v, k) for k, v in x.items()]).alias(name)

    return df.select(*[made(v, k) for k, v in tree.items()])


def change_index_dtype(df: DataFrame, dtype: str | dict[str, str], key_columns: Any = None) -> DataFrame:
    """Casts key columns, which stand for an index."""
    types = dtype if isinstance(dtype, dict) else {c: dtype for c in resolve(df, key_columns)}
    check_column(df, list(types))
    return df.withColumns({c: col(c).cast(t) for c, t in types.items()})


def row_to_names(df: DataFrame, row_numbers: int | list[int] = 0, remove_rows: bool = False, remove_rows_above: bool = False, separator: str = "_", order_by=None) -> DataFrame:
    """One row, or several joined by ``separator``, as header. Rows are counted from 0 in ``order_by``; only the header rows reach the driver."""
    no_stream(df, "row_to_names")
    rows = [row_numbers] if isinstance(row_numbers, int) else list(row_numbers)
    if not all(isinstance(x, int) for x in rows):
        raise TypeError("row numbers are integers")
    if len(rows) > 1 and remove_rows_above:
        raise ValueError("rows above can be removed for one header row only")
    (pos,) = free(df, "pos")
    placed = numbered(df, pos, given(order_by))
    head = sorted(placed.where(F.col(pos).isin(rows)).collect(), key=lambda r: r[pos])
    if len(head) < len(rows):
        raise ValueError("a header row is not in the table")
    names = [separator.join(str(r[c]) for r in head) for c in df.columns]
    p, cond = F.col(pos), F.lit(True)
    if remove_rows_above:
        cond = cond & (p >= rows[0])
    if remove_rows:
        cond = cond & ~p.isin(rows)
    return placed.where(cond).drop(pos).toDF(*names)


def drop_duplicate_columns(df: DataFrame, column_name: str, nth_index: int = 0) -> DataFrame:
    """Without the nth column of a name that stands several times."""
    at = [i for i, c in enumerate(df.columns) if c == column_name]
    if nth_index >= len(at):
        raise IndexError(f"{column_name!r} stands {len(at)} times")
    keep = [i for i in range(len(df.columns)) if i != at[nth_index]]
    tmp = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return tmp.select(*[f"c{i}" for i in keep]).toDF(*[df.columns[i] for i in keep])


def drop_constant_columns(df: DataFrame) -> DataFrame:
    """Without columns of exactly one distinct known value: one pass of minima and maxima."""
    no_stream(df, "drop_constant_columns")
    tests = []
    for i, f in enumerate(df.schema.fields):
        c = known(df, f.name)
        plain = not isinstance(f.dataType, (T.MapType, T.VariantType))
        tests.append(((F.min(c).eqNullSafe(F.max(c)) & F.min(c).isNotNull()) if plain else F.count_distinct(F.to_json(c)) == 1).alias(f"c{i}"))
    row = df.agg(*tests).first() if tests else []
    return df.select(*[col(c) for c, gone in zip(df.columns, row) if not gone])


def remove_empty(df: DataFrame, reset_index: bool = True) -> DataFrame:
    """Without columns and rows that hold nothing known; both are judged on the table as it comes."""
    no_stream(df, "remove_empty")
    if not df.columns:
        return df
    some = F.lit(False)
    for c in df.columns:
        some = some | ~missing(df, c)
    counts = df.agg(*[F.count(known(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return df.where(some).select(*[col(c) for c, n in zip(df.columns, counts) if n])


__all__ = [n for n, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not n.startswith("_")]
