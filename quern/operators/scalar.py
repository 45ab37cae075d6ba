"""Columns made of other columns of the same row. All of it is Column expressions and runs on streams as well; exceptions say so."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import FLOATS, bounded, check, check_column, col, free, given, known, listed, missing, no_stream, numbered, resolve
from .filters import condition


def _as_column(df: DataFrame, x: Any) -> Column:
    if isinstance(x, Column):
        return x
    return _as_column(df, x(df)) if callable(x) else F.lit(x)


def add_column(df: DataFrame, column_name: str, value: Any, fill_remaining: bool = False, order_by=None) -> DataFrame:
    """A new column of one value, a Column, or a list laid along ``order_by`` (and again from its start with ``fill_remaining``)."""
    check("column_name", column_name, [str])
    check_column(df, column_name, present=False)
    if isinstance(value, Column) or isinstance(value, str) or not hasattr(value, "__iter__"):
        return df.withColumn(column_name, value if isinstance(value, Column) else F.lit(value))
    no_stream(df, "a column from a list")
    values = list(value)
    n = df.count()
    if len(values) > n:
        raise ValueError(f"{len(values)} values for {n} rows")
    if len(values) < n and not fill_remaining or not values:
        raise ValueError(f"only {len(values)} values for {n} rows")
    (pos,) = free(df, "pos")
    return _laid(numbered(df, pos, given(order_by)), pos, {column_name: values}).drop(pos)


def _laid(df: DataFrame, pos: str, lists: dict[str, list]) -> DataFrame:
    return df.withColumns({c: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(pos) % len(values) + 1).cast("int")) for c, values in lists.items()})


def add_columns(df: DataFrame, fill_remaining: bool = False, order_by=None, **columns: Any) -> DataFrame:
    """add_column() for each; rows are counted and numbered once for all lists."""
    check_column(df, list(columns), present=False)
    plain = lambda v: isinstance(v, (Column, str)) or not hasattr(v, "__iter__")
    lists = {c: list(v) for c, v in columns.items() if not plain(v)}
    if lists:
        no_stream(df, "a column from a list")
        n = df.count()
        for values in lists.values():
            if len(values) > n or len(values) < n and not fill_remaining or not values:
                raise ValueError(f"{len(values)} values for {n} rows")
        (pos,) = free(df, "pos")
        df = _laid(numbered(df, pos, given(order_by)), pos, lists).drop(pos)
    out = df.withColumns({c: v if isinstance(v, Column) else F.lit(v) for c, v in columns.items() if plain(v)}) if len(lists) < len(columns) else df
    names = [c for c in df.columns if c not in columns] + list(columns)
    return out.select(*[col(c) for c in names])


def case_when(df: DataFrame, *args: Any, default: Any = None, column_name: str) -> DataFrame:
    """First condition that holds gives the value; conditions and values may be Columns, SQL text (conditions) or functions of the table."""
    args = list(args)
    if len(args) < 2:
        raise ValueError("give a condition and a value at least")
    if len(args) % 2:
        if default is not None:
            raise ValueError("the default is given twice")
        default = args.pop()
    out: Column | None = None
    for cond, value in zip(args[::2], args[1::2]):
        c = condition(df, cond) if isinstance(cond, str) else _as_column(df, cond)
        v = _as_column(df, value)
        out = F.when(c, v) if out is None else out.when(c, v)
    return df.withColumn(column_name, out.otherwise(_as_column(df, default)))


def update_where(df: DataFrame, conditions: Any, target_column_name: str, target_val: Any) -> DataFrame:
    """Sets a column where the condition holds; a column that wasn't there is null elsewhere."""
    cond = condition(df, conditions) if isinstance(conditions, str) else _as_column(df, conditions)
    if not isinstance(df.select(cond.alias("x")).schema["x"].dataType, T.BooleanType):
        raise ValueError("the condition must be boolean")
    old = col(target_column_name) if target_column_name in df.columns else F.lit(None)
    return df.withColumn(target_column_name, F.when(cond, _as_column(df, target_val)).otherwise(old))


def coalesce(df: DataFrame, *column_names: Any, target_column_name: str | None = None, default_value: Any = None) -> DataFrame:
    """First known value of the columns, put into the first of them or into the target."""
    names = resolve(df, *column_names)
    if len(names) < 2:
        raise ValueError("give two columns at least")
    parts = [known(df, c) for c in names] + ([] if default_value is None else [F.lit(default_value)])
    return df.withColumn(target_column_name or names[0], F.coalesce(*parts))


def find_replace(df: DataFrame, match: str = "exact", **mappings: dict) -> DataFrame:
    """Cells replaced: equal ones (exact), or those in which a pattern is found, one mapping after another (regex)."""
    if match not in ("exact", "regex"):
        raise ValueError("match is exact or regex")
    check_column(df, list(mappings))
    out = {}
    for name, mapping in mappings.items():
        if any(k is None for k in mapping):
            raise ValueError("null can't be replaced; use coalesce")
        c = col(name)
        if match == "exact":
            new: Column | None = None
            for old, v in mapping.items():
                new = F.when(c == F.lit(old), F.lit(v)) if new is None else new.when(c == F.lit(old), F.lit(v))
            out[name] = c if new is None else new.otherwise(c)
        else:
            for pattern, v in mapping.items():
                c = F.when(c.rlike(pattern), F.lit(v)).otherwise(c)
            out[name] = c
    return df.withColumns(out)


def change_type(df: DataFrame, column_name: Any, dtype: str | T.DataType | type, ignore_exception: bool | str = False) -> DataFrame:
    """Cast; ``keep_values`` leaves a column as it is if any cell fails, ``fillna`` makes failing cells null."""
    t = {int: "bigint", float: "double", str: "string", bool: "boolean"}.get(dtype, dtype)
    names = listed(column_name)
    check_column(df, names)
    if ignore_exception not in (False, True, "keep_values", "fillna"):
        raise ValueError("ignore_exception is keep_values or fillna")
    if ignore_exception == "fillna":
        return df.withColumns({c: col(c).try_cast(t) for c in names})
    if not ignore_exception:
        return df.withColumns({c: col(c).cast(t) for c in names})
    no_stream(df, "keep_values")
    bad = df.agg(*[F.bool_or(col(c).isNotNull() & col(c).try_cast(t).isNull()).alias(c) for c in names]).first()
    return df.withColumns({c: col(c).cast(t) for c in names if not bad[c]})


_STRPTIME = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM", "%a": "E", "%A": "EEEE", "%j": "DDD", "%z": "xx", "%%": "%"}


def to_datetime(df: DataFrame, column_name: str, format: str | None = None, errors: str = "raise", unit: str | None = None) -> DataFrame:
    """A timestamp without zone, from text (strptime or Spark pattern) or from a number of ``unit``."""
    check_column(df, column_name)
    c = col(column_name)
    if unit:
        micros = {"D": 86_400_000_000, "h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1000, "us": 1, "ns": 0.001}[unit]
        return df.withColumn(column_name, _from_epoch(c.cast("double") * micros / 1e6))
    if format:
        for a, b in _STRPTIME.items():
            format = format.replace(a, b)
    args = [F.lit(format)] if format else []
    if errors == "coerce":
        return df.withColumn(column_name, F.call_function("try_to_timestamp", c, *args).cast("timestamp_ntz"))
    return df.withColumn(column_name, F.call_function("to_timestamp", c, *args).cast("timestamp_ntz") if args else c.cast("timestamp_ntz"))


def _from_epoch(seconds: Column, epoch: str = "1970-01-01 00:00:00") -> Column:
    return F.lit(epoch).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(38,6)").cast("decimal(18,6)"))


def convert_excel_date(df: DataFrame, column_names: Any) -> DataFrame:
    """Days since 1899-12-30, with fractions."""
    names = listed(column_names)
    check_column(df, names)
    for c in names:
        if not isinstance(df.schema[c].dataType, (*FLOATS, T.IntegerType, T.LongType, T.ShortType, T.DecimalType)):
            raise ValueError(f"{c!r} is not numeric")
    return df.withColumns({c: excel_date(col(c)) for c in names})


def excel_date(c: Column) -> Column:
    return _from_epoch(c.cast("double") * 86400, "1899-12-30 00:00:00")


def convert_matlab_date(df: DataFrame, column_names: Any) -> DataFrame:
    """Days since year 0; day 719529 is 1970-01-01."""
    names = listed(column_names)
    check_column(df, names)
    return df.withColumns({c: matlab_date(col(c)) for c in names})


def matlab_date(c: Column) -> Column:
    return _from_epoch((c.cast("double") - 719529) * 86400)


def convert_unix_date(df: DataFrame, column_name: str) -> DataFrame:
    """Seconds since 1970; milliseconds if any value is beyond year 9999 in seconds (one look at the maximum)."""
    check_column(df, column_name)
    no_stream(df, "convert_unix_date")
    c = col(column_name).cast("double")
    most = df.agg(F.max(F.abs(c))).first()[0] or 0
    return df.withColumn(column_name, _from_epoch(c / 1000 if most > 253402300799 else c))


def truncate_datetime_dataframe(df: DataFrame, datepart: str) -> DataFrame:
    """All times cut to YEAR, MONTH, DAY, HOUR, MINUTE or SECOND."""
    part = datepart.upper()
    if part not in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND"):
        raise ValueError(f"{datepart!r} is no part of a date")
    out = {f.name: F.date_trunc(part, col(f.name)).cast(f.dataType) for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))}
    return df.withColumns(out) if out else df


def currency_column_to_numeric(df: DataFrame, column_name: str, cleaning_style: str | None = None, cast_non_numeric: dict | None = None, fill_all_non_numeric: float | None = None, remove_non_numeric: bool = False) -> DataFrame:
    """Amounts in text as numbers. accounting: parentheses are negative, a lone dash is 0.

    Else only digits, dots and dashes count; ``cast_non_numeric`` maps whole texts, ``fill_all_non_numeric`` stands for what is left
    without a number, ``remove_non_numeric`` drops such rows; empty cells stay null.
    """
    check_column(df, column_name)
    c = col(column_name).cast("string")
    if cleaning_style == "accounting":
        t = F.regexp_replace(F.translate(F.trim(c), ",)", ""), r"\(", "-")
        t = F.trim(t)
        return df.withColumn(column_name, F.when(t == "-", F.lit(0.0)).otherwise(F.replace(t, F.lit(" "), F.lit("")).try_cast("double")))
    if cleaning_style is not None:
        raise ValueError("cleaning_style is accounting or None")
    digits = F.regexp_replace(c, r"[^\-.0-9]", "")
    value = F.when(digits == "-", F.lit(None).cast("double")).otherwise(digits.try_cast("double"))
    for text, v in (cast_non_numeric or {}).items():
        value = F.when(c == text, F.lit(float(v))).otherwise(value)
    empty = c.isNull() | (F.trim(c) == "")
    if remove_non_numeric:
        return df.withColumn(free(df, "v")[0], value).where(value.isNotNull() | empty).withColumn(column_name, F.col(free(df, "v")[0])).drop(free(df, "v")[0])
    if fill_all_non_numeric is not None:
        value = F.when(value.isNull() & ~empty, F.lit(float(fill_all_non_numeric))).otherwise(value)
    return df.withColumn(column_name, value)


def round_to_fraction(df: DataFrame, column_name: str, denominator: int, digits: float = math.inf) -> DataFrame:
    """To the nearest 1/denominator, halves to even."""
    check_column(df, column_name)
    check("denominator", denominator, [int, float])
    if denominator <= 0:
        raise ValueError("the denominator must be positive")
    v = F.rint(col(column_name).cast("double") * denominator) / denominator
    return df.withColumn(column_name, v if math.isinf(digits) else F.bround(v, int(digits)))


def jitter(df: DataFrame, column_name: str, dest_column_name: str, scale: float, clip: list | None = None, random_state: int | None = None) -> DataFrame:
    check_column(df, column_name)
    check_column(df, dest_column_name, present=False)
    if scale <= 0:
        raise ValueError("the scale must be positive")
    v = col(column_name) + F.randn(random_state) * scale
    if clip is not None:
        if len(clip) != 2 or clip[0] > clip[1]:
            raise ValueError("clip is [least, greatest]")
        v = F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(float(clip[0]))), F.lit(float(clip[1]))))
    return df.withColumn(dest_column_name, v)


def flag_nulls(df: DataFrame, column_name: str = "null_flag", columns: Any = None) -> DataFrame:
    check_column(df, column_name, present=False)
    hit = F.lit(False)
    for c in df.columns if columns is None else resolve(df, *listed(columns)):
        hit = hit | missing(df, c)
    return df.withColumn(column_name, hit.cast("int"))


def _applied(df: DataFrame, name: str, function: Callable, elementwise: bool, returns: str | None) -> Column:
    """A function of a Column is called once, when the plan is made; any other becomes a UDF over Arrow batches."""
    if returns is None:
        try:
            got = function(col(name))
            if isinstance(got, Column):
                return got
        except Exception as e:
            raise TypeError("the function is none of Columns; give returns= (a type) to run it in Python") from e
        raise TypeError("the function gives no Column; give returns= (a type) to run it in Python")
    if elementwise:
        return F.udf(function, returns, useArrow=True)(col(name))
    import pandas as pd

    def run(s: pd.Series) -> pd.Series:
        return function(s)

    return F.pandas_udf(run, returns)(col(name))


def transform_column(df: DataFrame, column_name: str, function: Callable, dest_column_name: str | None = None, elementwise: bool = True, returns: str | None = None) -> DataFrame:
    check_column(df, column_name)
    if dest_column_name and dest_column_name != column_name:
        check_column(df, dest_column_name, present=False)
    return df.withColumn(dest_column_name or column_name, _applied(df, column_name, function, elementwise, returns))


def transform_columns(df: DataFrame, column_names: Any, function: Callable, suffix: str | None = None, elementwise: bool = True, new_column_names: dict | None = None, returns: str | None = None) -> DataFrame:
    if suffix and new_column_names:
        raise ValueError("give suffix or new_column_names")
    names = listed(column_names)
    check_column(df, names)
    dest = {c: c + suffix if suffix else (new_column_names or {}).get(c, c) for c in names}
    return df.withColumns({d: _applied(df, c, function, elementwise, returns) for c, d in dest.items()})


def join_apply(df: DataFrame, func: Callable, new_column_name: str, returns: str | None = None) -> DataFrame:
    """A function of the whole row: of a dict of Columns, or (with ``returns``) of a dict of values in Python."""
    check_column(df, new_column_name, present=False)
    if returns is None:
        return df.withColumn(new_column_name, func({c: col(c) for c in df.columns}))
    names = df.columns
    return df.withColumn(new_column_name, F.udf(lambda *v: func(dict(zip(names, v))), returns, useArrow=True)(*[col(c) for c in names]))


def also(df: DataFrame, func: Callable, *args: Any, **kwargs: Any) -> DataFrame:
    func(df, *args, **kwargs)
    return df


def then(df: DataFrame, func: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return func(df)


def fill_empty(df: DataFrame, column_names: Any, value: Any) -> DataFrame:
    names = listed(column_names)
    check_column(df, names)
    return df.withColumns({c: F.coalesce(known(df, c), F.lit(value)) for c in names})


def concatenate_columns(df: DataFrame, column_names: list, new_column_name: str, sep: str = "-", ignore_empty: bool = True, null_token: str | None = "nan") -> DataFrame:
    """Columns as text, joined. A missing value reads ``null_token`` (None: it is left out); empty pieces are left out with ``ignore_empty``."""
    if len(column_names) < 2:
        raise ValueError("give two columns at least")
    check_column(df, column_names)
    parts = []
    for c in column_names:
        t = F.when(~missing(df, c), col(c).cast("string"))
        t = t if null_token is None else F.coalesce(t, F.lit(null_token))
        parts.append(F.when(t != "", t) if ignore_empty else t)
    return df.withColumn(new_column_name, F.concat_ws(sep, *parts))


def deconcatenate_column(df: DataFrame, column_name: str, sep: str | None = None, new_column_names: list | tuple | None = None, autoname: str | None = None, preserve_position: bool = False) -> DataFrame:
    """Text (or an array) taken apart into columns, named or numbered from 1 after ``autoname``."""
    check_column(df, column_name)
    array = isinstance(df.schema[column_name].dataType, T.ArrayType)
    if not array and sep is None:
        raise ValueError("text needs a separator")
    if new_column_names is None and autoname is None:
        raise ValueError("give new_column_names or autoname")
    import re

    parts = col(column_name) if array else F.split(col(column_name), re.escape(sep), -1)
    if new_column_names is None or not df.isStreaming:
        width = df.agg(F.max(F.size(F.when(parts.isNotNull(), parts)))).first()[0] or 0
        if new_column_names is not None and len(new_column_names) != width:
            raise ValueError(f"{len(new_column_names)} names for {width} parts")
    names = list(new_column_names) if new_column_names is not None else [f"{autoname}{i + 1}" for i in range(width)]
    made = {n: F.try_element_at(parts, F.lit(i + 1)) for i, n in enumerate(names)}
    if not preserve_position:
        return df.withColumns(made)
    out: list[Column] = []
    for c in df.columns:
        out += [v.alias(n) for n, v in made.items()] if c == column_name else [col(c)]
    return df.select(*out)


def expand_column(df: DataFrame, column_name: str, sep: str = "|", concat: bool = True, labels: list[str] | None = None) -> DataFrame:
    """A 0/1 column for each label in separated text, in sorted order; null has none. ``labels`` saves the look for them."""
    import re

    check_column(df, column_name)
    parts = F.split(col(column_name), re.escape(sep), -1)
    if labels is None:
        no_stream(df, "expand_column without labels")
        labels = sorted(r[0] for r in bounded(df.select(F.explode(parts).alias("x")).where("x <> ''").distinct(), "expand_column"))
    made = [F.coalesce(F.array_contains(parts, x), F.lit(False)).cast("int").alias(x) for x in labels]
    return df.select(*([col(c) for c in df.columns] if concat else []), *made)


def get_features_targets(df: DataFrame, target_column_names: Any, feature_column_names: Any = None) -> tuple[DataFrame, DataFrame]:
    y = listed(target_column_names)
    check_column(df, y)
    x = listed(feature_column_names) or [c for c in df.columns if c not in y]
    check_column(df, x)
    return df.select(*[col(c) for c in x]), df.select(*[col(c) for c in y])
