"""Group transforms, statistics, codes, and what depends on the order of rows or on time."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import bounded, categories, check, check_column, col, free, known, listed, missing, no_stream, numbered, order_keys, resolve, with_metadata

_AGG: dict[str, Callable] = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "size": lambda c: F.count(F.lit(1)), "std": F.stddev_samp, "var": F.var_samp, "median": F.median, "first": F.first, "last": F.last, "nunique": lambda c: F.size(F.collect_set(c)), "any": F.bool_or, "all": F.bool_and}


def groupby_agg(df: DataFrame, by: Any, new_column_name: str, agg_column_name: str, agg: str | Callable, dropna: bool = True, series: bool = False) -> DataFrame:
    """The group's aggregate beside each row; with ``dropna`` rows with a missing key get null.

    Groups are aggregated where their rows lie and joined back, so few large groups are no few large tasks. ``agg`` is
    a name or a function of a Column; with ``series`` a function of a pandas Series (of the group's known values) to a
    number, for which each group's values meet in one task.
    """
    no_stream(df, "groupby_agg")
    check_column(df, new_column_name, present=False)
    keys = listed(by)
    check_column(df, [*keys, agg_column_name])
    v = known(df, agg_column_name)
    if series:
        if not callable(agg):
            raise ValueError("series needs a function")
        f = lambda c: F.pandas_udf(lambda x: float(agg(x.dropna())), "double", F.PandasUDFType.GROUPED_AGG)(c)
    else:
        f = _AGG.get(agg) if isinstance(agg, str) else agg
    if f is None:
        raise ValueError(f"{agg!r} is no aggregate")
    tmp = free(df, *[f"g{i}_" for i in range(len(keys))])
    rows = df
    if dropna:
        for k in keys:
            rows = rows.where(~missing(rows, k))
    one = rows.groupBy(*[col(k).alias(t) for k, t in zip(keys, tmp)]).agg(f(v).alias(new_column_name))
    same = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(t)) if not dropna else col(k) == F.col(t) for k, t in zip(keys, tmp)])
    return df.join(one, same, "left").drop(*tmp)


def impute(df: DataFrame, column_names: Any, value: Any = None, statistic_column_name: str | None = None) -> DataFrame:
    """Missing cells get a value, or a statistic of their column, worked out for all columns in one pass."""
    if (value is None) == (statistic_column_name is None):
        raise ValueError("give a value or a statistic")
    names = resolve(df, *listed(column_names))
    if value is not None:
        return df.withColumns({c: F.coalesce(known(df, c), F.lit(value)) for c in names})
    no_stream(df, "impute by a statistic")
    stat = {"mean": F.avg, "average": F.avg, "median": F.median, "mode": lambda c: F.mode(c, True), "min": F.min, "minimum": F.min, "max": F.max, "maximum": F.max}.get(statistic_column_name)
    if stat is None:
        raise ValueError(f"{statistic_column_name!r} is no statistic")
    tmp = free(df, *[f"s{i}" for i in range(len(names))])
    one = df.agg(*[stat(known(df, c)).alias(t) for c, t in zip(names, tmp)])
    return df.crossJoin(F.broadcast(one)).withColumns({c: F.coalesce(known(df, c), F.col(t)) for c, t in zip(names, tmp)}).drop(*tmp)


def min_max_scale(df: DataFrame, feature_range: tuple[float, float] = (0, 1), column_name: Any = None, jointly: bool = False) -> DataFrame:
    no_stream(df, "min_max_scale")
    lo, hi = feature_range
    if lo >= hi:
        raise ValueError("the range's first end must be the lesser")
    names = resolve(df, *listed(column_name)) if column_name is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    tmp = free(df, *[f"a{i}" for i in range(len(names))], *[f"b{i}" for i in range(len(names))])
    a, b = tmp[: len(names)], tmp[len(names) :]
    one = df.agg(*[F.min(known(df, c)).cast("double").alias(x) for c, x in zip(names, a)], *[F.max(known(df, c)).cast("double").alias(x) for c, x in zip(names, b)])
    out = df.crossJoin(F.broadcast(one))
    least = F.least(*[F.col(x) for x in a]) if jointly and len(a) > 1 else None
    most = F.greatest(*[F.col(x) for x in b]) if jointly and len(b) > 1 else None
    made = {}
    for c, x, y in zip(names, a, b):
        p, q = (F.col(x), F.col(y)) if least is None else (least, most)
        made[c] = F.try_divide((col(c).cast("double") - p) * F.lit(float(hi - lo)), q - p) + F.lit(float(lo))
    return out.withColumns(made).drop(*tmp)


def bin_numeric(df: DataFrame, from_column_name: str, to_column_name: str, bins: int | list[float] = 5, labels: list[str] | None = None, right: bool = True, retbins: bool = False, precision: int = 3, include_lowest: bool = False) -> DataFrame:
    """Intervals (a, b] as text or by ``labels``: so many of equal width (the lowest edge a thousandth of the range lower), given edges, or given pairs of edges that don't overlap."""
    if retbins:
        raise ValueError("retbins is not supported")
    check_column(df, from_column_name)
    check_column(df, to_column_name, present=False)
    v = known(df, from_column_name)
    if isinstance(bins, int):
        no_stream(df, "bin_numeric without edges")
        if bins < 1:
            raise ValueError("bins must be positive")
        lo, hi = df.agg(F.min(v).cast("double"), F.max(v).cast("double")).first()
        if lo is None:
            return df.withColumn(to_column_name, F.lit(None).cast("string"))
        if lo == hi:
            pad = 0.001 * abs(lo) if lo else 0.001
            lo, hi = lo - pad, hi + pad
            edges = [lo + (hi - lo) * i / bins for i in range(bins + 1)]
        else:
            edges = [lo + (hi - lo) * i / bins for i in range(bins)] + [hi]
            edges[0 if right else -1] += (-1 if right else 1) * 0.001 * (hi - lo)
    elif all(isinstance(x, (tuple, list)) for x in bins):
        edges = None
        pairs = [(float(a), float(b)) for a, b in bins]
        if any(a >= b for a, b in pairs) or any(x[1] > y[0] for x, y in zip(pairs, pairs[1:])):
            raise ValueError("intervals must grow and not overlap")
    else:
        edges = [float(x) for x in bins]
        if sorted(set(edges)) != edges:
            raise ValueError("edges must grow")
    if edges is not None:
        pairs = list(zip(edges, edges[1:]))
    if labels is None:
        text = lambda x: f"{x:.{precision}f}".rstrip("0").rstrip(".") if precision else f"{x:.0f}"
        labels = [f"({text(a)}, {text(b)}]" if right else f"[{text(a)}, {text(b)})" for a, b in pairs]
    if len(labels) != len(pairs):
        raise ValueError(f"{len(labels)} labels for {len(pairs)} bins")
    out = F.lit(None).cast("string")
    for k, ((a, b), name) in reversed(list(enumerate(zip(pairs, labels)))):
        inside = (v > a) & (v <= b) if right else (v >= a) & (v < b)
        if include_lowest and right and not k:
            inside = (v >= a) & (v <= b)
        out = F.when(inside, F.lit(name)).otherwise(out)
    return df.withColumn(to_column_name, out)


def factorize_columns(df: DataFrame, column_names: Any, suffix: str | None = "_enc", sort: bool = False, order_by=None) -> DataFrame:
    """Codes from 0 by first appearance in ``order_by`` (or by value with ``sort``); missing is -1. The distinct values are counted apart and joined."""
    no_stream(df, "factorize_columns")
    names = resolve(df, *listed(column_names))
    (pos,) = free(df, "pos")
    out = df if sort else df.withColumn(pos, F.struct(*order_keys(order_by)))
    for c in names:
        key, code = free(out, "f_key", "f_code")
        there = out.where(~missing(out, c))
        seen = there.groupBy(col(c).alias(key)).agg(F.lit(1).alias("o_") if sort else F.min(pos).alias("o_"))
        coded = numbered(seen, code, [F.col(key if sort else "o_")]).select(key, code)
        joined = out.join(coded, col(c) == F.col(key), "left")
        out = joined.withColumn(c + (suffix or ""), F.coalesce(F.col(code), F.lit(-1)).cast("bigint")).drop(key, code)
    return out.drop(pos)


def label_encode(df: DataFrame, column_names: Any, order_by=None) -> DataFrame:
    return factorize_columns(df, column_names, "_enc", order_by=order_by)


def encode_categorical(df: DataFrame, column_names: Any = None, order_by=None, **orders: Any) -> DataFrame:
    """Categories kept in the column's metadata; values outside given ones become null. By column: None, "sort", "appearance" or a list."""
    if column_names is not None and orders:
        raise ValueError("give column names or orders by column")
    for c in resolve(df, *listed(column_names)) if column_names is not None else []:
        orders[c] = None
    check_column(df, list(orders))
    for c, how in orders.items():
        ordered = how is not None
        if how in (None, "sort", "appearance"):
            no_stream(df, "encode_categorical without categories")
            there = df.where(~missing(df, c))
            if how == "appearance":
                rows = there.groupBy(col(c).alias("v")).agg(F.min(F.struct(*order_keys(order_by))).alias("p")).orderBy("p").select("v")
            else:
                rows = there.select(col(c).alias("v")).distinct().orderBy("v")
            values = [r["v"] for r in bounded(rows, "encode_categorical")]
        else:
            values = list(how)
            if len(set(values)) < len(values) or any(v is None for v in values):
                raise ValueError(f"categories of {c!r} must be unique and known")
            df = df.withColumn(c, F.when(col(c).isin(values), col(c)))
        df = with_metadata(df, c, categories=[v if isinstance(v, (int, float, bool)) else str(v) for v in values], ordered=ordered)
    return df


def unionize_dataframe_categories(*dataframes: DataFrame, column_names: Any = None) -> list[DataFrame]:
    """Tables whose categories of equal columns are made one set."""
    if any(not isinstance(d, DataFrame) for d in dataframes):
        raise TypeError("give tables")
    names = listed(column_names) or list(dict.fromkeys(c for d in dataframes for c in d.columns if categories(d, c) is not None))
    out = list(dataframes)
    for c in names:
        union = list(dict.fromkeys(v for d in dataframes if c in d.columns for v in categories(d, c) or []))
        out = [with_metadata(d, c, categories=union) if c in d.columns and categories(d, c) is not None else d for d in out]
    return out


def count_cumulative_unique(df: DataFrame, column_name: str, dest_column_name: str, case_sensitive: bool = True, order_by=None, partition_by: Any = None) -> DataFrame:
    """How many distinct known values have come so far in ``order_by``. Without ``partition_by`` the running sum is one task's work."""
    no_stream(df, "count_cumulative_unique")
    check_column(df, column_name)
    check_column(df, dest_column_name, present=False)
    if not case_sensitive and not isinstance(df.schema[column_name].dataType, T.StringType):
        raise TypeError("case matters in text only")
    (new,) = free(df, "new")
    keys, parts = order_keys(order_by), [col(c) for c in listed(partition_by)]
    v = known(df, column_name)
    v = v if case_sensitive else F.lower(v)
    first = (F.row_number().over(Window.partitionBy(*parts, v).orderBy(*keys)) == 1) & v.isNotNull()
    w = Window.partitionBy(*parts).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(new, first.cast("int")).withColumn(dest_column_name, F.sum(new).over(w)).drop(new)


def toset(df: DataFrame, column_name: str) -> set:
    return {r[0] for r in bounded(df.select(col(column_name)).distinct(), "toset", 10_000_000)}


class DataDescription:
    """Types, known cells and descriptions of a table's columns; descriptions lie in field metadata (``comment``)."""

    def __init__(self, df: DataFrame):
        self.df_described = df

    def set_description(self, desc: list | dict) -> DataFrame:
        names = self.df_described.columns
        if isinstance(desc, dict):
            check_column(self.df_described, list(desc))
        elif len(desc) != len(names):
            raise ValueError(f"{len(desc)} descriptions for {len(names)} columns")
        for c, text in (desc if isinstance(desc, dict) else dict(zip(names, desc))).items():
            self.df_described = with_metadata(self.df_described, c, comment=text)
        return self.df_described

    @property
    def df(self) -> DataFrame:
        d = self.df_described
        no_stream(d, "a description")
        row = d.agg(F.count(F.lit(1)).alias("n"), *[F.count(known(d, c)).alias(f"c{i}") for i, c in enumerate(d.columns)]).first()
        data = [(c, f.dataType.simpleString(), int(row[f"c{i}"]), 1 - row[f"c{i}"] / row["n"] if row["n"] else 0.0, (f.metadata or {}).get("comment", "")) for i, (c, f) in enumerate(zip(d.columns, d.schema.fields))]
        return d.sparkSession.createDataFrame(data, "column_name string, type string, count bigint, pct_missing double, description string")

    def display(self) -> None:
        self.df.show(truncate=False)


# -- order and time --------------------------------------------------------------------------


def fill_direction(df: DataFrame, order_by=None, partition_by: Any = None, **directions: str) -> DataFrame:
    """Missing cells filled from the last known one (down), the next (up), or one and then the other. Without ``partition_by`` it is one task's work."""
    no_stream(df, "fill_direction")
    check_column(df, list(directions))
    base = Window.partitionBy(*[col(c) for c in listed(partition_by)]).orderBy(*order_keys(order_by))
    made = {}
    for c, way in directions.items():
        down = F.last(known(df, c), ignorenulls=True).over(base.rowsBetween(Window.unboundedPreceding, 0))
        up = F.first(known(df, c), ignorenulls=True).over(base.rowsBetween(0, Window.unboundedFollowing))
        if way not in ("down", "up", "downup", "updown"):
            raise ValueError(f"{way!r} is no direction")
        made[c] = {"down": down, "up": up, "downup": F.coalesce(down, up), "updown": F.coalesce(up, down)}[way]
    return df.withColumns(made)


_FREQ = {"S": "SECOND", "s": "SECOND", "T": "MINUTE", "min": "MINUTE", "H": "HOUR", "h": "HOUR", "D": "DAY", "d": "DAY", "W": "WEEK", "MS": "MONTH", "QS": "QUARTER", "YS": "YEAR", "AS": "YEAR"}


def _interval(frequency: str) -> str:
    m = re.fullmatch(r"(\d*)\s*([A-Za-z]+)", frequency)
    if not m or m[2] not in _FREQ:
        raise ValueError(f"{frequency!r} is no frequency")
    n, unit = int(m[1] or 1), _FREQ[m[2]]
    return f"INTERVAL {n * 3} MONTH" if unit == "QUARTER" else f"INTERVAL {n * 7} DAY" if unit == "WEEK" else f"INTERVAL {n} {unit}"


def _grid(df: DataFrame, frequency: str, first: Any, last: Any, ts: str, out: str) -> DataFrame:
    t = df.schema[ts].dataType
    ends = df.agg(F.min(col(ts)).alias("a"), F.max(col(ts)).alias("b"))
    a = F.col("a") if first is None else F.lit(first).cast(t)
    b = F.col("b") if last is None else F.lit(last).cast(t)
    return ends.select(a.alias("a"), b.alias("b")).where("a <= b").select(F.explode(F.expr(f"sequence(a, b, {_interval(frequency)})")).alias(out))


def fill_missing_timestamps(df: DataFrame, frequency: str, first_time_stamp: Any = None, last_time_stamp: Any = None, timestamp_column: str = "ts") -> DataFrame:
    """A row for each time of the grid; rows off the grid are dropped."""
    no_stream(df, "fill_missing_timestamps")
    check_column(df, timestamp_column)
    (g,) = free(df, "grid")
    grid = _grid(df, frequency, first_time_stamp, last_time_stamp, timestamp_column, g)
    out = grid.join(df, F.col(g) == col(timestamp_column), "left")
    return out.select(*[F.col(g).alias(c) if c == timestamp_column else col(c) for c in df.columns])


def get_missing_timestamps(df: DataFrame, frequency: str, first_time_stamp: Any = None, last_time_stamp: Any = None, timestamp_column: str = "ts") -> DataFrame:
    """Times of the grid that no row has."""
    no_stream(df, "get_missing_timestamps")
    (g,) = free(df, "grid")
    grid = _grid(df, frequency, first_time_stamp, last_time_stamp, timestamp_column, g)
    return grid.join(df.select(col(timestamp_column)), F.col(g) == col(timestamp_column), "left_anti").select(F.col(g).alias(timestamp_column))


def sort_timestamps_monotonically(df: DataFrame, direction: str = "increasing", strict: bool = False, timestamp_column: str = "ts", order_by=None) -> DataFrame:
    """Sorted by time; ``strict`` keeps the first row of each time in ``order_by``."""
    no_stream(df, "sort_timestamps_monotonically")
    if direction not in ("increasing", "decreasing"):
        raise ValueError("direction is increasing or decreasing")
    if strict:
        (n,) = free(df, "n")
        df = df.withColumn(n, F.row_number().over(Window.partitionBy(col(timestamp_column)).orderBy(*order_keys(order_by)))).where(F.col(n) == 1).drop(n)
    c = col(timestamp_column)
    return df.orderBy(c.asc_nulls_last() if direction == "increasing" else c.desc_nulls_last())


def flag_jumps(df: DataFrame, scale: str | dict = "percentage", direction: str | dict = "any", threshold: float | dict = 0.0, strict: bool = False, order_by=None, partition_by: Any = None, columns: Any = None) -> DataFrame:
    """``<column>_jump_flag``: 1 where a value is beyond the threshold from the one before (absolute, or as a share of the last known one)."""
    no_stream(df, "flag_jumps")
    given = [x for x in (scale, direction, threshold) if isinstance(x, dict)]
    if strict and not given:
        raise ValueError("strict needs a dict of columns")
    if strict:
        names = sorted({c for x in given for c in x})
    else:
        drop = {*listed(order_by), *listed(partition_by)}
        names = resolve(df, *listed(columns)) if columns is not None else sorted(f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in drop)
    check_column(df, [*names, *(c for x in given for c in x)])
    w = Window.partitionBy(*[col(c) for c in listed(partition_by)]).orderBy(*order_keys(order_by))
    made = {}
    for c in names:
        s = scale.get(c, "percentage") if isinstance(scale, dict) else scale
        way = direction.get(c, "any") if isinstance(direction, dict) else direction
        t = threshold.get(c, 0.0) if isinstance(threshold, dict) else threshold
        if s not in ("absolute", "percentage") or way not in ("increasing", "decreasing", "any"):
            raise ValueError("scale is absolute or percentage; direction is increasing, decreasing or any")
        check("threshold", t, [int, float])
        if t < 0:
            raise ValueError("a threshold must not be negative")
        v = known(df, c).cast("double")
        if s == "percentage":
            v = F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
            prev = F.last(known(df, c).cast("double"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
            # past zero a change is without bounds, with the sign of the value; zero after zero is none
            d = F.when(prev == 0, F.when(v > 0, F.lit(float("inf"))).when(v < 0, F.lit(float("-inf")))).otherwise(F.try_divide(v, prev) - 1)
        else:
            d = v - F.lag(v).over(w)
        hit = {"increasing": d > t, "decreasing": d < -t, "any": F.abs(d) > t}[way]
        made[f"{c}_jump_flag"] = F.coalesce(hit, F.lit(False)).cast("int")
    return df.withColumns(made)
