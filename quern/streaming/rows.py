"""Which operators work row by row, and so on streams, and a check on it; and two windowed helpers for streams.

Operators that need all rows (ranks, statistics, joins on inequalities, pivots to wide form) refuse a streaming table.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import col, listed

ROW_LOCAL = frozenset(
    "select select_columns remove_columns reorder_columns rename_column rename_columns limit_column_characters clean_names filter_string filter_on filter_date filter_column_isin dropnotnull "
    "case_when update_where coalesce find_replace to_datetime convert_excel_date convert_matlab_date truncate_datetime_dataframe currency_column_to_numeric round_to_fraction flag_nulls "
    "transform_column transform_columns process_text concatenate_columns pivot_longer pivot_longer_spec fill_empty convert_units".split()
)


def apply_stream(df: DataFrame, operator: Callable[..., DataFrame], *args: Any, **kwargs: Any) -> DataFrame:
    """A row-local operator on a streaming table; others are an error before anything starts."""
    if df.isStreaming and operator.__name__ not in ROW_LOCAL:
        raise ValueError(f"{operator.__name__} needs all rows and is not supported on a streaming table")
    return operator(df, *args, **kwargs)


def windowed_agg(df: DataFrame, time_column: str, window: str, late: str, by: Any = None, **aggregates: Column) -> DataFrame:
    """Aggregates by time window (and ``by``); rows later than ``late`` behind the newest are dropped on a stream."""
    t = df.withWatermark(time_column, late) if df.isStreaming else df
    keys = [F.window(col(time_column), window).alias("w"), *[col(c) for c in listed(by)]]
    out = t.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[col(c) for c in listed(by)], *aggregates)
