"""Rows: conditions, duplicates, first and top rows, order."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import FLOATS, check, check_column, col, free, listed, missing, no_stream, order_keys


def filter_string(df: DataFrame, column_name: str, search_string: str, complement: bool = False, case: bool = True, flags: int = 0, na: bool | None = None, regex: bool = True) -> DataFrame:
    """Rows whose text holds the pattern; a missing text holds it if ``na`` says so, and by default neither it nor its complement takes the row."""
    check("search_string", search_string, [str])
    check_column(df, column_name)
    c = col(column_name)
    if regex:
        mark = "".join(x for x, f in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if flags & f or x == "i" and not case)
        hit = c.rlike(f"(?{mark}){search_string}" if mark else search_string)
    else:
        hit = c.contains(search_string) if case else F.lower(c).contains(search_string.lower())
    if na is not None:
        hit = F.coalesce(hit, F.lit(na))
    return df.where(~hit if complement else hit)


_OPS: dict[type, Callable] = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b, ast.Mod: lambda a, b: a % b, ast.Pow: F.pow,
    ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b,
}
_NAME = "quern_name_"


def _tree(criteria: str) -> tuple[ast.expr, list[str]] | None:
    """The condition's syntax tree, with ``&`` and ``|`` as loose as ``and`` and ``or``, and the names that stood in backticks; None if it is no Python."""
    names: list[str] = []

    def quoted(m: re.Match) -> str:
        if m[0][0] != "`":
            return m[0]
        names.append(m[0][1:-1])
        return f" {_NAME}{len(names) - 1} "

    text = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", quoted, criteria.strip())
    try:
        got = [{"&": "and", "|": "or"}.get(t.string, t.string) if t.type == tokenize.OP else t.string for t in tokenize.generate_tokens(io.StringIO(text).readline)]
        return ast.parse(" ".join(got).strip(), mode="eval").body, names
    except (SyntaxError, tokenize.TokenError):
        return None


def condition(df: DataFrame, criteria: str) -> Column:
    """A condition in the Python manner (``and or not & | ~``, comparisons, ``in``, arithmetic) as a Column; other text is SQL.

    A missing value meets no comparison but ``!=``, so ``not`` of a comparison holds for it.
    """
    tree = _tree(criteria)
    if tree is None:
        return F.expr(criteria)
    names = tree[1]

    def named(e: ast.expr) -> str | None:
        if isinstance(e, ast.Name):
            return names[int(e.id[len(_NAME) :])] if e.id.startswith(_NAME) else e.id
        return None

    def gone(e: ast.expr) -> Column | None:
        """Whether a float column is NaN, which compares as the greatest number."""
        n = named(e)
        return F.isnan(col(n)) if n in df.columns and isinstance(df.schema[n].dataType, FLOATS) else None

    def compare(a: ast.expr, op: ast.cmpop, b: ast.expr) -> Column:
        if isinstance(op, (ast.In, ast.NotIn)):
            if not isinstance(b, (ast.List, ast.Tuple, ast.Set)):
                raise ValueError("in needs a list of values")
            values = [x for x in b.elts if not (isinstance(x, ast.Constant) and x.value is None)]
            hit = build(a).isin([build(x) for x in values]) if values else F.lit(False)
            return ~F.coalesce(hit, F.lit(False)) if isinstance(op, ast.NotIn) else hit
        if isinstance(op, (ast.Is, ast.IsNot)):
            if not (isinstance(b, ast.Constant) and b.value is None):
                raise ValueError("is compares with None only")
            none = build(a).isNull() if gone(a) is None else build(a).isNull() | gone(a)
            return ~none if isinstance(op, ast.IsNot) else none
        hit, nan = _OPS[type(op)](build(a), build(b)), [x for x in (gone(a), gone(b)) if x is not None]
        if isinstance(op, ast.NotEq):
            return reduce(lambda x, y: x | y, [F.coalesce(hit, F.lit(True)), *[F.coalesce(x, F.lit(True)) for x in nan]])
        return reduce(lambda x, y: x & ~y, nan, hit)

    def build(e: ast.expr) -> Column:
        if isinstance(e, ast.BoolOp):
            return reduce(lambda x, y: x & y if isinstance(e.op, ast.And) else x | y, [build(x) for x in e.values])
        if isinstance(e, ast.UnaryOp):
            v = build(e.operand)
            if isinstance(e.op, (ast.Not, ast.Invert)):
                return ~F.coalesce(v, F.lit(False))
            return -v if isinstance(e.op, ast.USub) else v
        if isinstance(e, ast.Compare):
            sides = [e.left, *e.comparators]
            return reduce(lambda x, y: x & y, [compare(a, op, b) for a, op, b in zip(sides, e.ops, sides[1:])])
        if isinstance(e, ast.BinOp) and type(e.op) in _OPS:
            return _OPS[type(e.op)](build(e.left), build(e.right))
        if isinstance(e, ast.BinOp) and isinstance(e.op, ast.FloorDiv):
            return F.floor(build(e.left) / build(e.right))
        if isinstance(e, ast.Constant):
            return F.lit(e.value)
        if (n := named(e)) is not None:
            if n in df.columns:
                return col(n)
            if n.lower() in ("true", "false", "null"):
                return F.lit({"true": True, "false": False}.get(n.lower()))
            return F.expr(n)
        # functions and fields are Spark's own
        return F.expr(re.sub(_NAME + r"(\d+)", lambda m: "`" + names[int(m[1])] + "`", ast.unparse(e)))

    return build(tree[0])


def filter_on(df: DataFrame, criteria: str, complement: bool = False) -> DataFrame:
    cond = condition(df, criteria)
    return df.where(~F.coalesce(cond, F.lit(False)) if complement else cond)


def filter_date(df: DataFrame, column_name: str, start_date: Any = None, end_date: Any = None, years: Iterable[int] | None = None, months: Iterable[int] | None = None, days: Iterable[int] | None = None, format: str | None = None) -> DataFrame:
    """Rows of a span and of some years, months or days; the column becomes a timestamp if it is text. Without criteria all rows stay."""
    check_column(df, column_name)
    c = col(column_name)
    if df.schema[column_name].dataType.simpleString() == "string":
        df = df.withColumn(column_name, F.expr(f"try_to_timestamp(`{column_name}`" + (f", '{format}')" if format else ")")).cast("timestamp_ntz"))
    cond = F.lit(True)
    if start_date is not None:
        cond = cond & (c >= F.lit(start_date).cast("timestamp_ntz"))
    if end_date is not None:
        cond = cond & (c <= F.lit(end_date).cast("timestamp_ntz"))
    for part, wanted in ((F.year, years), (F.month, months), (F.dayofmonth, days)):
        if wanted is not None:
            cond = cond & part(c).isin(list(wanted))
    return df.where(cond)


def filter_column_isin(df: DataFrame, column_name: str, iterable: Iterable, complement: bool = False) -> DataFrame:
    """A missing value is in no list, so the complement keeps it."""
    check_column(df, column_name)
    values = list(iterable)
    if not values:
        raise ValueError("the list of values is empty")
    hit = F.coalesce(col(column_name).isin([v for v in values if v is not None]), F.lit(False))
    return df.where(~hit if complement else hit)


def dropnotnull(df: DataFrame, column_name: str) -> DataFrame:
    check_column(df, column_name)
    return df.where(missing(df, column_name))


def get_dupes(df: DataFrame, column_names: Any = None) -> DataFrame:
    """All rows whose key stands more than once; nulls are equal."""
    no_stream(df, "get_dupes")
    keys = listed(column_names) or df.columns
    check_column(df, keys)
    tmp = free(df, *[f"k{i}_" for i in range(len(keys))])
    (n,) = free(df, "n_")
    # keys are counted where their rows lie; rows of a key that stands very often aren't gathered
    many = df.groupBy(*[col(k).alias(t) for k, t in zip(keys, tmp)]).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1).drop(n)
    return df.join(many, reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(t)) for k, t in zip(keys, tmp)]), "left_semi")


def _sorted(names: list[str], ascending: bool | list[bool]) -> list:
    up = ascending if isinstance(ascending, list) else [ascending] * len(names)
    return [col(n).asc_nulls_last() if a else col(n).desc_nulls_last() for n, a in zip(names, up)]


def take_first(df: DataFrame, subset: Any, by: Any, ascending: bool | list[bool] = True, order_by=None) -> DataFrame:
    """The first row of each ``subset`` by ``by``; ``order_by`` breaks ties."""
    no_stream(df, "take_first")
    keys, by = listed(subset), listed(by)
    check_column(df, keys + by)
    (n,) = free(df, "n")
    w = Window.partitionBy(*[col(k) for k in keys]).orderBy(*_sorted(by, ascending), *order_keys(order_by))
    return df.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n)


def groupby_topk(df: DataFrame, by: Any, column: str, k: int, dropna: bool = True, ascending: bool = True, ignore_index: bool = True, order_by=None) -> DataFrame:
    """The k least (or greatest) rows of each group; missing values rank last."""
    no_stream(df, "groupby_topk")
    if k < 1:
        raise ValueError("k must be 1 or more")
    keys = listed(by)
    check_column(df, [*keys, column])
    (n,) = free(df, "n")
    if dropna:
        for key in keys:
            df = df.where(~missing(df, key))
    v = F.when(~missing(df, column), col(column))
    w = Window.partitionBy(*[col(x) for x in keys]).orderBy(v.asc_nulls_last() if ascending else v.desc_nulls_last(), *order_keys(order_by))
    return df.withColumn(n, F.row_number().over(w)).where(F.col(n) <= k).drop(n)


def shuffle(df: DataFrame, random_state: int | None = None, reset_index: bool = True) -> DataFrame:
    no_stream(df, "shuffle")
    return df.orderBy(F.rand(random_state))


def sort_column_value_order(df: DataFrame, column: str, column_value_order: dict, columns: Any = None) -> DataFrame:
    """Sorted by the rank given to each value, unranked ones last, then by further columns."""
    if not column_value_order:
        raise ValueError("the order of values is empty")
    check_column(df, [column, *listed(columns)])
    rank = F.lit(None).cast("double")
    for value, r in column_value_order.items():
        rank = F.when(col(column) == F.lit(value), F.lit(float(r))).otherwise(rank)
    return df.orderBy(rank.asc_nulls_last(), *[col(c).asc_nulls_last() for c in listed(columns)])


def natural_key(c):
    """Digits count as numbers, what stands between them as text: an array that sorts naturally."""
    parts = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"))
    number = lambda x: F.coalesce(x.try_cast("decimal(38,0)"), F.lit(-1).cast("decimal(38,0)"))
    return F.transform(parts, lambda x: F.struct(F.when(x.rlike(r"^\d"), 0).otherwise(1).alias("k"), number(x).alias("n"), x.alias("s")))


def sort_naturally(df: DataFrame, column_name: str, ascending: bool = True) -> DataFrame:
    check_column(df, column_name)
    key = natural_key(col(column_name).cast("string"))
    return df.orderBy(key.asc_nulls_last() if ascending else key.desc_nulls_last())


