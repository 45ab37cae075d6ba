"""Joins on inequalities, completion of combinations, products.

conditional_join puts equalities into the join's keys (hash or sort-merge join with the rest as a
residual). Without equalities:

- a point that must lie in an interval of the other side is joined over buckets of the number line. An
  interval's length gives its level, a power of two not below it, and it is copied to the two buckets of
  that width it can touch; a point is copied once to each level there is. So each pair is found once, by one equi-join, however
  intervals of different lengths are mixed;
- the first or last match of a point in intervals, whether there is one, and how many there are, are found without
  pairs: values that repeat count once, the line is cut into chunks of bounded numbers of ends and points, an interval is
  cut at the borders of its first and last chunk, and what covers whole chunks is added up by chunk (`_swept`). Work is
  of the size of the tables, however many pairs there are;
- the first or last match of a single inequality is a running minimum over both sides sorted by the
  compared value (equalities may be there, too); no pairs are made;
- whether any row matches a single inequality is a comparison with the other side's least or greatest value.

What is left (all pairs of a single inequality, two inequalities that make no interval) is Spark's nested
loop, whose work is of the size of the output or, in the last case, of the product.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import FLOATS, NUMERIC, check, check_column, col, free, listed, no_stream, numbered, resolve, stable

OPS = {">", ">=", "<", "<=", "==", "!="}
HOWS = {"inner", "left", "right", "outer", "left_semi", "left_anti"}


def _family(t: T.DataType) -> str:
    if isinstance(t, NUMERIC):
        return "number"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    if isinstance(t, T.DayTimeIntervalType):
        return "span"
    return t.simpleString()


def _checked(df: DataFrame, right: DataFrame, conditions: tuple, how: str, keep: str, equal_only: bool = False) -> None:
    if not isinstance(right, DataFrame):
        raise TypeError("right must be a DataFrame")
    if not conditions:
        raise ValueError("give at least one condition")
    for c in conditions:
        if not isinstance(c, tuple):
            raise TypeError("a condition is a tuple (left column, right column, operator)")
        if len(c) != 3:
            raise ValueError("a condition has three parts")
    for a, b, op in conditions:
        check("left column", a, [str])
        check("right column", b, [str])
        check_column(df, a)
        check_column(right, b)
        if op not in OPS:
            raise ValueError(f"operator {op!r} is none of {sorted(OPS)}")
    if not equal_only and all(op == "==" for *_, op in conditions):
        raise ValueError("give at least one condition that is no equality")
    if how not in HOWS:
        raise ValueError(f"how is one of {sorted(HOWS)}")
    if keep not in ("all", "first", "last"):
        raise ValueError("keep is all, first or last")
    for a, b, op in conditions:
        x, y = _family(df.schema[a].dataType), _family(right.schema[b].dataType)
        if x != y or op != "==" and op != "!=" and x not in ("number", "time", "span"):
            raise ValueError(f"{a!r} and {b!r} can't be compared by {op}")


def _value(c: Column, t: T.DataType) -> Column:
    return F.when(~F.isnan(c), c) if isinstance(t, FLOATS) else c


def _condition(op: str, a: Column, b: Column) -> Column:
    if op == "==":
        return a.eqNullSafe(b)
    if op == "!=":
        return (a != b) | a.isNull() | b.isNull()
    return {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


def _number(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.DateType):
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("double")
    if isinstance(t, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c).cast("double")
    if isinstance(t, T.TimestampType):
        return F.unix_micros(c).cast("double")
    return c.cast("double")


def _interval(conditions: tuple, L: DataFrame, R: DataFrame) -> tuple | None:
    """(point side, point column, low column, high column) of the first pair of conditions that puts a point into an interval."""
    if any(op == "==" for *_, op in conditions):
        return None
    kinds = [("span" if isinstance(L.schema[a].dataType, T.DayTimeIntervalType) else "", a, b, op) for a, b, op in conditions]
    if any(k for k, *_ in kinds):
        return None
    for _, a, b, op in kinds:
        for _, a2, b2, op2 in kinds:
            if op in (">", ">=") and op2 in ("<", "<="):
                if a == a2:
                    return ("left", a, b, b2)
                if b == b2:
                    return ("right", b, a2, a)
    return None


def _levelled(L: DataFrame, R: DataFrame, plan: tuple, width: float | None) -> tuple[DataFrame, DataFrame, list[int]]:
    """Points (``at_`` is null for those that can match nothing) and intervals with ``level_`` and ``bucket_``, and the levels."""
    side, p, lo, hi = plan
    points, spans = (L, R) if side == "left" else (R, L)
    big = F.lit(1.7e308)
    num = lambda d, c: _number(_value(col(c), d.schema[c].dataType), d.schema[c].dataType)
    end = lambda c: F.greatest(-big, F.least(big, num(spans, c)))
    s = spans.where(num(spans, lo).isNotNull() & num(spans, hi).isNotNull()).withColumns({"lo_": end(lo), "hi_": end(hi)}).where("lo_ <= hi_")
    length = F.least(big, F.col("hi_") - F.col("lo_"))
    level = F.greatest(F.lit(-1000), F.ceil(F.log2(F.when(length > 0, length))).cast("int"))
    if width is None:
        got = s.agg(F.percentile_approx(level, 0.5), F.collect_set(level)).first()
        least = got[0] if got[0] is not None else 0
        levels = sorted({max(least, x) for x in got[1]} | {least})
    else:
        least = math.ceil(math.log2(width))
        levels = sorted({max(least, r[0]) for r in s.select(level.alias("v")).where("v is not null").distinct().collect()} | {least})
    bucket = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("level_"))).cast("long")
    s = s.withColumn("level_", F.greatest(F.lit(least), F.coalesce(level, F.lit(least)))).withColumn("bucket_", F.explode(F.sequence(bucket(F.col("lo_")), bucket(F.col("hi_")))))
    pts = points.withColumn("at_", F.greatest(-big, F.least(big, num(points, p))))
    pts = pts.withColumn("level_", F.lit(levels[0]) if len(levels) == 1 else F.explode(F.array(*[F.lit(x) for x in levels])))
    pts = pts.withColumn("bucket_", F.when(num(points, p).isNotNull(), bucket(F.col("at_"))))
    return pts, s.drop("lo_", "hi_"), levels


def _bucketed(L: DataFrame, R: DataFrame, plan: tuple, cond: Column, width: float | None) -> DataFrame:
    """Inner join over buckets."""
    pts, spans, _ = _levelled(L, R, plan, width)
    mine = spans.withColumnsRenamed({"level_": "s_level", "bucket_": "s_bucket"})
    return pts.join(mine, (F.col("level_") == F.col("s_level")) & (F.col("bucket_") == F.col("s_bucket")) & cond).select(*L.columns, *R.columns)


#: Points and ends of intervals a chunk of the number line has, about; one task sweeps a chunk at a time.
CHUNK = 1 << 19


def _line(conditions: tuple, L: DataFrame, R: DataFrame) -> tuple | None:
    """(left column, (low column, operator), (high column, operator), type to compare in), where a match is an interval of the right side that the left row's value lies in."""
    by = {("low" if op in (">", ">=") else "high" if op in ("<", "<=") else ""): (a, b, op) for a, b, op in conditions}
    if len(conditions) != 2 or set(by) != {"low", "high"} or by["low"][0] != by["high"][0]:
        return None
    (a, lo, lo_op), (_, hi, hi_op) = by["low"], by["high"]
    types = [L.schema[a].dataType, R.schema[lo].dataType, R.schema[hi].dataType]
    whole = all(isinstance(t, T.IntegralType) for t in types)
    if not whole and types[1] != types[2]:
        return None
    t = T.LongType() if whole else L.select(col(a).alias("v_")).union(R.select(col(lo).alias("v_"))).schema["v_"].dataType
    known = isinstance(t, (T.IntegralType, *FLOATS, T.DateType, T.TimestampType, T.TimestampNTZType)) or isinstance(t, T.DecimalType) and t.precision <= 18
    return (a, (lo, lo_op), (hi, hi_op), t) if known else None


def _coded(d: DataFrame, name: str, t: T.DataType) -> Column:
    """The column as a long or double of the same order as in type ``t``."""
    c = _value(col(name), d.schema[name].dataType).cast(t)
    if isinstance(t, FLOATS):
        return c.cast("double") + F.lit(0.0)
    if isinstance(t, T.DecimalType):
        return (c * F.lit(10**t.scale).cast("decimal(19, 0)")).cast("long")
    if isinstance(t, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(t, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    return F.unix_micros(c) if isinstance(t, T.TimestampType) else c


def _place(v: Column, borders: list, first: int = 0) -> Column:
    """How many of the sorted borders aren't above ``v``."""
    if not borders:
        return F.lit(first)
    m = len(borders) // 2
    return F.when(v < F.lit(borders[m]), _place(v, borders[:m], first)).otherwise(_place(v, borders[m + 1 :], first + m + 1))


def _covering(places: int, a: np.ndarray, b: np.ndarray, times: np.ndarray, rank: np.ndarray, least: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``places``: how many spans [a, b) cover it, and the least (else greatest) rank of one that does.

    A span is two blocks, which may overlap, of the power of two that fits into it; blocks hand their best to their halves.
    """
    pick, none = (np.minimum, np.iinfo(np.int64).max) if least else (np.maximum, np.iinfo(np.int64).min)
    steps, best = np.zeros(places + 1, np.int64), np.full(places, none, np.int64)
    np.add.at(steps, a, times)
    np.subtract.at(steps, b, times)
    level = np.frexp((b - a).astype(np.float64))[1] - 1
    for k in range(int(level.max()) if len(level) else -1, -1, -1):
        i, width = level == k, 1 << k
        handed = best.copy()
        if width < places:
            pick(best[width:], handed[:-width], out=best[width:])
        pick.at(best, a[i], rank[i])
        pick.at(best, b[i] - width, rank[i])
    return np.cumsum(steps)[:places], best


def _swept(points: DataFrame, spans: DataFrame, lo_op: str, hi_op: str, least: bool) -> DataFrame:
    """(v_, n_, rank_): values of ``points`` that lie in any of ``spans`` (lo_, hi_, rank_), with the number of these and their least (else greatest) rank; written once."""
    take = F.min if least else F.max
    points = stable(points.where("v_ is not null").distinct())
    spans = stable(spans.where("lo_ <= hi_").groupBy("lo_", "hi_").agg(F.count(F.lit(1)).alias("n_"), take("rank_").alias("rank_")))
    kind = points.schema["v_"].dataType.simpleString()
    borders, wanted = [], math.ceil((points.count() + 2 * spans.count()) / CHUNK)
    if wanted > 1:
        ends = points.union(spans.select("lo_")).union(spans.select("hi_"))
        borders = sorted(set(ends.agg(F.percentile_approx("v_", [i / wanted for i in range(1, wanted)], 20 * wanted)).first()[0]))
    chunks = len(borders) + 1
    points = points.withColumn("chunk_", _place(F.col("v_"), borders))
    spans = spans.withColumns({"from_": _place(F.col("lo_"), borders), "to_": _place(F.col("hi_"), borders)})
    piece = lambda at, lo, hi: F.struct(F.col(at).alias("chunk_"), (F.col("lo_") if lo else F.lit(None).cast(kind)).alias("lo_"), (F.col("hi_") if hi else F.lit(None).cast(kind)).alias("hi_"))
    cut = F.when(F.col("from_") == F.col("to_"), F.array(piece("from_", True, True))).otherwise(F.array(piece("from_", True, False), piece("to_", False, True)))
    pieces = spans.select(F.inline(cut), "n_", "rank_").groupBy("chunk_", "lo_", "hi_").agg(F.sum("n_").alias("n_"), take("rank_").alias("rank_"))
    whole_n, whole_rank = np.zeros(chunks, np.int64), np.full(chunks, np.iinfo(np.int64).max if least else np.iinfo(np.int64).min, np.int64)
    if chunks > 2:
        # chunks that intervals cover whole: blocks of powers of two and steps of the number, a few rows a chunk
        level = F.length(F.bin(F.col("to_") - F.col("from_") - 1)) - 1
        block = lambda k, at, n, rank: F.struct(k.alias("k_"), at.alias("at_"), n.alias("n_"), rank.alias("rank_"))
        nothing, a, b, zero = F.lit(None).cast("long"), F.col("from_") + 1, F.col("to_"), F.lit(0).cast("long")
        blocks = F.array(block(F.lit(-1), a, F.col("n_"), nothing), block(F.lit(-1), b, -F.col("n_"), nothing), block(level, a, zero, F.col("rank_")), block(level, (b - F.pow(F.lit(2), level)).cast("int"), zero, F.col("rank_")))
        got = spans.where("to_ - from_ > 1").select(F.inline(blocks)).groupBy("k_", "at_").agg(F.sum("n_").alias("n_"), take("rank_").alias("rank_")).collect()
        steps, full = np.zeros(chunks + 1, np.int64), [r for r in got if r["k_"] >= 0]
        for r in got:
            steps[r["at_"]] += r["n_"]
        start = np.array([r["at_"] for r in full], np.int64)
        whole_rank = _covering(chunks, start, start + np.array([1 << r["k_"] for r in full], np.int64), np.zeros(len(full), np.int64), np.array([r["rank_"] for r in full], np.int64), least)[1]
        whole_n = np.cumsum(steps)[:chunks]

    def sweep(here: pa.Table, over: pa.Table) -> pa.Table:
        v = np.sort(here["v_"].to_numpy())
        c = here["chunk_"][0].as_py() if len(v) else 0
        at = lambda name, op, left, beyond: np.where(over[name].is_null().to_numpy(), beyond, np.searchsorted(v, over[name].fill_null(0).to_numpy(), "left" if op == left else "right")).astype(np.int64)
        a, b = at("lo_", lo_op, ">=", 0), at("hi_", hi_op, "<", len(v))
        some = a < b
        n, rank = _covering(len(v), a[some], b[some], over["n_"].to_numpy()[some], over["rank_"].to_numpy()[some], least)
        n, rank = n + whole_n[c], (np.minimum if least else np.maximum)(rank, whole_rank[c])
        return pa.table({"v_": v[n > 0], "n_": n[n > 0], "rank_": rank[n > 0]})

    return stable(points.groupBy("chunk_").cogroup(pieces.groupBy("chunk_")).applyInArrow(sweep, f"v_ {kind}, n_ bigint, rank_ bigint"))


def _sized(few: DataFrame, rows: int) -> DataFrame:
    """The side of a join that has ``rows`` rows: broadcast if they surely take no more than 32 MB, else merged, whatever a plan's estimates say."""
    fields = lambda t: sum(fields(f.dataType) for f in t.fields) if isinstance(t, T.StructType) else 1 if isinstance(t, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)) else math.inf
    return F.broadcast(few) if rows * (64 + 16 * fields(few.schema)) <= 1 << 25 else few.hint("merge")


def _inside(L: DataFrame, R: DataFrame, line: tuple, rank: Column, least: bool = True) -> tuple[DataFrame, DataFrame]:
    """L with its value as ``at_``, and _swept of these and R's intervals."""
    a, (lo, lo_op), (hi, hi_op), t = line
    L = L.withColumn("at_", _coded(L, a, t))
    return L, _swept(L.select(F.col("at_").alias("v_")), R.select(_coded(R, lo, t).alias("lo_"), _coded(R, hi, t).alias("hi_"), rank.alias("rank_")), lo_op, hi_op, least)


def _parts(conditions: tuple, L: DataFrame, R: DataFrame) -> Column:
    return reduce(lambda x, y: x & y, [_condition(op, _value(col(a), L.schema[a].dataType), _value(col(b), R.schema[b].dataType)) for a, b, op in conditions])


def _pairs(L: DataFrame, R: DataFrame, conditions: tuple, range_width: float | str | None) -> tuple[DataFrame | None, Column]:
    cond = _parts(conditions, L, R)
    plan = None if range_width is None else _interval(conditions, L, R)
    return _bucketed(L, R, plan, cond, None if range_width == "auto" else range_width) if plan else None, cond


def _split(conditions: tuple) -> tuple[list, list]:
    return [c for c in conditions if c[2] == "=="], [c for c in conditions if c[2] != "=="]


def _exists(L: DataFrame, R: DataFrame, conditions: tuple, anti: bool, range_width: float | str | None) -> DataFrame:
    """Rows of L that some row of R matches, or that none does."""
    equal, other = _split(conditions)
    how = "left_anti" if anti else "left_semi"
    plan = None if range_width is None else _interval(conditions, L, R)
    if len(other) == 1:
        a, b, op = other[0]
        x, y = _value(col(a), L.schema[a].dataType), _value(col(b), R.schema[b].dataType)
        wanted = [F.min(y).alias("least_"), F.max(y).alias("most_"), F.count(F.lit(1)).alias("all_"), F.count(y).alias("known_")]
        if equal:
            keys = [f"k{i}_" for i in range(len(equal))]
            one = R.groupBy(*[_value(col(c), R.schema[c].dataType).alias(k) for (_, c, _), k in zip(equal, keys)]).agg(*wanted)
            out = L.join(one, reduce(lambda p, q: p & q, [_value(col(c), L.schema[c].dataType).eqNullSafe(F.col(k)) for (c, _, _), k in zip(equal, keys)]), "left")
            least, most, rows, known_ = (F.col(c) for c in ("least_", "most_", "all_", "known_"))
        else:
            out = L
            least, most, rows, known_ = (R.select(c).scalar() for c in wanted)
        hit = {">": x > least, ">=": x >= least, "<": x < most, "<=": x <= most, "!=": (rows > 0) & (x.isNull() | (rows > known_) | (x != least) | (x != most))}[op]
        hit = F.coalesce(hit, F.lit(False))
        return out.where(~hit if anti else hit).select(*L.columns)
    if plan is None:
        return L.join(R, _parts(conditions, L, R), how)
    line = _line(conditions, L, R)
    if line:
        L, found = _inside(stable(L), R, line, F.lit(0).cast("long"))
        return L.join(_sized(found.select("v_"), found.count()), F.col("at_") == F.col("v_"), how).drop("at_")
    point_left = plan[0] == "left"
    if not point_left:
        L = stable(L.withColumn("lid", F.monotonically_increasing_id()))
        matched = _bucketed(L, R, plan, _parts(conditions, L, R), None if range_width == "auto" else range_width).select("lid").distinct()
        return L.join(matched, "lid", how).drop("lid")
    pts, spans, levels = _levelled(L, R, plan, None if range_width == "auto" else range_width)
    mine = spans.withColumnsRenamed({"level_": "s_level", "bucket_": "s_bucket"})
    near = lambda d: (d["level_"] == mine["s_level"]) & (d["bucket_"] == mine["s_bucket"]) & _parts(conditions, L, R)
    if len(levels) == 1:
        return pts.join(mine, near(pts), how).select(*L.columns)
    L = stable(L.withColumn("lid", F.monotonically_increasing_id()))
    pts, _, _ = _levelled(L, R, plan, None if range_width == "auto" else range_width)
    matched = pts.join(mine, near(pts), "left_semi").select("lid").distinct()
    return L.join(matched, "lid", how).drop("lid")


def _nearest(L: DataFrame, R: DataFrame, conditions: tuple, keep: str) -> DataFrame:
    """Every row of L with ``best``: the first or last row of R, by its column ``rid``, that meets the one inequality and all equalities."""
    equal, ((a, b, op),) = _split(conditions)
    keys = [f"k{i}_" for i in range(len(equal))]
    row = lambda d, v, eq, kind, l, best: d.select(_value(col(v), d.schema[v].dataType).alias("v_"), *[_value(col(c), d.schema[c].dataType).alias(k) for c, k in zip(eq, keys)], F.lit(kind).alias("kind_"), l.alias("l_"), best.alias("best_"))
    left = F.struct(*[col(c) for c in L.columns])
    right = F.struct(F.col("rid"), *[col(c) for c in R.columns if c != "rid"])
    kinds = (0, 1) if op in ("<", ">") else (1, 0)
    right_type, left_type = R.select(right.alias("x")).schema["x"].dataType, L.select(left.alias("x")).schema["x"].dataType
    both = row(L, a, [x for x, _, _ in equal], kinds[0], left, F.lit(None).cast(right_type)).unionByName(row(R, b, [y for _, y, _ in equal], kinds[1], F.lit(None).cast(left_type), right).where("v_ is not null"))
    up = op in (">", ">=")
    # rows without a value come before all others, where no match has been seen
    order = [F.col("v_").asc_nulls_first() if up else F.col("v_").desc_nulls_first(), F.col("kind_").asc()]
    take, of = (F.min, F.least) if keep == "first" else (F.max, F.greatest)
    if equal:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return both.withColumn("best_", take("best_").over(w)).where("l_ is not null").select("l_.*", F.col("best_").alias("best"))
    s = stable(both.orderBy(*order).withColumn("m_", F.monotonically_increasing_id())).withColumn("p_", F.shiftright("m_", 33))
    # a row a partition: the best match of all partitions before
    before = s.groupBy("p_").agg(take("best_").alias("x_")).select(F.col("p_").alias("q_"), take("x_").over(Window.partitionBy(F.lit(0)).orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)).alias("x_"))
    w = Window.partitionBy("p_").orderBy("m_").rowsBetween(Window.unboundedPreceding, 0)
    run = s.withColumn("best_", take("best_").over(w)).where("l_ is not null").join(F.broadcast(before), F.col("p_") == F.col("q_"))
    return run.select("l_.*", of("best_", "x_").alias("best"))


def _sortable(d: DataFrame) -> bool:
    plain = lambda t: not isinstance(t, (T.MapType, T.VariantType)) and all(plain(x) for x in ([t.elementType] if isinstance(t, T.ArrayType) else [f.dataType for f in t.fields] if isinstance(t, T.StructType) else []))
    return all(plain(f.dataType) for f in d.schema.fields)


def conditional_join(df: DataFrame, right: DataFrame, *conditions: tuple[str, str, str], how: str = "inner", df_columns: Any = slice(None), right_columns: Any = slice(None), keep: str = "all", indicator: bool | str = False, use_numba: bool = False, force: bool = False, order_by=None, left_order_by=None, range_width: float | str | None = "auto", suffixes: tuple[str, str] = ("left_", "right_"), matches: str | None = None) -> DataFrame:
    """Pairs of rows that meet all conditions (left column, right column, operator).

    ``keep`` first or last is by ``order_by`` on the right side, before outer rows are added: with right
    and outer joins a right row that matched but wasn't kept comes back alone. Missing values meet no
    inequality, equal each other in ``==``, and differ from everything in ``!=``. Columns that both sides have get
    the prefixes ``suffixes``. ``range_width``: least width of the buckets for interval joins, "auto" (by the median of the intervals' lengths) or None (no
    rewrite). ``how`` may be left_semi or left_anti, too. A side that is read more than once by its rows' numbers is
    written once (see ``core.stable``); ``left_order_by``, a unique key, saves that for the left side. ``use_numba`` and ``force`` change nothing.
    ``matches``, with ``keep`` first or last: a column with the number of right rows that meet the conditions, kept or not (0 for a left
    row without any, null for a right row that comes back alone).
    """
    no_stream(df, "conditional_join")
    _checked(df, right, conditions, how, keep)
    check("indicator", indicator, [bool, str])
    if df_columns is None and right_columns is None:
        raise ValueError("no columns are left of either side")
    check("matches", matches, [str, type(None)])
    if matches is not None and (keep == "all" or how in ("left_semi", "left_anti")):
        raise ValueError("matches are counted where the first or last is kept")
    flag = "_merge" if indicator is True else indicator or None
    if flag and flag in df.columns + right.columns:
        raise ValueError(f"the indicator's name {flag!r} is taken")
    if matches is not None and matches in [*df.columns, *right.columns, flag]:
        raise ValueError(f"the name {matches!r} is taken")
    lname, rname = {c: f"l{i}" for i, c in enumerate(df.columns)}, {c: f"r{i}" for i, c in enumerate(right.columns)}
    L, R = df.toDF(*lname.values()), right.toDF(*rname.values())
    conds = tuple((lname[a], rname[b], op) for a, b, op in conditions)
    if how in ("left_semi", "left_anti"):
        out = _exists(L, R, conds, how == "left_anti", range_width)
        return out.select(*[col(lname[c]).alias(c) for c in resolve(df, df_columns)])
    # columns that aren't asked for don't travel
    lcols = [] if df_columns is None else resolve(df, df_columns)
    rcols = [] if right_columns is None else resolve(right, right_columns)
    named = lambda names, given_: [col(names[k]) if isinstance(k, str) else k for k in listed(given_)]
    used = lambda names, cols, at, given_: [c for k, c in names.items() if k in set(cols) | set(x for x in listed(given_) if isinstance(x, str)) or c in {x[at] for x in conds}]
    if not any(isinstance(x, Column) for x in [*listed(order_by), *listed(left_order_by)]):
        L, R = L.select(*used(lname, lcols, 0, left_order_by)), R.select(*used(rname, rcols, 1, order_by))
    unmatched_left, unmatched_right = how in ("left", "outer"), how in ("right", "outer")
    interval = range_width is not None and _interval(conds, L, R)
    line = _line(conds, L, R) if interval and keep != "all" else None
    single = keep != "all" and matches is None and len(_split(conds)[1]) == 1 and _split(conds)[1][0][2] != "!=" and _sortable(R) and _sortable(L)
    if keep != "all" or unmatched_right and interval:
        if line and order_by is not None:
            R = numbered(R, "rk", named(rname, order_by))
        elif unmatched_right or order_by is None and keep != "all":
            R = stable(R.withColumn("rk", F.monotonically_increasing_id()))
        if keep != "all":
            R = R.withColumn("rid", F.struct(*named(rname, order_by)) if order_by is not None else F.col("rk"))
    if line:
        L = L if left_order_by is not None else stable(L)
    elif (keep != "all" and not single) or unmatched_left and interval:
        L = L.withColumn("lid", F.struct(*named(lname, left_order_by))) if left_order_by is not None else stable(L.withColumn("lid", F.monotonically_increasing_id()))
    mark = lambda d, *flags: d.withColumns({f: F.lit(1) for f in flags})
    rest = [c for c in R.columns]
    if keep == "all" and not interval:
        both = mark(L, "lf").join(mark(R, "rf"), _parts(conds, L, R), {"outer": "full_outer"}.get(how, how))
    elif line:
        L, found = _inside(L, R, line, F.col("rk"), keep == "first")
        many = found.count()
        best = R.select(F.col("rk").alias("rank_"), F.struct(*[col(c) for c in rest]).alias("best")).join(_sized(found, many), "rank_").select("v_", "n_", "best")
        both = L.join(_sized(best, many), F.col("at_") == F.col("v_"), "left" if unmatched_left else "inner")
        both = both.select(*L.columns, "n_", F.lit(1).alias("lf"), F.when(F.col("best").isNotNull(), 1).alias("rf"), *[F.col("best")[c].alias(c) for c in rest])
        if unmatched_right:
            both = both.unionByName(mark(R.join(_sized(found.select(F.col("rank_").alias("rk")), many), "rk", "left_anti"), "rf"), allowMissingColumns=True)
    elif single:
        got = _nearest(L, R, conds, keep)
        got = got if unmatched_left else got.where("best is not null")
        both = got.select(*L.columns, F.lit(1).alias("lf"), F.when(F.col("best").isNotNull(), 1).alias("rf"), *[F.col("best")[c].alias(c) for c in rest])
        if unmatched_right:
            both = both.unionByName(mark(R.join(both.where("rk is not null").select("rk"), "rk", "left_anti"), "rf"), allowMissingColumns=True)
    else:
        inner, cond = _pairs(L, R, conds, range_width)
        inner = L.join(R, cond) if inner is None else inner
        if keep != "all":
            w = Window.partitionBy("lid").orderBy(F.col("rid").asc() if keep == "first" else F.col("rid").desc())
            if matches is not None:
                inner = inner.withColumn("n_", F.count(F.lit(1)).over(Window.partitionBy("lid")))
            inner = inner.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
        both = mark(inner, "lf", "rf")
        if unmatched_left:
            both = both.unionByName(mark(L.join(inner.select("lid").distinct(), "lid", "left_anti"), "lf"), allowMissingColumns=True)
        if unmatched_right:
            both = both.unionByName(mark(R.join(inner.select("rk").distinct(), "rk", "left_anti"), "rf"), allowMissingColumns=True)
    clash = set(lcols) & set(rcols)
    out = [col(lname[c]).alias(suffixes[0] + c if c in clash else c) for c in lcols] + [col(rname[c]).alias(suffixes[1] + c if c in clash else c) for c in rcols]
    if flag:
        out.append(F.when(F.col("lf").isNull(), "right_only").when(F.col("rf").isNull(), "left_only").otherwise("both").alias(flag))
    if matches is not None:
        out.append(F.when(F.col("lf").isNotNull(), F.coalesce(F.col("n_"), F.lit(0).cast("long"))).alias(matches))
    return both.select(*out)


def get_join_indices(df: DataFrame, right: DataFrame, conditions: list[tuple], keep: str = "all", order_by=None, left_order_by=None, return_ragged_arrays: bool = False, range_width: float | str | None = "auto") -> DataFrame:
    """(left_index, right_index): places, from 0, of matching rows in ``left_order_by`` and ``order_by``; ragged: one row a left row with a sorted array."""
    no_stream(df, "get_join_indices")
    _checked(df, right, tuple(conditions), "inner", keep, equal_only=True)
    ln, rn = {c: f"l{i}" for i, c in enumerate(df.columns)}, {c: f"r{i}" for i, c in enumerate(right.columns)}

    def placed(d: DataFrame, names: dict, given, out: str) -> DataFrame:
        return numbered(d, "pos_", [col(k) if isinstance(k, str) else k for k in listed(given)]).toDF(*names.values(), out)

    L, R = placed(df, ln, left_order_by, "left_index"), placed(right, rn, order_by, "right_index")
    inner, cond = _pairs(L, R, tuple((ln[a], rn[b], op) for a, b, op in conditions), range_width)
    pairs = (L.join(R, cond) if inner is None else inner).select("left_index", "right_index")
    if keep != "all":
        pairs = pairs.groupBy("left_index").agg((F.min if keep == "first" else F.max)("right_index").alias("right_index"))
    return pairs.groupBy("left_index").agg(F.sort_array(F.collect_list("right_index")).alias("right_index")) if return_ragged_arrays else pairs


# -- products and completion -----------------------------------------------------------------


def _inputs(spark, x: Any, df: DataFrame | None) -> list[DataFrame]:
    if isinstance(x, DataFrame):
        return [x]
    if isinstance(x, dict):
        out = []
        for name, values in x.items():
            if isinstance(values, DataFrame):
                if len(values.columns) != 1:
                    raise ValueError("a table in a dict has one column")
                out.append(values.toDF(name))
                continue
            values = list(values(df) if callable(values) else values)
            if not values:
                raise ValueError(f"{name!r} has no values")
            out.append(spark.createDataFrame([(v,) for v in values], [name]))
        return out
    if df is not None and callable(x):
        return _inputs(spark, x(df), df)
    if df is not None and isinstance(x, str):
        return [df.select(*[col(c) for c in resolve(df, x)]).distinct()]
    if df is not None and isinstance(x, (list, tuple)):
        return [df.select(*[col(c) for c in resolve(df, list(x))]).distinct()]
    raise TypeError(f"{type(x).__name__} can't be expanded")


def _product(parts: list[DataFrame]) -> DataFrame:
    names = [c for p in parts for c in p.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"names stand twice: {names}")
    return reduce(lambda a, b: a.crossJoin(b), parts)


def cartesian_product(*inputs: Any, sort: bool = False, spark=None) -> DataFrame:
    """All combinations of the rows of tables and of the values in dicts."""
    if not inputs:
        raise ValueError("give at least one input")
    spark = spark or next((x.sparkSession for x in inputs if isinstance(x, DataFrame)), None)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.active()
    out = _product([p for x in inputs for p in _inputs(spark, x, None)])
    return out.orderBy(*[col(c).asc_nulls_last() for c in out.columns]) if sort else out


def expand_grid(df: DataFrame | None = None, df_key: str | None = None, *, others: dict) -> DataFrame:
    """All combinations of named inputs; a table's columns are named ``key_column``, a list's column ``key``."""
    if df is not None and df_key is None:
        raise KeyError("a table needs df_key")
    check("others", others, [dict])
    named = ({df_key: df} if df is not None else {}) | others
    parts = []
    for k, v in named.items():
        parts.append({k: v} if not isinstance(v, DataFrame) else v.toDF(*[f"{k}_{c}" for c in v.columns]))
    return cartesian_product(*parts, spark=df.sparkSession if df is not None else None)


def expand(df: DataFrame, *columns: Any, sort: bool = False, by: Any = None) -> DataFrame:
    """Combinations of distinct values (a name), distinct rows (a list), given values (a dict) or of a table; ``by`` does it inside groups."""
    no_stream(df, "expand")
    if not columns:
        raise ValueError("give at least one entry")
    if by is None:
        out = _product([p for x in columns for p in _inputs(df.sparkSession, x, df)])
    else:
        keys = listed(by)
        check_column(df, keys)
        tmp = {k: f"k{i}_" for i, k in enumerate(keys)}
        out = df.select(*[col(k) for k in keys]).distinct()
        for x in columns:
            if isinstance(x, (str, list, tuple)):
                names = resolve(df, x if isinstance(x, str) else list(x))
                part = df.select(*[col(k).alias(tmp[k]) for k in keys], *[col(c) for c in names]).distinct()
                cond = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(tmp[k])) for k in keys])
                out = out.join(part, cond).drop(*tmp.values())
            else:
                out = _product([out, *_inputs(df.sparkSession, x, df)])
        if len(set(out.columns)) < len(out.columns):
            raise ValueError("names stand twice")
    return out.orderBy(*[col(c).asc_nulls_last() for c in out.columns]) if sort else out


def complete(df: DataFrame, *columns: Any, sort: bool = False, by: Any = None, fill_value: Any = None, explicit: bool = True, mode: str = "outer") -> DataFrame:
    """``df`` with a row for each combination of expand(). ``fill_value`` (one value or by column) fills missing values, with ``explicit=False`` those of new rows only.

    ``mode`` left drops rows of ``df`` that are in no combination; outer keeps them.
    """
    no_stream(df, "complete")
    grid = expand(df, *columns, by=by)
    keys = grid.columns
    check_column(df, keys)
    there, *tmp = free(df, "there", *[f"g{i}" for i in range(len(keys))])
    g = grid.distinct().toDF(*tmp)
    data = df.withColumn(there, F.lit(1))
    cond = reduce(lambda a, b: a & b, [F.col(t).eqNullSafe(col(k)) for t, k in zip(tmp, keys)])
    # a key may be null on both sides, so presence is told by marks of each side
    (mark,) = free(data, "in_grid")
    both = g.withColumn(mark, F.lit(1)).join(data, cond, "left" if mode == "left" else "full_outer")
    fills = {} if fill_value is None else dict(fill_value) if isinstance(fill_value, dict) else {c: fill_value for c in df.columns if c not in keys}
    if not isinstance(fill_value, dict):
        fills = {c: v for c, v in fills.items() if _fits(df.schema[c].dataType, v)}
    out = []
    for c in df.columns:
        if c in keys:
            v = F.when(F.col(mark) == 1, F.col(tmp[keys.index(c)])).otherwise(col(c))
        elif c in fills:
            t = df.schema[c].dataType
            f = fills[c] if isinstance(fills[c], Column) else F.lit(fills[c]).cast(t)
            gone = F.col(there).isNull()
            v = F.when(gone, f).otherwise(col(c)) if not explicit else F.coalesce(_value(col(c), t), f)
        else:
            v = col(c)
        out.append(v.alias(c))
    done = both.select(*out)
    return done.orderBy(*[col(c).asc_nulls_last() for c in keys]) if sort else done


def _fits(t: T.DataType, v: Any) -> bool:
    return isinstance(v, Column) or (isinstance(t, T.StringType) == isinstance(v, str) and isinstance(t, T.BooleanType) == isinstance(v, bool))
