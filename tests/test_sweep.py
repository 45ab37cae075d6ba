"""Points in intervals without pairs: chunks of the number line against plain Python."""

import datetime
import decimal
import math
import operator
import random

import pytest
from pyspark.sql import functions as F

from quern import api as q
from quern.operators import joins

OPS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
KINDS = {
    "long": lambda v: v + 2**60,
    "double": lambda v: {-9: -math.inf, 9: math.inf, 8: math.nan, 0: -0.0}.get(v, v / 7),
    "date": lambda v: datetime.date(1970, 1, 1) + datetime.timedelta(v),
    "decimal(18, 18)": lambda v: decimal.Decimal(v).scaleb(-18),
    "decimal(38, 4)": lambda v: decimal.Decimal(v).scaleb(-4),
    "timestamp_ntz": lambda v: datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=v),
}


def tables(spark, kind, seed, n=60):
    r = random.Random(seed)
    some = lambda: None if r.random() < 0.1 else KINDS[kind](r.randint(-9, 9))
    points = [(i, some()) for i in range(n)]
    spans = [(j, r.choice([None, 1, 2, 3]), some(), some()) for j in range(n // 3)] + [(n + j, 1, x, x) for j, x in enumerate([KINDS[kind](0), KINDS[kind](5)])]
    return points, spans, spark.createDataFrame(points, f"i long, x {kind}"), spark.createDataFrame(spans, f"j long, g long, lo {kind}, hi {kind}")


def matches(points, spans, above, below):
    gone = lambda *v: any(x is None or x != x for x in v)
    return {i: [(g is not None, g or 0, j) for j, g, lo, hi in spans if not gone(x, lo, hi) and OPS[above](x, lo) and OPS[below](x, hi)] for i, x in points}


@pytest.mark.parametrize("kind, above, below, how, keep, chunk", [
    ("long", ">=", "<", "outer", "first", 3), ("long", ">", "<=", "right", "last", 1), ("double", ">", "<", "outer", "last", 4), ("double", ">=", "<=", "left", "first", 2),
    ("date", ">=", "<=", "inner", "last", 5), ("decimal(18, 18)", ">", "<=", "outer", "first", 3), ("decimal(38, 4)", ">=", "<", "outer", "first", 3), ("timestamp_ntz", ">=", "<", "right", "first", 7),
])
def test_first_and_last_over_chunks(spark, monkeypatch, kind, above, below, how, keep, chunk):
    monkeypatch.setattr(joins, "CHUNK", chunk)
    points, spans, a, b = tables(spark, kind, chunk)
    want = [(i, (min if keep == "first" else max)(js)[2]) for i, js in matches(points, spans, above, below).items() if js]
    assert want
    kept = {j for _, j in want}
    if how in ("left", "outer"):
        want += [(i, None) for i, _ in points if i not in {i for i, _ in want}]
    if how in ("right", "outer"):
        want += [(None, s[0]) for s in spans if s[0] not in kept]
    got = q.conditional_join(a, b, ("x", "lo", above), ("x", "hi", below), how=how, keep=keep, order_by=["g", "j"], df_columns="i", right_columns="j")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("how, chunk", [("left_semi", 3), ("left_anti", 50)])
def test_exists_over_chunks(spark, monkeypatch, how, chunk):
    monkeypatch.setattr(joins, "CHUNK", chunk)
    points, spans, a, b = tables(spark, "double", 11, 30)
    spans, b = spans[::4], b.where(F.col("j").isin([s[0] for s in spans[::4]]))
    got = q.conditional_join(a, b, ("x", "hi", "<"), ("x", "lo", ">="), how=how, df_columns="i")
    assert sorted(r[0] for r in got.collect()) == sorted(i for i, js in matches(points, spans, ">=", "<").items() if bool(js) == (how == "left_semi"))


def test_no_pairs(spark):
    """Every point in every interval: 10^10 pairs, none of which is made."""
    a = spark.range(100_000).select("id", (F.col("id") % 1000).cast("double").alias("x"))
    b = spark.range(100_000).select(F.col("id").alias("j"), (-F.col("id")).cast("double").alias("lo"), (F.col("id") + 1000).cast("double").alias("hi"))
    conditions = [("x", "lo", ">="), ("x", "hi", "<")]
    got = q.conditional_join(a, b, *conditions, keep="last", order_by="j", left_order_by="id", df_columns="id", right_columns="j")
    assert "bucket_" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.agg(F.count("id"), F.min("j"), F.max("j")).first() == (100_000, 99_999, 99_999)
    got = q.conditional_join(a, b, *conditions, how="left_semi", df_columns="id")
    assert "bucket_" not in got._jdf.queryExecution().executedPlan().toString() and got.count() == 100_000


def test_many_values_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(joins, "CHUNK", 5000)
    a = spark.range(40_000).select("id", (F.col("id") * 7919 % 40_000).cast("double").alias("x"))
    b = spark.range(30_000).select(F.col("id").alias("j"), F.col("id").cast("double").alias("lo"), (F.col("id") + F.col("id") % 20_000).cast("double").alias("hi"))
    got = {r["x"]: r["j"] for r in q.conditional_join(a, b, ("x", "lo", ">="), ("x", "hi", "<="), keep="first", order_by="j", df_columns="x", right_columns="j").collect()}
    want = {}
    left = list(range(40_000))  # next value that has no match yet

    def find(v):
        while v < 40_000 and left[v] != v:
            left[v] = left[left[v]] if left[v] < 40_000 else left[v]
            v = left[v]
        return v

    for j in range(30_000):
        v = find(j)
        while v <= min(j + j % 20_000, 39_999):
            want[float(v)] = j
            left[v] = v + 1
            v = find(v + 1)
    assert got == want


@pytest.mark.parametrize("keep, how, width, chunk", [("first", "outer", "auto", 3), ("last", "left", None, 3), ("last", "inner", "auto", 50)])
def test_matches_are_counted(spark, monkeypatch, keep, how, width, chunk):
    """With width None all pairs are made; the counts are the same."""
    monkeypatch.setattr(joins, "CHUNK", chunk)
    points, spans, a, b = tables(spark, "double", 5)
    found = matches(points, spans, ">=", "<")
    want = [(i, (min if keep == "first" else max)(js)[2], len(js)) for i, js in found.items() if js]
    assert max(n for *_, n in want) > 1
    kept = {j for _, j, _ in want}
    want += [(i, None, 0) for i, js in found.items() if not js and how != "inner"]
    want += [(None, s[0], None) for s in spans if s[0] not in kept and how == "outer"]
    got = q.conditional_join(a, b, ("x", "lo", ">="), ("x", "hi", "<"), how=how, keep=keep, order_by=["g", "j"], df_columns="i", right_columns="j", matches="n", range_width=width)
    assert got.columns == ["i", "j", "n"] and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_matches_errors(spark):
    a = spark.createDataFrame([(1, 5)], "k long, v long")
    b = a.toDF("m", "w")
    for more in ({}, {"keep": "first", "how": "left_semi"}, {"keep": "first", "matches": "w"}):
        with pytest.raises(ValueError):
            q.conditional_join(a, b, ("v", "w", "<="), **{"matches": "n", **more})
    assert q.conditional_join(a, b, ("v", "w", "<="), keep="first", order_by="m", df_columns="k", right_columns="m", matches="n").collect() == [(1, 1, 1)]


def test_range_query_makes_no_pairs(spark, tmp_path):
    """3,000 events of one value: 9 million pairs, which aren't rows of the plan; ids may repeat or be null."""
    from quern.plans import catalog

    rows = [(i, 1.0) for i in range(3000)] + [(7, 1.04), (None, 1.04), (None, 2.0), (9000, None)]
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["conditional_join_range"](spark, str(tmp_path))
    assert "bucket_" not in got._jdf.queryExecution().executedPlan().toString()
    want = {i: (3000, 0) for i in range(3000)} | {7: (6002, 0), None: (3003, 0)}
    assert {r["event_id"]: (r["n"], r["first_id"]) for r in got.collect()} == want
