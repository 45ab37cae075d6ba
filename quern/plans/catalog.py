"""Queries over whole tables, one or more for each operator, and the SQL they are held against."""

from __future__ import annotations

import io
import re
import uuid
import warnings
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import api as q
from ..core import categories, numbered, stable
from ..functions import guards, mathx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
LINE_SQL = ", ".join(LINE)
#: Tables have no nulls; low values stand for them, here and in SQL alike.
GAPS = "SELECT event_id, ts, user_id, event_type, CASE WHEN value >= 20 THEN value END AS v FROM events"


def gaps(t: Tables) -> DataFrame:
    return t.events.select("event_id", "ts", "user_id", "event_type", F.when(F.col("value") >= 20, F.col("value")).alias("v"))


# -- joins


@query("flagship", """
WITH j AS (SELECT o_orderkey, o_orderpriority, l_extendedprice, l_partkey, l_suppkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND o_orderdate < l_shipdate),
g AS (SELECT *, count(*) OVER (PARTITION BY o_orderpriority) AS n_priority FROM j),
k AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY l_extendedprice DESC, o_orderkey, l_partkey, l_suppkey, l_linenumber) AS r FROM g)
SELECT o_orderkey, o_orderpriority, l_extendedprice, n_priority FROM k WHERE r <= 10""")
def _(t):
    o = t.orders.select("o_orderkey", "o_orderpriority", "o_orderdate")
    j = q.conditional_join(o, t.lineitem.select(*LINE, "l_shipdate"), ("o_orderkey", "l_orderkey", "=="), ("o_orderdate", "l_shipdate", "<"))
    g = q.groupby_agg(j, "o_orderpriority", "n_priority", "o_orderkey", "size")
    return q.groupby_topk(g, "o_orderpriority", "l_extendedprice", 10, ascending=False, order_by=["o_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]).select("o_orderkey", "o_orderpriority", "l_extendedprice", "n_priority")


@query("conditional_join_inner", "SELECT o_orderkey, l_partkey, l_linenumber, l_extendedprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND o_orderdate < l_shipdate")
def _(t):
    return q.conditional_join(t.orders, t.lineitem, ("o_orderkey", "l_orderkey", "=="), ("o_orderdate", "l_shipdate", "<"), df_columns="o_orderkey", right_columns=["l_partkey", "l_linenumber", "l_extendedprice"])


@query("conditional_join_range", """
WITH i AS (SELECT event_id AS rid, value AS lo, value + 0.05 AS hi FROM events),
p AS (SELECT e.event_id, i.rid FROM events e JOIN i ON e.value >= i.lo AND e.value < i.hi)
SELECT event_id, count(*) AS n, min(rid) AS first_id FROM p GROUP BY event_id""")
def _(t):
    # matches are counted, not made; min passes over nulls, so an id that is one comes last
    right = t.events.select(F.col("event_id").alias("rid"), F.col("event_id").isNull().alias("gone"), F.col("value").alias("lo"), (F.col("value") + 0.05).alias("hi"))
    j = q.conditional_join(t.events.select("event_id", "value"), right, ("value", "lo", ">="), ("value", "hi", "<"), keep="first", order_by=["gone", "rid"], left_order_by="event_id", df_columns="event_id", right_columns="rid", matches="n")
    return j.groupBy("event_id").agg(F.sum("n").alias("n"), F.min("rid").alias("first_id"))


def _part_bounds(t):
    return t.part.select("p_partkey", F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") + F.col("p_size") / 100).alias("hi"))


_PB = "b AS (SELECT p_partkey, p_retailprice AS lo, p_retailprice + p_size / 100 AS hi FROM part)"


for _how, _kind in (("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL")):
    @query(f"conditional_join_{_how}", f"""WITH {_PB} SELECT c.c_custkey, b.p_partkey, CASE WHEN c.c_custkey IS NULL THEN 'right_only' WHEN b.p_partkey IS NULL THEN 'left_only' ELSE 'both' END AS side
FROM customer c {_kind} JOIN b ON c.c_acctbal > b.lo AND c.c_acctbal <= b.hi""")
    def _(t, how=_how):
        return q.conditional_join(t.customer, _part_bounds(t), ("c_acctbal", "lo", ">"), ("c_acctbal", "hi", "<="), how=how, df_columns="c_custkey", right_columns="p_partkey", indicator="side")


for _keep, _dir in (("first", "ASC"), ("last", "DESC")):
    @query(f"conditional_join_keep_{_keep}", f"""WITH k AS (SELECT o_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_orderkey {_dir}, l_partkey {_dir}, l_suppkey {_dir}, l_linenumber {_dir}, l_extendedprice {_dir}) AS r
FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND o_orderdate < l_shipdate) SELECT o_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM k WHERE r = 1""")
    def _(t, keep=_keep):
        return q.conditional_join(t.orders, t.lineitem, ("o_orderkey", "l_orderkey", "=="), ("o_orderdate", "l_shipdate", "<"), keep=keep, order_by=LINE, left_order_by="o_orderkey", df_columns="o_orderkey", right_columns=LINE[1:])


@query("conditional_join_keep_right", f"""WITH {_PB}, p AS (SELECT c.c_custkey, b.p_partkey, row_number() OVER (PARTITION BY c.c_custkey ORDER BY b.p_partkey) AS r FROM customer c JOIN b ON c.c_acctbal > b.lo AND c.c_acctbal <= b.hi),
k AS (SELECT c_custkey, p_partkey FROM p WHERE r = 1) SELECT c_custkey, p_partkey FROM k UNION ALL SELECT NULL, p_partkey FROM b WHERE p_partkey NOT IN (SELECT p_partkey FROM k)""")
def _(t):
    return q.conditional_join(t.customer, _part_bounds(t), ("c_acctbal", "lo", ">"), ("c_acctbal", "hi", "<="), how="right", keep="first", order_by="p_partkey", left_order_by="c_custkey", df_columns="c_custkey", right_columns="p_partkey")


@query("conditional_join_not_equal", "SELECT a.n_name AS left_n_name, b.n_name AS right_n_name FROM nation a JOIN nation b ON a.n_regionkey <> b.n_regionkey")
def _(t):
    return q.conditional_join(t.nation, t.nation, ("n_regionkey", "n_regionkey", "!="), df_columns="n_name", right_columns="n_name")


@query("conditional_join_two_ranges", """SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON s.s_nationkey > n.n_regionkey AND s.s_suppkey < n.n_nationkey""")
def _(t):
    return q.conditional_join(t.supplier, t.nation, ("s_nationkey", "n_regionkey", ">"), ("s_suppkey", "n_nationkey", "<"), df_columns="s_suppkey", right_columns="n_nationkey")


@query("conditional_join_anti", f"WITH {_PB} SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM b WHERE c.c_acctbal > b.lo AND c.c_acctbal <= b.hi)")
def _(t):
    return q.conditional_join(t.customer, _part_bounds(t), ("c_acctbal", "lo", ">"), ("c_acctbal", "hi", "<="), how="left_anti", df_columns="c_custkey")


@query("conditional_join_semi", f"WITH {_PB} SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM b WHERE c.c_acctbal > b.lo AND c.c_acctbal <= b.hi)")
def _(t):
    return q.conditional_join(t.customer, _part_bounds(t), ("c_acctbal", "lo", ">"), ("c_acctbal", "hi", "<="), how="left_semi", df_columns="c_custkey")


@query("conditional_join_anti_single", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE o.o_orderkey = l.l_orderkey AND o.o_orderdate < l.l_shipdate)")
def _(t):
    return q.conditional_join(t.orders, t.lineitem, ("o_orderkey", "l_orderkey", "=="), ("o_orderdate", "l_shipdate", "<"), how="left_anti", df_columns="o_orderkey")


@query("conditional_join_semi_single", "SELECT event_id FROM events WHERE value > (SELECT min(c_acctbal) FROM customer)")
def _(t):
    return q.conditional_join(t.events, t.customer, ("value", "c_acctbal", ">"), how="left_semi", df_columns="event_id")


for _keep, _f in (("last", "max"), ("first", "min")):
    @query(f"asof_{_keep}", f"SELECT o.o_orderkey, {_f}(e.event_id) AS event_id FROM orders o LEFT JOIN events e ON o.o_totalprice > e.value * 100 GROUP BY o.o_orderkey")
    def _(t, keep=_keep):
        e = t.events.select("event_id", (F.col("value") * 100).alias("v"))
        return q.conditional_join(t.orders, e, ("o_totalprice", "v", ">"), how="left", keep=keep, order_by="event_id", df_columns="o_orderkey", right_columns="event_id")


@query("asof_outer", """WITH k AS (SELECT c.c_custkey, max(s.s_suppkey) AS s FROM customer c LEFT JOIN supplier s ON c.c_acctbal >= s.s_acctbal GROUP BY 1)
SELECT c_custkey, s AS s_suppkey FROM k UNION ALL SELECT NULL, s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT s FROM k WHERE s IS NOT NULL)""")
def _(t):
    return q.conditional_join(t.customer, t.supplier, ("c_acctbal", "s_acctbal", ">="), how="outer", keep="last", order_by="s_suppkey", df_columns="c_custkey", right_columns="s_suppkey")


@query("get_join_indices", """WITH l AS (SELECT s_nationkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS left_index FROM supplier), r AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS right_index FROM nation)
SELECT left_index, right_index FROM l JOIN r ON s_nationkey >= n_nationkey""")
def _(t):
    return q.get_join_indices(t.supplier, t.nation, [("s_nationkey", "n_nationkey", ">=")], order_by="n_nationkey", left_order_by="s_suppkey")


#: Gaps come from the data: groups whose mean balance is high are nulled out of the counts.
_SEEN = "s AS (SELECT c_nationkey, c_mktsegment, n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, avg(c_acctbal) AS m FROM customer GROUP BY ALL) WHERE m < 4700 AND c_nationkey <> 3)"


def _seen(t):
    return t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("m")).where("m < 4700 and c_nationkey <> 3").drop("m")


@query("complete", f"WITH {_SEEN}, g AS (SELECT * FROM (SELECT DISTINCT c_nationkey FROM s) CROSS JOIN (SELECT DISTINCT c_mktsegment FROM s)) SELECT g.c_nationkey, g.c_mktsegment, coalesce(s.n, 0) AS n FROM g LEFT JOIN s ON s.c_nationkey = g.c_nationkey AND s.c_mktsegment = g.c_mktsegment")
def _(t):
    return q.complete(_seen(t), "c_nationkey", "c_mktsegment", fill_value={"n": 0})


@query("complete_values", f"WITH {_SEEN}, g AS (SELECT unnest(range(0, 30)) AS k) SELECT coalesce(g.k, s.c_nationkey)::INTEGER AS c_nationkey, s.c_mktsegment, coalesce(s.n, -1) AS n FROM g FULL JOIN s ON s.c_nationkey = g.k")
def _(t):
    return q.complete(_seen(t).withColumn("c_nationkey", F.col("c_nationkey").cast("long")), {"c_nationkey": list(range(30))}, fill_value={"n": -1}, explicit=False).withColumn("c_nationkey", F.col("c_nationkey").cast("int"))


@query("expand", "SELECT * FROM (SELECT DISTINCT o_orderstatus FROM orders) CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders)")
def _(t):
    return q.expand(t.orders, "o_orderstatus", "o_orderpriority")


@query("expand_by", "SELECT DISTINCT a.p_brand, a.p_type, b.p_size FROM part a JOIN part b ON a.p_brand = b.p_brand")
def _(t):
    return q.expand(t.part, "p_type", "p_size", by="p_brand")


@query("cartesian_product", "SELECT r_name, n_name, x FROM region CROSS JOIN nation CROSS JOIN (SELECT unnest([1, 2, 3])::BIGINT AS x)")
def _(t):
    return q.cartesian_product(t.region.select("r_name"), t.nation.select("n_name"), {"x": [1, 2, 3]})


@query("expand_grid", "SELECT n_name AS nat_n_name, x FROM nation CROSS JOIN (SELECT unnest([1, 2])::BIGINT AS x)")
def _(t):
    return q.expand_grid(t.nation.select("n_name"), "nat", others={"x": [1, 2]})


# -- columns and rows


@query("select", "SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders")
def _(t):
    return q.select(t.orders, "o_orderkey", "*status", q.is_string, ["o_totalprice"])


@query("select_drop", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def _(t):
    return q.select(t.customer, q.DropLabel(slice("c_acctbal", "c_mktsegment")))


@query("select_rows", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey IN (1, 4, 5, 6)")
def _(t):
    return q.select_rows(t.nation, 1, slice(4, 7), order_by="n_nationkey")


@query("names", "SELECT o_orderpriority AS priority, o_orderkey AS order_key, o_totalprice AS total_price FROM orders")
def _(t):
    d = t.orders.select(F.col("o_orderkey").alias("Order Key"), F.col("o_totalprice").alias("Total-Price?"), F.col("o_orderpriority").alias("Priority!"))
    d = q.clean_names(d, remove_special=True, strip_underscores=True)
    return q.reorder_columns(q.rename_columns(d, {"priority": "priority"}), ["priority"])


@query("clean_values", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[ #-]', '_', 'g'), '_+', '_', 'g') AS p_name FROM part")
def _(t):
    d = t.part.select("p_partkey", F.replace("p_name", F.lit("#"), F.lit(" ")).alias("p_name"))
    return q.clean_names(d, axis=None, column_names="p_name")


@query("move", "SELECT s_suppkey AS c2, s_acctbal AS c1, s_name AS c3, s_nationkey AS c4 FROM supplier")
def _(t):
    return q.move(t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), "s_acctbal", "s_suppkey").toDF("c1", "c2", "c3", "c4")


@query("move_rows", "SELECT s_suppkey, CASE WHEN k = 0 THEN n - 1 ELSE k - 1 END AS place FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS k, count(*) OVER () AS n FROM supplier)")
def _(t):
    return _ranked(q.move(t.supplier, 0, position="after", axis=0, order_by="s_suppkey"), "s_suppkey")


@query("remove_empty", "SELECT event_id, CASE WHEN value >= 20 THEN value END AS v FROM events")
def _(t):
    return q.remove_empty(gaps(t).select("event_id", "v", F.lit(None).cast("string").alias("nothing")))


@query("drop_constant_columns", "SELECT s_suppkey, s_name FROM supplier")
def _(t):
    return q.drop_constant_columns(t.supplier.select("s_suppkey", "s_name", F.lit("x").alias("same")))


@query("row_to_names", "SELECT n_nationkey AS \"0\", n_name AS head FROM nation WHERE n_nationkey > 0")
def _(t):
    d = t.nation.select(F.col("n_nationkey"), F.when(F.col("n_nationkey") == 0, "head").otherwise(F.col("n_name")).alias("n"))
    return q.row_to_names(d, 0, remove_rows=True, order_by="n_nationkey")


@query("filter_string", "SELECT p_partkey, p_type FROM part WHERE NOT regexp_matches(p_type, '^(STANDARD|PROMO)')")
def _(t):
    return q.filter_string(t.part, "p_type", "^(standard|promo)", complement=True, case=False).select("p_partkey", "p_type")


@query("filter_on", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F'")
def _(t):
    return q.filter_on(t.orders, 'o_totalprice > 1000 & o_orderstatus == "F"').select("o_orderkey")


@query("filter_on_not", "SELECT o_orderkey FROM orders WHERE NOT ((o_totalprice > 5000 AND o_totalprice < 100000) OR o_orderstatus IN ('F', 'P')) AND o_orderpriority <> '[x]'")
def _(t):
    return q.filter_on(t.orders, "~((o_totalprice > 5000 & o_totalprice < 100000) | o_orderstatus in ['F', 'P']) and `o_orderpriority` != '[x]'").select("o_orderkey")


@query("filter_on_missing", f"SELECT event_id FROM ({GAPS}) WHERE v IS NULL OR NOT v > 60")
def _(t):
    return q.filter_on(gaps(t), "v > 60", complement=True).select("event_id")


@query("case_when_text", "SELECT o_orderkey, CASE WHEN NOT (o_totalprice > 5000 OR o_orderstatus = 'F') THEN 'low' WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'calm' ELSE 'rest' END AS tag FROM orders")
def _(t):
    return q.case_when(t.orders, "not (o_totalprice > 5000 | o_orderstatus == 'F')", "low", "o_orderpriority not in ['1-URGENT', '2-HIGH']", "calm", default="rest", column_name="tag").select("o_orderkey", "tag")


@query("update_where_text", "SELECT c_custkey, CASE WHEN NOT (c_acctbal >= 0 AND c_mktsegment = 'BUILDING') THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(t):
    return q.update_where(t.customer, "~(c_acctbal >= 0 & c_mktsegment == 'BUILDING')", "c_acctbal", 0.0).select("c_custkey", "c_acctbal")


@query("filter_date", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND month(o_orderdate) IN (3, 4, 12)")
def _(t):
    return q.filter_date(t.orders, "o_orderdate", start_date="1995-01-01", months=[3, 4, 12]).select("o_orderkey", "o_orderdate")


@query("filter_column_isin", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def _(t):
    return q.filter_column_isin(t.orders, "o_orderstatus", ["F", "O"], complement=True).select("o_orderkey")


@query("dropnotnull", f"SELECT event_id FROM ({GAPS}) WHERE v IS NULL")
def _(t):
    return q.dropnotnull(gaps(t), "v").select("event_id")


@query("get_dupes", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1")
def _(t):
    return q.get_dupes(t.lineitem, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("take_first", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def _(t):
    return q.take_first(t.orders, "o_custkey", "o_totalprice", ascending=False, order_by="o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("groupby_topk", f"SELECT l_returnflag, {LINE_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity, {LINE_SQL}) AS r FROM lineitem) WHERE r <= 5")
def _(t):
    return q.groupby_topk(t.lineitem, "l_returnflag", "l_quantity", 5, order_by=LINE).select("l_returnflag", *LINE)


def _ranked(d, *keep):
    """The place of each row as the sorted table gives them."""
    return numbered(d, "place").select(*keep, "place")


@query("shuffle", "SELECT * FROM customer")
def _(t):
    return q.shuffle(t.customer, random_state=7)


@query("sort_column_value_order", "SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, o_orderkey) - 1 AS place FROM orders")
def _(t):
    return _ranked(q.sort_column_value_order(t.orders, "o_orderstatus", {"P": 1, "F": 2}, "o_orderkey"), "o_orderkey", "o_orderstatus")


@query("sort_naturally", "SELECT name, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM (SELECT c_custkey, 'No. ' || c_custkey AS name FROM customer)")
def _(t):
    return _ranked(q.sort_naturally(t.customer.select(F.concat(F.lit("No. "), F.col("c_custkey").cast("string")).alias("name")), "name"), "name")


# -- scalar columns


@query("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 5000 THEN 'high' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'rest' END AS tag FROM orders")
def _(t):
    return q.case_when(t.orders, F.col("o_totalprice") > 5000, "high", "o_orderstatus == 'F'", "done", default="rest", column_name="tag").select("o_orderkey", "tag")


@query("update_where", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(t):
    return q.update_where(t.customer, F.col("c_acctbal") < 0, "c_acctbal", 0.0).select("c_custkey", "c_acctbal")


@query("coalesce", f"SELECT event_id, coalesce(v, user_id, -1)::DOUBLE AS w FROM ({GAPS})")
def _(t):
    d = gaps(t).withColumn("u", F.col("user_id").cast("double"))
    return q.coalesce(d, "v", "u", target_column_name="w", default_value=-1.0).select("event_id", "w")


@query("find_replace", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(t):
    return q.find_replace(t.orders, o_orderstatus={"F": "filled", "O": "open"}).select("o_orderkey", "o_orderstatus")


@query("find_replace_regex", "SELECT o_orderkey, CASE WHEN regexp_matches(o_orderpriority, '^[12]') THEN 'soon' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def _(t):
    return q.find_replace(t.orders, match="regex", o_orderpriority={"^[12]": "soon"}).select("o_orderkey", "o_orderpriority")


@query("change_type", "SELECT p_partkey, try_cast(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS b, p_size::VARCHAR AS p_size FROM part")
def _(t):
    d = t.part.select("p_partkey", F.regexp_extract("p_brand", "[0-9]+", 0).alias("b"), "p_size")
    return q.change_type(q.change_type(d, "b", "bigint", ignore_exception="fillna"), "p_size", str)


@query("excel_date", "SELECT o_orderkey, TIMESTAMP '1899-12-30' + to_days((30000 + o_orderkey % 9000)::INTEGER) + to_hours(12) AS d FROM orders")
def _(t):
    return q.convert_excel_date(t.orders.select("o_orderkey", (30000.5 + F.col("o_orderkey") % 9000).alias("d")), "d")


@query("matlab_date", "SELECT o_orderkey, TIMESTAMP '1970-01-01' + to_days((o_orderkey % 9000)::INTEGER) AS d FROM orders")
def _(t):
    return q.convert_matlab_date(t.orders.select("o_orderkey", (719529 + F.col("o_orderkey") % 9000).alias("d")), "d")


@query("unix_date", "SELECT event_id, TIMESTAMP '1970-01-01' + to_seconds(1700000000 + event_id) AS d FROM events")
def _(t):
    return q.convert_unix_date(t.events.select("event_id", (F.col("event_id") + 1700000000).alias("d")), "d")


@query("to_datetime", "SELECT event_id, date_trunc('second', ts) AS d FROM events")
def _(t):
    return q.to_datetime(t.events.select("event_id", F.date_format("ts", "dd/MM/yyyy HH:mm:ss").alias("d")), "d", format="%d/%m/%Y %H:%M:%S")


@query("truncate_datetime", "SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS o_orderdate FROM orders")
def _(t):
    return q.truncate_datetime_dataframe(t.orders.select("o_orderkey", "o_orderdate"), "month")


@query("currency", "SELECT c_custkey, c_acctbal AS b FROM customer")
def _(t):
    d = t.customer.select("c_custkey", F.when(F.col("c_acctbal") < 0, F.concat(F.lit("("), F.format_number(-F.col("c_acctbal"), 2), F.lit(")"))).otherwise(F.format_number("c_acctbal", 2)).alias("b"))
    return q.currency_column_to_numeric(d, "b", "accounting")


@query("round_to_fraction", "SELECT event_id, round_even(value * 4, 0) / 4 AS value FROM events")
def _(t):
    return q.round_to_fraction(t.events.select("event_id", "value"), "value", 4)


@query("flag_nulls", f"SELECT event_id, CASE WHEN v IS NULL THEN 1 ELSE 0 END AS null_flag FROM ({GAPS})")
def _(t):
    return q.flag_nulls(gaps(t)).select("event_id", "null_flag")


@query("jitter", "SELECT event_id, value, true AS near, true AS inside FROM events")
def _(t):
    d = q.jitter(t.events.select("event_id", "value"), "value", "noisy", 0.5, clip=[-1000, 1000], random_state=3)
    return d.select("event_id", "value", ((F.col("noisy") != F.col("value")) & (F.abs(F.col("noisy") - F.col("value")) < 10)).alias("near"), F.col("noisy").between(-1000, 1000).alias("inside"))


@query("transform_columns", "SELECT c_custkey, upper(c_mktsegment) AS c_mktsegment_up FROM customer")
def _(t):
    return q.transform_columns(t.customer, ["c_mktsegment"], F.upper, suffix="_up").select("c_custkey", "c_mktsegment_up")


@query("join_apply", "SELECT l_orderkey, l_partkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def _(t):
    return q.join_apply(t.lineitem, lambda r: r["l_extendedprice"] * (1 - r["l_discount"]), "net").select("l_orderkey", "l_partkey", "net")


@query("process_text", "SELECT p_partkey, lpad(upper(substr(p_name, 2, 4)), 8, '*') AS p_name FROM part")
def _(t):
    d = t.part.select("p_partkey", "p_name")
    d = q.process_text(d, "p_name", "slice", start=1, stop=5)
    return q.process_text(q.process_text(d, "p_name", "upper"), "p_name", "rjust", width=8, fillchar="*")


@query("concatenate_columns", "SELECT p_partkey, p_brand || '-' || p_type AS x FROM part")
def _(t):
    return q.concatenate_columns(t.part, ["p_brand", "p_type"], "x").select("p_partkey", "x")


@query("deconcatenate_column", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS p1, CASE WHEN contains(o_orderpriority, '-') THEN split_part(o_orderpriority, '-', 2) END AS p2 FROM orders")
def _(t):
    d = t.orders.select("o_orderkey", "o_orderpriority")
    return q.deconcatenate_column(d, "o_orderpriority", "-", ["p1", "p2"]).select("o_orderkey", "p1", "p2")


@query("expand_column", "SELECT n_nationkey, (n_nationkey % 2 = 0)::INTEGER AS even, (n_nationkey % 3 = 0)::INTEGER AS three FROM nation")
def _(t):
    k = F.col("n_nationkey")
    d = t.nation.select("n_nationkey", F.concat_ws("|", F.when(k % 2 == 0, "even"), F.when(k % 3 == 0, "three")).alias("tags"))
    return q.expand_column(d, "tags").drop("tags")


@query("add_columns", "SELECT n_nationkey, 'x' AS c, [10, 20, 30][n_nationkey % 3 + 1]::BIGINT AS k FROM nation")
def _(t):
    d = t.nation.select("n_nationkey")
    return q.add_columns(d, fill_remaining=True, order_by="n_nationkey", c="x", k=[F.lit(v).cast("long") for v in (10, 20, 30)])


@query("convert_units", "SELECT s_suppkey, round((s_acctbal + 459.67) * 5 / 9 - 273.15, 6) AS c FROM supplier")
def _(t):
    return q.convert_units(t.supplier, "s_acctbal", "degF", "degC", "c").select("s_suppkey", F.round("c", 6).alias("c"))


@query("convert_compound_units", "SELECT s_suppkey, round(s_acctbal * 3.6, 6) AS v, round(s_acctbal * 1000 / 4.184, 6) AS e FROM supplier")
def _(t):
    d = q.convert_units(q.convert_units(t.supplier, "s_acctbal", "m/s", "km*hour**-1", "v"), "s_acctbal", "kg*m**2/s**2", "mcal", "e")
    return d.select("s_suppkey", F.round("v", 6).alias("v"), F.round("e", 6).alias("e"))


@query("inflate_currency", "SELECT s_suppkey, round(s_acctbal * (120.0 / 80.0)::DOUBLE, 6) AS s_acctbal_2020 FROM supplier")
def _(t):
    d = q.inflate_currency(t.supplier, "s_acctbal", "X", 2010, 2020, {("X", 2010): 80.0, ("X", 2020): 120.0}, make_new_column=True)
    return d.select("s_suppkey", F.round("s_acctbal_2020", 6).alias("s_acctbal_2020"))


# -- groups, statistics, order


@query("groupby_agg", "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
def _(t):
    d = q.groupby_agg(q.groupby_agg(t.orders, "o_custkey", "m", "o_totalprice", "max"), "o_custkey", "n", "o_orderkey", "size")
    return d.select("o_orderkey", "m", "n")


@query("impute", f"WITH g AS ({GAPS}) SELECT event_id, coalesce(v, (SELECT median(v) FROM g)) AS v FROM g")
def _(t):
    return q.impute(gaps(t), "v", statistic_column_name="median").select("event_id", "v")


@query("impute_mode", "WITH g AS (SELECT p_partkey, CASE WHEN p_size > 10 THEN p_size END AS s FROM part) SELECT p_partkey, coalesce(s, (SELECT s FROM g WHERE s IS NOT NULL GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)) AS s FROM g")
def _(t):
    d = t.part.select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_size")).alias("s"))
    return q.impute(d, "s", statistic_column_name="mode")


@query("min_max_scale", "SELECT c_custkey, round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) * 10 / (SELECT max(c_acctbal) - min(c_acctbal) FROM customer), 6) AS c_acctbal FROM customer")
def _(t):
    return q.min_max_scale(t.customer, (0, 10), "c_acctbal").select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@query("bin_numeric", "SELECT event_id, CASE WHEN value > 0 AND value <= 10 THEN 'low' WHEN value > 10 AND value <= 50 THEN 'mid' WHEN value > 50 AND value <= 1000 THEN 'high' END AS b FROM events")
def _(t):
    return q.bin_numeric(t.events, "value", "b", [0, 10, 50, 1000], labels=["low", "mid", "high"]).select("event_id", "b")


@query("factorize_columns", "WITH f AS (SELECT o_orderpriority, min(o_orderkey) AS m FROM orders GROUP BY 1), c AS (SELECT o_orderpriority, row_number() OVER (ORDER BY m) - 1 AS k FROM f) SELECT o_orderkey, c.k AS o_orderpriority_enc FROM orders o JOIN c ON o.o_orderpriority = c.o_orderpriority")
def _(t):
    return q.factorize_columns(t.orders, "o_orderpriority", order_by="o_orderkey").select("o_orderkey", "o_orderpriority_enc")


@query("encode_categorical", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END AS o_orderstatus FROM orders")
def _(t):
    return q.encode_categorical(t.orders, o_orderstatus=["F", "O"]).select("o_orderkey", "o_orderstatus")


@query("count_cumulative_unique", "SELECT event_id, sum(CASE WHEN r = 1 THEN 1 ELSE 0 END) OVER (ORDER BY event_id)::BIGINT AS n FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events)")
def _(t):
    return q.count_cumulative_unique(t.events, "user_id", "n", order_by="event_id").select("event_id", "n")


_COUNTED = " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{k}' AS type, count({c}) AS count, round(1 - count({c}) / count(*), 9) AS pct_missing, '{text}' AS description FROM g" for c, k, text in (("event_id", "bigint", "number"), ("user_id", "bigint", ""), ("event_type", "string", ""), ("v", "double", "what was measured")))


@query("data_description", f"WITH g AS ({GAPS}) {_COUNTED}")
def _(t):
    d = q.DataDescription(gaps(t).drop("ts").withColumn("user_id", F.col("user_id").cast("bigint")))
    d.set_description({"event_id": "number", "v": "what was measured"})
    d.display()
    return d.df.withColumn("pct_missing", F.round("pct_missing", 9))


@query("fill_direction", f"SELECT event_id, user_id, coalesce(last_value(v IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM ({GAPS}) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def _(t):
    return q.fill_direction(gaps(t), order_by="event_id", partition_by="user_id", v="downup").select("event_id", "user_id", "v")


@query("flag_jumps", "SELECT event_id, CASE WHEN abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 20 THEN 1 ELSE 0 END AS value_jump_flag FROM events")
def _(t):
    return q.flag_jumps(t.events, scale="absolute", threshold=20, order_by=["ts", "event_id"], partition_by="user_id", columns="value").select("event_id", "value_jump_flag")


_DAYS = "d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM events GROUP BY 1)"


def _days(t):
    return t.events.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 0")


@query("fill_missing_timestamps", f"WITH {_DAYS}, e AS (SELECT * FROM d WHERE n % 2 = 0), g AS (SELECT unnest(generate_series((SELECT min(day) FROM e), (SELECT max(day) FROM e), INTERVAL 1 DAY)) AS day) SELECT g.day, e.n FROM g LEFT JOIN e ON g.day = e.day")
def _(t):
    return q.fill_missing_timestamps(_days(t), "1D", timestamp_column="day")


@query("get_missing_timestamps", f"WITH {_DAYS}, e AS (SELECT * FROM d WHERE n % 2 = 0), g AS (SELECT unnest(generate_series((SELECT min(day) FROM e), (SELECT max(day) FROM e), INTERVAL 1 DAY)) AS day) SELECT day FROM g WHERE day NOT IN (SELECT day FROM e)")
def _(t):
    return q.get_missing_timestamps(_days(t), "D", timestamp_column="day")


@query("sort_timestamps", "SELECT user_id, ts, event_id, row_number() OVER (ORDER BY ts DESC) - 1 AS place FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY event_id) AS r FROM events) WHERE r = 1")
def _(t):
    return _ranked(q.sort_timestamps_monotonically(t.events, "decreasing", strict=True, order_by="event_id"), "user_id", "ts", "event_id")


# -- reshaping


@query("pivot_longer", f"SELECT {LINE_SQL}, 'l_tax' AS variable, l_tax AS value FROM lineitem UNION ALL SELECT {LINE_SQL}, 'l_discount', l_discount FROM lineitem")
def _(t):
    return q.pivot_longer(t.lineitem.select(*LINE, "l_tax", "l_discount"), index=LINE)


@query("pivot_longer_value", "SELECT s_suppkey, 'x' AS k, s_acctbal AS bal, s_nationkey AS nat FROM supplier UNION ALL SELECT s_suppkey, 'y', s_acctbal * 2, s_nationkey + 1 FROM supplier")
def _(t):
    d = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("bal_x"), (F.col("s_acctbal") * 2).alias("bal_y"), F.col("s_nationkey").alias("nat_x"), (F.col("s_nationkey") + 1).alias("nat_y"))
    return q.pivot_longer(d, index="s_suppkey", names_to=[".value", "k"], names_sep="_")


@query("pivot_longer_spec", "SELECT c_custkey, 'name' AS part, c_name AS v FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer")
def _(t):
    return q.pivot_longer_spec(t.customer.select("c_custkey", "c_name", "c_mktsegment"), [{".name": "c_name", ".value": "v", "part": "name"}, {".name": "c_mktsegment", ".value": "v", "part": "segment"}])


@query("pivot_wider", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def _(t):
    d = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return q.pivot_wider(d, "o_orderpriority", "o_orderstatus", "n", names_values=["F", "O", "P"])


# -- operators whose result is no large table, shown over whole tables all the same


def _folder(t: Tables, name: str) -> str:
    """A new folder in the shared one."""
    stable(t.spark.range(1))
    return f"{t.spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("read_csvs", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t):
    path = _folder(t, "csv")
    t.nation.repartition(3, "n_nationkey").write.option("header", True).csv(path)
    return q.read_csvs(t.spark, f"{path}/part-*.csv").select(F.col("n_nationkey").cast(t.nation.schema["n_nationkey"].dataType).alias("n_nationkey"), "n_name", F.col("n_regionkey").cast(t.nation.schema["n_regionkey"].dataType).alias("n_regionkey"))


@query("read_commandline", "SELECT 1 AS a, 'x' AS b UNION ALL SELECT 2, 'y'")
def _(t):
    return q.read_commandline(t.spark, ["printf", "a,b\\n1,x\\n2,y\\n"])


@query("join_fasta", "SELECT p_partkey, p_name || p_name AS seq FROM part")
def _(t):
    path = _folder(t, "fasta")
    letters = F.regexp_replace("p_name", r"\s", "")
    t.part.select(F.concat(F.lit(">"), F.col("p_partkey").cast("string"), F.lit(" some part\n"), letters, F.lit("\n"), letters)).write.text(path)
    d = q.join_fasta(t.part.select("p_partkey", "p_name", F.col("p_partkey").cast("string").alias("id")), path, "id", "seq")
    return d.select("p_partkey", F.when(F.col("seq") == F.concat(letters, letters), F.concat("p_name", "p_name")).alias("seq"))


def _workbook(t: Tables) -> str:
    """The nation table as a spreadsheet in the shared folder."""
    m, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    p = "http://schemas.openxmlformats.org/package/2006/relationships"
    rows = [("key", "name")] + [(x["n_nationkey"], x["n_name"]) for x in t.nation.orderBy("n_nationkey").collect()]
    cell = lambda ref, v: f'<c r="{ref}"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    sheet = "".join(f'<row r="{i}">{cell(f"A{i}", a)}{cell(f"B{i}", b)}</row>' for i, (a, b) in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{p}"><Relationship Id="rId1" Type="{r}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{m}"><sheetData>{sheet}</sheetData></worksheet>')
        z.writestr("xl/worksheets/_rels/sheet1.xml.rels", f'<Relationships xmlns="{p}"><Relationship Id="r1" Type="{r}/table" Target="../tables/table1.xml"/></Relationships>')
        z.writestr("xl/tables/table1.xml", f'<table xmlns="{m}" displayName="T" ref="A1:B{len(rows)}"><tableColumns><tableColumn name="key"/><tableColumn name="name"/></tableColumns></table>')
    path = _folder(t, "book") + ".xlsx"
    jvm = t.spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(t.spark._jsc.hadoopConfiguration()).create(at)
    stream.write(out.getvalue())
    stream.close()
    return path


@query("xlsx_table", "SELECT n_nationkey::BIGINT AS key, n_name AS name FROM nation")
def _(t):
    return q.xlsx_table(t.spark, _workbook(t), table="T").select(F.col("key").cast("long").alias("key"), "name")


@query("xlsx_cells", "WITH n AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) + 1 AS i FROM nation) SELECT 'A' || i AS coordinate, n_nationkey::VARCHAR AS value FROM n UNION ALL SELECT 'B' || i, n_name FROM n UNION ALL SELECT 'A1', 'key' UNION ALL SELECT 'B1', 'name'")
def _(t):
    return q.xlsx_cells(t.spark, _workbook(t)).select("coordinate", F.regexp_replace("value", r"\.0$", "").alias("value"))


@query("select_columns", "SELECT s_name, s_acctbal FROM supplier")
def _(t):
    return q.select_columns(t.supplier, ["s_suppkey", "s_nationkey"], invert=True)


@query("select_by_table", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def _(t):
    return q.select(t.supplier, lambda d: [c for c, k in d.dtypes if k != "string"])


@query("get_index_labels", "SELECT unnest(['c_custkey', 'c_nationkey']) AS label")
def _(t):
    return t.spark.createDataFrame([(x,) for x in q.get_index_labels(t.customer, re.compile("key$"))], "label string")


@query("get_columns", "SELECT c_nationkey, sum(c_acctbal) AS c_acctbal FROM customer GROUP BY c_nationkey")
def _(t):
    keys, rest = q.get_columns(t.customer.select("c_nationkey", "c_acctbal"), "c_nationkey", "*")
    return t.customer.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rest])


@query("remove_columns", "SELECT p_partkey, p_name, p_brand FROM part")
def _(t):
    return q.remove_columns(t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), ["p_type", "p_size"])


@query("rename_column", "SELECT p_partkey AS key, p_name FROM part")
def _(t):
    return q.rename_column(t.part.select("p_partkey", "p_name"), "p_partkey", "key")


@query("rename_columns", "SELECT p_partkey AS P_PARTKEY_X, p_name AS P_NAME_X FROM part")
def _(t):
    return q.rename_columns(t.part.select("p_partkey", "p_name"), function=lambda c: c.upper() + "_X")


@query("limit_column_characters", "SELECT c_custkey AS c_c, c_name AS c_n, c_nationkey AS c_n_1 FROM customer")
def _(t):
    return q.limit_column_characters(t.customer.select("c_custkey", "c_name", "c_nationkey"), 3)


@query("collapse_levels", "SELECT c_custkey AS id, c_name AS who_name, c_nationkey AS who_at_nation, c_acctbal AS who_at_money FROM customer")
def _(t):
    at = F.struct(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("money"))
    return q.collapse_levels(t.customer.select(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("name"), at.alias("at")).alias("who")))


@query("explode_index", "SELECT c_custkey AS id, c_nationkey AS a, c_acctbal AS b FROM customer")
def _(t):
    d = q.explode_index(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("at_x_nation"), F.col("c_acctbal").alias("at_x_money")), names_sep="_")
    return d.select("id", F.col("at.x.nation").alias("a"), F.col("at.x.money").alias("b"))


@query("change_index_dtype", "SELECT c_custkey::VARCHAR AS c_custkey, c_nationkey::DOUBLE AS c_nationkey FROM customer")
def _(t):
    return q.change_index_dtype(t.customer.select("c_custkey", "c_nationkey"), {"c_custkey": "string", "c_nationkey": "double"})


@query("drop_duplicate_columns", "SELECT c_custkey AS a, c_name AS b FROM customer")
def _(t):
    return q.drop_duplicate_columns(t.customer.select("c_custkey", "c_name", "c_nationkey").toDF("a", "b", "a"), "a", 1)


@query("label_encode", "WITH f AS (SELECT c_mktsegment, min(c_custkey) AS m FROM customer GROUP BY 1), c AS (SELECT c_mktsegment, row_number() OVER (ORDER BY m) - 1 AS k FROM f) SELECT c_custkey, c.k AS c_mktsegment_enc FROM customer JOIN c USING (c_mktsegment)")
def _(t):
    return q.label_encode(t.customer, "c_mktsegment", order_by="c_custkey").select("c_custkey", "c_mktsegment_enc")


@query("encode_categorical_found", "SELECT DISTINCT o_orderstatus AS category, true AS kept FROM orders")
def _(t):
    d = q.encode_categorical(t.orders, o_orderstatus="sort")
    return t.spark.createDataFrame([(x,) for x in categories(d, "o_orderstatus")], "category string").join(d.select(F.col("o_orderstatus").alias("category"), F.lit(True).alias("kept")).distinct(), "category", "left")


@query("unionize_categories", "SELECT unnest(['F', 'O', 'P']) AS category")
def _(t):
    a, b = q.encode_categorical(t.orders, o_orderstatus=["F", "O"]), q.encode_categorical(t.orders, o_orderstatus=["O", "P"])
    both = [categories(d, "o_orderstatus") for d in q.unionize_dataframe_categories(a, b)]
    return t.spark.createDataFrame([(x,) for x in both[0] if x in both[1]], "category string")


@query("toset", "SELECT DISTINCT o_orderpriority AS v FROM orders")
def _(t):
    return t.spark.createDataFrame([(x,) for x in q.toset(t.orders, "o_orderpriority")], "v string")


@query("get_features_targets", "SELECT c_acctbal, c_nationkey, c_mktsegment FROM customer")
def _(t):
    d = t.customer.select("c_acctbal", "c_nationkey", "c_mktsegment")
    x, y = q.get_features_targets(d, "c_mktsegment")
    return d.select(*x.columns, *y.columns)


@query("fill_empty", f"SELECT event_id, coalesce(v, -1.0) AS v FROM ({GAPS})")
def _(t):
    return q.fill_empty(gaps(t), "v", -1.0).select("event_id", "v")


@query("bin_numeric_found", "WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT event_id, least(3, greatest(0, ceil((value - lo) / ((hi - lo) / 4)) - 1))::INTEGER AS b FROM events, e")
def _(t):
    return q.bin_numeric(t.events, "value", "b", 4, labels=["0", "1", "2", "3"]).select("event_id", F.col("b").cast("int").alias("b"))


@query("bin_numeric_intervals", "SELECT event_id, CASE WHEN value > 10 AND value <= 20 THEN '(10, 20]' WHEN value > 30 AND value <= 50 THEN '(30, 50]' END AS b FROM events")
def _(t):
    return q.bin_numeric(t.events, "value", "b", [(10, 20), (30, 50)]).select("event_id", "b")


@query("transform_column", "SELECT c_custkey, length(c_name) * 2 AS n FROM customer")
def _(t):
    return q.transform_column(t.customer, "c_name", lambda s: len(s) * 2, "n", returns="bigint").select("c_custkey", "n")


@query("join_apply_python", "SELECT s_suppkey, s_name || ':' || s_nationkey AS x FROM supplier")
def _(t):
    return q.join_apply(t.supplier, lambda r: f"{r['s_name']}:{r['s_nationkey']}", "x", returns="string").select("s_suppkey", "x")


@query("also_then", "SELECT count(*) AS n FROM supplier WHERE s_acctbal > 0")
def _(t):
    seen = []
    d = q.also(t.supplier, lambda x: seen.append(x.columns))
    return q.then(d, lambda x: x.where("s_acctbal > 0")).agg(F.count(F.lit(1)).alias("n")) if seen else d


@query("convert_currency", "SELECT s_suppkey, round(s_acctbal * (1.25 / 0.5)::DOUBLE, 6) AS b FROM supplier")
def _(t):
    d = q.convert_currency(t.supplier, "s_acctbal", "A", "B", {"A": 1.25, "B": 0.5}, make_new_column=True)
    return d.select("s_suppkey", F.round("s_acctbal_B", 6).alias("b"))


@query("convert_stock", "SELECT s_suppkey, n_name AS name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey > 3")
def _(t):
    symbol = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    names = t.nation.where("n_nationkey > 3").select(F.upper(symbol("n_nationkey")).alias("symbol"), F.col("n_name").alias("name"))
    return q.convert_stock(t.supplier.select("s_suppkey", symbol("s_nationkey").alias("symbol")), names).select("s_suppkey", "name")


@query("get_symbol", "SELECT n_name AS name FROM nation WHERE n_nationkey = 7")
def _(t):
    known = {f"N{r['n_nationkey']}": r["n_name"] for r in t.nation.collect()}
    return t.spark.createDataFrame([(q.get_symbol("n7", known),)], "name string")


@query("logit", "SELECT event_id, CASE WHEN value > 0 AND value < 1000 THEN round(ln((value / 1000) / (1 - value / 1000)), 8) END AS x FROM events")
def _(t):
    return t.events.select("event_id", F.round(mathx.logit(F.col("value") / 1000), 8).alias("x"))


@query("softmax_all", "SELECT c_custkey, round(exp(c_acctbal / 1000 - m) / sum(exp(c_acctbal / 1000 - m)) OVER (), 10) AS s FROM customer, (SELECT max(c_acctbal / 1000) AS m FROM customer)")
def _(t):
    return t.customer.select("c_custkey", F.round(mathx.softmax(F.col("c_acctbal") / 1000, df=t.customer), 10).alias("s"))


@query("complete_left", f"WITH {_SEEN}, g AS (SELECT unnest(range(5, 9)) AS k) SELECT g.k::INTEGER AS c_nationkey, s.c_mktsegment, coalesce(s.n, -1) AS n FROM g LEFT JOIN s ON s.c_nationkey = g.k")
def _(t):
    d = _seen(t).withColumn("c_nationkey", F.col("c_nationkey").cast("long"))
    return q.complete(d, {"c_nationkey": [5, 6, 7, 8]}, fill_value={"n": -1}, mode="left").withColumn("c_nationkey", F.col("c_nationkey").cast("int"))


@query("row_to_names_several", "SELECT n_nationkey AS \"0_1\", n_name AS head_top FROM nation WHERE n_nationkey > 1")
def _(t):
    k = F.col("n_nationkey")
    d = t.nation.select(k, F.when(k == 0, "head").when(k == 1, "top").otherwise(F.col("n_name")).alias("n"))
    return q.row_to_names(d, [0, 1], remove_rows=True, order_by="n_nationkey")


@query("pivot_wider_found", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def _(t):
    d = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return q.pivot_wider(d, "o_orderpriority", "o_orderstatus", "n")


@query("clone_using", "SELECT n_nationkey, (row_number() OVER (ORDER BY n_nationkey) - 1) * 2 AS value FROM nation")
def _(t):
    d = t.nation.select("n_nationkey", F.lit(0).alias("value"))
    return q.clone_using(d, [i * 2 for i in range(t.nation.count())], ["n_nationkey"]).withColumn("value", F.col("value").cast("long"))


@query("datetime_to_number", "SELECT o_orderkey, (date_diff('microsecond', TIMESTAMP '1970-01-01', o_orderdate::TIMESTAMP) / 86400000000)::DOUBLE AS o_orderdate FROM orders")
def _(t):
    return q.convert_datetime_to_number(t.orders.select("o_orderkey", "o_orderdate"), "D", "o_orderdate")


@query("groupby_agg_python", "SELECT c_custkey, max(c_acctbal) OVER (PARTITION BY c_nationkey) - min(c_acctbal) OVER (PARTITION BY c_nationkey) AS spread FROM customer")
def _(t):
    return q.groupby_agg(t.customer, "c_nationkey", "spread", "c_acctbal", lambda s: s.max() - s.min(), series=True).select("c_custkey", "spread")


@query("skipna_skiperror", f"SELECT event_id, CASE WHEN v IS NULL THEN NULL WHEN v >= 60 THEN -1.0 ELSE v * 2 END AS x FROM ({GAPS})")
def _(t):
    def double(v):
        if v >= 60:
            raise ValueError(v)
        return v * 2

    f = F.udf(guards.skipna(guards.skiperror(double, return_val=-1.0)), "double", useArrow=True)
    return gaps(t).select("event_id", f("v").alias("x"))


@query("checks", "SELECT unnest(['type', 'absent', 'present', 'gone', 'both', 'idempotent']) AS refused")
def _(t):
    renamed = guards.deprecated_alias(old="new")(lambda new=None: new)
    gone = guards.deprecated_kwargs("old")(lambda **k: k)
    tries = {
        "type": lambda: q.check("x", 1, [str]), "absent": lambda: q.check_column(t.nation, "zz"), "present": lambda: q.check_column(t.nation, "n_name", present=False), "gone": lambda: gone(old=1),
        "both": lambda: renamed(old=1, new=2), "idempotent": lambda: q.idempotent(lambda d: d.withColumn("n_nationkey", F.col("n_nationkey") + 1), t.nation), "fine": lambda: q.idempotent(q.clean_names, t.nation), "right": lambda: q.check("x", "a", [str]),
    }
    refused = []
    for name, f in tries.items():
        try:
            f()
        except (TypeError, ValueError, AssertionError):
            refused.append((name,))
    return t.spark.createDataFrame(refused, "refused string")


@query("helpers", "SELECT unnest(['alias', 'refactored', 'patterns', 'import', 'level', 'modules', 'offline', 'method']) AS works")
def _(t):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        kwargs = {"old": 1}
        guards.rename_kwargs("f", kwargs, {"old": "new"})

        def only_names(df):
            return df.select("n_name")

        if not hasattr(DataFrame, "only_names"):
            q.register_dataframe_method(only_names)
        works = {
            "alias": kwargs == {"new": 1}, "refactored": guards.refactored_function("moved")(lambda: 5)() == 5, "patterns": guards.patterns("^n").search("nation") is not None, "import": "pip install x" in guards.import_message("m", "x", pip_install=True),
            "level": guards.find_stack_level() >= 1, "modules": "quern.functions.text" in guards.dynamic_import("quern.functions"), "offline": not guards.is_connected("nowhere.invalid", timeout=0.2), "method": t.nation.only_names().columns == ["n_name"],
        }
    return t.spark.createDataFrame([(k,) for k, ok in works.items() if ok], "works string")


# -- mathematics


@query("math", "SELECT event_id, CASE WHEN value > 0 THEN round(ln(value), 8) END AS log, round(1 / (1 + exp(-value / 100)), 8) AS sigmoid, round(exp(value / 100), 8) AS exp FROM events")
def _(t):
    v = F.col("value")
    return t.events.select("event_id", F.round(mathx.log(v), 8).alias("log"), F.round(mathx.sigmoid(v / 100), 8).alias("sigmoid"), F.round(mathx.exp(v / 100), 8).alias("exp"))


@query("z_score", "SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_samp(c_acctbal) FROM customer), 6) AS z FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.round(mathx.z_score(F.col("c_acctbal"), df=t.customer), 6).alias("z"))


@query("softmax", "SELECT c_custkey, round(exp(x - max(x) OVER (PARTITION BY c_nationkey)) / sum(exp(x - m)) OVER (PARTITION BY c_nationkey), 8) AS s FROM (SELECT *, c_acctbal / 1000 AS x, max(c_acctbal / 1000) OVER (PARTITION BY c_nationkey) AS m FROM customer)")
def _(t):
    return t.customer.select("c_custkey", F.round(mathx.softmax(F.col("c_acctbal") / 1000, Window.partitionBy("c_nationkey")), 8).alias("s"))


@query("ecdf", "SELECT c_acctbal AS x, row_number() OVER (ORDER BY c_acctbal) / (SELECT count(*) FROM customer) AS y FROM customer")
def _(t):
    return mathx.ecdf(t.customer, "c_acctbal")


@query("probit_of_cdf", "SELECT event_id, round(value / 1000, 6) AS x FROM events")
def _(t):
    return t.events.select("event_id", F.round(mathx.probit(mathx.normal_cdf(F.col("value") / 1000)), 6).alias("x"))


@query("windowed_agg", "SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    from ..streaming.rows import windowed_agg

    d = windowed_agg(t.events, "ts", "1 hour", "10 minutes", "event_type", n=F.count(F.lit(1)))
    return d.select("window_start", "event_type", "n")
