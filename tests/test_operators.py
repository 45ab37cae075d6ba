"""Operators on small tables: literal results, errors, and properties against plain Python."""

import itertools
import math
import statistics
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern import api as q
from quern.functions import mathx

few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
maybe = st.one_of(st.none(), st.integers(-5, 5))


def out(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


L = [(1, 2, "A"), (1, 5, "B"), (1, 7, "C"), (2, 1, "D"), (2, 3, "E"), (3, 4, "F")]
R = [(0, 1), (3, 5), (7, 9), (12, 15), (0, 1), (2, 4), (3, 6), (1, 3)]


@pytest.mark.parametrize("width", [None, "auto", 0.5, 100.0])
def test_range_join(spark, width):
    left, right = spark.createDataFrame(L, "id long, value_1 long, S string"), spark.createDataFrame(R, "value_2A long, value_2B long")
    j = q.conditional_join(left, right, ("value_1", "value_2A", ">"), ("value_1", "value_2B", "<"), df_columns="value_1", range_width=width)
    assert sorted(out(j)) == [(2, 1, 3), (3, 2, 4), (4, 3, 5), (4, 3, 6), (5, 3, 6)]


@few
@given(st.lists(maybe, max_size=6), st.lists(st.tuples(maybe, maybe), max_size=6), st.sampled_from(["inner", "left", "right", "outer"]), st.sampled_from(["all", "first", "last"]))
def test_join_against_python(spark, left, right, how, keep):
    a = spark.createDataFrame(list(enumerate(left)), "i long, x long")
    b = spark.createDataFrame([(j, *r) for j, r in enumerate(right)], "j long, lo long, hi long")
    pairs = [(i, j) for i, x in enumerate(left) for j, (lo, hi) in enumerate(right) if None not in (x, lo, hi) and lo <= x < hi]
    if keep != "all":
        pick = min if keep == "first" else max
        pairs = [(i, pick(j for k, j in pairs if k == i)) for i in {i for i, _ in pairs}]
    want = list(pairs)
    if how in ("left", "outer"):
        want += [(i, None) for i in range(len(left)) if i not in {p[0] for p in pairs}]
    if how in ("right", "outer"):
        want += [(None, j) for j in range(len(right)) if j not in {p[1] for p in pairs}]
    got = q.conditional_join(a, b, ("x", "lo", ">="), ("x", "hi", "<"), how=how, keep=keep, order_by="j", left_order_by="i", df_columns="i", right_columns="j", range_width=2.0)
    assert sorted(out(got), key=repr) == sorted(want, key=repr)


def test_join_nulls_and_errors(spark):
    a = spark.createDataFrame([(1, None), (2, 5)], "k long, v long")
    assert sorted(out(q.conditional_join(a, a, ("v", "v", "!="), df_columns="k", right_columns="k"))) == [(1, 1), (1, 2), (2, 1)]
    assert out(q.conditional_join(a, a, ("v", "v", "=="), ("k", "k", "<="), df_columns="k", right_columns="k"), 1) == [(1, 1), (2, 2)]
    with pytest.raises(ValueError):
        q.conditional_join(a, a, ("v", "v", "=="))
    with pytest.raises(ValueError):
        q.conditional_join(a, a, ("v", "v", "<"), keep="some")
    with pytest.raises(TypeError):
        q.conditional_join(a, [1], ("v", "v", "<"))


def test_complete(spark):
    d = spark.createDataFrame([(1, 1, "a", 1.0, 4), (2, 2, "a", None, 5), (1, 2, "b", 3.0, 6), (2, 3, "b", 4.0, 7)], "g long, i long, n string, v1 double, v2 long")
    got = q.complete(d, "g", ["i", "n"], fill_value={"v1": 0.0, "v2": 99}, explicit=False, sort=True)
    assert got.count() == 8 and got.where("v1 is null").count() == 1 and got.where("v2 = 99").count() == 4
    years = spark.createDataFrame([(1999, "S", 4), (2000, "S", 5), (2004, "S", 2), (1999, "A", 1), (2004, "A", 8)], "y long, t string, n long")
    assert q.complete(years, {"y": list(range(1999, 2005))}, "t").count() == 12
    assert q.complete(years, {"y": [1999]}, "t").count() == 5 and q.complete(years, {"y": [1999]}, "t", mode="left").count() == 2


@few
@given(st.lists(st.tuples(maybe, maybe), min_size=1, max_size=6))
def test_expand_against_python(spark, data):
    d = spark.createDataFrame(data, "a long, b long")
    assert sorted(out(q.expand(d, "a", "b")), key=repr) == sorted(itertools.product({a for a, _ in data}, {b for _, b in data}), key=repr)


def test_pivot_longer(spark):
    d = spark.createDataFrame([("A", 1, 2, 3, 4)], "c string, vault_2012 long, floor_2012 long, vault_2016 long, floor_2016 long")
    assert sorted(out(q.pivot_longer(d, "c", names_to=["event", "year"], names_sep="_", names_transform={"year": int}))) == [("A", "floor", 2012, 2), ("A", "floor", 2016, 4), ("A", "vault", 2012, 1), ("A", "vault", 2016, 3)]
    assert sorted(out(q.pivot_longer(d, "c", names_to=[".value", "year"], names_pattern="(.+)_(.+)").select("c", "year", "vault", "floor"))) == [("A", "2012", 1, 2), ("A", "2016", 3, 4)]
    x = spark.createDataFrame([(1, 4, 5)], "id long, x1 long, x2 long")
    assert sorted(out(q.pivot_longer(x, "id", names_to=".value", names_pattern="(.)"))) == [(1, 4), (1, 5)]
    f = spark.createDataFrame([("H", 1, 2, 3, 4, 5)], "city string, Mango long, Orange long, Melon long, Gin long, Vodka long")
    got = q.pivot_longer(f, "city", names_to=["Fruit", "Drink"], values_to=["Pounds", "Ounces"], names_pattern=["M|O", "G|V"])
    assert sorted(out(got.select("Fruit", "Drink", "Pounds", "Ounces")), key=repr) == sorted([("Mango", "Gin", 1, 4), ("Orange", "Vodka", 2, 5), ("Melon", None, 3, None)], key=repr)
    with pytest.raises(ValueError):
        q.pivot_longer(d, "c", names_to=["a", "b", "e"], names_sep="_")
    with pytest.raises(KeyError):
        q.pivot_longer_spec(d, [{"x": 1}])


def test_pivot_wider(spark):
    d = spark.createDataFrame([("01", "income", 10, 1), ("01", "rent", 20, 2), ("02", "income", 30, 3)], "g string, variable string, estimate long, error long")
    w = q.pivot_wider(d, "g", "variable", ["estimate", "error"])
    assert w.columns == ["g", "estimate_income", "estimate_rent", "error_income", "error_rent"] and out(w, "g") == [("01", 10, 20, 1, 2), ("02", 30, None, 3, None)]
    with pytest.raises(Exception, match="several rows"):
        q.pivot_wider(d.union(d), "g", "variable", "estimate").collect()


def test_names(spark):
    d = spark.createDataFrame([(1, 2, 3)], ["Bell Chart", "decorated-elephant", "animals@#$%^"])
    assert q.clean_names(d, remove_special=True).columns == ["bell_chart", "decorated_elephant", "animals"]
    assert q.limit_column_characters(d.toDF("abcd", "abce", "x"), 3).columns == ["abc", "abc_1", "x"]
    assert q.drop_duplicate_columns(d.toDF("a", "b", "a"), "a", 1).columns == ["a", "b"]
    assert q.clean_names(spark.createDataFrame([("Crème-Brûlée é",)], ["x"]), axis=None, column_names="x").first()[0] == "creme_brulee_e"
    with pytest.raises(KeyError):
        q.select(d, "zz*")
    q.idempotent(q.clean_names, d)


def test_scalar(spark):
    m = spark.createDataFrame([(" 24.56",), ("-",), ("(12.12)",), ("1,000,000",), ("",), (None,)], "a string")
    assert [r[0] for r in q.currency_column_to_numeric(m, "a", "accounting").collect()] == [24.56, 0.0, -12.12, 1000000.0, None, None]
    e = spark.createDataFrame([("foo",), ("1.23 dollars",), ("-1,000 yen",), ("",)], "a string")
    assert [r[0] for r in q.currency_column_to_numeric(e, "a", cast_non_numeric={"foo": 42}).collect()] == [42.0, 1.23, -1000.0, None]
    c = spark.createDataFrame([(1.0, 2, 2.0), (None, 3, math.nan), (3.0, 1, 9.0)], "a double, b long, c double")
    assert [r[0] for r in q.coalesce(c.withColumn("a", F.lit(None).cast("double")), "a", "c", "b").collect()] == [2.0, 3.0, 9.0]
    with pytest.raises(ValueError):
        q.coalesce(c, "a")
    x = q.convert_excel_date(spark.createDataFrame([(39690.5,)], "d double"), "d").first()[0]
    assert str(x) == "2008-08-30 12:00:00"
    s = spark.createDataFrame([("A21",), ("A3",), ("B12",), ("B2",), (None,)], "w string")
    assert [r[0] for r in q.sort_naturally(s, "w").collect()] == ["A3", "A21", "B2", "B12", None]
    t = spark.createDataFrame([("hello wOrld",), (None,)], "t string")
    for name, kw in (("title", {}), ("swapcase", {}), ("capitalize", {}), ("zfill", {"width": 14}), ("center", {"width": 16}), ("rfind", {"sub": "o"}), ("removeprefix", {"prefix": "hel"})):
        want = getattr("hello wOrld", name)(*kw.values())
        assert [r[0] for r in q.process_text(t, "t", name, **kw).collect()] == [want, None], name


def test_order(spark):
    d = spark.createDataFrame([(1, None, 1.0), (2, "a", None), (3, None, 3.0), (4, "b", None)], "i long, s string, v double")
    assert [r[1] for r in out(q.fill_direction(d, order_by="i", s="downup"), "i")] == ["a", "a", "a", "b"]
    assert [r[-1] for r in out(q.count_cumulative_unique(d, "s", "n", order_by="i"), "i")] == [0, 1, 1, 2]
    assert [r[-1] for r in out(q.factorize_columns(d, "s", order_by="i"), "i")] == [-1, 0, -1, 1]
    j = spark.createDataFrame([(1, 0.0), (2, 5.0), (3, 5.0), (4, 0.0), (5, 0.0)], "i long, v double")
    assert [r[-1] for r in out(q.flag_jumps(j, order_by="i", columns="v"), "i")] == [0, 1, 0, 1, 0]
    assert q.drop_constant_columns(spark.createDataFrame([(1, None, 2), (1, None, None)], "a long, b long, c long")).columns == ["b"]
    assert out(q.groupby_agg(spark.createDataFrame([("x", 1), (None, 2)], "k string, v long"), "k", "n", "v", "sum"), "v") == [("x", 1, 1), (None, 2, None)]


def test_math(spark):
    xs = [-9.0, -3.5, -1.0, -1e-3, 0.0, 0.3, 1.96, 3.0, 5.5]
    d = spark.createDataFrame([(x,) for x in xs], "x double")
    n = statistics.NormalDist()
    for x, y in d.select("x", mathx.normal_cdf(F.col("x"))).collect():
        assert math.isclose(y, 0.5 * math.erfc(-x / math.sqrt(2)), rel_tol=1e-9, abs_tol=1e-15)
    for p, y in spark.createDataFrame([(p,) for p in (1e-6, 0.01, 0.3, 0.5, 0.975)], "p double").select("p", mathx.probit(F.col("p"))).collect():
        assert abs(y - n.inv_cdf(p)) < 1e-7


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("x,y\n3,4\n")
    assert sorted(out(q.read_csvs(spark, f"{tmp_path}/*.csv"))) == [(1, 2), (3, 4)]
    assert set(q.read_csvs(spark, f"{tmp_path}/*.csv", separate_df=True)) == {"a.csv", "b.csv"}
    (tmp_path / "c.csv").write_text("x,z\n3,4\n")
    with pytest.raises(ValueError):
        q.read_csvs(spark, f"{tmp_path}/*.csv")
    assert out(q.read_commandline(spark, ["cat", f"{tmp_path}/a.csv"])) == [(1, 2)]
    (tmp_path / "s.fa").write_text(">s1 first\nAC\nGT\n>s2\nTTT\n")
    ids = spark.createDataFrame([("s1",), ("s2",)], "id string")
    assert out(q.join_fasta(ids, f"{tmp_path}/s.fa", "id", "seq"), "id") == [("s1", "ACGT"), ("s2", "TTT")]
    with pytest.raises(Exception, match="no sequence"):
        q.join_fasta(spark.createDataFrame([("s9",)], "id string"), f"{tmp_path}/s.fa", "id", "seq").collect()


def test_spreadsheet(spark, tmp_path):
    m = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    p = "http://schemas.openxmlformats.org/package/2006/relationships"
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{p}"><Relationship Id="rId1" Type="{r}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}"><si><t>name</t></si><si><t>n</t></si><si><t>ada</t></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{m}"><fonts><font><b/></font></fonts><cellXfs><xf numFmtId="0"/><xf numFmtId="14" fontId="0"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{m}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>7</v></c><c r="C2" s="1"><v>39690.5</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/_rels/sheet1.xml.rels", f'<Relationships xmlns="{p}"><Relationship Id="r1" Type="{r}/table" Target="../tables/table1.xml"/></Relationships>')
        z.writestr("xl/tables/table1.xml", f'<table xmlns="{m}" displayName="T" ref="A1:B2"><tableColumns><tableColumn name="name"/><tableColumn name="n"/></tableColumns></table>')
    path = str(tmp_path / "w.xlsx")
    assert out(q.xlsx_table(spark, path, table="T")) == [("ada", 7)]
    cells = q.xlsx_cells(spark, path, font=True, include_blank_cells=False)
    assert cells.count() == 5 and cells.where("coordinate = 'C2' and is_date and value like '2008-08-30 12%'").count() == 1
    with pytest.raises(KeyError):
        q.xlsx_table(spark, path, table="U")


def test_stream(spark, tmp_path):
    from quern.streaming.rows import apply_stream

    spark.createDataFrame([(1, 2.0)], "a long, b double").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("a long, b double").parquet(str(tmp_path / "in"))
    long = apply_stream(s, q.pivot_longer, index="a")
    w = long.writeStream.format("memory").queryName("longer").trigger(availableNow=True).start()
    w.awaitTermination(60)
    assert out(spark.table("longer")) == [(1, "b", 2.0)]
    with pytest.raises(ValueError):
        apply_stream(s, q.take_first, "a", "b")
    with pytest.raises(ValueError):
        q.get_dupes(s, "a")


def test_registration(spark):
    @q.register_dataframe_method
    def first_column_only(df):
        return df.select(df.columns[0])

    assert spark.range(3).withColumn("x", F.lit(1)).first_column_only().columns == ["id"]
    with pytest.raises(ValueError):
        q.register_dataframe_method(lambda df: df) if False else q.register_dataframe_method(type("f", (), {"__name__": "select", "__call__": lambda s, d: d})())


names = st.sampled_from(["a", "b", "`c d`"])
atoms = st.one_of(
    st.tuples(names, st.sampled_from(["<", "<=", ">", ">=", "==", "!="]), st.integers(-3, 3)).map(lambda t: f"{t[0]} {t[1]} {t[2]}"),
    st.tuples(names, st.sampled_from(["in", "not in"]), st.lists(st.integers(-3, 3), min_size=1, max_size=3)).map(lambda t: f"{t[0]} {t[1]} {t[2]}"),
    st.tuples(st.sampled_from(["==", "!="]), st.sampled_from(["x[1]", "p & q", "~r", "it's | so"])).map(lambda t: f's {t[0]} "{t[1]}"'),
)
texts = st.recursive(atoms, lambda x: st.one_of(st.tuples(x, st.sampled_from([" & ", " | ", " and ", " or "]), x).map(lambda t: f"({t[0]}{t[1]}{t[2]})"), x.map(lambda t: f"not ({t})"), x.map(lambda t: f"~({t})")), max_leaves=6)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts, st.booleans())
def test_conditions_against_python(spark, text, complement):
    rows = [(i, a, float(b) if b is not None else math.nan, c, s) for i, (a, b, c, s) in enumerate(itertools.product([-2, 0, 3, None], [1, None], [0, 2], ["x[1]", "p & q", "~r", "it's | so", None]))]
    d = spark.createDataFrame(rows, "i long, a long, b double, `c d` long, s string")

    class Maybe:
        """A value that meets no comparison but != where it is missing."""

        def __init__(self, v):
            self.v = None if v != v else v

        def __eq__(self, o):
            return self.v is not None and self.v == o

        def __ne__(self, o):
            return self.v is None or self.v != o

        __hash__ = None

        def __lt__(self, o):
            return self.v is not None and self.v < o

        def __le__(self, o):
            return self.v is not None and self.v <= o

        def __gt__(self, o):
            return self.v is not None and self.v > o

        def __ge__(self, o):
            return self.v is not None and self.v >= o

    bare = "".join(x if x[:1] == '"' else x.replace("&", " and ").replace("|", " or ").replace("~", " not ").replace("`c d`", "c_d") for x in __import__("re").split(r'("[^"]*")', text))
    want = {i for i, a, b, c, s in rows if eval(bare, {"a": Maybe(a), "b": Maybe(b), "c_d": Maybe(c), "s": Maybe(s)}) != complement}
    assert {r["i"] for r in q.filter_on(d, text, complement).collect()} == want


def test_conditions(spark):
    d = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, 3.0, None)], "a long, b double, s string")
    assert out(q.filter_on(d, "a % 2 == 1 and -b < -2").select("a")) == [(3,)]
    assert out(q.filter_on(d, "1 < a <= 2").select("a")) == [(2,)] and out(q.filter_on(d, "s is None or b is not None").select("a"), "a") == [(1,), (3,)]
    assert out(q.filter_on(d, "length(s) = 1 AND s LIKE 'a%'").select("a")) == [(1,)] and out(q.filter_on(d, "upper(s) == 'B'").select("a")) == [(2,)]
    assert out(q.update_where(d, "~(a > 1)", "s", "z").select("s"), "s") == [(None,), ("b",), ("z",)]


@few
@given(st.lists(maybe, max_size=7), st.lists(maybe, max_size=7), st.sampled_from([">", ">=", "<", "<="]), st.sampled_from(["first", "last"]), st.sampled_from(["inner", "left", "outer", "left_semi", "left_anti"]), st.booleans())
def test_single_inequality_against_python(spark, left, right, op, keep, how, equal):
    import operator

    f = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}[op]
    a = spark.createDataFrame([(i, x, i % 2) for i, x in enumerate(left)], "i long, x long, k long")
    b = spark.createDataFrame([(j, y, j % 2) for j, y in enumerate(right)], "j long, y long, m long")
    match = {i: [j for j, y in enumerate(right) if None not in (x, y) and f(x, y) and (not equal or i % 2 == j % 2)] for i, x in enumerate(left)}
    conditions = [("x", "y", op)] + ([("k", "m", "==")] if equal else [])
    if how.startswith("left_"):
        got = q.conditional_join(a, b, *conditions, how=how, df_columns="i")
        assert sorted(r[0] for r in got.collect()) == [i for i in match if bool(match[i]) == (how == "left_semi")]
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
        return
    pick = min if keep == "first" else max
    want = [(i, pick(js)) for i, js in match.items() if js] + [(i, None) for i, js in match.items() if not js and how != "inner"]
    if how == "outer":
        want += [(None, j) for j in range(len(right)) if j not in {p[1] for p in want}]
    got = q.conditional_join(a, b, *conditions, how=how, keep=keep, order_by="j", df_columns="i", right_columns="j")
    assert sorted(out(got), key=repr) == sorted(want, key=repr)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


@few
@given(st.lists(maybe, max_size=7), st.lists(st.tuples(maybe, st.one_of(maybe, st.just(1000))), max_size=7), st.sampled_from(["left_semi", "left_anti"]), st.booleans())
def test_interval_exists_against_python(spark, points, spans, how, turned):
    a = spark.createDataFrame(list(enumerate(points)), "i long, x long")
    b = spark.createDataFrame([(j, *r) for j, r in enumerate(spans)], "j long, lo long, hi long")
    inside = lambda x, r: None not in (x, *r) and r[0] <= x < r[1]
    if turned:
        got = q.conditional_join(b, a, ("lo", "x", "<="), ("hi", "x", ">"), how=how, df_columns="j")
        want = [j for j, r in enumerate(spans) if any(inside(x, r) for x in points) == (how == "left_semi")]
    else:
        got = q.conditional_join(a, b, ("x", "lo", ">="), ("x", "hi", "<"), how=how, df_columns="i")
        want = [i for i, x in enumerate(points) if any(inside(x, r) for r in spans) == (how == "left_semi")]
    assert sorted(r[0] for r in got.collect()) == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_numbers_of_rows(spark):
    from quern.core import bounded, numbered

    d = spark.range(1000, numPartitions=7).select((F.col("id") * 7 % 1000).alias("v"))
    assert sorted(out(numbered(d, "n", [F.col("v")]))) == [(i, i) for i in range(1000)]
    assert sorted(r["n"] for r in numbered(d, "n").collect()) == list(range(1000)) and numbered(d.limit(0), "n").count() == 0
    with pytest.raises(ValueError):
        bounded(d, "test", 999)
    plan = mathx.probit(mathx.normal_cdf(mathx.probit(mathx.normal_cdf(F.col("v") / 1000))))
    assert len(d.select(plan.alias("p"))._jdf.queryExecution().optimizedPlan().toString()) < 200_000
    x = d.select("v", plan.alias("p")).where("v = 500").first()
    assert abs(x["p"] - 0.5) < 1e-14


def test_units(spark):
    from quern.operators.domain import _unit as unit

    for a, b in (("kN", "kg*km/s**2"), ("kWh", "3.6*MJ"), ("Pa", "N/m**2"), ("Hz", "1/s"), ("mV", "m*m*kg/s^3/A/1000"), ("L", "dm**3")):
        assert unit(a)[0] == unit(b)[0] and math.isclose(unit(a)[1], unit(b)[1], rel_tol=1e-12), (a, b)
    d = spark.createDataFrame([(20.0,)], "x double")
    assert abs(q.convert_units(d, "x", "degC", "K", "y").first()["y"] - 293.15) < 1e-9
    for a, b in (("m", "s"), ("m", "zz"), ("m**0.5", "m"), ("m+s", "m"), ("import", "m")):
        with pytest.raises(ValueError):
            q.convert_units(d, "x", a, b, "y")
