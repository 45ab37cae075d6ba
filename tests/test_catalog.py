"""Every catalog query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from quern.plans import catalog

SF = "/root/testdata/sf0.001"


def rows(d: pd.DataFrame) -> list:
    def plain(v):
        if pd.isna(v):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    return sorted((tuple(plain(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLES:
        want = con.execute(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry_without_llm(monkeypatch, spark):
    import builtins

    import __spark_entry__ as e

    real = builtins.__import__

    def no_llm(name, *a, **k):
        if name.startswith(("quern.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name, name=name)
        return real(name, *a, **k)

    def broken(name, *a, **k):
        if name == "quern.llm" or name == "corpus_pipeline":
            raise ModuleNotFoundError("x", name="some_library")
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", broken)
    with pytest.raises(ModuleNotFoundError):
        e.queries()
    monkeypatch.setattr(builtins, "__import__", no_llm)
    assert set(e.queries()) == set(catalog.QUERIES)
    assert set(e.oracle_sql()) == set(catalog.ORACLES)
