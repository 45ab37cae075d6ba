"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names: the results that docstrings define."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import components, fertility, line_dedup, mixing, near_dedup, packing, scratch, secrets, sharding, toxicity, url_rules, vector_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, H string, chain double, band int"
WORDS = [a + b for a in ("ta", "re", "mi", "so", "la", "ne", "ku", "po") for b in ("ran", "lis", "dem", "vor", "tag", "bel", "nox", "pir")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(5, 60)) for _ in range(30)]
    texts += [texts[0]] * 3 + [None, "", " \n ", "word", prose(rng, 20_000), "x" * 300_000]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", len(t or ""), i, "x", 0.5, 1) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[4], "en", "s1", 1, 1, None, None, None), (None,) * 9]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_packing(spark, odd):
    d, rows = odd
    got = packing.pack(d, window=64).toPandas()
    want = sum(len((r[1] or "").replace("\n", " ").split()) for r in rows)
    assert (got.end - got.start).sum() == want and (got.end > got.start).all()
    load = (got.end - got.start).groupby(got.window).sum()
    assert load.index.tolist() == list(range(len(load))) and (load.iloc[:-1] == 64).all()
    # a null id has its null, a repeated one all its rows, a text without words none
    assert got[got.doc_id.isna()].end.max() == len(rows[4][1].split()) and (got[got.doc_id == 3].start == 0).sum() == 3
    assert not set(got.doc_id) & {33, 34, 35}
    assert packing.pack(d.limit(0)).count() == 0 and packing.pack(d.where("doc_id in (33, 34)")).count() == 0


def test_toxicity(spark, odd):
    d, rows = odd
    rng = random.Random(2)
    base = spark.createDataFrame([(1000 + i, prose(rng, 40) + (" vile rotten scum vile rotten" if i % 4 == 0 else ""), "en") for i in range(400)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1000 + i, int(i % 4 == 0)) for i in range(400)] + [(1001, None), (None, 1), (1002, 0), (1000, 0)], "doc_id long, toxic int")
    bad = spark.createDataFrame([(None, prose(rng, 40) + " vile rotten scum vile rotten", None)] + [(5, prose(rng, 40) + " vile rotten scum vile rotten", "xx")] * 2, "doc_id long, text string, lang string")
    every = base.unionByName(bad).unionByName(d.select("doc_id", "text", "lang"))
    rejected = [r["doc_id"] for r in toxicity.toxic_passages(every, labels).select("doc_id", "p_toxic", "passage").collect() if r["passage"]]
    assert None in rejected and rejected.count(5) == 2 and {1000 + i for i in range(0, 400, 4)} <= set(rejected)
    kept = toxicity.drop_toxic(every.withColumn("p_toxic", F.lit("mine")).withColumn("passages", F.lit(1)), labels)
    assert kept.columns == ["doc_id", "text", "lang", "p_toxic", "passages"] and kept.count() == 300 + len(rows)
    assert toxicity.toxic_passages(every, labels.where("toxic = 0")).count() == 0 and toxicity.toxic_passages(every.limit(0), labels).count() == 0


def test_secrets(spark):
    key = np.random.default_rng(3).bytes(20).hex()
    text = "password = " + key
    d = spark.createDataFrame([(1, text, 1), (1, text, 1), (None, text, 1), (2, "z " * 400_000 + text, 1), (3, None, 1), (4, "", 1), (5, text + " " + text, 1)], "doc_id long, text string, start int")
    got = [(r["doc_id"], r["start"]) for r in secrets.find_secrets(d).collect()]
    assert sorted(got, key=repr) == sorted([(1, 11), (1, 11), (None, 11), (2, 800_011), (5, 11), (5, len(text) + 12)], key=repr)
    assert len({r["digest"] for r in secrets.find_secrets(d).collect()}) == 1 and secrets.find_secrets(d.limit(0)).count() == 0


def test_fertility(spark, odd):
    d, rows = odd
    got = fertility.fertility(d).toPandas()
    assert len(got) == len(rows) and got[got.doc_id.isin([33, 34, 35])].kept.all() and got[got.doc_id.isin([33, 34, 35])].entropy.isna().all()
    whole = got[got.doc_id == 37].n_tokens.iloc[0]
    enc, *_ = fertility.vocabularies(fertility.VOCABULARIES)
    assert whole == sum(len(enc.encode_ordinary(" " + w)) for w in rows[37][1].split()) and (got[got.doc_id == 3].n_tokens.nunique(), (got.doc_id == 3).sum()) == (1, 3)


def test_mixing_ties(spark):
    # equal ids have equal odds; the lesser id comes first, equal ones together
    d = spark.createDataFrame([(i // 3, "x" * 8, None if i % 2 else "s", i) for i in range(120)] + [(None, None, "s", -1)], "doc_id long, text string, source string, m_key long")
    for total in (10, 60, 300):
        got = mixing.mix_sources(d, total=total)
        assert got.columns == d.columns
        n = got.groupBy("source").count().collect()
        want = mixing.places({None: 60, "s": 61}, total)
        assert {r["source"] for r in n} == {None, "s"} and all(want[r["source"]] <= r["count"] <= want[r["source"]] + 2 for r in n)
        again = mixing.mix_sources(d, total=total)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, again.collect()), key=repr)
    assert mixing.mix_sources(d.limit(0)).count() == 0


def test_sharding(spark, odd):
    d, rows = odd
    got = sharding.assign_shards(d, group_col="source", capacity=100_000, shard_col="rid").toPandas()
    assert list(got.columns) == [*d.columns, "_rid"] and len(got) == len(rows)
    for s in ("s1", "s2"):
        assert got[got.source == s]._rid.nunique() == 1
    again = sharding.assign_shards(d, group_col="source", capacity=100_000).toPandas()
    assert sorted(again.groupby("shard").size()) == sorted(got.groupby("_rid").size()) and set(again.shard) == set(range(again.shard.nunique()))
    assert sharding.assign_shards(d.limit(0)).count() == 0 and sharding.shard_documents(d.limit(0)).count() == 0


def test_ids_of_other_kinds(spark):
    rng = random.Random(3)
    texts = [prose(rng, 40) for _ in range(12)]
    rows = [(datetime.date(2020, 1, 1 + i), t) for i, t in enumerate(texts + texts[:6])]
    d = spark.createDataFrame(rows, "doc_id date, text string")
    got = {r["doc_id"]: r["duplicate_of"] for r in near_dedup.near_duplicates(d).collect()}
    assert got == {datetime.date(2020, 1, 13 + i): datetime.date(2020, 1, 1 + i) for i in range(6)}
    left = [r["text"] for r in line_dedup.dedup_lines(d).collect()]
    assert sorted(t for t in left if t) == sorted(texts) and len(left) == 18


def test_clashing_names(spark):
    v = spark.createDataFrame([(i, [1.0, float(i % 2)], "c", i, 1, "v") for i in range(6)] + [(None, None, None, None, None, None)], "vec_id long, embedding array<double>, cell string, home int, block int, vec string")
    assert {r["vec_id"]: r["duplicate_of"] for r in vector_join.near_duplicates(v).collect()} == {2: 0, 4: 0, 3: 1, 5: 1}
    u = spark.createDataFrame([(1, "http://m.x.org/", "a", False)], "page_id int, url string, RULES string, Blocked boolean")
    assert url_rules.filter_urls(u).columns == ["page_id", "url", "RULES", "Blocked", "_rules", "_blocked"]
    d = spark.createDataFrame([(1, "a b c\nline", "x", 1, 2), (2, "other\nline", "x", 1, 2)], "doc_id long, text string, line_doc string, line_gone int, REMOVED_LINES int")
    got = line_dedup.dedup_lines(d)
    assert got.columns == [*d.columns, "_removed_lines"] and [r["text"] for r in got.orderBy("doc_id").collect()] == ["a b c\nline", "other"]


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (None, 1), (3, 1), (3, 2)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}
    hub = spark.range(1, 3000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    assert components.components(hub).where("root <> 0").count() == 0 and components.components(e.limit(0)).count() == 0


def test_kept_tables_go(spark, monkeypatch):
    since = scratch.mark()
    a, b = scratch.keep(spark.range(5), "a"), scratch.keep(spark.range(6), "b")
    scratch.release(spark, since, b)
    assert b.count() == 6 and scratch.mark() == since + 1
    with pytest.raises(Exception, match="does not exist|DOES_NOT_EXIST|FAILED_READ|FileNotFound"):
        a.count()

    class Cluster:
        conf = type("Unset", (), {"get": staticmethod(lambda name, default: default)})
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    monkeypatch.setattr(scratch, "_own", None)
    with pytest.raises(RuntimeError):
        scratch.shared_dir(Cluster)


def test_pipeline(spark, odd, tmp_path):
    d, rows = odd
    rng = random.Random(6)
    shared = "\n".join(prose(rng, 12) for _ in range(6))
    more = [(100 + i, prose(rng, 40) + "\n" + shared, "en", "hot") for i in range(20)] + [(200 + i, prose(rng, 30) + " vile rotten scum vile rotten", "en", "hot") for i in range(40)]
    more += [(300 + i, prose(rng, 50), "en", "hot") for i in range(60)]
    docs = d.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string")).withColumn("n_chars", F.length("text").cast("long")).withColumn("extra", F.lit(1))
    labels = [(200 + i, 1, 1) for i in range(40)] + [(300 + i, 1, 0) for i in range(60)] + [(None, 1, 1), (5, None, None)]
    for name, table in (("full", docs), ("empty", docs.limit(0))):
        sf = str(tmp_path / name)
        table.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        got = corpus_pipeline.run(spark, sf).toPandas()
        if name == "empty":
            assert len(got) == 0
            continue
        ids = set(got.doc_id.dropna().astype(int))
        assert not ids & {200 + i for i in range(40)} and not ids & {33, 34, 35}
        load = (got.end - got.start).groupby(got.window).sum()
        assert load.index.tolist() == list(range(len(load))) and (load.iloc[:-1] == packing.WINDOW).all()
        # stage by stage: what line and near deduplication leave
        step = spark.read.parquet(f"{sf}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:3]:
            step = scratch.keep(f(spark, step, sf))
            assert step.columns == docs.columns
        assert {300 + i for i in range(60)} <= {r["doc_id"] for r in step.collect()}
        lines = [x for r in step.collect() for x in (r["text"] or "").split("\n") if x.strip()]
        assert sum(lines.count(x) for x in shared.split("\n")) == 6 and len({30, 31, 32} & {r["doc_id"] for r in step.collect()}) == 0
