"""The ten operators and the pipeline: brute force on small tables, and defined results on messy ones."""

import base64
import itertools
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import fertility, line_dedup, mixing, near_dedup, packing, secrets, sharding, toxicity, url_rules, vector_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone long, SIZE string, p double"
WORDS = [a + b for a in ("ta", "re", "mi", "so", "la", "ne", "ku", "po") for b in ("ran", "lis", "dem", "vor", "tag", "bel", "nox", "pir")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def messy(spark):
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(5, 80)) for _ in range(40)]
    texts += [texts[0]] * 3 + [texts[1] + " extra", None, "", " \n\t ", "é", "word", prose(rng, 30000), "same line\n" + texts[2] + "\nsame line", "a\x00b c"]
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 11 == 0 else f"s{i % 3}", len(t or ""), i, "x", 0.5) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[4], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 5 == 0) for i in range(40)] + [(3, None, None), (None, 1, True)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))


def test_messy(spark, messy, empty, labels):
    n = messy.count()
    for d, size in ((messy, n), (empty, 0)):
        assert d.columns == toxicity.drop_toxic(d, labels).columns and toxicity.drop_toxic(d, labels.limit(0)).count() == size
        toxicity.toxic_passages(d, labels).collect()
        lines = line_dedup.dedup_lines(d)
        assert lines.columns == [*d.columns, "removed_lines"] and lines.count() == size
        near_dedup.near_duplicates(d).collect()
        assert near_dedup.keep_one(d).columns == d.columns
        mixed = mixing.mix_sources(d)
        assert mixed.columns == d.columns and mixed.count() == size
        packing.pack(d, window=64).collect()
        assert sharding.shard_documents(d, capacity=2000).count() == size
        assert sharding.assign_shards(d, group_col="source", capacity=2000).count() == size
        secrets.find_secrets(d).collect()
        assert fertility.fertility(d).count() == size
    kept = {r["doc_id"] for r in near_dedup.keep_one(messy).collect()}
    assert 0 in kept and not {40, 41, 42} & kept and {44, 45, 46, None} <= kept
    text = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(messy).collect()}
    assert text[44] is None and text[45] == "" and text[50].count("same line") == 1 and text[40] == ""


def test_urls(spark):
    urls = spark.createDataFrame([(1, "http://a.example.net/en/5"), (2, None), (3, ""), (4, "https://m.x.org/fr/1?utm_source=a"), (4, "http://x.org/" + "a/" * 9000 + "login"), (5, "http://x.org/de/5\n")], "rules int, url string")
    got = url_rules.filter_urls(urls)
    assert got.columns == ["rules", "url", "_rules", "blocked"]
    for r in got.collect():
        hit = [] if r["url"] is None else [(i, a) for i, a, p in url_rules.RULES if url_rules.compiled(p).search(r["url"])]
        assert r["_rules"] == ",".join(str(i) for i, _ in sorted(hit))
        assert r["blocked"] == (any(a == "block" for _, a in hit) and not any(a == "allow" for _, a in hit))
    assert url_rules.filter_urls(urls.limit(0)).count() == 0 and not any(r["blocked"] for r in url_rules.filter_urls(urls, rules=[]).collect())
    with pytest.raises(ValueError):
        url_rules.filter_urls(urls, rules=[(1, "block", "a"), (1, "allow", "b")])
    assert [t for t, _ in url_rules.sure(r"/(login|cart)(/|\?|$)")] == [["login"]] * 3 + [["cart"]] * 3
    assert {(*t, r) for t, r in url_rules.sure(r"[?&](utm_[a-z]+|gclid)=")} == {("utm", "utm_"), ("gclid", "gclid=")} and url_rules.sure(r"abc") == [([], "abc")]
    assert [t for t, _ in url_rules.sure(r"^https?://ads?\.")] == [["http", "ad"], ["http", "ads"], ["https", "ad"], ["https", "ads"]]
    index = url_rules.Index(url_rules.RULES, {"http": 10**6, "https": 10**6})
    assert index.always == [] and {url_rules.RULES[k][0] for ks in index.by_run.values() for k in ks} == {13, 16}


def test_url_index_loses_no_match():
    rng = random.Random(4)
    parts = ["http://", "https://", "m.", "ads.", "ad.", "www.a.example.org", "example.net", "/login", "/cart?", "?ref=x", "&utm_a=", "gclid=", ".jpg", "/tag/", "page=7", "&page=12", "session=af", "sessionid=0", "#comments", "#comment", "casino", "//x--y", "1.2.3.4:", "/feed.xml", "/rss", "/wp-login", "/de/5#top", "/fr/1?page=2&ref=x", "x", "/", "É", "K"]
    index = url_rules.Index(url_rules.RULES, {})
    for _ in range(4000):
        u = "".join(rng.choice(parts) for _ in range(rng.randint(1, 6)))
        u = u.upper() if rng.random() < 0.2 else u
        assert index.match(u)[0] == sorted(i for i, _, p in url_rules.RULES if url_rules.compiled(p).search(u)), u


def test_best_fit():
    rng = random.Random(3)
    for cap in (10, 37, 100):
        sizes = [rng.randint(1, cap + 5) for _ in range(400)]
        bins = []
        for s in sorted(sizes, reverse=True):
            fit = [i for i, left in enumerate(bins) if left >= s] if s <= cap else []
            if fit:
                bins[min(fit, key=lambda i: bins[i])] -= s
            else:
                bins.append(max(0, cap - s))
        hist = {s: sizes.count(s) for s in set(sizes)}
        runs, n = sharding.pack(list(hist.items()), cap)
        assert n == len(bins)
        load = {}
        for k, (s, rank, first, per) in enumerate(runs):
            end = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == s else hist[s]
            for r in range(rank, end):
                load.setdefault(first + (r - rank) // per, []).append(s)
        assert sorted(x for v in load.values() for x in v) == sorted(sizes)
        assert sorted(max(0, cap - sum(v)) for v in load.values()) == sorted(bins)


def test_shards(spark, messy):
    got = sharding.shard_documents(messy.where("doc_id is not null and text is not null"), capacity=1500).join(messy.select("doc_id", "text").dropDuplicates(), "doc_id").toPandas()
    assert (got.groupby("text").shard.nunique() == 1).all()
    load = got.assign(b=got.text.str.encode("utf-8").str.len() + 16).groupby("shard").b.agg(["sum", "nunique"])
    assert ((load["sum"] <= 1500) | (load["nunique"] == 1)).all()
    tiny = sharding._assign(spark.range(50).withColumn("k", F.col("id").cast("string")), F.col("k"), F.lit(10).cast("long"), 100, "shard", ("a", "b", "c", "d"), 7, spark)
    assert sorted(r["count"] for r in tiny.groupBy("shard").count().collect()) == [10] * 5


def test_mixing(spark):
    d = spark.createDataFrame([(i, "x" * (i % 90), "big" if i % 10 else "small") for i in range(2000)], "doc_id long, text string, source string")
    got = mixing.mix_sources(d, targets={"big": 1, "small": 1}, total=1000).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in got} == {"big": 500, "small": 500}
    copies = mixing.mix_sources(d, targets={"small": 1}, total=1000).groupBy("doc_id").count().toPandas()
    w = {i: int(np.sqrt(i % 90)) + 1 for i in range(0, 2000, 10)}
    for i, c in copies.itertuples(index=False):
        m = 1000 * w[i] / sum(w.values())
        assert int(m) <= c <= int(m) + 1
    with pytest.raises(ValueError):
        mixing.mix_sources(d, targets={"big": -1.0})
    # inclusion frequencies over seeds follow the wanted chances
    one = d.where("doc_id < 60")
    hits = np.zeros(60)
    for seed in range(12):
        for r in mixing.mix_sources(one, targets={"big": 1}, total=20, seed=str(seed)).collect():
            hits[r["doc_id"]] += 1
    assert np.corrcoef(hits[[i for i in range(60) if i % 10]], [np.sqrt(i) for i in range(60) if i % 10])[0, 1] > 0.25


def test_minhash_recall(spark):
    rng = random.Random(9)
    base = [[rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(80)] for _ in range(60)]
    docs, sets = [], []
    for i, w in enumerate(base):
        docs.append(w)
        docs.append([x if rng.random() > 0.04 else "changed" + str(rng.random()) for x in w])
    sets = [{tuple(x[i : i + 3]) for i in range(len(x) - 2)} for x in docs]
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")
    got = {r["doc_id"]: r["duplicate_of"] for r in near_dedup.near_duplicates(d).collect()}
    true = [(a, b) for a, b in itertools.combinations(range(len(docs)), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6]
    assert len(true) > 30 and sum(got.get(b) == a for a, b in true) >= 0.9 * len(true)
    assert all(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.3 for b, a in got.items())


def test_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8))
    x[300:] = x[:300] + rng.normal(size=(300, 8)) * 0.05
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(600, [0.0] * 8), (601, None), (602, [None] * 8), (None, [1.0] * 8), (603, [1.0, 2.0]), (604, [2.0, 4.0]), (5, rows5 := [float(v) for v in x[5]]), (605, rows5), (606, [float("nan")] * 8), (607, [])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    u = np.float32(x) / np.linalg.norm(np.float32(x), axis=1, keepdims=True)
    s = u @ u.T
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(s >= 0.9, 1)))} | {(603, 604)} | {(min(5, int(j)), max(5, int(j))) for j in np.flatnonzero(s[5] >= 0.9) if j != 5} | {(min(j, 605), 605) for j in np.flatnonzero(s[5] >= 0.9).tolist()}
    for cell, tile in ((4096, 2048), (64, 32)):
        got = {(r["a"], r["b"]) for r in vector_join.near_pairs(t, cell=cell, tile=tile).collect()}
        assert got == want
        dup = {r["vec_id"]: r["duplicate_of"] for r in vector_join.near_duplicates(t, cell=cell, tile=tile).collect()}
        root = {}
        find = lambda a: a if root.get(a, a) == a else find(root[a])
        for a, b in sorted(want):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        assert dup == {v: find(v) for v in {y for p in want for y in p} if find(v) != v}
    assert vector_join.near_duplicates(t.limit(0)).count() == 0


def test_neighbours_are_exact(spark):
    rng = random.Random(2)
    d = spark.createDataFrame([(i, prose(rng, rng.randint(3, 60))) for i in range(700)] + [(700, "one"), (701, "one")], "doc_id long, text string")
    points, nodes, links, s = packing.graph(d, k=5, cell=40)
    assert s > 1
    n = nodes.toPandas().sort_values("nid")
    z, ids = n[[f"z{j}" for j in range(packing.DIMS)]].to_numpy(float), n.nid.to_numpy()
    got = links.toPandas().groupby("a").d.apply(lambda x: sorted(x)).to_dict()
    full = ((z[:, None] - z[None]) ** 2).sum(-1)
    np.fill_diagonal(full, np.inf)
    for i, a in enumerate(ids):
        assert got[a] == np.sort(full[i])[:5].tolist()
    p = packing.pack(d, window=100, k=5, cell=40).toPandas()
    words = {r["id"]: r["n"] for r in points.select("id", "n").collect()}
    assert (p.assign(n=p.end - p.start).groupby("doc_id").n.sum().to_dict()) == words
    load = p.assign(n=p.end - p.start, region=p.window // 2**32).groupby(["region", "window"]).n.sum()
    assert (load <= 100).all() and all((g.iloc[:-1] == 100).all() for _, g in load.groupby(level=0))


def test_neighbours_in_all_features(spark, monkeypatch):
    rng = random.Random(4)
    kinds = [rng.sample(WORDS, 20) for _ in range(6)]
    d = spark.createDataFrame([(i, " ".join(rng.choice(kinds[i % 6] if rng.random() < 0.7 else WORDS) for _ in range(rng.randint(20, 90)))) for i in range(1500)], "doc_id long, text string")
    monkeypatch.setattr(packing, "LEAST", 2)
    points, nodes, links, cells = packing.graph(d, k=5, cell=40)
    n = nodes.select("nid", "f").toPandas()
    x = np.stack([np.frombuffer(f, np.uint8) for f in n.f]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T
    np.fill_diagonal(near, -1)
    true = {(a, b) for i, a in enumerate(n.nid) for b in n.nid.to_numpy()[np.argsort(-near[i])[:5]]}
    got = {(r["a"], r["b"]) for r in links.collect()}
    assert cells > 30 and len(got) == 5 * len(n) and len(got & true) >= 0.9 * len(true)


def test_walk():
    ids = np.array([1, 2, 3, 4, 9])
    paths = packing.walk(ids, np.array([1, 2, 2, 1, 0]), np.array([1, 2, 3]), np.array([2, 3, 4]), np.array([1.0, 1.0, 1.0]))
    assert paths == [[9], [1, 2, 3, 4]]
    doc, win, slot, start, end = packing.fill(np.array([3, 5, 2]), 4)
    assert list(zip(doc, win, slot, start, end)) == [(0, 0, 0, 0, 3), (1, 0, 1, 0, 1), (1, 1, 0, 1, 5), (2, 2, 0, 0, 2)]


def test_paths_join_over_regions(spark, monkeypatch):
    # path 0 = 1..2, path 1 = 5..6, path 2 = 9: 2-6 is the shortest, 5-9 next, 1-9 would close a ring
    chains = packing.join_paths(np.array([1, 5, 9]), np.array([2, 6, 9]), np.array([1, 9, 2]), np.array([9, 5, 6]), np.array([3.0, 2.0, 1.0]))
    nodes = [x for i, back in chains[0] for x in (([1, 2], [5, 6], [9])[i][::-1] if back else ([1, 2], [5, 6], [9])[i])]
    assert len(chains) == 1 and nodes in ([1, 2, 6, 5, 9], [9, 5, 6, 2, 1])
    rng = random.Random(6)
    d = spark.createDataFrame([(i, prose(rng, rng.randint(20, 60))) for i in range(400)], "doc_id long, text string")
    monkeypatch.setattr(packing, "REGION", 60)
    p = packing.pack(d, window=100, k=5, cell=20).toPandas().sort_values(["window", "slot"])
    _, nodes, links, _ = packing.graph(d, k=5, cell=20)
    region = {r["nid"]: r["region"] for r in nodes.select("nid", "region").collect()}
    assert len(set(region.values())) > 3
    load = (p.end - p.start).groupby(p.window).sum()
    assert load.index.tolist() == list(range(len(load))) and (load.iloc[:-1] == 100).all()
    assert (p.groupby("window").slot.apply(list).map(lambda x: x == list(range(len(x))))).all()
    of = {r["id"]: r["nid"] for r in packing._words(d, "doc_id", "text", 128).join(nodes.select("f", "nid"), "f").collect()}
    order = [of[x] for x in p.doc_id.drop_duplicates()]
    linked = {frozenset((r["a"], r["b"])) for r in links.collect()}
    assert any(region[a] != region[b] and frozenset((a, b)) in linked for a, b in zip(order, order[1:]))


def b64(x):
    return base64.urlsafe_b64encode(x).rstrip(b"=").decode()


def der(tag, body):
    n = len(body)
    head = bytes([n]) if n < 128 else bytes([0x80 | len(h := n.to_bytes((n.bit_length() + 7) // 8, "big"))]) + h
    return bytes([tag]) + head + body


def test_secrets(spark):
    rng = np.random.default_rng(1)
    key = der(0x30, der(2, b"\0") + b"".join(der(2, b"\x01" + rng.bytes(63)) for _ in range(8)))
    token = ".".join([b64(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()), b64(b'{"sub":"1"}'), b64(rng.bytes(32))])
    hexed = rng.bytes(20).hex()
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(x for x in [base64.b64encode(key).decode()[i : i + 64] for i in range(0, 900, 64)] if x) + "\n-----END RSA PRIVATE KEY-----"
    good = {0: ("signed_token", token), 1: ("keyed_value", f'token = "{hexed}"'), 2: ("rsa_private_key", pem), 3: ("rsa_private_key", key.hex()), 4: ("keyed_value", base64.b64encode(f'password="{hexed}" and more'.encode()).decode()), 5: ("rsa_private_key", base64.b64encode(key).decode())}
    bad = {10: hexed, 11: token[:-4], 12: pem.replace("A", "B"), 13: "token = " + "ab" * 20, 14: "a" * 5000, 15: b64(b"just some ordinary words here"), 16: None, 17: "", 18: "password = averylongwordwithoutanydigits"}
    rows = [(i, "text before é " + t + " after") for i, (_, t) in good.items()] + list(bad.items())
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["kind"]) for r in got} == {(i, k) for i, (k, _) in good.items()}


def test_fertility(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 60), "en") for i in range(200)] + [(200 + i, "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(60)), "en") for i in range(2)] + [(300, None, "en"), (301, "", None)]
    got = {r["doc_id"]: r for r in fertility.fertility(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(not got[i]["kept"] for i in range(200)) == 0 and got[300]["kept"] and got[300]["entropy"] is None
    enc, sp, is_byte = fertility.vocabularies(fertility.VOCABULARIES)
    t = rows[0][1]
    assert got[0]["n_tokens"] == len(enc.encode_ordinary(" " + t))
    ids = enc.encode_ordinary(" " + t)
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    assert abs(got[0]["entropy"] + (p * np.log2(p)).sum()) < 1e-9
    mixed = fertility.measure(__import__("pyarrow").array(["龘靐齉 hello"]))
    assert mixed["byte_share"][0] > 0.5


def test_segments():
    rng = np.random.default_rng(6)
    for _ in range(50):
        n = 30
        s = np.where(rng.random(n) < 0.4, rng.normal(size=n) * 3, -0.5)
        at = np.flatnonzero(s != -0.5)
        got = toxicity.segments(s[at], at, -0.5, n)
        cum = np.concatenate([[0], np.cumsum(s)])
        best = max((cum[j] - cum[i] for i in range(n) for j in range(i + 1, n + 1)), default=0)
        if best > 1e-9:
            assert abs(max(x for *_, x in got) - best) < 1e-9
        assert all(abs(cum[b] - cum[a] - x) < 1e-9 for a, b, x in got)


def test_toxicity_held_out(spark):
    rng = random.Random(1)
    bad = ["vile", "rotten", "scumbag", "filthy"]
    docs = []
    for i in range(1200):
        w = prose(rng, 60).split()
        if i % 6 == 0:
            w[10:20] = [rng.choice(bad) for _ in range(5)] + w[15:20]
        docs.append((i, " ".join(w), "en"))
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(600)], "doc_id long, toxic int")
    kept = {r["doc_id"] for r in toxicity.drop_toxic(d, lab).collect()}
    assert sum(i not in kept for i in range(600, 1200, 6)) >= 95 and sum(i in kept for i in range(600, 1200) if i % 6) >= 495


def test_lines(spark):
    rng = random.Random(7)
    pool = [prose(rng, 6) for _ in range(30)]
    d = spark.createDataFrame([(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else prose(rng, 5) for _ in range(6))) for i in range(60)], "doc_id long, text string")
    owner, want = {}, {}
    for r in d.orderBy("doc_id").collect():
        kept = []
        for x in r["text"].split("\n"):
            if owner.setdefault(x, r["doc_id"]) == r["doc_id"] and x not in kept:
                kept.append(x)
        want[r["doc_id"]] = "\n".join(kept)
    for probes in (line_dedup.PROBES, 7):
        assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(d, shard_keys=50, probes=probes).collect()} == want
    # ids of text, in the order of their hashes; rows without an id come last and count as one document
    s = d.withColumn("doc_id", F.concat(F.lit("k"), F.col("doc_id").cast("string"))).union(spark.createDataFrame([(None, "\n".join(pool[:3]) + "\nown line"), (None, "own line\nanother")], "doc_id string, text string"))
    got = {(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(s, shard_keys=50).collect()}
    left = [x for _, t in got for x in t.split("\n")]
    assert sorted(set(left)) == sorted({x for r in s.collect() for x in r["text"].split("\n")}) and (None, "own line\nanother") in got
    assert all(left.count(x) <= 1 for x in pool) and (None, "own line") in got


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test tables")
def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols, lines = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, docs.sparkSession.createDataFrame(stage(spark, docs, sf).toPandas(), docs.schema)
        assert docs.columns == cols
        a, b = before.toPandas(), docs.toPandas()
        if name == "line_dedup":
            lines = [x for t in b.text for x in t.split("\n") if x.strip()]
            assert len(set(lines)) == len(lines) and set(lines) == {x for t in a.text for x in t.split("\n") if x.strip()}
        if name == "minhash_dedup":
            gone = {r["doc_id"] for r in near_dedup.near_duplicates(before).collect()}
            assert set(b.doc_id) == set(a.doc_id) - gone
        if name == "mixing":
            assert len(b) == len(a)
    p = corpus_pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    assert set(p.doc_id) == set(docs.toPandas().doc_id)
