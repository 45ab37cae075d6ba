"""Hot groups, the far side of size limits, and figures that must not be capped, against brute force."""

import base64
import itertools
import json
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import fertility, near_dedup, secrets, toxicity, vector_join
from quern.llm.textbuf import shingle_hashes, word_hashes


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def family(rng, n):
    """Texts of one template and of some others that share parts of it: their buckets are large, and not one family."""
    word = lambda: "w" + str(rng.randint(0, 4000))
    base = [word() for _ in range(60)]
    other = [base[:30] + [word() for _ in range(30)] for _ in range(4)]
    out = []
    for i in range(n):
        t = list(base if i % 3 else other[i // 3 % 4])
        for _ in range(rng.randint(0, 7)):
            t[rng.randrange(len(t))] = word()
        out.append(" ".join(t))
    return out


def test_hot_buckets_lose_no_link(spark, monkeypatch):
    texts = family(random.Random(3), 240)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    k, bits = near_dedup.PERMUTATIONS, near_dedup.BITS
    m, _ = near_dedup.minima(*shingle_hashes(*word_hashes(pa.array(texts)), near_dedup.SHINGLE), k)
    sig = near_dedup.pack(m, bits).view(np.uint64)
    share = lambda i, j: (m[:, i] == m[:, j]).reshape(-1, near_dedup.ROWS)
    band = {}
    for i in range(len(texts)):
        for r in range(k // near_dedup.ROWS):
            band.setdefault((r, *m[r :: k // near_dedup.ROWS, i][: near_dedup.ROWS].tolist()), []).append(i)
    pairs = {p for b in band.values() for p in itertools.combinations(b, 2)}
    linked = [(i, j) for i, j in pairs if near_dedup.similarity(sig[i], sig[j], k, bits) >= near_dedup.THRESHOLD]
    want = roots(len(texts), linked)
    assert max(map(len, band.values())) > 60 and 1 < len(set(want)) < 200
    for hot, leaders, tile, part in ((1 << 14, 32, 1 << 12, 1 << 16), (8, 3, 7, 11), (8, 32, 64, 1 << 16)):
        for name, v in (("HOT", hot), ("SAMPLED", 1), ("LEADERS", leaders), ("TILE", tile), ("PART", part)):
            monkeypatch.setattr(near_dedup, name, v)
        got = {r["doc_id"]: r["duplicate_of"] for r in near_dedup.near_duplicates(d).collect()}
        assert got == {i: r for i, r in enumerate(want) if r != i}
    del share


def test_text_ids(spark):
    texts = family(random.Random(4), 40)
    d = spark.createDataFrame([(f"k{i:03}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    same = {r["doc_id"]: r["duplicate_of"] for r in near_dedup.near_duplicates(d).collect()}
    whole = {r["doc_id"]: r["duplicate_of"] for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert same == {f"k{a:03}": f"k{b:03}" for a, b in whole.items()}


def test_vectors_beyond_the_limits(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 6)).astype(np.float32)
    x[250:] = x[:250] + rng.normal(size=(250, 6)).astype(np.float32) * 0.1
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.95, 1)))}
    t = spark.createDataFrame([(i, [float(v) for v in r], "x", 1) for i, r in enumerate(x)], "vec_id long, embedding array<float>, cell string, home int")
    monkeypatch.setattr(vector_join, "BROADCAST_BYTES", 0)
    assert {(r["a"], r["b"]) for r in vector_join.near_pairs(t, threshold=0.95, cell=60, tile=40).collect()} == want
    units = vector_join.unit_vectors(t)
    for rounds in (1, 2):
        parts = vector_join.cells(units, 0.95, 60, rounds)
        assert {r["id"] for p in parts for r in p.where("home").collect()} == set(range(500))


def slow_secrets(raw):
    """Key encodings and assigned values by trying every substring of runs, wrapped lines joined."""
    found = set()
    joined = re.sub(rb"(?<=[A-Za-z0-9+/]{20})[ \t]*\r?\n[ \t]*(?=[A-Za-z0-9+/])", b"", raw)
    for body in re.findall(rb"[A-Za-z0-9+/_-]+={0,2}", joined) + re.findall(rb"[A-Za-z0-9+/]+={0,2}", joined):
        for i in range(len(body)):
            if body[i : i + 1] != b"M" and body[i : i + 2] != b"30":
                continue
            for j in range(len(body), i + 30, -1):
                b = secrets.unbase64(body[i:j])
                if b is not None and (kind := secrets.private_der(b)):
                    found.add(kind)
                    break
    return found


def der(tag, body):
    n = len(body)
    head = bytes([n]) if n < 128 else bytes([0x80 | len(h := n.to_bytes((n.bit_length() + 7) // 8, "big"))]) + h
    return bytes([tag]) + head + body


def test_secrets_anywhere_in_a_text():
    rng, r = np.random.default_rng(5), random.Random(5)
    url = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=")
    keys = {
        "rsa_private_key": der(0x30, der(2, b"\0") + b"".join(der(2, b"\x01" + rng.bytes(33)) for _ in range(8))),
        "ec_private_key": der(0x30, der(2, b"\1") + der(4, rng.bytes(32))),
    }
    fill = [b"plain words of a text", b"\n", b" ", b"abcDEF0123+/", b"key", b"=", b"/", b"x-", b"Man", b"30"]
    for _ in range(120):
        kind = r.choice(list(keys))
        enc = base64.b64encode(keys[kind])
        if r.random() < 0.4:
            width = r.choice([20, 64, 76])
            enc = b"\n".join(enc[i : i + width] for i in range(0, len(enc), width))
            if len(enc.rsplit(b"\n", 1)[-1].rstrip(b"=")) == 0:
                continue
        raw = b"".join(r.choice(fill) for _ in range(r.randint(0, 4))) + b" " * (r.random() < 0.5) + enc + b" " + b"".join(r.choice(fill) for _ in range(3))
        assert {k for k, *_ in secrets.scan(raw)} >= slow_secrets(raw) & {kind}
        if raw.count(b"\n") == 0:
            assert kind in {k for k, *_ in secrets.scan(raw)}
    hexed = rng.bytes(20).hex().encode()
    token = b".".join([url(json.dumps({"alg": "HS256"}).encode()), url(b'{"sub":"1"}'), url(rng.bytes(32))])
    for raw, want in {
        b"password" + b" " * 500 + b"=" + b"\n" * 80 + b'"' + hexed + b'"': ["keyed_value"], b"passphrase = " + hexed: ["keyed_value"], b"api key: " + hexed: ["keyed_value"], b"token=" + hexed + b"/x=1": ["keyed_value"],
        b"t=" + token + b"&password=" + hexed + b"=" + token: ["keyed_value", "signed_token", "signed_token"], b"glued" + token + b"more": ["signed_token"], keys["rsa_private_key"].hex().encode() * 2: ["rsa_private_key", "rsa_private_key"],
        b"z" * 3000 + base64.b64encode(keys["ec_private_key"]) + b" " + b"long " * 50_000: ["ec_private_key"], b"sha = " + hexed: [], b"password = averylongwordwithoutanydigits": [],
    }.items():
        got = secrets.scan(raw)
        assert sorted(k for k, *_ in got) == want and all(0 <= a < b <= len(raw) for _, a, b in got)


def slow_segments(s):
    """All maximal scoring segments by their definition: the best span, then the same to its left and right."""
    best = max(((s[i:j].sum(), -(j - i), -i, i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0, 0, 0, 0, 0))
    if best[0] <= 1e-12:
        return []
    i, j = best[3:]
    shift = lambda x, by: [(a + by, b + by, v) for a, b, v in x]
    return slow_segments(s[:i]) + [(i, j, best[0])] + shift(slow_segments(s[j:]), j)


def test_all_maximal_segments():
    rng = np.random.default_rng(6)
    for _ in range(150):
        n = int(rng.integers(1, 26))
        s = np.where(rng.random(n) < 0.5, rng.normal(size=n) * 3, -0.5)
        at = np.flatnonzero(s != -0.5)
        got = sorted(toxicity.segments(s[at], at, -0.5, n))
        assert [x[:2] for x in got] == [x[:2] for x in slow_segments(s)] and np.allclose([x[2] for x in got], [x[2] for x in slow_segments(s)])


def test_tail_and_sum_statistic():
    # scores with an exponential tail give its rate and number back
    score = (np.arange(400) + 0.5) / 20
    n = np.rint(1e6 * np.exp(-1.3 * score)).astype(np.int64)
    lam, k = toxicity.fit(score, n, 10**7)
    beyond = n[score > 5].sum()
    assert 0.9 <= lam <= 1.0 and 0.2 <= beyond / (k * 10**7 * np.exp(-lam * 5)) <= 1.0
    # no document has too many passages to count
    one, many = toxicity.p_value([3.0], 100, 1.0, 0.01), toxicity.p_value([3.0] * 3000, 100, 1.0, 0.01)
    few = toxicity.p_value([3.0] * 50, 100, 1.0, 0.01)
    assert many < few < one < 0.06 and many < 1e-300 and toxicity.p_value([], 10, 1.0, 1.0) == 1.0
    # nor is a score too large or too small
    assert toxicity.p_value([5000.0, 1.0], 100, 1.0, 0.01) == 0.0 and toxicity.p_value([0.1], 10**6, 1.0, 1.0) == 1.0


def test_passages_are_places_of_the_text(spark):
    rng = random.Random(1)
    text = lambda bad: "İstanbul ẞ " * 3 + " ".join(f"Wort{rng.randint(0, 60)}" for _ in range(30)) + (" Vile ROTTEN vile Rotten" if bad else "") + " Ende"
    d = spark.createDataFrame([(i, text(i % 4 == 0), "de") for i in range(400)], "doc_id long, text string, lang string")
    rows = toxicity.toxic_passages(d, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")).collect()
    texts = {r["doc_id"]: r["text"].encode() for r in d.collect()}
    assert len(rows) >= 90
    for r in rows:
        a, b = map(int, r["span"].split("-"))
        assert texts[r["doc_id"]][a:b].decode() == r["passage"] and "ROTTEN" in r["passage"]


def test_labelled_sample_is_bounded(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    lab = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("toxic"))
    assert 300 < toxicity.training(d, lab, labelled=500).count() < 700 and toxicity.training(d, lab).count() == 3000


def test_fertility_bands_by_hand(spark):
    rng = random.Random(8)
    words = ["table", "river", "market", "window", "summer", "letter", "garden", "people", "doctor", "yellow"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, prose(rng.randint(30, 60)), "en") for i in range(120)] + [(200 + i, "§$%&/()=?+*#" * 30, "en") for i in range(3)] + [(300, prose(4000), "en"), (301, "#§%&" * 4000, "en"), (302, "только", "ru")]
    got = fertility.fertility(spark.createDataFrame(rows, "doc_id long, text string, lang string")).toPandas()
    kept = got.set_index("doc_id").kept
    assert kept.loc[:119].all() and not kept.loc[200:202].any() and kept[300] and not kept[301] and kept[302]
    ids = got[got.band == got.band[got.doc_id == 0].iloc[0]]
    for m, floor in zip(fertility.MEASURES, fertility.FLOORS):
        v = np.rint(ids[m] * fertility.STEP)
        low = lambda x: np.sort(x)[(len(x) - 1) // 2]
        mid = low(v)
        dev = low(np.abs(v - mid)) * 1.4826
        out = np.abs(ids[m] - mid / fertility.STEP) > fertility.WIDTH * max(dev / fertility.STEP, floor)
        assert not out[ids.kept].any()


@pytest.mark.parametrize("n", [0, 3])
def test_empty_and_tiny(spark, n):
    d = spark.createDataFrame([(i, None if i else "one two", "en", "s") for i in range(n)], "doc_id long, text string, lang string, source string")
    assert near_dedup.near_duplicates(d).count() == 0 and secrets.find_secrets(d).count() == 0 and fertility.fertility(d).where("kept").count() == n
