"""Words of all scripts, joined paths and copies, against brute force."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quern.llm import near_dedup, packing, textbuf, toxicity


def words_of(texts, pairs=False):
    data, offsets = textbuf.buffers(pa.array(texts))
    starts, ends, first = textbuf.words(data, offsets, pairs)
    raw = data.tobytes()
    flat = [raw[a:b].decode() for a, b in zip(starts, ends)]
    return [flat[first[i] : first[i + 1]] for i in range(len(texts))]


def slowly(text):
    alone = lambda c: unicodedata.category(c)[0] in "LN" and any(a <= ord(c) <= b for a, b in textbuf.ALONE)
    mark = lambda c: unicodedata.category(c)[0] == "M" and any(a <= ord(c) <= b for a, b in textbuf.ALONE)
    out, open_, lone = [], False, False
    for c in text:
        if alone(c):
            out.append(c)
            open_ = lone = True
        elif mark(c):
            if open_:
                out[-1] += c
            else:
                out.append(c)
            open_ = lone = True
        elif c == "_" or unicodedata.category(c)[0] in "LNM":
            if open_ and not lone:
                out[-1] += c
            else:
                out.append(c)
            open_, lone = True, False
        else:
            open_ = False
    return out


def test_words_of_all_scripts():
    rng = random.Random(3)
    pool = "ab1_ .,-\n“”—…éßñΩж中文字日カなๆไทยดี 💥’ "
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["", "中", "é", "naïve “quoted”—dash"]
    assert words_of(texts) == [slowly(t) for t in texts]
    assert words_of(["我们abc去", "学校", "中 国"], True) == [["我们", "们", "abc", "去"], ["学校", "校"], ["中", "国"]]


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(1)
    text = pa.array([" ".join("w" * rng.randint(1, 30) + str(i % 97) for i in range(3000))])
    whole = textbuf.word_hashes(text)[0]
    monkeypatch.setattr(textbuf, "BLOCK", 50)
    assert (textbuf.word_hashes(text)[0] == whole).all()


def test_chinese_near_copies_and_toxic_words(spark):
    rng = random.Random(2)
    pool = [chr(c) for c in rng.sample(range(0x4E00, 0x9F00), 600)]
    prose = lambda n: "".join(rng.choice(pool) for _ in range(n))
    base = [prose(120) for _ in range(20)]
    near = [t[:40] + prose(1) + t[41:80] + prose(1) + t[81:] for t in base]
    d = spark.createDataFrame(list(enumerate(base + near)), "doc_id long, text string")
    got = {r["doc_id"]: r["duplicate_of"] for r in near_dedup.near_duplicates(d).collect()}
    assert got == {20 + i: i for i in range(20)}
    bad = "坏蛋垃圾"
    docs = [(i, prose(60) + (bad + prose(3) + bad[:2] + prose(2) + bad[2:] if i % 5 == 0 else "") + prose(20), "zh") for i in range(600)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    kept = {r["doc_id"] for r in toxicity.drop_toxic(d, lab).collect()}
    assert sum(i not in kept for i in range(400, 600, 5)) >= 36 and sum(i in kept for i in range(400, 600) if i % 5) >= 158


def test_rounds_join_all_that_can_be(spark):
    rng = random.Random(8)
    first, last, at = [], [], 0
    for _ in range(160):
        first.append(at)
        last.append(at + (at % 2))
        at += 3
    ends = sorted({*first, *last})
    links = {tuple(sorted(rng.sample(ends, 2))): float(rng.randint(1, 12)) for _ in range(700)}
    paths = spark.createDataFrame([(a, b, 1 + a % 7, a // 60) for a, b in zip(first, last)], "head long, tail long, n long, region long")
    path_of = {x: i for i in range(160) for x in (first[i], last[i])}
    region = lambda x: first[path_of[x]] // 60
    edges = spark.createDataFrame([(a, b, d, region(a), region(b)) for (a, b), d in links.items()], "a long, b long, d double, ra long, rb long")
    k = {(r["a"], r["b"]): r["k"] for r in edges.select("a", "b", F.xxhash64("a", "b").alias("k")).collect()}
    # the greedy order, link by link, on lists of nodes
    chains = {i: [first[i]] if first[i] == last[i] else [first[i], last[i]] for i in range(160)}
    of = dict(path_of)
    for a, b in sorted(links, key=lambda p: (links[p], k[p], p)):
        i, j = of[a], of[b]
        if i != j and a in (chains[i][0], chains[i][-1]) and b in (chains[j][0], chains[j][-1]):
            left = chains[i] if chains[i][-1] == a else chains[i][::-1]
            right = chains.pop(j) if chains[j][0] == b else chains.pop(j)[::-1]
            chains[i] = left + right
            of.update({x: i for x in right})
    for tail in (1, 100, packing.TAIL):
        got = sorted(packing.chain_paths(paths, edges, tail).collect(), key=lambda r: r["begin"])
        assert sorted(r["head"] for r in got) == first
        assert [r["begin"] for r in got] == np.concatenate([[0], np.cumsum([r["n"] for r in got])])[:-1].tolist()
        line = [x for r in got for x in ([r["head"]] if last[path_of[r["head"]]] == r["head"] else [r["head"], last[path_of[r["head"]]]][:: -1 if r["back"] else 1])]
        if tail == packing.TAIL:
            text = " ".join(map(str, line))
            assert all(f" {' '.join(map(str, c))} " in f" {text} " or f" {' '.join(map(str, c[::-1]))} " in f" {text} " for c in chains.values())
        # pieces of the line that links hold together can't be joined any further
        cut = [i for i in range(1, len(line)) if path_of[line[i]] != path_of[line[i - 1]] and tuple(sorted((line[i - 1], line[i]))) not in links]
        pieces = [line[a:b] for a, b in zip([0, *cut], [*cut, len(line)])]
        piece = {x: i for i, p in enumerate(pieces) for x in p}
        tips = {x for p in pieces for x in (p[0], p[-1])}
        assert not [p for p in links if set(p) <= tips and piece[p[0]] != piece[p[1]]]


def test_copies_are_placed_by_counting(spark):
    n = 30_000
    d = spark.range(n, numPartitions=6).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "the same few words").otherwise(F.concat(F.lit("text of number "), (F.col("id") % 97).cast("string"))).alias("text"))
    p = packing.pack(d, window=50).toPandas()
    assert p.doc_id.nunique() == n and (p.groupby("doc_id").end.max() == 4).all() and (p.end - p.start).sum() == 4 * n
    load = (p.end - p.start).groupby(p.window).sum()
    assert load.index.tolist() == list(range(len(load))) and (load.iloc[:-1] == 50).all()
    assert p.groupby("window").slot.apply(lambda s: sorted(s) == list(range(len(s)))).all()
    # copies of a text stand side by side
    same = p.assign(kind=np.where(p.doc_id % 3 > 0, -1, p.doc_id % 97)).sort_values(["window", "slot"])
    hot = (same.kind == -1).astype(int)
    assert (hot.diff() == 1).sum() + hot.iloc[0] == 1
