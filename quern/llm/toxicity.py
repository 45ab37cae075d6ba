"""Toxic passages by maximum-scoring segments.

Words of labelled documents get log-odds of toxic against clean use under an informative Dirichlet
prior (the word's share over all documents); a word counts once a document, so that one text that
repeats itself says no more than others. Words whose log-odds are significant keep them as
scores; all others share one small negative score. A linear scan finds all maximal scoring segments
of a text; a word that stood among the ``REPEAT`` words before is no new evidence and scores as others do. How often chance gives a segment of some score is fitted on clean labelled documents that
the scores were not learned from (two halves, crosswise), for each language that has ``ENOUGH`` such segments: N(score >= x) = K * words * exp(-lambda x).
Under this extreme-value law a segment has an expectation, and a document's best segments together a
sum statistic; a document is rejected where that is at most ``ALPHA``, which was set by held-out error on both classes.
Scripts without spaces have words of two characters, overlapping. What is learned from are the labelled texts, ``LABELLED`` at most; how often
words are used, and what is scanned, is the whole table.

Defined results
- a null or wordless text has no words and is never rejected; a null id takes part and is rejected like any other;
- a label counts for all rows of its id; several labels of an id: toxic wins; null labels don't count;
- texts that are equal count once in learning; without toxic and clean labels no word scores and nothing is rejected;
- rows that repeat an id are judged one by one; an empty table gives an empty result; other columns pass unchanged, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import free_names, importable, keep, small_side
from .textbuf import buffers, slices, span_hashes, words

PRIOR, Z, DRIFT, ALPHA, PASSAGE, REPEAT, ENOUGH = 0.02, 3.0, 0.05, 1e-3, 0.05, 8, 100
#: Labelled texts that are learned from at most: those of the least hashes. The number of significant words, each of which takes about Z^2 such texts to be one, follows this bound and not the corpus.
LABELLED = 1 << 20


def training(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label: str = "toxic", labelled: int = LABELLED) -> DataFrame:
    """(id, code): one document of each distinct labelled text, ``labelled`` at most; code is 2 * half + toxic."""
    known = keep(labels.select(F.col(label_id).alias("id"), F.col(label).cast("int").alias("toxic")).where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic")), "labels")
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).isNotNull().alias("ok")).where("ok and id is not null")
    one = texts.join(small_side(known, 16), "id").groupBy("h").agg(F.min("id").alias("id"), F.max("toxic").alias("toxic"))
    one = keep(one, "toxic-texts")
    if (n := one.count()) > labelled:
        one = one.where(F.pmod(F.xxhash64("h", F.lit(5)), F.lit(1 << 30)) < int(labelled / n * (1 << 30)))
    return one.groupBy("id").agg(F.min(F.pmod(F.xxhash64("h"), F.lit(2)).cast("int") * 2 + F.least("toxic", F.lit(1))).alias("code"))


def _group(docs: DataFrame, group_col: str | None):
    return (F.col(f"`{group_col}`").cast("string") if group_col in docs.columns else F.lit(None).cast("string")).alias("grp")


def _with_code(docs: DataFrame, train: DataFrame, id_col: str, text_col: str, how: str, group_col: str | None = None) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _group(docs, group_col)).where("text is not null").join(small_side(train, 16), "id", how)


def _words_of(text: pa.Array) -> tuple:
    data, offsets = buffers(pc.utf8_lower(text))
    starts, ends, first = words(data, offsets, pairs=True)
    return data, offsets, starts, ends, first, span_hashes(data, starts, ends)


def _original(text: str, lower: bytes, lo: int, hi: int) -> tuple[int, int, str]:
    """Bytes lo to hi of the lower-cased text as bytes and text of the text itself: lower-casing keeps the number of characters, but not always their bytes."""
    a, b = len(lower[:lo].decode()), len(lower[:hi].decode())
    start = len(text[:a].encode())
    passage = text[a:b]
    return start, start + len(passage.encode()), passage


def word_counts(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h, n, n0, n1, n2, n3): how many of all documents use each word, and how many training documents of each code."""
    importable(docs.sparkSession)

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            key, n = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            return key[at], np.add.reduceat(n, at, axis=0) if len(at) else n

        def flush():
            key, n = merged()
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(pa.array(np.ascontiguousarray(n[:, i])) for i in range(5))], names=["h", "n", "n0", "n1", "n2", "n3"])

        for batch in batches:
            for part in slices(batch, "text"):
                *_, first, h = _words_of(part.column("text"))
                code = np.asarray(pc.fill_null(part.column("code"), -1))
                doc = np.repeat(np.arange(part.num_rows), np.diff(first))
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h, of_word = h[new], code[doc[new]]
                key, back = np.unique(h, return_inverse=True)
                n = np.zeros((len(key), 5), np.int64)
                n[:, 0] = np.bincount(back, minlength=len(key))
                for c in range(4):
                    if (code == c).any():
                        n[:, c + 1] = np.bincount(back[of_word == c], minlength=len(key))
                held.append((key, n))
                size += len(key)
                if size > 1_500_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 750_000:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    counted = _with_code(docs, train, id_col, text_col, "left").select("text", "code").mapInArrow(run, "h bigint, n bigint, n0 bigint, n1 bigint, n2 bigint, n3 bigint")
    return counted.groupBy("h").agg(*(F.sum(c).alias(c) for c in ("n", "n0", "n1", "n2", "n3")))


def lexicon(counts: DataFrame, prior: float = PRIOR, z: float = Z, drift: float = DRIFT) -> tuple[dict[str, np.ndarray], dict[str, float]]:
    """Scores of the significant words (h sorted, s0 and s1 learned from one half, s from both) and of every other word.

    Only words with a significant score reach the driver (24 bytes each); their number is bounded by ``LABELLED``.
    """
    tot = counts.agg(*(F.sum(c).alias(c) for c in ("n", "n0", "n1", "n2", "n3"))).first()
    models = {"s0": (["n1"], ["n0"]), "s1": (["n3"], ["n2"]), "s": (["n1", "n3"], ["n0", "n2"])}
    columns, sums = {}, {}
    for name, (toxic, clean) in models.items():
        t, c = sum(tot[x] or 0 for x in toxic), sum(tot[x] or 0 for x in clean)
        sums[name] = (t, c)
        if not t or not c:
            columns[name] = F.lit(0.0)
            continue
        strength = prior * (t + c)
        yt, yc = sum(F.col(x) for x in toxic), sum(F.col(x) for x in clean)
        a = F.col("n") * F.lit(strength / tot["n"])
        odds = F.log((yt + a) / (t + strength - yt - a)) - F.log((yc + a) / (c + strength - yc - a))
        sure = F.abs(odds) / F.sqrt(1 / (yt + a) + 1 / (yc + a)) >= z
        columns[name] = F.when(sure & (yt + yc > 0), odds).otherwise(0.0)
    found = counts.where("n0 + n1 + n2 + n3 > 0").select("h", "n0", "n1", "n2", "n3", *(c.alias(k) for k, c in columns.items())).where("s0 <> 0 or s1 <> 0 or s <> 0").toPandas().sort_values("h")
    lex = {"h": found["h"].to_numpy().view(np.uint64), **{k: found[k].to_numpy(float) for k in models}}
    order = np.argsort(lex["h"])
    lex = {k: v[order] for k, v in lex.items()}
    n = {k: found[k].to_numpy()[order] for k in ("n0", "n1", "n2", "n3")}
    rest = {}
    for name, (toxic, clean) in models.items():
        t, c = sums[name]
        used = lex[name] != 0
        left_t, left_c = t - sum(n[x][used].sum() for x in toxic), c - sum(n[x][used].sum() for x in clean)
        rest[name] = min(-drift, math.log((left_t / t) / (left_c / c))) if t and c and left_t > 0 and left_c > 0 else -drift
        lex[name] = np.where(used, lex[name], rest[name])
    return lex, rest


def segments(scores: np.ndarray, places: np.ndarray, rest: float, n: int) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, end word, score) of n words that score ``rest`` each but at ``places``.

    The linear algorithm with a stack of candidate segments; stretches without a positive word are passed over at once.
    """
    up = scores > 0
    if not up.any():
        return []
    total = np.cumsum(scores - rest) + rest * (places + 1.0)  # cumulative score up to and with each place
    stack: list[list] = []  # [first place, end place, sum before, sum to end, index of nearest candidate below with a lesser sum before]
    for i in np.flatnonzero(up):
        right = float(total[i])
        left = right - float(scores[i])
        cand = [int(places[i]), int(places[i]) + 1, left, right, -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= cand[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= cand[3]:
                cand[4] = j
                stack.append(cand)
                break
            cand = [stack[j][0], cand[1], stack[j][2], cand[3], -1]
            del stack[j:]
    return [(a, b, r - l) for a, b, l, r, _ in stack]


def _scan(h: np.ndarray, first: np.ndarray, lex_h: np.ndarray, score: np.ndarray, rest: float):
    """(text, its segments, words) of the texts that have a segment."""
    if not len(lex_h):
        return
    at = np.minimum(np.searchsorted(lex_h, h), len(lex_h) - 1)
    hit = np.flatnonzero(lex_h[at] == h)
    value = score[at[hit]]
    if len(hit):
        key = at[hit]
        text = np.searchsorted(first, hit, "right")
        order = np.lexsort((hit, key, text))
        again = (key[order][1:] == key[order][:-1]) & (text[order][1:] == text[order][:-1]) & (np.diff(hit[order]) <= REPEAT)
        value[order[1:][again]] = rest
    edges = np.searchsorted(hit, first)
    for d in np.unique(np.searchsorted(first, hit[value > 0], "right") - 1):
        lo, hi = edges[d], edges[d + 1]
        n = int(first[d + 1] - first[d])
        yield int(d), segments(value[lo:hi], hit[lo:hi] - first[d], rest, n), n


def calibrate(docs: DataFrame, train: DataFrame, lex: dict, rest: dict, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = "lang") -> dict[str | None, tuple[float, float]]:
    """(lambda, K) by group (language), and at None of all, from the segments of clean training documents, scored by the half they are not in."""

    def run(batches):
        seen: dict[tuple[str | None, int, int], int] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                *_, first, h = _words_of(part.column("text"))
                code, group = np.asarray(part.column("code")), part.column("grp").to_pylist()
                for g, n in zip(group, np.diff(first).tolist()):
                    seen[(g, -1, 0)] = seen.get((g, -1, 0), 0) + n
                for c, model in ((0, "s1"), (2, "s0")):
                    for d, found, _ in _scan(h, first, lex["h"], lex[model], rest[model]):
                        if code[d] == c:
                            for _, _, s in found:
                                b = (group[d], 0, int(s * 20))
                                seen[b] = seen.get(b, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int32()), pa.array([k[2] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["grp", "kind", "bin", "n"])

    clean = train.where("code in (0, 2)")
    rows = _with_code(docs, clean, id_col, text_col, "inner", group_col).select("text", "code", "grp").mapInArrow(run, "grp string, kind int, bin int, n bigint").groupBy("grp", "kind", "bin").agg(F.sum("n").alias("n")).collect()
    out: dict[str | None, tuple[float, float]] = {}
    for g in {r["grp"] for r in rows} | {None}:
        own = [r for r in rows if g is None or r["grp"] == g]
        total = sum(r["n"] for r in own if r["kind"] == -1)
        x: dict[float, int] = {}
        for r in own:
            if r["kind"] == 0:
                x[r["bin"] / 20 + 0.025] = x.get(r["bin"] / 20 + 0.025, 0) + r["n"]
        if g is None or sum(x.values()) >= ENOUGH:
            out[g] = fit(np.array(sorted(x)), np.array([x[b] for b in sorted(x)]), total)
    return out


def fit(score: np.ndarray, n: np.ndarray, total: int) -> tuple[float, float]:
    """lambda and K of the tail beyond the median score: the slowest decay from there to three higher quantiles (under 3 % of wrong labels don't move it)."""
    if not total or n.sum() < 20:
        return 1.0, max(1, n.sum()) / max(1, total) * math.e**2
    cum = np.cumsum(n)
    median = float(score[np.searchsorted(cum, cum[-1] / 2)])
    lam = 1.0
    for tail in (0.25, 0.1, 0.03):
        upper = float(score[np.searchsorted(cum, cum[-1] * (1 - tail))])
        lam = min(lam, math.log(0.5 / tail) / max(upper - median, 0.05))
    return lam, float(cum[-1] / 2 / total * math.exp(lam * median))


def p_value(scores: list[float], n: int, lam: float, k: float) -> float:
    """Chance of a document of n words to have segments as good: the best sum statistic over the r top segments for any r, paid for by 2^r."""
    best, t = 0.0, 0.0  # logarithm of the chance, sum of normalised scores
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        x = lam * s - math.log(k * max(n, 1))
        t += x
        if r == 1:
            p = -x if x > 30 else math.log(-math.expm1(-math.exp(-x))) if x > -30 else 0.0
        elif t > r:
            p = -t + (r - 1) * math.log(t) - math.lgamma(r + 1) - math.lgamma(r)
        else:
            break
        best = min(best, p + (r - 1) * math.log(2))
        if x < 0:  # lesser segments only take from the sum
            break
    return math.exp(best)


class Model:
    """Scored words, the score of all others, and (lambda, K) by group."""

    def __init__(self, h: np.ndarray, s: np.ndarray, rest: float, law: dict[str | None, tuple[float, float]], group_col: str | None):
        self.h, self.s, self.rest, self.law, self.group_col = h, s, rest, law, group_col


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label: str = "toxic", group_col: str | None = "lang") -> Model:
    train = keep(training(docs, labels, id_col, text_col, label_id, label), "toxic-train")
    counts = keep(word_counts(docs, train, id_col, text_col), "toxic-words")
    lex, rest = lexicon(counts)
    law = calibrate(docs, train, lex, rest, id_col, text_col, group_col) if len(lex["h"]) else {None: (1.0, 1.0)}
    used = lex["s"] != rest["s"]
    return Model(lex["h"][used], lex["s"][used], rest["s"], law, group_col)


def judged(docs: DataFrame, model: Model, text_col: str = "text", alpha: float = ALPHA, passage: float = PASSAGE) -> tuple[DataFrame, str, str]:
    """``docs`` with its p value and the significant passages (start and end byte of the text, text, score, expectation), and the two columns' names."""
    importable(docs.sparkSession)
    p_name, seg_name, g_name = free_names(docs, "p_toxic", "passages", "p_group")
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("passage", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField(p_name, T.DoubleType()), T.StructField(seg_name, kind)])
    at_text = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.h, model.s))
    rest, law, columns = model.rest, model.law, len(docs.columns)
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("passage", pa.string()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches):
        lex_h, score = shared.value
        for batch in batches:
            for part in slices(batch, text_col):
                data, offsets, starts, ends, first, h = _words_of(part.column(at_text))
                p, found = np.ones(part.num_rows), [[] for _ in range(part.num_rows)]
                group = part.column(columns).to_pylist()
                for d, segs, n in _scan(h, first, lex_h, score, rest):
                    lam, k = law.get(group[d], law[None])
                    p[d] = p_value([s for *_, s in segs], n, lam, k)
                    good = [(a, b, s, e) for a, b, s in segs if (e := k * n * math.exp(-lam * s)) <= passage]
                    if good:
                        text, lower = part.column(at_text)[d].as_py(), data[offsets[d] : offsets[d + 1]].tobytes()
                        for a, b, s, e in good:
                            lo, hi, said = _original(text, lower, int(starts[first[d] + a] - offsets[d]), int(ends[first[d] + b - 1] - offsets[d]))
                            found[d].append({"start": lo, "end": hi, "passage": said, "score": s, "expected": e})
                yield pa.RecordBatch.from_arrays([*part.columns[:columns], pa.array(p), pa.array(found, arrow)], names=schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns], _group(docs, model.group_col).alias(g_name)).mapInArrow(run, schema), p_name, seg_name


def toxic_passages(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA) -> DataFrame:
    """A row for each significant passage of each rejected document: id, p of the document, passage, its place as "start-end", score and expectation."""
    out, p, segs = judged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([F.col("lang")] if "lang" in docs.columns else [])), learn(docs, labels, id_col, text_col), "text", alpha)
    s = out.where(F.col(p) <= alpha).select("doc_id", p, F.explode_outer(segs).alias("s"))
    return s.select("doc_id", p, F.concat_ws("-", F.col("s.start").cast("string"), F.col("s.end").cast("string")).alias("span"), "s.passage", "s.score", "s.expected")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA) -> DataFrame:
    """``docs`` without its rejected documents."""
    out, p, _ = judged(docs, learn(docs, labels, id_col, text_col), text_col, alpha)
    return out.where(F.col(p) > alpha).select(*[F.col(f"`{c}`") for c in docs.columns])
