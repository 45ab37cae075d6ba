"""Mixing sources to target weights by Pareto order sampling.

Each source gets a fixed number of places: its target weight's share of all, by largest remainders.
Inside a source a document's expected copies are in proportion to a size measure (whole square root
of its characters, plus 1). Whole copies are certain; for the rest, lambda, documents are ranked by
random odds over inclusion odds, u/(1-u) / (lambda/(1-lambda)), and the least are taken until the
source has its number: a fixed-size sample with unequal chances. u comes of md5(seed and id), so a
run is repeatable and SQL gives the same.

The rank of the last taken document is found by counting: a histogram of the keys of each source says
in which narrow bin it lies, and only that bin's documents are ranked. What reaches the documents is
one row a source; texts are never shuffled.

Defined results
- a null source is a source of its own; a null text has no characters; a null id has the text "null" in its hash;
- rows that repeat an id are documents of their own, with equal u; ties go to the lesser id (nulls first), and what is equal in these too is taken together: only then may a sample exceed its number;
- sources that ``targets`` lacks weigh 0; weights below 0 or of 0 in sum are refused; without ``targets`` a source weighs the square root of its number of documents;
- an empty table gives an empty one; other columns pass unchanged, whatever their names; a document with n copies has n equal rows.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import free_names, keep, small_side

SEED, BINS = "7", 1 << 14


def places(counts: dict[str | None, int], total: int, targets: dict[str | None, float] | None = None) -> dict[str | None, int]:
    """Places of each source, ``total`` in sum: largest remainders, ties to the lesser name, null first."""
    if targets is None:
        w = {s: math.isqrt(n * 1048576) for s, n in counts.items()}
    else:
        if any(x < 0 for x in targets.values()):
            raise ValueError("target weights must not be negative")
        w = {s: Fraction(targets.get(s, 0)) for s in counts}
    whole = sum(w.values())
    if not counts or not total:
        return {s: 0 for s in counts}
    if not whole:
        raise ValueError("target weights sum to 0")
    share = {s: total * x / whole if isinstance(x, Fraction) else Fraction(total * x, whole) for s, x in w.items()}
    out = {s: int(x) for s, x in share.items()}
    order = sorted(counts, key=lambda s: (out[s] - share[s], s is not None, s or ""))
    for s in order[: total - sum(out.values())]:
        out[s] += 1
    return out


def _uniform(id_col: Column, seed: str) -> Column:
    """In (0, 1): 52 bits of md5, in the middle of their interval."""
    h = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(":" + seed)))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", targets: dict | None = None, total: int | None = None, seed: str = SEED) -> DataFrame:
    """``docs`` mixed to ``total`` rows (as many as there are, by default)."""
    spark = docs.sparkSession
    src, size, m, lam, key, copies, k, idk = free_names(docs, "m_source", "m_size", "m_expected", "m_lambda", "m_key", "m_copies", "m_places", "m_id")
    kind = docs.schema[id_col].dataType.simpleString()
    id_ = F.col(f"`{id_col}`")
    measure = (F.floor(F.sqrt(F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(0)).cast("double"))) + 1).cast("long")
    slim = keep(docs.select(id_.alias(idk), F.col(f"`{source_col}`").cast("string").alias(src), measure.alias(size)), "mix")
    by = slim.groupBy(src).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("w")).collect()
    n = sum(r["n"] for r in by)
    want = places({r[src]: r["n"] for r in by}, n if total is None else total, targets)
    table = spark.createDataFrame([(r[src], want[r[src]], r["w"]) for r in by], f"`{src}` string, `{k}` long, w long")

    def scored(rows: DataFrame, plan: DataFrame) -> DataFrame:
        p = plan.withColumnRenamed(src, src + "_")
        out = rows.join(F.broadcast(p) if len(by) < 100_000 else p, F.col(src).eqNullSafe(F.col(src + "_"))).drop(src + "_")
        out = out.withColumn(m, F.col(k).cast("double") * F.col(size).cast("double") / F.col("w").cast("double"))
        out = out.withColumn(lam, F.col(m) - F.floor(F.col(m)).cast("double"))
        u = _uniform(F.col(idk), seed)
        # least keys are taken; no chance at all comes last. The key is put into (0, 1) by q / (1 + q), which keeps the order.
        q = (u / (1 - u)) / (F.col(lam) / (1 - F.col(lam)))
        return out.withColumn(key, F.when(F.col(lam) > 0, q / (1 + q)))

    s = scored(slim, table)
    certain = s.groupBy(src).agg(F.sum(F.floor(m)).alias("c")).collect()
    left = {r[src]: want[r[src]] - int(r["c"]) for r in certain}
    binned = s.where(F.col(key).isNotNull()).withColumn("bin", F.floor(F.col(key) * BINS).cast("int"))
    hist = binned.groupBy(src, "bin").agg(F.count(F.lit(1)).alias("n"))
    cum = F.sum("n").over(Window.partitionBy(src).orderBy("bin"))
    lefts = spark.createDataFrame([(a, b) for a, b in left.items()], f"`{src}_` string, left_ long")
    edge = hist.withColumn("cum", cum).join(F.broadcast(lefts) if len(by) < 100_000 else lefts, F.col(src).eqNullSafe(F.col(src + "_"))).where("left_ > 0 and cum >= left_ and cum - n < left_").select(F.col(src + "_"), "bin", (F.col("left_") - (F.col("cum") - F.col("n"))).alias("take"))
    edge = keep(edge, "mix-edge").withColumnRenamed("bin", "bin_")
    at = binned.join(small_side(edge, 48), F.col(src).eqNullSafe(F.col(src + "_")) & (F.col("bin") == F.col("bin_")))
    # rows that are equal in key and id are counted before they meet in a task
    equal = at.groupBy(src, key, idk).agg(F.count(F.lit(1)).alias("n"), F.first("take").alias("take"))
    up_to = F.sum("n").over(Window.partitionBy(src).orderBy(key, F.col(idk).asc_nulls_first()))
    last = keep(equal.withColumn("rank", up_to).where("rank >= take and rank - n < take").select(src, F.struct(key, F.col(idk).alias("id")).alias("last")), "mix-last")
    # a source that takes all it has with a chance above 0 has no edge
    got = {r[src]: r["last"] for r in last.collect()}
    plan = spark.createDataFrame([(r[src], want[r[src]], r["w"], left[r[src]], got[r[src]][key] if r[src] in got else None, got[r[src]]["id"] if r[src] in got else None) for r in by], f"`{src}` string, `{k}` long, w long, left_ long, last_key double, last_id {kind}")
    full = scored(docs.withColumn(idk, id_).withColumn(src, F.col(f"`{source_col}`").cast("string")).withColumn(size, measure), plan)
    earlier = (F.col(key) < F.col("last_key")) | ((F.col(key) == F.col("last_key")) & F.coalesce(F.col(idk) <= F.col("last_id"), F.col(idk).isNull()))
    taken = F.when((F.col("left_") > 0) & F.col(key).isNotNull() & (F.col("last_key").isNull() | earlier), 1).otherwise(0)
    full = full.withColumn(copies, (F.floor(m) + taken).cast("int"))
    return full.where(F.col(copies) > 0).withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])


#: Rows (doc_id, source, copies) for the query over the whole table.
SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(floor(sqrt(CAST(coalesce(length(text), 0) AS DOUBLE))) AS BIGINT) + 1 AS size FROM documents),
s AS (SELECT source, count(*) AS n, sum(size) AS w, CAST(floor(sqrt(CAST(count(*) * 1048576 AS DOUBLE))) AS HUGEINT) AS r FROM d GROUP BY source),
t AS (SELECT *, (SELECT sum(n) FROM s) AS total, (SELECT sum(r) FROM s) AS whole FROM s),
p AS (SELECT *, CAST(total * r // whole AS BIGINT) AS base, total * r % whole AS rest FROM t),
q AS (SELECT *, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, source) <= total - (SELECT sum(base) FROM p) THEN 1 ELSE 0 END AS places FROM p),
e AS (SELECT d.doc_id, d.source, q.places, CAST(q.places AS DOUBLE) * CAST(d.size AS DOUBLE) / CAST(q.w AS DOUBLE) AS m,
  (CAST(CAST('0x' || substr(md5(CAST(d.doc_id AS VARCHAR) || ':{SEED}'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
f AS (SELECT *, m - floor(m) AS l, places - sum(CAST(floor(m) AS BIGINT)) OVER (PARTITION BY source) AS left_ FROM e),
g AS (SELECT *, CASE WHEN l > 0 THEN (u / (1 - u)) / (l / (1 - l)) END AS x FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY x / (1 + x) NULLS LAST, doc_id) AS k FROM g),
c AS (SELECT doc_id, source, CAST(CAST(floor(m) AS BIGINT) + CASE WHEN k <= left_ AND l > 0 THEN 1 ELSE 0 END AS INTEGER) AS copies FROM h)
SELECT doc_id, source, copies FROM c WHERE copies > 0
"""


def counted(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, source, copies) of mix_sources()."""
    slim = docs.select("doc_id", "source", "text")
    return mix_sources(slim, **how).groupBy("doc_id", "source").agg(F.count(F.lit(1)).cast("int").alias("copies"))
