"""Near-duplicate vectors by an exact metric range join.

Vectors become unit vectors; cosine >= ``threshold`` is a Euclidean distance of at most eps. Pivots
(vectors of the table with the least hashes) part a cell: each vector is at home with its nearest pivot p. By
the triangle inequality a vector v within eps of something at home with q has d(v,q) - d(v,p) <= 2 eps;
in Euclidean space the sharper (d(v,q)^2 - d(v,p)^2) / (2 d(p,q)) <= eps holds too (as d(v,p) + d(v,q) >= d(p,q)),
and sets where v is copied to. Cells beyond ``CELL`` are parted again by pivots of their own, unless the copies
would cost more comparisons than they save (in many dimensions distances crowd). A cell joins by
itself, in square tiles if it is large, so that no task grows with the cell.

Defined results
- vectors that are null or empty, hold a null, NaN or infinite element, or are all 0 take no part, nor do rows with a null id;
- vectors of different length are never near each other;
- rows that repeat an id count as one, near whatever any of them is near; equal vectors are near each other without any comparison;
- similarity is computed in single precision; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import BROADCAST_BYTES, importable, keep, stored_bytes

THRESHOLD, CELL, TILE, PIVOTS, GAIN, TASKS, ROUNDS = 0.9, 4096, 8192, 64, 0.7, 4000, 40


def _vectors(column: pa.Array) -> np.ndarray:
    """(rows, d) of a binary column of equal widths."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1) if rows else np.zeros((0, 1), np.float32)


def unit_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, cell, vec): valid vectors as unit vectors in binary; the first cell is their length."""
    importable(table.sparkSession)
    kind = table.schema[id_col].dataType.simpleString()
    v = F.col(f"`{vec_col}`").cast("array<float>")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("v")
            n = np.asarray(pc.list_value_length(lists))
            flat = np.asarray(lists.flatten().cast(pa.float64()))
            first = np.cumsum(n) - n
            for d in np.unique(n).tolist():
                rows = np.flatnonzero(n == d)
                x = flat[first[rows][:, None] + np.arange(d)]
                with np.errstate(all="ignore"):
                    big = np.abs(x).max(1, keepdims=True)
                    x = x / big
                    x = (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)
                good = np.isfinite(x).all(1)
                if good.any():
                    raw = [r.tobytes() for r in x[good]]
                    yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows[good])), pa.array([str(d)] * len(raw)), pa.array(raw, pa.binary())], names=["id", "cell", "vec"])

    some = table.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).where("id is not null and size(v) > 0 and not array_contains(transform(v, x -> x is null), true)")
    return some.mapInArrow(run, f"id {kind}, cell string, vec binary")


def _split(v: np.ndarray, pivots: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pivot, at home) of the vectors in the cells of ``pivots``, home and copies."""
    d2 = np.maximum(2 - 2 * (v.astype(np.float64) @ pivots.T.astype(np.float64)), 0)
    home = d2.argmin(1)
    between = np.sqrt(np.maximum(2 - 2 * (pivots.astype(np.float64) @ pivots.T.astype(np.float64)), 0))
    here = d2[np.arange(len(v)), home]
    inside = d2 - here[:, None] <= 2 * between[home] * (eps + 1e-4)
    inside[np.arange(len(v)), home] = True
    rows, p = np.nonzero(inside)
    return rows, p, home[rows] == p


def _parted(rows: DataFrame, pivots: DataFrame, eps: float, counts: bool = False) -> DataFrame:
    """``rows`` of the cells that have pivots, in the cells these make; ``parent`` is the cell they come from. Or only how many there are: (parent, cell, m, o), o at home."""
    kind = rows.schema["id"].dataType.simpleString()
    out = "parent string, cell string, m bigint, o bigint" if counts else f"id {kind}, cell string, vec binary, home boolean, parent string"

    def cut(t, p: np.ndarray, cell: str):
        at, q, own = _split(_vectors(t.column("vec")), p, eps)
        home = np.asarray(t.column("home"))[at] & own
        if counts:
            m, o = np.bincount(q, minlength=len(p)), np.bincount(q[home], minlength=len(p))
            return [pa.array([cell] * len(p), pa.string()), pa.array([f"{cell}.{x}" for x in range(len(p))], pa.string()), pa.array(m), pa.array(o)]
        take = pa.array(at)
        return [t.column("id").take(take), pa.array([f"{cell}.{x}" for x in q.tolist()], pa.string()), t.column("vec").take(take), pa.array(home), pa.array([cell] * len(at), pa.string())]

    names = ["parent", "cell", "m", "o"] if counts else ["id", "cell", "vec", "home", "parent"]
    if stored_bytes(pivots) * 2 <= BROADCAST_BYTES:
        held: dict[str, np.ndarray] = {}
        for r in pivots.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("k", "vec"))).alias("p")).collect():
            held[r["cell"]] = np.stack([np.frombuffer(bytes(x["vec"]), np.float32) for x in r["p"]])
        shared = rows.sparkSession.sparkContext.broadcast(held)

        def run(batches):
            for b in batches:
                cells = np.asarray(b.column("cell").to_pylist(), dtype=object)
                for c in dict.fromkeys(cells.tolist()):
                    if c in shared.value:
                        part = b.take(pa.array(np.flatnonzero(cells == c)))
                        yield pa.RecordBatch.from_arrays(cut(part, shared.value[c], c), names=names)

        return rows.mapInArrow(run, out)

    def group(key, left, right):
        p = right.sort_by("k").column("vec").combine_chunks()
        return pa.Table.from_arrays(cut(left, _vectors(p), key[0].as_py()), names=names)

    salts = F.ceil(F.col("n") / F.lit(CELL * 16)).cast("int")
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    there = pivots.join(sizes, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), salts))).select(*(F.col(c).alias(c) for c in ("cell", "salt", "k", "vec")))
    here = rows.join(sizes.join(pivots.select("cell").distinct(), "cell"), "cell").withColumn("salt", F.pmod(F.xxhash64("id"), salts + 1).cast("int")).select(*(F.col(c).alias(c) for c in ("cell", "salt", "id", "vec", "home")))
    return here.groupBy("cell", "salt").cogroup(there.groupBy("cell", "salt")).applyInArrow(group, out)


def cells(units: DataFrame, threshold: float = THRESHOLD, cell: int = CELL, rounds: int = ROUNDS) -> list[DataFrame]:
    """Kept tables (id, cell, vec, home): each pair within the threshold stands together in the home cell of either."""
    eps = math.sqrt(max(0.0, 2 - 2 * threshold))
    rows, done = units.withColumn("home", F.lit(True)), []
    for _ in range(rounds):
        sizes = keep(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("long")).alias("own")), "cells")
        large = sizes.where((F.col("n") > cell) & (F.col("own") > 1))
        if large.isEmpty():
            done.append(rows)
            break
        want = F.least(F.lit(PIVOTS), F.ceil(F.col("n") * 2 / F.lit(cell))).cast("int")
        w = Window.partitionBy("cell").orderBy(F.xxhash64("id"), "id")
        chosen = rows.where("home").join(large.select("cell", want.alias("want")), "cell").withColumn("k", F.row_number().over(w)).where(f"k <= {PIVOTS} and k <= want").select("cell", "k", "vec")
        pivots = keep(chosen, "pivots")
        # copies are counted before any is written
        now = _parted(rows, pivots, eps, counts=True).groupBy("parent", "cell").agg(F.sum("m").alias("m"), F.sum("o").alias("o")).groupBy("parent").agg(F.sum(F.col("m").cast("double") * F.col("o")).alias("cost"))
        better = keep(large.join(now, large["cell"] == now["parent"]).where(F.col("cost") < GAIN * F.col("n").cast("double") * F.col("own")).select("parent"), "better")
        done.append(rows.join(better, rows["cell"] == better["parent"], "left_anti"))
        if better.isEmpty():
            break
        there = rows.join(better, rows["cell"] == better["parent"], "left_semi")
        rows = keep(_parted(there, keep(pivots.join(better, pivots["cell"] == better["parent"], "left_semi"), "pivots"), eps).select("id", "cell", "vec", "home"), "parts")
    else:
        # cells that are large still are joined as they are, in tiles
        done.append(rows)
    return done


def _near(a: np.ndarray, b: np.ndarray, least: float):
    """Places (i, j) of the pairs at or above ``least``, in pieces."""
    for lo in range(0, len(a), 512):
        i, j = np.nonzero(a[lo : lo + 512] @ b.T >= least)
        yield i + lo, j


def _settle(n: int, edges) -> np.ndarray:
    """Least place of each place's component, from an iterable of (i, j) pieces."""
    label = np.arange(n)

    def root(x: np.ndarray) -> np.ndarray:
        while (label[x] != x).any():
            x = label[x]
        return x

    for i, j in edges:
        while len(i):
            a, b = root(i), root(j)
            new = a != b
            i, j, a, b = i[new], j[new], a[new], b[new]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
    return root(label)


def _tiles(part: DataFrame, tile: int) -> DataFrame:
    n = keep(part.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(tile))).cast("int").alias("blocks")), "blocks")
    # a tile's work is the square of its size, so tasks are cut by tiles, not by bytes
    tiles = n.agg(F.sum(F.expr("blocks * (blocks + 1) / 2"))).first()[0] or 1
    rows = part.join(n, "cell").withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    out = rows.select("*", other).select("id", "vec", "home", "block", "cell", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y"))
    return out.repartition(int(min(TASKS, max(1, tiles))), "cell", "x", "y")


def near_pairs(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, cell: int = CELL, tile: int = TILE) -> DataFrame:
    """(a, b, cosine) of all pairs of ids a < b with a cosine of at least ``threshold``, each once."""
    units = keep(unit_vectors(table, id_col, vec_col), "units")
    kind = units.schema["id"].dataType.simpleString()

    def run(key, t):
        t = t.sort_by("id")
        v, ids, home, block = _vectors(t.column("vec").combine_chunks()), t.column("id"), np.asarray(t.column("home")), np.asarray(t.column("block"))
        x, y = key[1].as_py(), key[2].as_py()
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        found = [(left[i], right[j]) for i, j in _near(v[left], v[right], threshold)]
        i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1)) if found else (np.zeros(0, int),) * 2
        i, j = np.minimum(i, j), np.maximum(i, j)
        once = (i < j) & home[i]
        pair = np.unique(np.stack([i[once], j[once]]), axis=1)
        cos = (v[pair[0]] * v[pair[1]]).sum(1)
        return pa.table([ids.take(pa.array(pair[0])), ids.take(pa.array(pair[1])), pa.array(cos.astype(np.float64))], names=["a", "b", "cosine"])

    out = None
    for part in cells(units, threshold, cell):
        p = _tiles(part, tile).groupBy("cell", "x", "y").applyInArrow(run, f"a {kind}, b {kind}, cosine double")
        out = p if out is None else out.unionByName(p)
    # rows that repeat an id
    return out.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("cosine").alias("cosine"))


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, cell: int = CELL, tile: int = TILE) -> DataFrame:
    """(id, duplicate_of): each vector that goes, with the one of its group (connected by near pairs) that stays: the least id."""
    units = keep(unit_vectors(table, id_col, vec_col), "units")
    kind = units.schema["id"].dataType.simpleString()
    one = keep(units.groupBy("cell", "vec").agg(F.min("id").alias("id")).select("id", "cell", "vec"), "distinct")
    same = units.join(one.withColumnRenamed("id", "b"), ["cell", "vec"]).where("id <> b").select(F.col("id").alias("a"), "b")

    def run(key, t):
        t = t.sort_by("id")
        v, ids, block = _vectors(t.column("vec").combine_chunks()), t.column("id"), np.asarray(t.column("block"))
        left, right = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
        root = _settle(len(v), ((left[i], right[j]) for i, j in _near(v[left], v[right], threshold)))
        moved = np.flatnonzero(root != np.arange(len(v)))
        return pa.table([ids.take(pa.array(moved)), ids.take(pa.array(root[moved]))], names=["a", "b"])

    edges = same
    for part in cells(one, threshold, cell):
        edges = edges.unionByName(_tiles(part, tile).groupBy("cell", "x", "y").applyInArrow(run, f"a {kind}, b {kind}"))
    return components(edges).where("node <> root").select(F.col("node").alias(id_col), F.col("root").alias("duplicate_of"))


SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (a.n * b.n) >= {THRESHOLD}),
r AS (SELECT a AS node, a AS root FROM p UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node)
SELECT node AS vec_id, min(root) AS duplicate_of FROM r GROUP BY node HAVING min(root) < node
"""
