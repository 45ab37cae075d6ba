"""Connected components of an edge table by alternating large-star and small-star rounds.

Rounds grow with the logarithm of the longest path; each moves only pairs of ids, no node is
ever gathered with all its edges in one task, and each round's table is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import keep


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node of its component.

    Edges with a null end are left out, as are loops of one node; an empty table gives an empty one.
    """
    e = keep(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    for _ in range(rounds):
        # large star: neighbours greater than the node go to the least of the node and its neighbours
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its lesser neighbours go to the least of them
        large = large.where("a <> b").distinct()
        m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(m, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("s")).select("s.*").where("a <> b").distinct()
        new = keep(small, "cc")
        if _same(new, e):
            break
        e = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _same(x: DataFrame, y: DataFrame) -> bool:
    """Equal counts and equal sums of two hashes; a wrong yes has a chance of about 2^-64."""
    sums = [d.agg(F.count(F.lit(1)), *(F.sum(F.xxhash64("a", "b", F.lit(k)).cast("decimal(38,0)")) for k in (1, 2))).first() for d in (x, y)]
    return tuple(sums[0]) == tuple(sums[1])
