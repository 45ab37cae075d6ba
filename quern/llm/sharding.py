"""Fixed-capacity shards by best-fit-decreasing bin packing of indivisible groups.

Groups of equal size are interchangeable, so the packing runs over the histogram of sizes: sizes from
large to small, each into the bins of the least sufficient remaining capacity, found in a balanced
search tree of remaining capacities. Bins that are alike (one remaining capacity) stand in the tree
as one node with their numbers, so a step fills many bins at once; the outcome is that of placing
the groups one by one. What the driver holds follows the number of distinct sizes and of open
capacities, not the number of groups. Groups get their rank among those of their size (ranks are
counted within hash buckets, no size is gathered in one task) and find their shard by an as-of
lookup of the rank.

Defined results
- a group is all rows of equal ``group_col`` (nulls, each a group of its own, where it is null); without ``group_col`` each row is a group;
- a group's size is the sum of its texts' UTF-8 bytes and ``ROW_BYTES`` a row; a null text has no bytes, so no size is 0;
- a group beyond ``capacity`` gets a shard of its own, which alone exceeds the capacity;
- order among groups of a size is that of a hash of the key; shards are numbered from 0 in the order in which they are opened;
- an empty table gives an empty result; other columns pass unchanged, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import free_names, keep

CAPACITY, ROW_BYTES, BUCKET_ROWS = 8 << 20, 16, 1 << 20


class Tree:
    """Ordered keys in a balanced tree of 64-way nodes, each a word of bits that says which children hold a key: insertion, removal and successor take a step a level."""

    def __init__(self, most: int = 1 << 24):
        self.levels: list[dict[int, int]] = [{}]
        while most >> 6 * len(self.levels):
            self.levels.append({})

    def add(self, k: int) -> None:
        for level in self.levels:
            k, bit = k >> 6, 1 << (k & 63)
            level[k] = level.get(k, 0) | bit

    def remove(self, k: int) -> None:
        for level in self.levels:
            k, bit = k >> 6, 1 << (k & 63)
            level[k] &= ~bit
            if level[k]:
                return
            del level[k]

    def at_least(self, k: int) -> int | None:
        for depth, level in enumerate(self.levels):
            here = level.get(k >> 6, 0) >> (k & 63) << (k & 63)
            if here:
                k = k >> 6 << 6 | (here & -here).bit_length() - 1
                for below in reversed(self.levels[:depth]):
                    word = below[k]
                    k = k << 6 | (word & -word).bit_length() - 1
                return k
            k = (k >> 6) + 1
        return None


def pack(histogram: list[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """(runs, number of bins) for (size, number of groups) pairs.

    A run (size, rank, bin, per bin) says: from this rank on, groups of this size go to this bin and the following ones, so many to each.
    """
    tree, bins, runs, opened = Tree(capacity), {}, [], 0  # bins: remaining capacity -> ranges [first, number], lowest last

    def put(left: int, first: int, n: int) -> None:
        if n:
            if left not in bins:
                bins[left] = []
                tree.add(left)
            bins[left].append([first, n])

    for size, count in sorted(histogram, reverse=True):
        rank = 0
        while rank < count:
            left = tree.at_least(size) if size <= capacity else None
            if left is None:  # open as many bins as the rest needs
                per = max(1, capacity // size)
                n = -(-(count - rank) // per)
                first, room, opened = opened, capacity, opened + n
            else:
                first, n = bins[left].pop()
                if not bins[left]:
                    del bins[left]
                    tree.remove(left)
                per, room = left // size, left
            runs.append((size, rank, first, per))
            full, rest = divmod(min(count - rank, n * per), per)
            rank += full * per + rest
            put(max(0, room - per * size), first, full)
            if rest:
                put(room - rest * size, first + full, 1)
            if left is not None:
                put(left, first + full + bool(rest), n - full - bool(rest))
    return runs, opened


def assign_shards(docs: DataFrame, text_col: str = "text", group_col: str | None = None, capacity: int = CAPACITY, shard_col: str = "shard", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` with the number of each row's shard. See the module for defined results."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = docs.sparkSession
    shard_col, key, size, rank, b = free_names(docs, shard_col, "g_key", "g_size", "g_rank", "g_bucket")
    lone = F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))
    group: Column = lone if group_col is None else F.coalesce(F.concat(F.lit("g "), F.col(f"`{group_col}`").cast("string")), lone)
    (own,) = free_names(docs, "g_own")
    # rows without a group are numbered once: a table read again could number them otherwise
    keyed = keep(docs.withColumn(own, group), "shard-keys")
    return _assign(keyed, F.col(own), F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long") + ROW_BYTES, capacity, shard_col, (key, size, rank, b), bucket_rows, spark).drop(own)


def _assign(docs, group, bytes_, capacity, shard_col, names, bucket_rows, spark):
    key, size, rank, b = names
    marked = docs.withColumn(key, group)
    sizes = keep(marked.groupBy(F.col(key)).agg(F.sum(bytes_).alias(size)), "groups")
    most = sizes.groupBy(size).count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, -(-most // bucket_rows))
    sizes = sizes.withColumn(b, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    counted = sizes.groupBy(size, b).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values([size, b])
    offset: dict[int, list[tuple[int, int, int]]] = {}
    for s, k, n in counted.itertuples(index=False, name=None):
        at = offset.setdefault(s, [])
        start = at[-1][1] + at[-1][2] if at else 0
        at.append((k, start, n))
    runs, _ = pack([(s, x[-1][1] + x[-1][2]) for s, x in offset.items()], capacity)
    by_size: dict[int, list[tuple[int, int, int]]] = {}
    for s, r, first, per in runs:
        by_size.setdefault(s, []).append((r, first, per))
    # runs cut where a bucket of a size begins: (size, bucket, rank in bucket, first bin, bins' share, rank where the run begins)
    cols: list[list[int]] = [[] for _ in range(6)]
    for s, own in by_size.items():
        starts = [r for r, *_ in own]
        for k, start, n in offset[s]:
            i = bisect_left(starts, start + 1) - 1
            while i < len(own) and own[i][0] < start + n:
                for c, v in zip(cols, (s, k, max(own[i][0] - start, 0) + 1, own[i][1], own[i][2], own[i][0] - start)):
                    c.append(v)
                i += 1
    table = pa.table([pa.array(c, pa.int64()) for c in cols], names=[size, b, rank, "first", "per", "begin"])
    runs_df = spark.createDataFrame(table) if table.num_rows else spark.createDataFrame([], f"`{size}` long, `{b}` long, `{rank}` long, first long, per long, begin long")
    ranked = sizes.withColumn(rank, F.row_number().over(Window.partitionBy(size, b).orderBy(F.xxhash64(key), key)).cast("long"))
    # the run with the last rank at or before the group's
    both = ranked.select(size, F.col(b).cast("long").alias(b), rank, key, F.lit(1).alias("kind"), *[F.lit(None).cast("long").alias(c) for c in ("first", "per", "begin")]).unionByName(runs_df.select(size, b, rank, F.lit(None).cast("string").alias(key), F.lit(0).alias("kind"), "first", "per", "begin"))
    w = Window.partitionBy(size, b).orderBy(rank, "kind").rowsBetween(Window.unboundedPreceding, 0)
    run = F.last(F.when(F.col("kind") == 0, F.struct("first", "per", "begin")), ignorenulls=True).over(w)
    placed = both.withColumn("run", run).where("kind = 1").select(key, (F.col("run.first") + F.expr(f"(`{rank}` - 1 - run.begin) div run.per")).alias(shard_col))
    return marked.join(placed, key).select(*[F.col(f"`{c}`") for c in docs.columns], shard_col)


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, shard): documents of equal text are a group, so copies never fall into different shards. Only ids and hashes are shuffled."""
    t = F.col(f"`{text_col}`")
    slim = docs.select(F.col(f"`{id_col}`").alias(id_col), F.xxhash64(t).alias("h"), F.coalesce(F.octet_length(t), F.lit(0)).cast("long").alias("bytes"), t.isNull().alias("gone"))
    lone = F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))
    slim = keep(slim.select(id_col, "bytes", F.when(F.col("gone"), lone).otherwise(F.concat_ws(" ", "h", "bytes")).alias("key")), "shard-rows")
    return _assign(slim, F.col("key"), F.col("bytes") + ROW_BYTES, capacity, "shard", ("g_key", "g_size", "g_rank", "g_bucket"), BUCKET_ROWS, docs.sparkSession).select(id_col, "shard")
