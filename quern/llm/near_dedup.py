"""Near-duplicate documents by b-bit MinHash.

Each text gives the minima of ``PERMUTATIONS`` hash functions over its word shingles. Bands of
whole minima name buckets (candidates); of each minimum only ``BITS`` low bits are kept, packed
into one binary value. Inside a bucket similarity is estimated by counting equal b-bit groups of
two packed signatures, corrected for chance: (equal/k - 2^-b) / (1 - 2^-b).

A bucket of about ``HOT`` documents or more (found in a sample of the ids, which decides nothing else) isn't left to one task: ``LEADERS`` of its documents are
compared with all others, in parts; those that the leaders' largest connected group reaches are one group, and only the rest is
compared with every document of the bucket, in tiles of ``TILE``. So no link is lost, and a bucket that is one family costs its length.

A pair is found with the chance that it shares a band and that its estimate reaches ``THRESHOLD``: by calculation 0.47, 0.80, 0.96 and 0.99 at
similarities of 0.50, 0.55, 0.60 and 0.65.

Defined results
- null or wordless texts (no shingle) are never duplicates; fewer than ``SHINGLE`` words make one shingle;
- texts of equal shingle sets are duplicates of each other, without any estimate;
- scripts without spaces have a word a character;
- rows with a null id take no part; rows that repeat an id count as one document (their texts' union of links);
- groups are the connected components of the links; the least id of a group stays;
- an empty table gives an empty result; further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import free_names, importable, keep, small_side
from .textbuf import mix, shingle_hashes, slices, word_hashes

PERMUTATIONS, BITS, ROWS, SHINGLE, THRESHOLD, SEED = 128, 2, 4, 3, 0.5, 7
#: Documents of a bucket that one task may take, the share of ids that is counted to find larger ones, leaders of those, rows of a tile and of a part.
HOT, SAMPLED, LEADERS, TILE, PART = 1 << 14, 64, 32, 1 << 12, 1 << 16


def _functions(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 2**64, k, dtype=np.uint64) | np.uint64(1), r.integers(0, 2**64, k, dtype=np.uint64)


def minima(shingles: np.ndarray, first: np.ndarray, k: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(k, m) mixed minima of the m texts that have shingles, and the places of those texts."""
    have = np.flatnonzero(np.diff(first))
    out = np.empty((k, len(have)), dtype=np.uint64)
    if not len(have):
        return out, have
    a, b = _functions(k, seed)
    starts = first[:-1][have]
    # runs of whole texts that stay in the cache while all k functions pass over them
    cuts = [0]
    while cuts[-1] < len(have):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(starts, starts[cuts[-1]] + 32768))))
    for lo, hi in zip(cuts, cuts[1:]):
        x = shingles[starts[lo] : first[have[hi - 1] + 1]]
        at = starts[lo:hi] - starts[lo]
        y = np.empty_like(x)
        for j in range(k):
            np.bitwise_xor(x, b[j], out=y)
            np.multiply(y, a[j], out=y)
            out[j, lo:hi] = np.minimum.reduceat(y, at)
    return mix(out), have


def pack(m: np.ndarray, bits: int) -> np.ndarray:
    """(texts, bytes): the low bits of each minimum, bit plane after bit plane."""
    planes = [np.packbits(((m >> np.uint64(p)) & np.uint64(1)).astype(np.uint8), axis=0) for p in range(bits)]
    return np.ascontiguousarray(np.concatenate(planes, axis=0).T)


def similarity(one: np.ndarray, many: np.ndarray, k: int, bits: int) -> np.ndarray:
    """Estimates from packed signatures (uint64 words): a minimum's groups agree where no bit plane differs."""
    x = one ^ many
    w = x.shape[-1] // bits
    differs = x[..., :w].copy()
    for p in range(1, bits):
        differs |= x[..., p * w : (p + 1) * w]
    equal = k - np.bitwise_count(differs).sum(-1, dtype=np.int64)
    chance = 2.0**-bits
    return (equal / k - chance) / (1 - chance)


def link(ids: np.ndarray, sigs: np.ndarray, threshold: float, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, root) that connect exactly the components of all pairs of one bucket at or above ``threshold``.

    Documents first gather round leaders; then members of different gatherings, and only those, are
    compared all with all. A bucket that is one family costs a pass a leader, not a square.
    """
    order = np.argsort(ids, kind="stable")
    ids, sigs = ids[order], sigs[order]
    n = len(ids)
    root = np.full(n, -1)
    left = np.arange(n)
    while len(left):
        near = similarity(sigs[left[0]], sigs[left], k, bits) >= threshold
        near[0] = True
        root[left[near]] = left[0]
        left = left[~near]
    leaders = np.unique(root)
    if len(leaders) > 1:
        parent = {int(x): int(x) for x in leaders}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        groups = {int(x): np.flatnonzero(root == x) for x in leaders}
        by_size = sorted(groups, key=lambda x: len(groups[x]))
        for i, g in enumerate(by_size[:-1]):
            others = np.concatenate([groups[h] for h in by_size[i + 1 :]])
            for x in groups[g]:
                hit = others[similarity(sigs[x], sigs[others], k, bits) >= threshold]
                for h in np.unique(root[hit]):
                    p, q = find(g), find(int(h))
                    if p != q:
                        parent[max(p, q)] = min(p, q)
        root = np.array([find(int(x)) for x in root])
    moved = root != np.arange(n)
    return ids[moved], ids[root[moved]]


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = PERMUTATIONS, bits: int = BITS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """(id, whole, sig, bands): hash of all minima, packed low bits and band keys of each text that has shingles."""
    importable(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                h, first = word_hashes(part.column("text"))
                m, have = minima(*shingle_hashes(h, first, shingle), k)
                if not len(have):
                    continue
                key = np.zeros((k // rows, m.shape[1]), dtype=np.uint64)
                for r in range(rows):
                    key = mix(key * np.uint64(0x9FB21C651E98DF25) + m[r : rows * (k // rows) : rows])
                key = mix(key + np.arange(k // rows, dtype=np.uint64)[:, None])
                whole = np.zeros(m.shape[1], dtype=np.uint64)
                for j in range(k):
                    whole = mix(whole + m[j])
                sig = pack(m, bits)
                flat = pa.array(np.ascontiguousarray(key.T).view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(have)),
                        pa.array(whole.view(np.int64)),
                        pa.Array.from_buffers(pa.binary(), len(have), [None, pa.py_buffer((np.arange(len(have) + 1) * sig.shape[1]).astype(np.int32)), pa.py_buffer(sig)]),
                        pa.ListArray.from_arrays(pa.array((np.arange(len(have) + 1) * (k // rows)).astype(np.int32)), flat),
                    ],
                    names=["id", "whole", "sig", "bands"],
                )

    rows_in = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return rows_in.mapInArrow(run, f"id {kind.simpleString()}, whole bigint, sig binary, bands array<bigint>")


def links(sigs: DataFrame, threshold: float = THRESHOLD, k: int = PERMUTATIONS, bits: int = BITS) -> DataFrame:
    """Links (a, b) between documents whose estimate reaches ``threshold``, among those that share a band."""
    kind = sigs.schema["id"].dataType.simpleString()
    width = k * bits // 8

    def bucketed(batches):
        carry: list[pa.Table] = []

        def emit(t: pa.Table):
            key = np.asarray(t.column("band"))
            edge = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
            many = np.flatnonzero(ends - starts > 1)
            if not len(many):
                return None
            # one gather of the rows that are in any bucket of two or more
            rows_of = np.concatenate([np.arange(starts[i], ends[i]) for i in many])
            ids = np.asarray(t.column("id"))[rows_of] if not pa.types.is_string(t.schema.field("id").type) else np.asarray(t.column("id").take(pa.array(rows_of)).to_pylist(), dtype=object)
            packed = t.column("sig").take(pa.array(rows_of)).combine_chunks()
            raw = np.frombuffer(b"".join(packed.to_pylist()), dtype=np.uint64).reshape(len(rows_of), width // 8)
            out_a, out_b, at = [], [], 0
            for i in many:
                n = int(ends[i] - starts[i])
                a, b = link(ids[at : at + n], raw[at : at + n], threshold, k, bits)
                out_a.append(a)
                out_b.append(b)
                at += n
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            if not len(a):
                return None
            return pa.RecordBatch.from_arrays([pa.array(a, t.schema.field("id").type), pa.array(b, t.schema.field("id").type)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            key = np.asarray(t.column("band"))
            edge = np.flatnonzero(np.diff(key)) + 1
            if not len(edge):
                if carry and carry[0].column("band")[0].as_py() != key[0]:
                    if (r := emit(pa.concat_tables(carry))) is not None:
                        yield r
                    carry = []
                carry.append(t)
                continue
            done = pa.concat_tables([*carry, t.slice(0, edge[-1])])
            carry = [t.slice(edge[-1])]
            if (r := emit(done)) is not None:
                yield r
        if carry and (r := emit(pa.concat_tables(carry))) is not None:
            yield r

    one = keep(sigs.groupBy("whole").agg(F.min("id").alias("id"), F.min("sig").alias("sig"), F.first("bands").alias("bands")), "distinct")
    exploded = one.select("id", "sig", F.explode("bands").alias("band"))
    sampled = one.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(SAMPLED)) == 0).select(F.explode("bands").alias("band"))
    hot = keep(sampled.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(1, HOT * 5 // (8 * SAMPLED))).select("band"), "hot")
    rest = exploded
    some = hot.count() > 0
    if some:
        large = small_side(hot, 8)
        rest = exploded.join(large, "band", "left_anti")
    found = rest.select("id", "sig", "band").repartition("band").sortWithinPartitions("band").mapInArrow(bucketed, f"a {kind}, b {kind}")
    if some:
        found = found.unionByName(_hot_links(keep(exploded.join(large, "band", "left_semi").select("band", "id", "sig"), "hot-rows"), kind, threshold, k, bits))
    same = sigs.select("id", "whole").join(one.select("whole", F.col("id").alias("first")), "whole").where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    return found.unionByName(same).distinct()


def _raw(t: pa.Table, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint64).reshape(t.num_rows, width // 8)


def _joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place that each of n places is connected with by the pairs (i, j)."""
    parent = np.arange(n)
    while len(i):
        low = np.minimum(parent[i], parent[j])
        np.minimum.at(parent, parent[i], low)
        np.minimum.at(parent, parent[j], low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        apart = parent[i] != parent[j]
        i, j = i[apart], j[apart]
    return parent


def _hot_links(rows: DataFrame, kind: str, threshold: float, k: int, bits: int) -> DataFrame:
    """Links (a, b) that connect the components of large buckets, of rows (band, id, sig)."""
    width = k * bits // 8
    order = Window.partitionBy("band").orderBy(F.xxhash64("id", F.lit(3)), "id")
    leaders = keep(rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= LEADERS), "leaders")
    sizes = keep(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")), "hot-sizes")
    size = small_side(sizes, 16)
    named = lambda d, *c: d.select(*(F.col(x).alias(x) for x in c))
    parts = F.ceil(F.col("n") / PART).cast("int")
    here = named(rows.join(size, "band").withColumn("part", F.pmod(F.xxhash64("id", F.lit(4)), parts).cast("int")), "band", "part", "id", "sig")
    there = named(leaders.join(size, "band").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))), "band", "part", "k", "id", "sig")

    def led(key, left, right):
        # the first leader of each row (0: none), and which leaders a row connects
        right = right.sort_by("k")
        a, b = _raw(left, width), _raw(right, width)
        near = np.stack([similarity(b[x], a, k, bits) >= threshold for x in range(len(b))], axis=1) if len(a) and len(b) else np.zeros((len(a), len(b)), bool)
        first = np.where(near.any(1), near.argmax(1), -1)
        i, j = np.nonzero(near)
        root = _joined(len(b), first[i], j)
        n = len(a)
        pairs = np.flatnonzero(root != np.arange(len(b)))
        band = key[0].as_py()
        k1 = pa.array(np.concatenate([np.where(first >= 0, first + 1, 0), pairs + 1]).astype(np.int32))
        k2 = pa.array(np.concatenate([np.zeros(n), root[pairs] + 1]).astype(np.int32))
        ids = pa.concat_arrays([left.column("id").combine_chunks() if n else pa.array([], right.schema.field("id").type), pa.nulls(len(pairs), right.schema.field("id").type)])
        sig = pa.concat_arrays([left.column("sig").combine_chunks() if n else pa.array([], pa.binary()), pa.nulls(len(pairs), pa.binary())])
        return pa.table([pa.array([band] * (n + len(pairs)), pa.int64()), ids, sig, k1, k2], names=["band", "id", "sig", "k1", "k2"])

    got = keep(here.groupBy("band", "part").cogroup(there.groupBy("band", "part")).applyInArrow(led, f"band bigint, id {kind}, sig binary, k1 int, k2 int"), "led")
    # leaders' groups: at most LEADERS rows and links a part for each bucket
    load = got.where("k2 = 0 and k1 > 0").groupBy("band", "k1").agg(F.count(F.lit(1)).alias("n")).withColumn("k2", F.col("k1")).unionByName(got.where("k2 > 0").select("band", "k1", "k2").distinct().withColumn("n", F.lit(0).cast("long")))

    def groups(key, t):
        i, j, n = (np.asarray(t.column(c)) for c in ("k1", "k2", "n"))
        root = _joined(LEADERS + 1, i.astype(np.int64), j.astype(np.int64))
        weight = np.bincount(root[i], weights=n, minlength=LEADERS + 1)
        at = np.unique(i)
        return pa.table([pa.array([key[0].as_py()] * len(at), pa.int64()), pa.array(at.astype(np.int32)), pa.array(root[at] == weight.argmax())], names=["band", "k1", "main"])

    main = keep(named(load, "band", "k1", "k2", "n").groupBy("band").applyInArrow(groups, "band bigint, k1 int, main boolean"), "main")
    named_leaders = leaders.select(F.col("band"), F.col("k").alias("k1"), F.col("id").alias("b"))
    mine = got.where("k2 = 0").join(small_side(main, 13), ["band", "k1"], "left")
    by_leader = mine.where("k1 > 0").select("band", "k1", F.col("id").alias("a")).join(small_side(keep(named_leaders, "leader-ids"), 24), ["band", "k1"]).select("a", "b")
    of_leaders = got.where("k2 > 0").select("band", "k1", "k2").join(named_leaders.withColumnRenamed("b", "a"), ["band", "k1"]).join(named_leaders.withColumnRenamed("k1", "k2"), ["band", "k2"]).select("a", "b")
    # what the main group doesn't reach is compared with all of its bucket
    left_over = keep(mine.where(~F.coalesce("main", F.lit(False))).select("band", "id", "sig"), "left-over")
    many = small_side(keep(left_over.groupBy("band").agg(F.count(F.lit(1)).alias("m")), "left-sizes"), 16)
    tiles = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    cell = lambda seed, c: F.pmod(F.xxhash64("id", F.lit(seed)), tiles(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), tiles(c) - 1))
    few = named(left_over.join(many, "band").join(size, "band").withColumn("x", cell(5, "m")).withColumn("y", every("n")), "band", "x", "y", "id", "sig")
    all_ = named(rows.join(many, "band").join(size, "band").withColumn("y", cell(6, "n")).withColumn("x", every("m")), "band", "x", "y", "id", "sig")

    def tile(key, left, right):
        a, b = _raw(left, width), _raw(right, width)
        i, j = [], []
        for x in range(len(a)):
            hit = np.flatnonzero(similarity(a[x], b, k, bits) >= threshold)
            i.append(np.full(len(hit), x))
            j.append(hit)
        i, j = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (i, j))
        n = len(a) + len(b)
        root = _joined(n, i, j + len(a))
        moved = np.flatnonzero(root != np.arange(n))
        ids = pa.concat_arrays([t.column("id").combine_chunks() if t.num_rows else pa.array([], (left if left.num_rows else right).schema.field("id").type) for t in (left, right)])
        return pa.table([ids.take(pa.array(moved)), ids.take(pa.array(root[moved]))], names=["a", "b"])

    tiled = few.groupBy("band", "x", "y").cogroup(all_.groupBy("band", "x", "y")).applyInArrow(tile, f"a {kind}, b {kind}")
    return by_leader.unionByName(of_leaders).unionByName(tiled).where("a <> b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, k: int = PERMUTATIONS, bits: int = BITS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """(id, duplicate_of): each document that goes, with the document of its group that stays (the least id). See the module for defined results."""
    sigs = keep(signatures(docs, id_col, text_col, k, bits, rows, shingle), "sigs")
    groups = components(links(sigs, threshold, k, bits))
    return groups.where("node <> root").select(F.col("node").alias(id_col), F.col("root").alias("duplicate_of"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that near_duplicates() names; all columns and rows with a null id stay."""
    (name,) = free_names(docs, "gone")
    gone = small_side(keep(near_duplicates(docs, id_col, text_col, **how).select(F.col(id_col).alias(name)), "gone"), 24)
    return docs.join(gone, docs[id_col] == gone[name], "left_anti")
