"""Line deduplication through a sharded minimal perfect hash.

Every distinct line hash gets a slot of its own in one shard's minimal perfect hash (levels of bit
arrays with ranks). Slots index compact arrays: a 16-bit fingerprint, an 8-bit saturated count of
documents and, for the slots of repeated lines only, the first document. Documents probe these
arrays: each document's line hashes, once a document, travel to their shards (a shard that many probes ask is copied, so that
no task takes more than about ``PROBES`` of them), and only the hashes of lines to drop come back, gathered by document. Lines are never
joined with lines. At any size there is this one way; the arrays are rows of a table that Spark reads, on any file system.

Defined results
- a line is what stands between line feeds, compared byte by byte; lines without a byte above 0x20 are blank and always stay;
- a line that stands in ``MIN_DOCS`` documents or more stays in the one with the least id only (hash of the id where ids aren't integers), there and elsewhere in its first place only;
- a null text stays null and has no lines; an empty text stays;
- a null id counts as one document after all others; rows that repeat an id count as one document, and each keeps its lines;
- an empty table gives an empty one; further columns pass unchanged, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import free_names, importable, keep, small_side
from .textbuf import buffers, lines, mix, slices, span_hashes

MIN_DOCS, SHARD_KEYS, PROBES = 2, 1 << 18, 1 << 20
_LAST = (1 << 63) - 1
INDEX = "shard int, n bigint, sizes array<bigint>, bits binary, fingerprints binary, counts binary, repeated binary, owners binary"


class BitRank:
    """Bits with the number of ones before any place."""

    def __init__(self, packed: np.ndarray):
        self.words = packed.view(np.uint64)
        ones = np.bitwise_count(self.words)
        self.before = np.concatenate([[0], np.cumsum(ones, dtype=np.int64)])[:-1].astype(np.int32 if len(ones) < 1 << 24 else np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        w = at >> 6
        below = self.words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(below)


def _packed(flags: np.ndarray) -> np.ndarray:
    out = np.packbits(flags, bitorder="little")
    return np.concatenate([out, np.zeros(-len(out) % 8, np.uint8)])


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)


def build_hash(keys: np.ndarray, gamma: float = 1.7) -> tuple[list[int], np.ndarray]:
    """(level sizes, bits) of a minimal perfect hash of distinct keys."""
    sizes, parts, level = [], [], 0
    while len(keys):
        size = max(64, -(-int(gamma * len(keys)) // 64) * 64)
        at = _place(keys, level, size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        parts.append(_packed(alone))
        keys = keys[~alone[at]]
        level += 1
    return sizes, np.concatenate(parts) if parts else np.zeros(0, np.uint8)


class Shard:
    """One shard's hash and arrays."""

    def __init__(self, row: dict):
        self.n, self.sizes = row["n"], row["sizes"]
        raw = lambda x, kind: np.frombuffer(x, dtype=kind)
        self.bits = BitRank(raw(row["bits"], np.uint8))
        self.fingerprints, self.counts = raw(row["fingerprints"], np.uint16), raw(row["counts"], np.uint8)
        self.repeated, self.owners = BitRank(raw(row["repeated"], np.uint8)), raw(row["owners"], np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for a key that is surely not in the set."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = _place(keys[left], level, size) + base
            hit = self.bits.get(at)
            out[left[hit]] = self.bits.rank(at[hit])
            left = left[~hit]
            base += size
        ok = out >= 0
        ok[ok] = self.fingerprints[out[ok]] == fingerprint(keys[ok])
        out[~ok] = -1
        return out

    def foreign(self, keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """True where the key's line is repeated and its first document is another."""
        slot = self.slots(keys)
        drop = slot >= 0
        drop[drop] = self.repeated.get(slot[drop])
        drop[drop] = self.owners[self.repeated.rank(slot[drop])] != ids[drop]
        return drop


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(48)).astype(np.uint16)


def build_shard(shard: int, keys: np.ndarray, n_docs: np.ndarray, owner: np.ndarray, min_docs: int) -> dict:
    sizes, bits = build_hash(keys)
    me = Shard({"n": len(keys), "sizes": sizes, "bits": bits, "fingerprints": np.zeros(0, np.uint16), "counts": b"", "repeated": b"", "owners": b""})
    left, base, slot = np.arange(len(keys)), 0, np.zeros(len(keys), np.int64)
    for level, size in enumerate(sizes):
        at = _place(keys[left], level, size) + base
        hit = me.bits.get(at)
        slot[left[hit]] = me.bits.rank(at[hit])
        left, base = left[~hit], base + size
    fp, counts, rep = np.zeros(len(keys), np.uint16), np.zeros(len(keys), np.uint8), np.zeros(len(keys), bool)
    fp[slot], counts[slot], rep[slot] = fingerprint(keys), np.minimum(n_docs, 255), n_docs >= min_docs
    by_slot = np.zeros(len(keys), np.int64)
    by_slot[slot] = owner
    return {"shard": shard, "n": len(keys), "sizes": sizes, "bits": bits.tobytes(), "fingerprints": fp.tobytes(), "counts": counts.tobytes(), "repeated": _packed(rep).tobytes(), "owners": by_slot[rep].tobytes()}


def _owner(docs: DataFrame, id_col: str) -> Column:
    c = F.col(f"`{id_col}`")
    whole = isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return F.coalesce(c.cast("long") if whole else F.when(c.isNotNull(), F.xxhash64(c)), F.lit(_LAST))


def _hashed(text: pa.Array) -> tuple:
    data, offsets = buffers(text)
    starts, ends, first = lines(data, offsets)
    visible = np.concatenate([[0], np.cumsum(data > 32)])
    shown = visible[ends] > visible[starts]
    return data, starts, ends, first, shown, span_hashes(data, starts, ends)


def _doc(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """What tells documents apart that have the same id or none. Two documents that fall together here would at worst drop a line that is repeated in both."""
    return F.xxhash64(_owner(docs, id_col), F.col(f"`{text_col}`"))


def line_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(occurrences (h, id, doc, part) once a document, table (h, n, owner) by distinct line)."""
    importable(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                _, _, _, first, shown, h = _hashed(part.column("text"))
                doc = np.repeat(np.arange(part.num_rows), np.diff(first))[shown]
                h = h[shown]
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                at = pa.array(doc[new])
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), *(part.column(c).take(at) for c in ("id", "doc", "part"))], names=["h", "id", "doc", "part"])

    rows = docs.select(_owner(docs, id_col).alias("id"), _doc(docs, id_col, text_col).alias("doc"), F.spark_partition_id().alias("part"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    occurrences = rows.mapInArrow(run, "h bigint, id bigint, doc bigint, part int")
    return occurrences, occurrences.select("h", "id").groupBy("h").agg(F.count_distinct("id").alias("n") if _repeats(docs, id_col) else F.count(F.lit(1)).alias("n"), F.min("id").alias("owner"))


def _repeats(docs: DataFrame, id_col: str) -> bool:
    """Whether an id stands in several rows; then documents of a line are counted by id."""
    d = docs.select(_owner(docs, id_col).alias("id")).groupBy("id").count().where("count > 1")
    return not d.isEmpty()


def build_index(counts: DataFrame, shards: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row of arrays (INDEX) for each shard."""

    def run(key, table):
        h = np.asarray(table.column("h")).view(np.uint64)
        r = build_shard(key[0].as_py(), h, np.asarray(table.column("n")), np.asarray(table.column("owner")), min_docs)
        return pa.Table.from_pydict({k: [v] for k, v in r.items()}, schema=pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("fingerprints", pa.binary()), ("counts", pa.binary()), ("repeated", pa.binary()), ("owners", pa.binary())]))

    return counts.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(run, INDEX)


def dropped(docs: DataFrame, id_col: str, text_col: str, min_docs: int, shard_keys: int, probes: int) -> DataFrame:
    """(doc, lines): hashes of the lines that stand in an earlier document, for each document that has some."""
    occurrences, counts = line_counts(docs, id_col, text_col)
    counts = keep(counts, "line-counts")
    shards = max(1, math.ceil(counts.count() / shard_keys))
    shard = F.pmod("h", F.lit(shards)).cast("int").alias("shard")
    index = keep(build_index(counts, shards, min_docs), "line-index")
    copies = keep(counts.select(shard, "n").groupBy("shard").agg(F.ceil(F.sum("n") / probes).cast("int").alias("copies")), "line-copies")
    hot = small_side(keep(copies.where("copies > 1"), "line-hot"), 8)

    def probe(key, left, right):
        h, ids = np.asarray(left.column("h")), np.asarray(left.column("id"))
        drop = Shard(right.to_pylist()[0]).foreign(h.view(np.uint64), ids) if right.num_rows else np.zeros(len(h), bool)
        return pa.table({"doc": left.column("doc").filter(pa.array(drop)), "h": h[drop]})

    asked = occurrences.select("h", "id", "doc", "part", shard).join(hot, "shard", "left")
    asked = asked.select("h", "id", "doc", F.col("shard").alias("shard"), F.pmod(F.xxhash64("doc", "part"), F.coalesce("copies", F.lit(1))).cast("int").alias("copy"))
    spread = index.join(small_side(copies, 8), "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select(*(F.col(c).alias(c) for c in (*index.columns, "copy")))
    found = asked.groupBy("shard", "copy").cogroup(spread.groupBy("shard", "copy")).applyInArrow(probe, "doc bigint, h bigint")
    return found.groupBy("doc").agg(F.collect_set("h").alias("lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, probes: int = PROBES, drop_emptied: bool = False, count_col: str | None = "removed_lines") -> DataFrame:
    """``docs`` with repeated lines taken from its texts, and the number taken in ``count_col``.

    ``drop_emptied`` leaves out documents that lost lines and keep none but blank ones: all they say stands in earlier documents.
    """
    count_name, doc, gone = free_names(docs, count_col or "removed", "line_doc", "line_gone")
    lines_gone = dropped(docs, id_col, text_col, min_docs, shard_keys, probes).select(F.col("doc").alias(doc), F.col("lines").alias(gone))
    marked = docs.withColumn(doc, _doc(docs, id_col, text_col)).join(lines_gone, doc, "left")
    schema = T.StructType([f for f in docs.schema.fields] + [T.StructField(count_name, T.IntegerType())])
    at_text, columns = docs.columns.index(text_col), len(docs.columns)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                text = part.column(at_text)
                data, starts, ends, first, shown, h = _hashed(text)
                n = part.num_rows
                doc = np.repeat(np.arange(n), np.diff(first))
                drop = np.zeros(len(h), bool)
                # later places of a line in its own document
                order = np.lexsort((np.arange(len(h)), h, doc))
                ho, do = h[order], doc[order]
                drop[order[1:]] = (ho[1:] == ho[:-1]) & (do[1:] == do[:-1])
                drop &= shown
                ask = np.flatnonzero(shown & ~drop)
                lists = part.column(columns)
                pair = lambda d, x: mix(x + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                gone_doc = np.repeat(np.arange(n), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
                drop[ask] = np.isin(pair(doc[ask], h[ask]), pair(gone_doc, np.asarray(lists.flatten()).view(np.uint64)))
                taken = np.bincount(doc[drop], minlength=n)
                emptied = np.zeros(n, bool)
                if taken.any():
                    stays = np.bincount(doc[shown & ~drop], minlength=n)
                    emptied = (taken > 0) & (stays == 0)
                    raw, new = data.tobytes(), text.to_pylist()
                    for d in np.flatnonzero(taken):
                        at = np.flatnonzero(~drop[first[d] : first[d + 1]]) + first[d]
                        new[d] = b"\n".join([raw[starts[i] : ends[i]] for i in at]).decode()
                    text = pa.array(new, text.type)
                arrays = [text if i == at_text else part.column(i) for i in range(columns)] + [pa.array(taken.astype(np.int32))]
                out = pa.RecordBatch.from_arrays(arrays, names=[str(i) for i in range(columns + 1)])
                out = out.filter(pa.array(~emptied)) if drop_emptied and emptied.any() else out
                yield pa.RecordBatch.from_arrays(out.columns, names=schema.names)

    done = marked.select(*[F.col(f"`{c}`") for c in docs.columns], gone).mapInArrow(run, schema)
    return done if count_col else done.drop(count_name)


SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
s AS (SELECT *, regexp_matches(line, '[^\\x00-\\x20]') AS shown, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS again FROM l),
o AS (SELECT line, count(DISTINCT doc_id) AS n, min(doc_id) AS owner FROM s WHERE shown GROUP BY line),
k AS (SELECT s.doc_id, s.pos, s.line, NOT shown OR (again = 1 AND (n < 2 OR owner = s.doc_id)) AS stays FROM s LEFT JOIN o ON s.line = o.line),
t AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '') AS text, CAST(count(*) FILTER (WHERE NOT stays) AS INTEGER) AS removed_lines FROM k GROUP BY doc_id)
SELECT doc_id, text, removed_lines FROM t
"""
