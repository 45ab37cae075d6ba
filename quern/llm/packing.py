"""Packing of related documents into fixed windows.

Each text's words are hashed to ``WIDTH`` features; the square roots of their counts, at length one,
are a document's point of ``DIMS`` coordinates. Documents of equal features are one node. Every node is
joined to its ``K`` nearest others over all coordinates: centroids of about equal numbers of nodes (from
a sample halved again and again along its principal direction) give every node a cell; a node is compared with all
nodes of the ``probes`` cells whose centroids are nearest. ``probes`` is set anew for each table: sampled nodes
are compared with every node there is, and as many cells are searched as hold ``RECALL`` of their true
neighbours; at ``LEAST`` cells or fewer all are searched and the graph is exact. In each region (adjacent cells) greedy
paths are walked over the graph: the unvisited node of the least degree begins, the
nearest unvisited neighbour follows, until none is left. Then links between ends of paths, of whatever regions, join
them, the shortest first, as long as both nodes are still ends of different paths. No task sees all of them: links inside blocks of
adjacent regions come first, then those inside larger blocks (see chain_paths). Windows are filled along the
joined paths, one after another, with their documents' words; a document that doesn't fit goes on in the next window.
A node's copies are placed by counting their words, so no task gets all copies of a text.

Defined results
- rows (id, window, slot, start, end): words start to end (without it) of the document stand at this slot of the window;
- null, empty and wordless texts have no words and no rows; a null id is packed with its null; rows that repeat an id are documents of their own;
- a window holds ``WINDOW`` words; only the last one may hold fewer; window numbers are consecutive from 0;
- neighbours at equal distance go by the least row, links between ends of equal length in a block by their hash; copies of a node stand in the order in which they are read;
- scripts without spaces count a word a character;
- an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import importable, keep, small_side
from .textbuf import slices, word_hashes

WINDOW, K, DIMS, WIDTH, CELL, SCALE = 2048, 8, 128, 128, 1024, 1_000_000
#: Share of true neighbours to find, cells searched at least, nodes of a region, nodes that are compared with all others.
RECALL, LEAST, REGION, SAMPLE = 0.93, 32, 40960, 512
#: Nodes at most (up to a cell) whose neighbours one task searches, numbers of a table of closeness that are held at once.
SEARCH, ROOM = 163840, 1 << 20
#: Links between ends of paths that one task may take.
TAIL = 1 << 17
#: What 32-bit products may be wrong by; pairs within it are compared again in whole numbers.
EPS = 1e-5


def features(h: np.ndarray, first: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """(texts, width): square roots of counts of hashed words, as bytes."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    counts = np.bincount(doc * width + (h % np.uint64(width)).astype(np.int64), minlength=n * width).reshape(n, width)
    return np.minimum(np.rint(np.sqrt(counts) * 8), 255).astype(np.uint8)


def _units(raw: list[bytes], width: int) -> np.ndarray:
    return _points(np.frombuffer(b"".join(raw), np.uint8).reshape(-1, width))


def _points(f: np.ndarray, kind: type = np.float64) -> np.ndarray:
    """Features at length one."""
    x = f.astype(kind)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _words(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(rid, id, n, f) of the documents that have words."""
    importable(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                h, first = word_hashes(part.column("text"))
                have = np.flatnonzero(np.diff(first))
                if len(have):
                    f = features(h, first, width)[have]
                    yield pa.RecordBatch.from_arrays([part.column("rid").take(pa.array(have)), part.column("id").take(pa.array(have)), pa.array(np.diff(first)[have]), pa.array([r.tobytes() for r in f], pa.binary())], names=["rid", "id", "n", "f"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    return rows.mapInArrow(run, f"rid bigint, id {kind}, n bigint, f binary")


def _whole(x: np.ndarray) -> np.ndarray:
    """The coordinates in whole numbers: squared distances of them are exact."""
    return np.rint(x * SCALE)


def _share(nodes: DataFrame, want: int, count: int) -> DataFrame:
    """About ``want`` of ``count`` nodes, chosen by the hash of their number."""
    return nodes.where(F.pmod(F.xxhash64("nid"), F.lit(1 << 30)) < int(min(1.0, want / max(count, 1)) * (1 << 30)))


def centroids(nodes: DataFrame, count: int, cell: int, width: int) -> np.ndarray:
    """(cells, width): means of a sample's parts, adjacent ones beside each other; the largest part is halved along its principal direction until there is one for each ``cell`` nodes."""
    cells = max(1, math.ceil(count / cell))
    sample = _share(nodes, max(1 << 16, 16 * cells), count).select("nid", "f").toPandas().sort_values("nid")
    x = _units(sample["f"].tolist(), width).astype(np.float32)
    parts = [(-len(x), "", np.arange(len(x)))]
    while len(parts) < cells and parts[0][0] < -1:
        _, code, at = heapq.heappop(parts)
        y = x[at] - x[at].mean(0)
        v = np.ones(width, np.float32) + np.arange(width, dtype=np.float32) / width
        for _ in range(8):
            v = y.T @ (y @ v)
            v /= max(float(np.sqrt((v * v).sum())), 1e-30)
        order = at[np.argsort(y @ v, kind="stable")]
        half = len(order) // 2
        for c, part in (("0", order[:half]), ("1", order[half:])):
            heapq.heappush(parts, (-len(part), code + c, part))
    return np.stack([x[at].mean(0) for _, _, at in sorted(parts, key=lambda p: p[1]) if len(at)]) if len(x) else np.zeros((1, width), np.float32)


def _close(x: np.ndarray, cent: np.ndarray) -> np.ndarray:
    """(points, cells): the greater, the nearer the centroid."""
    return x @ cent.T - (cent * cent).sum(1) / 2


def _steps(x: np.ndarray, cent: np.ndarray):
    """Points by so many at a time that their closeness to all centroids takes ``ROOM`` numbers: (first point, closeness)."""
    step = max(1, ROOM // len(cent))
    for lo in range(0, len(x), step):
        yield lo, _close(x[lo : lo + step], cent)


def _last(close: np.ndarray, probes: int) -> np.ndarray:
    """(points,): the closeness of the last cell that each point searches."""
    at = max(0, close.shape[1] - probes)
    return np.partition(close, at, axis=1)[:, at].copy()  # a view would hold the whole table


def celled(nodes: DataFrame, cent: np.ndarray) -> DataFrame:
    """``nodes`` with their cell."""
    shared = nodes.sparkSession.sparkContext.broadcast(cent)
    width = cent.shape[1]

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = _units(b.column("f").to_pylist(), width).astype(np.float32)
                cell = np.concatenate([close.argmax(1) for _, close in _steps(x, shared.value)])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], names=[*names, "cell"])

    names = nodes.columns
    return nodes.mapInArrow(run, T.StructType([*nodes.schema.fields, T.StructField("cell", T.IntegerType())]))


def probes_for(nodes: DataFrame, count: int, cent: np.ndarray, k: int, recall: float = RECALL) -> int:
    """How many cells hold ``recall`` of the k true neighbours of sampled nodes, which are compared with all nodes."""
    if len(cent) <= LEAST:
        return len(cent)
    width = cent.shape[1]
    sample = _share(nodes, SAMPLE, count).select("nid", "f").toPandas().sort_values("nid").iloc[: 2 * SAMPLE]
    if not len(sample):
        return len(cent)
    mine, x = sample["nid"].to_numpy(), _units(sample["f"].tolist(), width).astype(np.float32)
    shared = nodes.sparkSession.sparkContext.broadcast((mine, x))

    def run(batches):
        mine, x = shared.value
        best, where = np.full((len(x), k), -np.inf, np.float32), np.full((len(x), k), -1, np.int32)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                s = x @ _units(part.column("f").to_pylist(), width).astype(np.float32).T
                s[mine[:, None] == np.asarray(part.column("nid"))[None, :]] = -np.inf
                s = np.concatenate([best, s], axis=1)
                cell = np.concatenate([where, np.tile(np.asarray(part.column("cell")), (len(x), 1))], axis=1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                best, where = np.take_along_axis(s, top, 1), np.take_along_axis(cell, top, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(x)), k)), pa.array(best.ravel().astype(np.float64)), pa.array(where.ravel())], names=["i", "s", "cell"])

    found = nodes.mapInArrow(run, "i bigint, s double, cell int").where("cell >= 0").toPandas().sort_values(["i", "s"], ascending=[True, False]).groupby("i").head(k)
    score = _close(x, cent)
    rank = (score[found["i"].to_numpy()] > score[found["i"].to_numpy(), found["cell"].to_numpy()][:, None]).sum(1)
    need = int(np.sort(rank)[max(0, math.ceil(len(rank) * recall) - 1)]) + 1
    return min(len(cent), max(LEAST, need))


class Nearest:
    """The k nearest targets of each query so far, by whole-number distance and then by number. Queries are sorted by cell.

    A query takes its features' bytes and some 200 more, what is looked at a bounded room: neither coordinates nor a list of
    the cells that a query asks are held.
    """

    def __init__(self, f: np.ndarray, ids: np.ndarray, home: np.ndarray, cent: np.ndarray, probes: int, k: int):
        self.f, self.ids, self.home, self.cent, self.k = f, ids, home, cent, k
        self.d, self.b = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.cell = np.zeros((len(ids), k), np.int32)
        step = max(1, ROOM // len(cent))
        self.bound = np.concatenate([_last(_close(_points(f[i : i + step], np.float32), cent), probes) for i in range(0, len(f), step)]) - np.float32(EPS)
        names, first = np.unique(home, return_index=True)
        parts = list(zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(home)]))
        for cell, lo, hi in parts:  # a node's own cell first: it bounds the others
            self.look(np.arange(lo, hi), f[lo:hi], ids[lo:hi], cell)
        for i in range(0, len(parts), 16):
            for (cell, lo, hi), asking in zip(parts[i : i + 16], self.asking(names[i : i + 16])):
                self.look(asking[home[asking] != cell], f[lo:hi], ids[lo:hi], cell)

    def asking(self, cells: np.ndarray) -> list[np.ndarray]:
        """The queries that search each of a few cells."""
        c = self.cent[cells]
        close = np.concatenate([c @ _points(self.f[i : i + 4096], np.float32).T for i in range(0, len(self.f), 4096)], axis=1)
        return [np.flatnonzero(x >= self.bound + h) for x, h in zip(close, (c * c).sum(1) / 2)]

    def look(self, at: np.ndarray, f: np.ndarray, ids: np.ndarray, cell: int) -> None:
        """Compare the queries ``at`` with targets of a cell."""
        for part in range(0, len(ids), 2048):
            self._look(at, f[part : part + 2048], ids[part : part + 2048], cell)

    def _look(self, at: np.ndarray, f: np.ndarray, ids: np.ndarray, cell: int) -> None:
        t = _points(f, np.float32).T
        for lo in range(0, len(at), 2048):
            q = at[lo : lo + 2048]
            s = _points(self.f[q], np.float32) @ t
            least = 1 - self.d[q, -1] / (2.0 * SCALE * SCALE)
            if s.shape[1] > self.k + 1 and np.isinf(least).any():
                new = np.isinf(least)
                least[new] = np.partition(s[new], s.shape[1] - self.k - 1, axis=1)[:, s.shape[1] - self.k - 1]
            hit = np.flatnonzero(s >= (least - EPS).astype(np.float32)[:, None])
            for h in range(0, len(hit), 1 << 13):
                i, j = np.divmod(hit[h : h + (1 << 13)], s.shape[1])
                other = self.ids[q[i]] != ids[j]
                i, j = i[other], j[other]
                self._merge(q[i], ((_whole(_points(self.f[q[i]])) - _whole(_points(f[j]))) ** 2).sum(1), ids[j], cell)

    def _merge(self, i: np.ndarray, d: np.ndarray, b: np.ndarray, cell: int) -> None:
        rows = np.unique(i)
        c = np.concatenate([np.full(len(i), cell, np.int32), self.cell[rows].ravel()])
        i = np.concatenate([i, np.repeat(rows, self.k)])
        d, b = np.concatenate([d, self.d[rows].ravel()]), np.concatenate([b, self.b[rows].ravel()])
        order = np.lexsort((b, d, i))
        i = i[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        top = place < self.k
        self.d[i[top], place[top]], self.b[i[top], place[top]], self.cell[i[top], place[top]] = d[order][top], b[order][top], c[order][top]

    def links(self, region: np.ndarray):
        for lo in range(0, len(self.ids), 1 << 13):
            i, j = np.nonzero(np.isfinite(self.d[lo : lo + (1 << 13)]))
            i += lo
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (self.ids[i], self.b[i, j], self.d[i, j], region[self.home[i]], region[self.cell[i, j]])], names=["a", "b", "d", "ra", "rb"])


def searched(batches, cent: np.ndarray, region: np.ndarray, probes: int, k: int):
    """Links of the nodes of a block (away 0), which come first, to each other and to the nodes of other cells (away 1), which follow cell by cell; then those of the next block."""
    width = cent.shape[1]
    mine: list[tuple] = []
    near, now = None, None

    def begun() -> Nearest:
        f, ids, home = (np.concatenate(x) for x in zip(*mine))
        mine.clear()
        return Nearest(f, ids, home, cent, probes, k)

    for b in batches:
        at, away, cell, ids = (np.asarray(b.column(c)) for c in ("block", "away", "cell", "nid"))
        cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(away) != 0)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows]):
            if lo == hi:
                continue
            if now is not None and at[lo] != now:
                yield from (near or begun()).links(region)
                near = None
            now = at[lo]
            f = np.frombuffer(b"".join(b.column("f").slice(lo, hi - lo).to_pylist()), np.uint8).reshape(-1, width)
            if not away[lo]:
                mine.append((f, ids[lo:hi].copy(), cell[lo:hi].copy()))
                continue
            near = near or begun()
            names, first = np.unique(cell[lo:hi], return_index=True)
            end = [*first[1:].tolist(), hi - lo]
            for i in range(0, len(names), 16):
                for name, x, y, who in zip(names[i : i + 16].tolist(), first[i : i + 16].tolist(), end[i : i + 16], near.asking(names[i : i + 16])):
                    near.look(who, f[x:y], ids[lo + x : lo + y], name)
    if now is not None:
        yield from (near or begun()).links(region)


def neighbours(nodes: DataFrame, cent: np.ndarray, region: np.ndarray, block: np.ndarray, probes: int, k: int) -> DataFrame:
    """(a, b, d, ra, rb): the k nearest nodes b of each node a among those of the ``probes`` cells it searches, with their squared distance and both regions.

    One task has the nodes of a block of adjacent cells (``block`` by cell) and reads the nodes of all other cells that they
    search as a stream sorted by cell, so it never holds more of the table than its block.
    """
    width, blocks = cent.shape[1], int(block.max()) + 1
    shared = nodes.sparkSession.sparkContext.broadcast((cent, region, block))

    def wanted(batches):
        cent, _, block = shared.value
        asked = np.zeros((blocks, len(cent)), bool)
        for b in batches:
            if b.num_rows:
                x, home = _units(b.column("f").to_pylist(), width).astype(np.float32), block[np.asarray(b.column("cell"))]
                for lo, close in _steps(x, cent):
                    ask, of = close >= _last(close, probes)[:, None], home[lo : lo + len(close)]
                    for i in np.unique(of).tolist():
                        asked[i] |= ask[of == i].any(0)
        asked[block, np.arange(len(cent))] = False  # a block's own cells are there
        i, c = np.nonzero(asked)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(c.astype(np.int32))], names=["block", "cell"])

    wants = keep(nodes.select("f", "cell").mapInArrow(wanted, "block int, cell int").distinct(), "wants")
    copies = nodes.select("cell", "nid", "f").join(small_side(wants, 24), "cell").select("block", F.lit(1).alias("away"), "cell", "nid", "f")
    asking = nodes.select("block", F.lit(0).alias("away"), "cell", "nid", "f")

    def search(batches):
        cent, region, _ = shared.value
        yield from searched(batches, cent, region, probes, k)

    sent = asking.unionByName(copies).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "away", "cell")
    return sent.mapInArrow(search, "a bigint, b bigint, d double, ra bigint, rb bigint")


def walk(ids: np.ndarray, degree: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> list[list[int]]:
    """Greedy paths over the nodes ``ids`` and links (a, b) of distance d in either direction."""
    place = {int(x): i for i, x in enumerate(ids)}
    near: list[list[tuple[float, int]]] = [[] for _ in ids]
    for x, y, w in zip(a.tolist(), b.tolist(), d.tolist()):
        i, j = place.get(x), place.get(y)
        if i is not None and j is not None:
            near[i].append((w, j))
            near[j].append((w, i))
    order = lambda i: (int(degree[i]), int(ids[i]))
    heap = [(*order(i), i) for i in range(len(ids))]
    heapq.heapify(heap)
    seen, paths = np.zeros(len(ids), bool), []
    for n in near:
        n.sort(key=lambda x: (x[0], int(ids[x[1]])))
    while heap:
        i = heapq.heappop(heap)[-1]
        if seen[i]:
            continue
        path = []
        at: int | None = i
        while at is not None:
            seen[at] = True
            path.append(int(ids[at]))
            at = next((j for _, j in near[at] if not seen[j]), None)
        paths.append(path)
    return paths


def join_paths(first: np.ndarray, last: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray, k: np.ndarray | None = None) -> list[list[tuple[int, bool]]]:
    """Chains of (path, reversed): links (a, b) between ends of the paths (first, last) are taken in the order of (d, k, a, b) while both are still ends of different chains."""
    path: dict[int, int] = {}
    free: dict[int, int] = {}
    for i, (x, y) in enumerate(zip(first.tolist(), last.tolist())):
        path[x] = path[y] = i
        free[x] = free.get(x, 0) + 1
        free[y] = free.get(y, 0) + 1
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((hi, lo, np.zeros(len(d)) if k is None else k, d))
    root = list(range(len(first)))
    joined: list[list[tuple[int, int, int]]] = [[] for _ in first]

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for x, y in zip(lo[order].tolist(), hi[order].tolist()):
        i, j = path[x], path[y]
        p, q = top(i), top(j)
        if not free[x] or not free[y] or p == q:
            continue
        root[p] = q
        free[x] -= 1
        free[y] -= 1
        joined[i].append((x, y, j))
        joined[j].append((y, x, i))
    chains, seen = [], [False] * len(first)
    for start in sorted(range(len(first)), key=lambda i: (len(joined[i]), i)):
        if seen[start]:
            continue
        chain, at, came = [], start, None
        while at is not None:
            seen[at] = True
            out = next(((x, y, j) for x, y, j in joined[at] if not seen[j]), None)
            # it leaves at its last node, or comes in at its first one
            back = came != first[at] if came is not None else out is not None and out[0] != last[at]
            chain.append((at, bool(back)))
            at, came = (out[2], out[1]) if out else (None, None)
        chains.append(chain)
    return chains


def _mutual(chains: DataFrame, live: DataFrame) -> DataFrame:
    """Moves of the links that are the first of both their chains."""
    best = live.select("*", F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").agg(F.min(F.struct("d", "k", "a", "b", "ca", "cb")).alias("s")).select("s.*")
    taken = best.groupBy("a", "b", "ca", "cb").agg(F.count(F.lit(1)).alias("m")).where("m = 2")
    # the chain of the lesser number goes first
    up = F.col("ca") < F.col("cb")
    taken = taken.select(F.least("ca", "cb").alias("p"), F.greatest("ca", "cb").alias("q"), F.when(up, F.col("a")).otherwise(F.col("b")).alias("pe"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("qe"))
    side = lambda c: chains.select(F.col("chain").alias(c), F.col("x").alias(c + "x"), F.col("y").alias(c + "y"), F.col("n").alias(c + "n"))
    both = taken.join(side("p"), "p").join(side("q"), "q")
    both = both.withColumns({"prev": F.col("pe") != F.col("py"), "qrev": F.col("qe") != F.col("qx")})
    both = both.withColumns({"nx": F.when(F.col("prev"), F.col("py")).otherwise(F.col("px")), "ny": F.when(F.col("qrev"), F.col("qx")).otherwise(F.col("qy")), "total": F.col("pn") + F.col("qn")})
    two = F.array(F.struct(F.col("p").alias("chain"), F.col("prev").alias("rev"), F.lit(0).cast("long").alias("shift"), F.col("pn").alias("length")), F.struct(F.col("q").alias("chain"), F.col("qrev").alias("rev"), F.col("pn").alias("shift"), F.col("qn").alias("length")))
    return both.select(F.col("p").alias("new"), "nx", "ny", "total", F.explode(two).alias("s")).select("s.chain", "new", "s.rev", "s.shift", "s.length", "nx", "ny", "total")


def _inside(chains: DataFrame, live: DataFrame, blocks: int, regions: int) -> DataFrame:
    """Moves by the links inside blocks of chains, each block in its own greedy order."""
    block = lambda c: F.expr(f"{c} * {blocks} div {regions}")
    sent = live.where(block("ra") == block("rb")).select(block("ra").alias("at"), "a", "b", "d", "k")
    # a chain without a link inside its block doesn't move: as many chains as links go to a task at most
    linked = live.where(block("ra") == block("rb")).select(F.explode(F.array("ca", "cb")).alias("chain")).distinct()
    used = chains.join(linked, "chain", "left_semi").select(block("region").alias("at"), "chain", "x", "y", "n")

    def run(key, left, right):
        chain, x, y, n = (np.asarray(left.column(c)) for c in ("chain", "x", "y", "n"))
        by = np.argsort(chain)
        chain, x, y, n = chain[by], x[by], y[by], n[by]
        out = []
        for c in join_paths(x, y, *(np.asarray(right.column(c)) for c in ("a", "b", "d", "k"))) if len(chain) else []:
            if len(c) < 2:
                continue
            at, who = 0, [i for i, _ in c]
            (i, back), (j, end) = c[0], c[-1]
            same = (int(chain[who].min()), int(y[i] if back else x[i]), int(x[j] if end else y[j]), int(n[who].sum()))
            for i, back in c:
                out.append((int(chain[i]), same[0], back, at, int(n[i]), *same[1:]))
                at += int(n[i])
        kinds = [pa.bool_() if i == 2 else pa.int64() for i in range(8)]
        return pa.table([pa.array([r[i] for r in out], kinds[i]) for i in range(8)], names=["chain", "new", "rev", "shift", "length", "nx", "ny", "total"])

    return used.groupBy("at").cogroup(sent.groupBy("at")).applyInArrow(run, "chain bigint, new bigint, rev boolean, shift bigint, length bigint, nx bigint, ny bigint, total bigint")


def chain_paths(paths: DataFrame, edges: DataFrame, tail: int = TAIL) -> DataFrame:
    """(head, begin, back, n): where each path (head, tail, n words, region) begins among all words once links (a, b, d, and the regions ra and rb) between ends have joined the paths.

    In each round blocks of adjacent regions, of about ``tail`` links, take the links inside them, the shortest first; the links
    between blocks are for later rounds, whose blocks are larger. A round after one that did little takes the links that are the first of
    both their chains, wherever they are. At ``tail`` links or fewer there is one block, and no link between ends of different chains is left.
    """
    regions = (paths.agg(F.max("region")).first()[0] or 0) + 1
    chains = keep(paths.select(F.col("head").alias("chain"), F.col("head").alias("x"), F.col("tail").alias("y"), "n", "region"), "chains")
    placed = paths.select("head", F.col("head").alias("chain"), F.lit(0).cast("long").alias("off"), F.lit(False).alias("back"), "n")
    ends = small_side(keep(chains.select("chain", F.explode(F.array_distinct(F.array("x", "y"))).alias("end")), "ends"), 24)
    e = edges.join(ends.select(F.col("end").alias("a"), F.col("chain").alias("ca")), "a").join(ends.select(F.col("end").alias("b"), F.col("chain").alias("cb")), "b")
    live = keep(e.where("ca <> cb").select("a", "b", "d", F.xxhash64("a", "b").alias("k"), "ca", "cb", "ra", "rb"), "live")
    before, slow, history = None, False, []
    while (left := live.count()) > 0:
        blocks = max(1, math.ceil(left / max(1, tail)))
        slow = before is not None and left > 0.7 * before and not slow and blocks > 1
        before = left
        moves = keep(_mutual(chains, live) if slow else _inside(chains, live, blocks, regions), "moves")
        history.append(moves)
        if blocks == 1:
            break
        # a joined chain lies where its first path does
        to = small_side(keep(moves.join(chains.select(F.col("chain").alias("new"), "region"), "new"), "to"), 56)
        chains = keep(chains.join(to.select("chain"), "chain", "left_anti").unionByName(to.where("chain = new").select("chain", F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("total").alias("n"), "region")), "chains")
        for c, end, r in (("ca", "a", "ra"), ("cb", "b", "rb")):
            by = to.select(F.col("chain").alias(c), "new", "nx", "ny", "region")
            live = live.join(by, c, "left").where(F.col("new").isNull() | (F.col(end) == F.col("nx")) | (F.col(end) == F.col("ny"))).withColumns({c: F.coalesce("new", c), r: F.coalesce("region", r)}).drop("new", "nx", "ny", "region")
        live = keep(live.where("ca <> cb").select("a", "b", "d", "k", "ca", "cb", "ra", "rb"), "live")
    # where a chain goes in all rounds from one on: the last round first, so each step is of the size of the chains that still move
    later = None
    for moves in reversed(history):
        now = moves.select("chain", "new", "rev", "shift", "length", "total")
        if later is not None:
            n = later.select(F.col("chain").alias("new"), F.col("new").alias("new2"), F.col("rev").alias("rev2"), F.col("shift").alias("shift2"), F.col("total").alias("total2"))
            turned = F.when(F.col("rev2"), F.col("total") - F.col("shift") - F.col("length")).otherwise(F.col("shift"))
            both = now.join(n, "new", "left").select("chain", F.coalesce("new2", "new").alias("new"), F.when(F.col("rev2"), ~F.col("rev")).otherwise(F.col("rev")).alias("rev"), F.when(F.col("new2").isNull(), F.col("shift")).otherwise(turned + F.col("shift2")).alias("shift"), "length", F.coalesce("total2", "total").alias("total"))
            now = keep(both.unionByName(later.join(now.select("chain"), "chain", "left_anti")), "later")
        later = now
    if later is not None:
        m = later.select("chain", "new", "rev", "shift", F.col("total").alias("all"))
        placed = placed.join(m, "chain", "left").select("head", F.coalesce("new", "chain").alias("chain"), F.coalesce("shift", F.lit(0)).alias("off"), F.coalesce("rev", F.lit(False)).alias("back"), "n", F.coalesce("all", "n").alias("length"))
    else:
        placed = placed.withColumn("length", F.col("n"))
    placed = keep(placed, "placed")
    # a chain's first path says how long it is
    lengths = placed.where("off = 0").select("chain", "length")
    buckets = max(1, placed.count() >> 18)
    lengths = lengths.withColumn("bucket", F.pmod(F.xxhash64("chain"), F.lit(buckets)))
    all_before = F.sum("all").over(Window.partitionBy(F.lit(0)).orderBy("bucket")) - F.col("all")  # a row a bucket
    bases = keep(lengths.groupBy("bucket").agg(F.sum("length").alias("all")).select("bucket", all_before.alias("base")), "bases")
    begun = lengths.join(small_side(bases, 16), "bucket").select("chain", (F.col("base") + F.sum("length").over(Window.partitionBy("bucket").orderBy("chain")) - F.col("length")).alias("begin"))
    return placed.join(begun, "chain").select("head", (F.col("begin") + F.col("off")).alias("begin"), "back", "n")


def fill(lengths: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(document, window, slot, start, end) of documents laid one after another."""
    ends = np.cumsum(lengths)
    begins = ends - lengths
    w0, w1 = begins // window, (ends - 1) // window
    n = w1 - w0 + 1
    doc = np.repeat(np.arange(len(lengths)), n)
    win = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + w0[doc]
    start = np.maximum(begins[doc], win * window) - begins[doc]
    end = np.minimum(ends[doc], (win + 1) * window) - begins[doc]
    slot = np.arange(len(win)) - np.searchsorted(win, win)
    return doc, win, slot, start, end


def _graph(docs: DataFrame, id_col: str, text_col: str, k: int, width: int, cell: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, int, int]:
    """(documents, their counts by features and part, nodes with cell and region, links, cells, cells that each node searches)."""
    # two hashes stand for the features wherever rows are moved but once
    words = _words(docs, id_col, text_col, width)
    points = keep(words.select("rid", "id", "n", "f", F.xxhash64("f").alias("h"), F.xxhash64("f", F.lit(1)).alias("g"), F.shiftright("rid", 33).alias("part")), "features")
    # a part is what one task read: however often a text stands, a part's copies are few enough for one task
    parts = keep(points.groupBy("h", "g", "part").agg(F.min("rid").alias("rid"), F.sum("n").alias("n")), "parts")
    first = parts.groupBy("h", "g").agg(F.min("rid").alias("nid"), F.sum("n").alias("n"))
    nodes = keep(first.join(points.select(F.col("rid").alias("nid"), "f"), "nid"), "nodes")
    count = nodes.count()
    cent = centroids(nodes, count, cell, width)
    nodes = keep(celled(nodes, cent), "cells")
    size = np.zeros(len(cent), np.int64)
    for r in nodes.groupBy("cell").count().collect():
        size[r["cell"]] = r["count"]
    region, block = ((np.cumsum(size) - size) // most for most in (REGION, min(max(REGION, count // 16), SEARCH)))
    names = docs.sparkSession.createDataFrame([(i, int(r), int(b)) for i, (r, b) in enumerate(zip(region, block))], "cell int, region bigint, block int")
    probes = probes_for(nodes, count, cent, k)
    nodes = nodes.join(small_side(names, 16), "cell")
    return points, parts, nodes, keep(neighbours(nodes, cent, region, block, probes, k), "links"), len(cent), probes


def graph(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH, cell: int = CELL) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(documents, nodes with their coordinates, links, cells)."""
    points, _, nodes, links, cells, _ = _graph(docs, id_col, text_col, k, width, cell)

    def run(batches):
        for b in batches:
            if b.num_rows:
                z = _whole(_units(b.column("f").to_pylist(), width)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("nid"), b.column("region"), b.column("f"), *(pa.array(np.ascontiguousarray(z[:, j])) for j in range(width))], names=["nid", "region", "f", *(f"z{j}" for j in range(width))])

    return points, nodes.select("nid", "region", "f").mapInArrow(run, "nid bigint, region bigint, f binary, " + ", ".join(f"z{j} bigint" for j in range(width))), links, cells


def undirected(links: DataFrame) -> DataFrame:
    """(a, b, d, ra, rb) with a < b: each pair of neighbours once, whether one or both name the other."""
    up = F.col("a") < F.col("b")
    return links.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("d").alias("d"), F.min(F.when(up, F.col("ra")).otherwise(F.col("rb"))).alias("ra"), F.min(F.when(up, F.col("rb")).otherwise(F.col("ra"))).alias("rb"))


def walked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(region, nid, n, head, tail, begin): each node's path, by its end nodes, and the words before the node in it. Paths are walked inside regions."""
    degree = edges.select(F.explode(F.array("a", "b")).alias("nid")).groupBy("nid").agg(F.count(F.lit(1)).alias("deg"))
    members = nodes.select("region", "nid", "n").join(degree, "nid", "left").select(F.col("region").alias("region"), "nid", "n", F.coalesce("deg", F.lit(0)).alias("deg"))
    inner = edges.where("ra = rb").select(F.col("ra").alias("region"), "a", "b", "d")

    def run(key, left, right):
        nid, n, deg = (np.asarray(left.column(c)) for c in ("nid", "n", "deg"))
        by = np.argsort(nid)
        nid, n, deg = nid[by], n[by], deg[by]
        paths = walk(nid, deg, *(np.asarray(right.column(c)) for c in ("a", "b", "d"))) if len(nid) else []
        size = [len(p) for p in paths]
        flat = np.array([x for p in paths for x in p], dtype=np.int64)
        words = n[np.searchsorted(nid, flat)]
        before = np.cumsum(words) - words
        starts = np.cumsum(size) - size
        begin = before - np.repeat(before[starts], size) if len(flat) else before
        head, tail = (np.repeat(np.array([p[i] for p in paths], dtype=np.int64), size) for i in (0, -1))
        region = np.full(len(flat), key[0].as_py())
        return pa.table([pa.array(x.astype(np.int64)) for x in (region, flat, words, head, tail, begin)], names=["region", "nid", "n", "head", "tail", "begin"])

    return members.groupBy("region").cogroup(inner.groupBy("region")).applyInArrow(run, "region bigint, nid bigint, n bigint, head bigint, tail bigint, begin bigint")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K, width: int = WIDTH, cell: int = CELL) -> DataFrame:
    """(id, window, slot, start, end) of each piece of each document. See the module for defined results."""
    points, parts, nodes, links, _, _ = _graph(docs, id_col, text_col, k, width, cell)
    edges = keep(undirected(links), "edges")
    path = keep(walked(nodes, edges), "walked")
    paths = path.groupBy("head").agg(F.min("tail").alias("tail"), F.sum("n").alias("n"), F.min("region").alias("region"))
    places = chain_paths(keep(paths, "paths"), edges).select("head", F.col("begin").alias("path_at"), "back", F.col("n").alias("length"))
    at = path.join(places, "head").select("nid", (F.col("path_at") + F.when(F.col("back"), F.col("length") - F.col("begin") - F.col("n")).otherwise(F.col("begin"))).alias("node_at"))
    at = nodes.select("nid", "h", "g").join(at, "nid").select("h", "g", "node_at")
    up_to = lambda *by: F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1])) - F.col("n")
    of_part = parts.join(at, ["h", "g"]).select("h", "g", "part", (F.col("node_at") + up_to("h", "g", "part")).alias("part_at"))
    each = points.select("rid", "id", "n", "h", "g", "part").join(of_part, ["h", "g", "part"]).select("id", "n", (F.col("part_at") + up_to("h", "g", "part", "rid")).alias("at"))
    piece = each.select("*", F.explode(F.expr(f"sequence(at div {window}, (at + n - 1) div {window})")).alias("window"))
    start = F.greatest("at", F.col("window") * window)
    end = F.least(F.col("at") + F.col("n"), (F.col("window") + 1) * window)
    slot = (F.row_number().over(Window.partitionBy("window").orderBy("at")) - 1).cast("bigint")
    return piece.select(F.col("id").alias(id_col), "window", slot.alias("slot"), (start - F.col("at")).alias("start"), (end - F.col("at")).alias("end"))
