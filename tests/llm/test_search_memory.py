"""The neighbour search of packing holds its block, however large the rest of the table is."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from quern.llm import packing


def batch(block, away, cell, ids, f):
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block, np.int32)), pa.array(np.full(len(ids), away, np.int32)), pa.array(cell.astype(np.int32)), pa.array(ids), pa.array([x.tobytes() for x in f], pa.binary())], names=["block", "away", "cell", "nid", "f"])


def peak(mine, cells, rows, cent, probes):
    """Links of ``mine`` nodes of cell 0, and the most bytes that were held while ``rows`` nodes of each other cell went by."""
    rng = np.random.default_rng(1)
    points = lambda n: rng.integers(0, 9, (n, 16)).astype(np.uint8) + np.uint8(1)

    def batches():
        yield batch(0, 0, np.zeros(mine), np.arange(mine), points(mine))
        for c in range(1, cells):
            yield batch(0, 1, np.full(rows, c), np.arange(rows) + c * 10**6, points(rows))

    tracemalloc.start()
    links = sum(b.num_rows for b in packing.searched(batches(), cent, np.zeros(len(cent), np.int64), probes, 3))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return links, most


def test_search_holds_its_block_only(monkeypatch):
    monkeypatch.setattr(packing, "ROOM", 1 << 14)
    cent = np.random.default_rng(2).random((2000, 16)).astype(np.float32)
    few, many = peak(500, 5, 500, cent, 2000), peak(500, 200, 500, cent, 2000)
    assert few[0] == many[0] == 1500
    assert many[1] < 1.2 * few[1]
    # nor the closeness of all its nodes to all cells, which takes 24 MB here
    cent = np.random.default_rng(3).random((20000, 16)).astype(np.float32)
    assert peak(300, 2, 10, cent, 40)[1] < 12e6


def test_links_over_blocks_are_exact(spark, monkeypatch):
    rng = random.Random(8)
    words = ["w" + str(i) for i in range(80)]
    d = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 40)))) for i in range(600)], "doc_id long, text string")
    monkeypatch.setattr(packing, "REGION", 90)
    monkeypatch.setattr(packing, "SEARCH", 150)
    _, nodes, links, cells = packing.graph(d, k=4, cell=20)
    n, got = nodes.toPandas(), links.toPandas()
    z, ids = n[[f"z{j}" for j in range(packing.DIMS)]].to_numpy(float), n.nid.to_numpy()
    full = ((z[:, None] - z[None]) ** 2).sum(-1)
    np.fill_diagonal(full, np.inf)
    want = {(a, ids[j], full[i, j]) for i, a in enumerate(ids) for j in np.lexsort((ids, full[i]))[:4]}
    assert cells > 20 and set(zip(got.a, got.b, got.d)) == want and len(got) == len(want)
    region = dict(zip(n.nid, n.region))
    assert len(set(region.values())) > 4 and (got.a.map(region) == got.ra).all() and (got.b.map(region) == got.rb).all()
