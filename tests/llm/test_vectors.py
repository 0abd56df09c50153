import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import topk_search, vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, raw string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)


def families(seed, n=300, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    rows = [(k, (centres[k % 8] + rng.normal(size=dim) * (0.05 + 0.1 * (k % 5))).astype(np.float32).tolist()) for k in range(n)]
    rows += [(n + k, rng.normal(size=dim).astype(np.float32).tolist()) for k in range(60)]
    rows += [(1000 + k, rows[0][1]) for k in range(5)]
    return rows


ODD = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [1.0, None] + [0.5] * 14), (2004, [float("nan")] * 16), (2005, [float("inf")] + [1.0] * 15), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (2008, [3e38] * 16)]


@pytest.mark.parametrize("block", [8192, 37])
def test_threshold_links(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rows = families(1) + ODD
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.threshold_links(vector_dedup.parse_vectors(table(spark, rows))).collect()}
    assert got == brute.cosine_links(rows)


def test_threshold_links_edges(spark):
    empty = vector_dedup.threshold_links(vector_dedup.parse_vectors(table(spark, []))).collect()
    assert empty == []
    same = table(spark, [(7, [1.0, 0.0]), (7, [1.0, 0.0]), (3, [1.0, 0.0])])
    got = sorted(map(tuple, vector_dedup.threshold_links(vector_dedup.parse_vectors(same)).collect()))
    assert got == [(3, 2, 3, True), (7, 2, 3, False), (7, 2, 3, False)]


def test_cover_tree_bounds():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = vector_dedup.CoverTree(x, np.ones(400))
    for level, (node, centre, radius) in enumerate(zip(tree.node_of, tree.centre, tree.radius)):
        d = np.linalg.norm(x - x[centre[node]], axis=1)
        assert (d <= radius[node] + 1e-9).all()
        if level:
            assert set(tree.centre[level - 1]) <= set(centre)
    want = x @ x.T >= 0.9
    found = vector_dedup.Join(tree, tree)
    assert (found.counts("a") == want.sum(axis=1)).all()


def brute_top(rows, every, k=5):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            good.setdefault(i, [int(x) for x in np.floor(256 * np.array(np.float32(v), dtype=float))])
    out = []
    for q, a in good.items():
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in good.items() if j != q and len(a) == len(b))[:k]
            out += [(q, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("rows", [families(4), ODD[:8] + families(5, 40), [(0, [1.0, 2.0]), (50, [3.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0])], [(0, [1.0])], []])
def test_top_k(spark, monkeypatch, rows):
    monkeypatch.setattr(topk_search, "ROWS", 64)
    monkeypatch.setattr(topk_search, "QUERIES", 4)
    df = topk_search.quantise(table(spark, rows), "vec_id", "embedding")
    from pyspark.sql import functions as F

    got = sorted(map(tuple, topk_search.top_k(df, F.col("vec_id") % 10 == 0).collect()))
    assert got == brute_top(rows, 10)


def test_large_components():
    q = np.floor(256 * np.array([[1e9, 2.0]]))
    x = np.floor(256 * np.array([[1e9, 1.0], [1e9, 3.0], [-1e9, 0.0]]))
    got = topk_search.search_block(q, np.array([0]), x, np.array([5, 6, 7]), 2)
    exact = lambda a, b: sum(int(u) * int(v) for u, v in zip(a, b))
    top = (1 << 63) - 1
    assert [(i, j) for i, j, _ in got] == [(0, 6), (0, 5)] and got[0][2] == min(top, exact(q[0], x[1]))


def test_scores_beyond_64_bits_keep_their_order(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "ROWS", 1)
    rows = [(0, [1e18, 1.0])] + [(k, [sign * (1e18 + k * 1e15), 0.0]) for k, sign in ((1, 1), (2, 1), (3, 1), (4, -1), (5, -1))] + [(6, [0.0, 1.0])]
    vectors = topk_search.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = topk_search.top_k(vectors, F.col("vec_id") == 0, 6).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [3, 2, 1, 6, 4, 5]
    assert [topk_search.beyond(s) for s in (5, -5)] == ["", ""]
    values = [-(10**30), -(10**25), -(1 << 63) - 1]
    assert sorted(values, key=topk_search.beyond) == values
