import random

import brute
import numpy as np
import pytest

from quillspan.llm import near_dedup
from quillspan.llm.graph import components


def test_edges(spark, edge_docs, no_docs, edge_rows):
    got = near_dedup.near_duplicates(edge_docs).collect()
    assert len(got) == len(edge_rows)
    want = brute.near_duplicates([(i, t) for i, t in dict(edge_rows).items() if i is not None])
    for r in got:
        if r["doc_id"] is None:
            assert not r["kept"] and r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert near_dedup.near_duplicates(no_docs).collect() == []
    kept = near_dedup.drop_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 2, 3, 4, 6, 7, None, 10, 11, -3], key=repr)


@pytest.mark.parametrize("change", [0.02, 0.035, 0.05])
def test_families_of_near_copies(spark, change):
    """Groups in which many pairs are near the limit on either side, and chains."""
    rng = random.Random(int(change * 1000))
    from brute import WORDS, prose

    rows, at = [], 0
    for _ in range(4):
        base = prose(rng, 150).split()
        for _ in range(60):
            rows.append((at, " ".join(rng.choice(WORDS) if rng.random() < change else w for w in base)))
            at += 1
    chain = prose(rng, 200).split()
    for k in range(40):
        rows.append((at, " ".join(chain)))
        chain[(k * 5) % 200] = f"new{k}"
        at += 1
    rows += [(at + k, w) for k, w in enumerate(["a b", "a b c", "a b c d e", "a b c d e f", "A B C D E"])]
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near_duplicates(rows)


def test_blocks_smaller_than_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    test_families_of_near_copies(spark, 0.035)


def test_pairs_that_the_estimate_threw_away(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "_estimated", lambda pairs, reps: pairs.limit(0))
    test_families_of_near_copies(spark, 0.035)


def test_small_parts_and_blocks_of_bytes(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HEAD", 3)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 4000)
    test_families_of_near_copies(spark, 0.035)


def test_ids_with_several_texts(spark):
    rng = random.Random(5)
    p, u, v = brute.prose(rng, 60), brute.prose(rng, 60), brute.prose(rng, 60)
    rows = [(1, p), (2, p), (2, u), (3, u + " more"), (4, v), (4, p + " x"), (5, v), (5, v)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, gone_id int, d int")
    left = sorted(map(tuple, near_dedup.drop_near_duplicates(df).select("doc_id", "text").collect()))
    # Of the two texts of 4 one is its document; the other stands alone. Nothing that no other row has is lost.
    assert {(1, p), (2, u)} <= set(left) and (2, p) not in left and (3, u + " more") not in left
    assert {(4, v)} & set(left) and not {(5, v)} & set(left)
    assert near_dedup.drop_near_duplicates(df).columns == df.columns


def test_estimates_and_intersections():
    rng = np.random.default_rng(1)
    for n, common in ((400, 300), (2000, 1200), (60, 50)):
        pool = np.unique(rng.integers(0, 1 << 63, 3 * n, dtype=np.uint64))
        pool = near_dedup._mix(pool)
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:common], pool[n : 2 * n - common]]))
        j = common / (2 * n - common)
        matches = np.array([(near_dedup.registers(a) == near_dedup.registers(b)).sum()])
        assert abs(matches[0] / near_dedup.BUCKETS - j) < 5 * np.sqrt(j * (1 - j) / near_dedup.BUCKETS) + 0.05
        x, y = ((s >> np.uint64(32)).astype(np.uint32) for s in (a, b))
        assert near_dedup.common_counts([np.unique(x)], [np.unique(y)])[0, 0] == common
    assert 0 < near_dedup.collision_rate(np.array([300]), np.array([300]))[0] < 0.002


@pytest.mark.parametrize("in_task", [0, 1 << 24])
def test_components(spark, in_task):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, x) for x in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), in_task).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100)}
    assert components(spark.createDataFrame([], "a long, b long"), in_task).collect() == []
