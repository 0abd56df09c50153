import zlib
from collections import Counter

import numpy as np
import pytest

from quillspan.llm import sharding


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    at = sharding.hilbert_index(cells, bits)
    assert sorted(at) == list(range(len(cells)))
    walk = cells[np.argsort(at)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_documents(edge_docs, no_docs, edge_rows):
    for shards in (3, 24):
        got = sharding.shard_documents(edge_docs, shards).collect()
        want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in edge_rows)
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
        counts = Counter(r["shard"] for r in got)
        sizes = [counts.get(k, 0) for k in range(shards)]
        assert max(sizes) - min(sizes) <= 1
        for k, n in counts.items():
            assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(n))
    assert sharding.shard_documents(no_docs).collect() == []


def test_shards_prune(spark):
    # Distinct texts: equal ones would lie together, wherever their ids are.
    rows = [(i, f"{i:04d}" + "x" * (i * 37 % 500), f"src{i % 20}", "en") for i in range(2000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), 24).collect()
    for value in (lambda r: r["doc_id"] / 2000, lambda r: np.log2(r["size"] / 12) / np.log2(511 / 12), lambda r: int(r["source"][3:]) / 20):
        spans = [max(v) - min(v) for k in range(24) if (v := [value(r) for r in got if r["shard"] == k])]
        assert np.mean(spans) < 0.75


def test_outliers_and_equal_texts(spark):
    rows = [(i, "x" * (i * 37 % 500) + f" {i}", f"src{i % 20}", "en") for i in range(1500)] + [(10**15, "far", None, None)]
    rows += [(2000 + i, "the same text", f"src{i % 20}", "en") for i in range(100)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), 24).collect()
    # One far id does not crowd the others into one cell.
    spans = [max(v) - min(v) for k in range(24) if (v := [r["doc_id"] for r in got if r["shard"] == k and r["doc_id"] < 1500])]
    assert np.mean(spans) < 0.75 * 1500
    same = sorted((r["shard"], r["slot"]) for r in got if r["doc_id"] in range(2000, 2100))
    per = len(rows) / 24
    assert len({s for s, _ in same}) <= -(-100 // int(per)) + 1
    place = {(r["shard"], r["slot"]): k for k, r in enumerate(sorted(got, key=lambda r: (r["shard"], r["slot"])))}
    at = [place[s] for s in same]
    assert at[-1] - at[0] == 99
