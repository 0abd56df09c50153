import hashlib

import numpy as np
import pytest
from pyspark.sql import types as T

from quillspan.operators import zipf
from quillspan.sources.schemas import PAGES
from quillspan.streaming import ingest
from quillspan.streaming.recrawl import PageStore, start_recrawl

SCHEMA = T.StructType([*PAGES.fields, T.StructField("crawled_at", T.LongType())])


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def now(store):
    return sorted((r["url"], r["html"], r["version"], r["crawled_at"]) for r in store.reload().current().collect())


def test_versions(spark, tmp_path):
    s = PageStore(spark, str(tmp_path / "s"), SCHEMA)
    assert now(s) == []
    first = [(1, "http://a/", "one", 10), (2, "http://A/#x", "older", 9), (3, "http://b", None, 10), (4, None, "lost", 10), (5, "http://c", "c", 10)]
    assert s.upsert(rows(spark, first)) == {"seen": 5, "no_url": 1, "pages": 3, "new": 3, "changed": 0, "unchanged": 0, "repeated": 1, "late": 0}
    second = [(1, "http://a/", "two", 20), (3, "http://b", "", 20), (5, "http://c", "c", 20), (6, "http://d", "d", 20)]
    assert s.upsert(rows(spark, second)) == {"seen": 4, "no_url": 0, "pages": 4, "new": 1, "changed": 2, "unchanged": 1, "repeated": 0, "late": 0}
    want = [("http://a/", "two", 2, 20), ("http://b", "", 2, 20), ("http://c", "c", 1, 10), ("http://d", "d", 1, 20)]
    assert now(s) == want
    for replay in (first, second, first + second, []):  # whatever comes again, nothing changes
        before = s.version
        assert s.upsert(rows(spark, replay))["changed"] == 0 and now(s) == want and s.version == before
    assert s.history().count() == 6
    between = [(5, "http://c", "late", 15), (1, "http://a/", "late", 20)]
    assert s.upsert(rows(spark, between))["late"] == 2 and now(s) == want  # c was crawled again at 20, unchanged
    s.compact()
    assert s.upsert(rows(spark, between))["late"] == 2
    assert now(s) == want and s.history().count() == 6 and len(s.state["parts"]) == 2
    assert s.upsert(rows(spark, [(1, "http://a/", "three", 30)]))["changed"] == 1
    s.compact(keep_history=False)
    s.vacuum()
    assert now(s) == [("http://a/", "three", 3, 30), *want[1:]] and s.history().count() == 4
    assert s.reload().current().first()["content_hash"] is not None
    assert {bytes(r["content_hash"]) for r in s.current().where("url = 'http://c'").collect()} == {hashlib.sha256(b"c").digest()}


def test_stream_of_two_landings(spark, tmp_path):
    landing, store = str(tmp_path / "in"), str(tmp_path / "s")
    counted = []
    run = lambda checkpoint, files=None: start_recrawl(spark, landing, store, str(tmp_path / checkpoint), SCHEMA, ("page_id",), files, counted).awaitTermination(120)
    pages = [(k, f"http://x/{k % 30}", f"text {k}", 1) for k in range(40)]
    rows(spark, pages).repartition(3).write.mode("append").parquet(landing)
    run("a")
    rows(spark, [(k, u, h if k % 3 else h + " changed", 2) for k, u, h, _ in pages]).write.mode("append").parquet(landing)
    run("a")
    run("a")
    want = sorted((u, f"text {k}" + " changed" * (k % 3 == 0), 1 + (k % 3 == 0), 1 + (k % 3 == 0)) for k, u, _, _ in pages[10:])
    s = PageStore(spark, store, SCHEMA, ("page_id",))
    assert now(s) == want and [(c["seen"], c["new"], c["changed"]) for c in counted] == [(40, 30, 0), (40, 0, 10)]
    run("b", 1)  # a lost checkpoint: all files again, one by one
    assert now(s) == want


def test_ingest_counts_what_it_writes(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/p", "x"), (2, "http://a/p/", "y"), (3, "http://b", "z"), (4, None, "n"), (5, None, "n")], PAGES)
    store = str(tmp_path / "store")
    assert ingest.append_new(pages, store, ["page_id"]) == {"seen": 5, "no_url": 2, "repeated": 1, "known": 0, "added": 2}
    # The path's last slash does not tell URLs apart.
    again = ingest.append_new(pages.unionAll(spark.createDataFrame([(9, "http://c", "c"), (10, "http://c", "c")], PAGES)), store, ["page_id"])
    assert again["added"] == 1 and again["repeated"] == 2 and again["no_url"] == 2 and again["seen"] == 7
    assert again["known"] == spark.read.parquet(store).count() - 1
    assert ingest.append_new(pages.limit(0), store, ["page_id"]) == {"seen": 0, "no_url": 0, "repeated": 0, "known": 0, "added": 0}


def plain_fit(f, n, r):
    """Variable projection on a fine grid of shifts, refined: the least squares of each shift are a line."""
    y, w, r = np.log(f), np.asarray(n, float), np.asarray(r, float)

    def cost(b):
        x = np.log(r + b)
        mx, my = (w * x).sum() / w.sum(), (w * y).sum() / w.sum()
        slope = (w * (x - mx) * (y - my)).sum() / (w * (x - mx) ** 2).sum()
        return (w * (y - my - slope * (x - mx)) ** 2).sum(), -slope, my - slope * mx

    low, high = -0.9999, 1e4
    grid = np.expm1(np.linspace(np.log1p(low), np.log1p(high), 4000))
    for _ in range(12):
        k = int(np.argmin([cost(b)[0] for b in grid]))
        grid = np.linspace(grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)], 60)
    b = grid[int(np.argmin([cost(b)[0] for b in grid]))]
    total, exponent, c = cost(b)
    return np.exp(c), b, exponent, np.sqrt(total / w.sum())


def test_mandelbrot_equals_a_plain_solver(spark):
    rng = np.random.default_rng(1)
    ranks = np.arange(1, 3001)
    frequency = np.maximum(1, (50_000 / (ranks + 7.5) ** 1.2 * np.exp(rng.normal(size=3000) * 0.05)).astype(int))
    terms = spark.createDataFrame([(f"t{k}", int(f)) for k, f in enumerate(frequency)], "term string, frequency long")
    classes = zipf.rank_classes(terms)
    points = sorted(classes.collect(), key=lambda r: r["rank"])
    assert sum(p["n"] for p in points) == 3000 and points[0]["rank"] == (points[0]["n"] + 1) / 2
    got = zipf.mandelbrot(classes)
    want = plain_fit([p["frequency"] for p in points], [p["n"] for p in points], [p["rank"] for p in points])
    assert (got.scale, got.shift, got.exponent, got.error) == pytest.approx(want, rel=1e-4)
    assert got.steps < 60


def test_mandelbrot_of_few_frequencies(spark):
    table = lambda *f: zipf.rank_classes(spark.createDataFrame([(f"t{k}", v) for k, v in enumerate(f)], "term string, frequency long"))
    assert zipf.mandelbrot(table(5).where("false")) == zipf.Mandelbrot(0.0, 0.0, 0.0, 0.0, 0)
    one = zipf.mandelbrot(table(5, 5, 5))
    assert (one.scale, one.shift, one.exponent) == pytest.approx((5.0, 0.0, 0.0), abs=1e-6)
    two = zipf.mandelbrot(table(8, 4))
    assert (two.scale, two.shift, two.exponent) == pytest.approx((8.0, 0.0, 1.0), abs=1e-6)


def test_what_grows_is_not_broadcast(spark, tmp_path):
    s = PageStore(spark, str(tmp_path / "s"), SCHEMA)
    s.upsert(rows(spark, [(1, "http://a/", "one", 10), (2, "http://b/", "b", 10)]))
    s.upsert(rows(spark, [(1, "http://a/", "two", 20)]))
    plan = s._current()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan  # before: what was superseded went through the driver with every batch
    assert now(s) == [("http://a/", "two", 2, 20), ("http://b/", "b", 1, 10)]
