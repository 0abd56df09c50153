import math
from fractions import Fraction

import numpy as np
import pytest

from quillspan.llm import whitening as H


def exact(rows):
    """(x of each usable row, n, S, exact covariance as fractions) for vectors of one length."""
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted(set(map(tuple, x.values())))
    n, d = len(fit), len(fit[0])
    s = [sum(p[k] for p in fit) for k in range(d)]
    centred = [[Fraction(p[k]) - Fraction(s[k], n) for k in range(d)] for p in fit]
    v = [[sum(c[a] * c[b] for c in centred) / n for b in range(d)] for a in range(d)]
    return x, n, s, v


def run(spark, rows, parts=3, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(parts)
    points = H.quantise(df, "vec_id", "embedding")
    return H.whiten(points, H.fit(points))


def check(found, rows, components, null=0):
    x, n, s, v = exact(rows)
    table = {}
    for r in found:
        table.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(table) == set(x)
    matrix = np.array([[float(a) for a in row] for row in v])
    want = np.linalg.eigvalsh(matrix)[::-1]
    for i, point in x.items():
        assert set(table[i]) == set(range(1, components + 1))
        for c, r in table[i].items():
            assert r["n"] == n and r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(point, s))
            assert r["identity_error"] <= 1e-9
            assert math.isclose(r["explained"], max(want[c - 1], 0) / max(np.trace(matrix), 1e-300), rel_tol=1e-9, abs_tol=1e-15)
            assert (r["whitened"] is None) == (c > components - null)
    # whitened entries are projections: their gram matrix is that of the centred rows in the metric of the components
    whole = components - null
    ids = sorted(x)
    y = np.array([[table[i][c]["whitened"] for c in range(1, whole + 1)] for i in ids])
    centred = np.array([[float(Fraction(a) - Fraction(b, n)) for a, b in zip(x[i], s)] for i in ids])
    e, w = np.linalg.eigh(matrix)
    e, w = e[::-1][:whole], w[:, ::-1][:, :whole]
    assert np.allclose(np.abs(y), np.abs(centred @ w / np.sqrt(e)), rtol=1e-7, atol=1e-7)
    return y


def test_equals_exact_fractions(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.normal(size=20) * np.linspace(0.2, 3, 20) + 5).tolist()) for k in range(150)]
    rows += [(500 + k, rows[0][1]) for k in range(60)]
    check(run(spark, rows).collect(), rows, 16)


def test_many_tasks_are_merged_in_levels(spark, monkeypatch):
    monkeypatch.setattr(H, "FAN", 2)
    monkeypatch.setattr(H, "ROWS", 3)
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=6) * 40).tolist()) for k in range(90)]
    check(run(spark, rows, 7).collect(), rows, 6)


def test_small_variance_beside_large(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [1e4 * a, 1e4 * a + b / 64, b]) for k, (a, b) in enumerate(zip(rng.normal(size=80).tolist(), rng.normal(size=80).tolist()))]
    found = run(spark, rows, kind="double").collect()
    assert {r["component"] for r in found} == {1, 2, 3} and max(r["identity_error"] for r in found) <= 1e-4
    assert all(r["whitened"] is not None for r in found)


def test_without_variance(spark):
    rows = [(1, [1.0, 2.0, 2.0]), (2, [2.0, 2.0, 2.0]), (3, [4.0, 2.0, 2.0]), (4, [4.0, 2.0, 2.0])]
    check(run(spark, rows).collect(), rows, 3, null=2)
    one = run(spark, rows[:1]).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, 0.0, 0.0)] * 3


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.1, -0.2]), (2, [0.5, 0.25]), (2, [0.5, 0.25]), (None, [-1.0, 3.0]), (9, [-0.0, 0.01])]
    bad = [(3, None), (4, [0.1, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [])]
    found = run(spark, good + bad).collect()
    assert sorted({(r["vec_id"], r["component"]) for r in found}, key=repr) == sorted([(i, c) for i in (1, 2, 9, None) for c in (1, 2)], key=repr) and len(found) == 10
    assert {r["n"] for r in found} == {4} and max(r["identity_error"] for r in found) < 1e-9
    assert run(spark, bad).collect() == []
    other = run(spark, [*good, (20, [1.0, 2.0, 3.0]), (21, [1.5, 2.0, 3.0])]).collect()  # lengths do not mix
    assert sorted((r["vec_id"], r["component"], r["n"]) for r in other if r["vec_id"] in (20, 21)) == [(i, c, 2) for i in (20, 21) for c in (1, 2, 3)]
    assert {r["n"] for r in other if r["vec_id"] not in (20, 21)} == {4}


def test_large_entries(spark):
    rows = [(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 2.0**40])]
    found = run(spark, rows, kind="double").collect()
    assert len(found) == 6 and {r["deviation"] for r in found if r["vec_id"] == 1} == {None}


@pytest.mark.parametrize("spread", [0, 30])
def test_products_keep_what_doubles_lose(spread):
    """Sums that cancel: the parts agree with exact arithmetic to 100 bits of the largest square."""
    rng = np.random.default_rng(8)
    a = rng.normal(size=(300, 4)) * 2.0 ** rng.integers(-spread, 1, size=(300, 4))
    low = a * 2.0**-55
    a, low = H.two_sum(a, low)
    total = H.Parts(np.zeros((4, 4)), np.zeros((4, 4)))
    for at in range(0, 300, 100):
        total.add_products(a[at : at + 100], low[at : at + 100])
    largest = Fraction(float(np.abs(a).max())) ** 2
    for i in range(4):
        for j in range(4):
            want = sum((Fraction(float(a[r, i])) + Fraction(float(low[r, i]))) * (Fraction(float(a[r, j])) + Fraction(float(low[r, j]))) for r in range(300))
            have = Fraction(float(total.high[i, j])) + Fraction(float(total.low[i, j]))
            assert abs(have - want) <= 300 * largest / 2**96


def test_eigen_of_clustered_values():
    rng = np.random.default_rng(9)
    q = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    v = (q * np.array([5, 5, 5, 3, 2, 2, 1, 1e-6, 1e-9, 1e-12, 0, 0])) @ q.T
    v = ((v + v.T) / 2).astype(np.longdouble)
    e, x = H.eigen(v)
    assert np.abs(x.T @ x - np.eye(12)).max() < 1e-15 and np.abs(v @ x - x * e).max() < 1e-15
