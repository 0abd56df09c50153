"""Whitening of embeddings by a compensated covariance.

Vectors become integers (``quantise``); the fit list holds each distinct integer vector once. Counts and sums
are exact, so the mean is known as a rational number and every entry is centred to a double-double before
anything is multiplied. The outer products of a block of rows are accumulated with error-free transformations: each
centred entry is cut into ``SLICES`` pieces of ``BITS`` bits on a common grid, so a matrix product of two pieces is a
matrix of integers below 2**53, exact in double precision whatever the order of its sums; TwoSum adds it to a high
and a low part. The parts of all tasks are merged, high and low, ``FAN`` at a time until few are left. What is
dropped lies 2**-100 below the largest square.

The d x d matrix that remains goes to the driver. ``numpy.linalg.eigh`` is LAPACK's ``syevd``: reduction to tridiagonal form,
divide and conquer. Its vectors are then polished against the merged matrix in extended precision, so that
components of very small variance are whitened as well as large ones. The covariance of the whitened fit list is
accumulated in the same way, in a pass of its own, to report its distance from the identity.

Rows whose vector is null, or holds null or non-finite entries, are dropped, and so are empty vectors. Entries beyond 2**50 count as 2**50.
Repeated rows count once in the fit and all get results; rows without id get results too. Vectors of different lengths are populations of
their own, with their own means and components. A component without variance (an eigenvalue within ``RANK`` of the
largest; all of them if there is one distinct vector) has rows with a null ``whitened`` and takes no part in ``identity_error``. A ``deviation``
beyond 64 bits is null. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, give_back, prepare, scratch, to_arrow

K = 16
SCALE = 64
OFFSET = 1_000_000
#: Pieces of a centred entry, their bits, and rows of a block: 2 * BITS + log2(ROWS) + 1 bits are within the 53 of a double.
SLICES, BITS, ROWS = 5, 20, 2048
#: Parts that are merged at once.
FAN = 16
#: Share of the largest eigenvalue up to which a component has no variance.
RANK = 1e-14
_MOST = float(1 << 50)
_KINDS = {2: np.int16, 4: np.int32, 8: np.int64}


def _entries(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the usable vectors of a list column, by length."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
    begin = np.cumsum(sizes) - sizes
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        matrix = values[begin[rows][:, None] + np.arange(d)]
        fine = np.isfinite(matrix).all(axis=1)
        if fine.any():
            yield rows[fine], matrix[fine]


def quantise(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, dim, point: the integers floor(SCALE * c) + OFFSET of every usable vector, as bytes that are equal where the integers are."""
    prepare(vectors.sparkSession)
    df = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("e"))
    schema = T.StructType([df.schema["vec_id"], T.StructField("dim", T.IntegerType()), T.StructField("point", T.BinaryType())])
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in _entries(batch.column(1)):
                with np.errstate(over="ignore"):
                    x = np.clip(np.floor(SCALE * matrix), -_MOST, _MOST).astype(np.int64)
                low, high = x.min(axis=1), x.max(axis=1)
                width = np.where((low >= -(1 << 15)) & (high < 1 << 15), 2, np.where((low >= -(1 << 31)) & (high < 1 << 31), 4, 8))
                for w in np.unique(width).tolist():
                    part = np.flatnonzero(width == w)
                    points = [bytes([w]) + p.tobytes() for p in x[part].astype(f"<i{w}")]
                    ids = batch.column(0).take(pa.array(rows[part]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([matrix.shape[1]] * len(part), pa.int32()), pa.array(points, pa.binary())], schema=arrow)
        give_back()

    return df.mapInArrow(run, schema)


def _points(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, rows, integers) of a batch of points, at most ``ROWS`` rows at a time."""
    dims = batch.column(batch.schema.get_field_index("dim")).to_numpy(zero_copy_only=False)
    raw = batch.column(batch.schema.get_field_index("point")).to_pylist()
    widths = np.array([p[0] for p in raw], dtype=np.int64)
    for d in np.unique(dims).tolist():
        for w, kind in _KINDS.items():
            rows = np.flatnonzero((dims == d) & (widths == w))
            for at in range(0, len(rows), ROWS):
                some = rows[at : at + ROWS]
                yield d, some, np.frombuffer(b"".join(raw[r][1:] for r in some), dtype=kind).reshape(-1, d).astype(np.int64) + OFFSET


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b and its rounding error; their sum is exact."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


class Parts:
    """A matrix as the sum of a high and a low part."""

    def __init__(self, high: np.ndarray, low: np.ndarray):
        self.high, self.low = high, low

    def add(self, x: np.ndarray, low: np.ndarray | float = 0.0) -> None:
        s, e = two_sum(self.high, x)
        self.high, self.low = two_sum(s, e + (self.low + low))

    def add_products(self, high: np.ndarray, low: np.ndarray | float = 0.0) -> None:
        """Add the outer products of the rows of ``high + low``, summed over the rows."""
        most = float(np.abs(high).max(initial=0.0))
        if most == 0.0:
            return
        top = math.frexp(most)[1]
        pieces, rest = [], high
        for k in range(1, SLICES + 1):
            grid = top - BITS * k
            pieces.append(np.rint(np.ldexp(rest, -grid)))
            rest = rest - np.ldexp(pieces[-1], grid)
            if k == 2:
                rest = rest + low
        for i in range(SLICES):
            for j in range(i, SLICES - i):
                exact = pieces[i].T @ pieces[j]
                self.add(np.ldexp(exact if i == j else exact + exact.T, 2 * top - BITS * (i + j + 2)))


@dataclass
class Population:
    """Count, exact sums and mean (high and low) of the distinct vectors of one length."""

    n: int
    sums: list[int]
    mean: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Population:
        means = [Fraction(s, n) for s in sums]
        mean = [float(m) for m in means]
        return cls(n, sums, np.array(mean), np.array([float(m - Fraction(h)) for m, h in zip(means, mean)]))

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high, low = two_sum(x.astype(np.float64), -self.mean)
        return two_sum(high, low - self.rest)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S)**2, exact; None beyond 64 bits."""
        most = max(abs(int(v)) for v in (x.min(), x.max()))
        far = self.n * most + max(map(abs, self.sums))
        if far * far * x.shape[1] < 1 << 63:
            d = self.n * x - np.array(self.sums, dtype=np.int64)
            return np.einsum("ij,ij->i", d, d).tolist()
        near, shift = np.abs(x - np.rint(self.mean).astype(np.int64)), np.rint(self.mean).astype(np.int64)
        rest = [s - self.n * int(m) for s, m in zip(self.sums, shift)]
        far = self.n * int(near.max()) + max(map(abs, rest))
        if far * far * x.shape[1] < 1 << 63:  # the same differences, taken from the nearest integers of the mean
            d = self.n * (x - shift) - np.array(rest, dtype=np.int64)
            return np.einsum("ij,ij->i", d, d).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def populations(fit: DataFrame) -> dict[int, Population]:
    """The population of each vector length; one number for each length and dimension reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        for batch in batches:
            for d, rows, x in _points(batch):
                high, low = (x >> 26).sum(axis=0).tolist(), (x & ((1 << 26) - 1)).sum(axis=0).tolist()
                part = [(h << 26) + v for h, v in zip(high, low)] + [len(rows)]
                sums[d] = [a + b for a, b in zip(sums.get(d, [0] * (d + 1)), part)]
        for d, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * (d + 1), pa.int32()), pa.array(range(d + 1), pa.int32()), pa.array(map(Decimal, part), pa.decimal128(38, 0))], names=["dim", "place", "s"])
        give_back()

    rows = fit.mapInArrow(run, "dim int, place int, s decimal(38,0)").groupBy("dim", "place").agg(F.sum("s").alias("s")).collect()
    found: dict[int, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["dim"], r["place"])):
        found.setdefault(r["dim"], []).append(int(r["s"]))
    return {d: Population.of(s[-1], s[:-1]) for d, s in found.items()}


_PARTS = "dim int, part int, high binary, low binary"


def _products(fit: DataFrame, centred) -> dict[int, Parts]:
    """Sums of outer products of ``centred(dim, integers)`` - high and low - by length, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, Parts] = {}
        for batch in batches:
            for d, _, x in _points(batch):
                high, low = centred(d, x)
                if d not in sums:
                    sums[d] = Parts(np.zeros((high.shape[1],) * 2), np.zeros((high.shape[1],) * 2))
                sums[d].add_products(high, low)
        part = TaskContext.get().partitionId()
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([part], pa.int32()), pa.array([s.high.tobytes()], pa.binary()), pa.array([s.low.tobytes()], pa.binary())], names=["dim", "part", "high", "low"])
        give_back()

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = _merged(rows.sort_values("part")[["high", "low"]].itertuples(index=False))
        return pd.DataFrame({"dim": [key[0]], "part": [key[1]], "high": [total.high.tobytes()], "low": [total.low.tobytes()]})

    parts = fit.mapInArrow(run, _PARTS)
    left = fit._jdf.queryExecution().analyzed().rdd().getNumPartitions()
    while left > FAN:
        parts = parts.groupBy("dim", F.floor(F.col("part") / FAN).cast("int").alias("group")).applyInPandas(merge, _PARTS)
        left = -(-left // FAN)
    found: dict[int, list] = {}
    for r in sorted(parts.collect(), key=lambda r: (r["dim"], r["part"])):
        found.setdefault(r["dim"], []).append((r["high"], r["low"]))
    return {d: _merged(rows) for d, rows in found.items()}


def _merged(rows) -> Parts:
    total: Parts | None = None
    for high, low in rows:
        high, low = np.frombuffer(high), np.frombuffer(low)
        if total is None:
            total = Parts(high, low)
        else:
            total.add(high, low)
    side = math.isqrt(len(total.high))
    return Parts(total.high.reshape(side, side), total.low.reshape(side, side))


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix in extended precision.

    In the basis of the double-precision vectors, made orthonormal to extended precision, the matrix is diagonal but for rounding;
    a few sweeps of plane rotations remove that, relative to each pair of values.
    """
    x = np.linalg.eigh(v.astype(np.float64))[1].astype(np.longdouble)
    for _ in range(2):
        x = x @ (3 * np.eye(len(v), dtype=np.longdouble) - x.T @ x) / 2
    s = x.T @ v @ x
    eps = np.finfo(np.longdouble).eps
    least = RANK * np.abs(np.diag(s)).max()
    for _ in range(8):
        turned = False
        for p in range(len(v) - 1):
            for q in range(p + 1, len(v)):
                if abs(s[p, q]) > eps * max(np.sqrt(abs(s[p, p] * s[q, q])), least):
                    turned = True
                    half = (s[q, q] - s[p, p]) / (2 * s[p, q])
                    t = (1 if half >= 0 else -1) / (abs(half) + np.sqrt(half * half + 1))
                    c = 1 / np.sqrt(t * t + 1)
                    turn = np.array([[c, t * c], [-t * c, c]], dtype=np.longdouble)
                    s[:, [p, q]] = s[:, [p, q]] @ turn
                    s[[p, q]] = turn.T @ s[[p, q]]
                    x[:, [p, q]] = x[:, [p, q]] @ turn
        if not turned:
            break
    order = np.argsort(-np.diag(s), kind="stable")
    return np.diag(s)[order], x[:, order]


@dataclass
class Model:
    """What whitens the vectors of one length."""

    population: Population
    scale: np.ndarray  # dimensions x components with variance: eigenvectors over the roots of their values
    components: int  # with and without variance
    explained: list[float]
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        high, low = self.population.centred(x)
        return high @ self.scale + low @ self.scale


def fit(points: DataFrame, k: int = K) -> dict[int, Model]:
    """The model of each vector length, fitted on the distinct points."""
    spark = points.sparkSession
    with scratch(spark, collect=False):
        distinct = durable(points.select("dim", "point").distinct())
        known = populations(distinct)
        models = {}
        for d, s in _products(distinct, lambda d, x: known[d].centred(x)).items():
            p = known[d]
            v = (s.high.astype(np.longdouble) + s.low.astype(np.longdouble)) / p.n
            e, x = eigen((v + v.T) / 2)
            real = int(np.count_nonzero(e[:k] > RANK * max(e[0], 0)))
            total = np.trace(v)
            models[d] = Model(p, (x[:, :real] / np.sqrt(e[:real])).astype(np.float64), min(k, d), [float(max(a, 0) / total) if total > 0 else 0.0 for a in e[: min(k, d)]])
        for d, s in _products(distinct, lambda d, x: (models[d].whitened(x), 0.0)).items():
            off = (s.high + s.low) / known[d].n - np.eye(len(s.high))
            models[d].identity_error = float(np.abs(off).max(initial=0.0))
    return models


def whiten(points: DataFrame, models: dict[int, Model]) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every point."""
    result = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = T.StructType([points.schema["vec_id"], *T._parse_datatype_string(result)])
    arrow = to_arrow(schema)
    sent = points.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, x in _points(batch):
                m = sent.value[d]
                k, size = m.components, len(rows)
                whitened = np.full((size, k), np.nan)
                whitened[:, : m.scale.shape[1]] = m.whitened(x)
                many = np.repeat(np.arange(size), k)
                columns = [
                    batch.column(0).take(pa.array(rows[many])), np.tile(np.arange(1, k + 1), size), np.full(size * k, m.population.n), pa.array(m.population.deviations(x), pa.int64()).take(pa.array(many)),
                    pa.array(whitened.ravel(), mask=np.isnan(whitened.ravel())), np.tile(m.explained, size), np.full(size * k, m.identity_error),
                ]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
        give_back()

    return points.mapInArrow(run, schema)
