"""Rank-frequency analysis."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.readers import checkpointed

def ranked(frequencies: DataFrame) -> DataFrame:
    """(term, frequency, rank): ranks from 1 by falling frequency, ties by term.

    Terms are laid out in ranges of (frequency, term), which spreads those of one frequency as far as their letters tell them apart,
    and that layout is checkpointed: a rank is the place in a partition after the terms of all partitions before, of which there is one row each.
    """
    order = F.desc("frequency"), F.asc("term")
    laid = checkpointed(frequencies.select("term", "frequency").repartitionByRange(*order).sortWithinPartitions(*order))
    placed = laid.withColumns({"part": F.spark_partition_id(), "own": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = laid.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # One row for each partition.
    return placed.join(F.broadcast(counts), "part").select("term", "frequency", (F.col("before") + F.col("own") + 1).cast("long").alias("rank"))


def with_expected(ranks: DataFrame) -> DataFrame:
    """Add the theoretical frequency C / rank (C: the largest frequency) and both logarithms."""
    top = ranks.agg(F.max("frequency").alias("c")).withColumn("k", F.lit(1))
    both = ranks.withColumn("k", F.lit(1)).join(F.broadcast(top), "k").drop("k")  # one row
    both = both.withColumn("zipf_expected", F.col("c") / F.col("rank")).drop("c")
    return both.withColumns({"log_rank": F.log10("rank"), "log_frequency": F.log10("frequency")})


def top_terms(frequencies: DataFrame, n: int = 10) -> DataFrame:
    return frequencies.orderBy(F.desc("frequency"), "term").limit(n)


def frequency_of_frequencies(frequencies: DataFrame) -> DataFrame:
    return frequencies.groupBy("frequency").agg(F.count("*").alias("n_terms"))


@dataclass(frozen=True)
class Mandelbrot:
    """frequency = scale / (rank + shift) ** exponent, fitted to the logarithms; ``error`` is the root of the mean squared residual."""

    scale: float
    shift: float
    exponent: float
    error: float
    steps: int


def rank_classes(frequencies: DataFrame) -> DataFrame:
    """(frequency, n, rank): the terms of one frequency as one point, at the middle of their ranks. As many rows as there are frequencies."""
    above = W.orderBy(F.desc("frequency")).rowsBetween(W.unboundedPreceding, -1)
    counted = frequencies.groupBy("frequency").agg(F.count("*").alias("n"))
    return counted.select("frequency", "n", (F.coalesce(F.sum("n").over(above), F.lit(0)) + (F.col("n") + 1) / 2).alias("rank"))


def mandelbrot(classes: DataFrame, tolerance: float = 1e-12, most: int = 200) -> Mandelbrot:
    """Fit of the Zipf-Mandelbrot law to (frequency, n, rank) by damped Gauss-Newton steps, each term with equal weight.

    With u = log(1 + shift) the residual is log(frequency) - c + exponent * log(rank + e**u - 1), so the shift
    stays above -1. Every step is one aggregation: ten sums that make the normal equations, computed for several dampings of the
    step before at once, so that a step that does not help costs no pass. Only these sums reach the driver.
    Needs three frequencies; with fewer the shift is 0, with one the exponent too.
    """
    points = classes.select(F.ln("frequency").alias("y"), F.col("n").cast("double").alias("w"), F.col("rank").cast("double").alias("r")).cache()
    try:
        some = points.agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.max("y").alias("y")).first()
        if not some["n"]:
            return Mandelbrot(0.0, 0.0, 0.0, 0.0, 0)
        free = 3 if some["n"] >= 3 else 2 if some["n"] == 2 else 1
        best = np.array([some["y"], 1.0 if free > 1 else 0.0, 0.0])
        (cost, normal, slope), damping, steps = _sums(points, [best])[0], 1e-3, 1
        while steps < most:
            tried = []
            for factor in (0.1, 1.0, 10.0, 1000.0):
                a = normal[:free, :free]
                step = np.zeros(3)
                step[:free] = np.linalg.solve(a + damping * factor * np.diag(np.maximum(np.diag(a), 1e-12)), -slope[:free])
                tried.append((factor, best + step))
            found = _sums(points, [at for _, at in tried])
            steps += 1
            k = min(range(len(tried)), key=lambda i: found[i][0] if np.isfinite(found[i][0]) else np.inf)
            if not found[k][0] < cost:
                if damping > 1e12:
                    break
                damping *= 1e4
                continue
            gain, moved = cost - found[k][0], np.abs(tried[k][1] - best).max()
            damping, best, (cost, normal, slope) = max(damping * tried[k][0], 1e-15), tried[k][1], found[k]
            if gain <= tolerance * cost and moved <= 1e-9:
                break
        c, a, u = (float(v) for v in best)
        return Mandelbrot(float(np.exp(c)), float(np.expm1(u)), a, float(np.sqrt(cost / some["w"])), steps)
    finally:
        points.unpersist()


def _sums(points: DataFrame, at: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(sum of squares, normal matrix, gradient) of the weighted residuals for each set of parameters, in one aggregation."""
    columns: list[Column] = []
    for k, (c, a, u) in enumerate(at):
        shifted = F.col("r") + float(np.expm1(u))
        residual = F.col("y") - float(c) + float(a) * F.ln(shifted)
        partial = [F.lit(-1.0), F.ln(shifted), float(a * np.exp(u)) / shifted]
        for i, p in enumerate([residual, *partial]):
            for j, q in enumerate([residual, *partial][i:], i):
                columns.append(F.sum(F.col("w") * p * q).alias(f"s{k}_{i}_{j}"))
    row = points.agg(*columns).first()
    out = []
    for k in range(len(at)):
        value = lambda i, j, k=k: row[f"s{k}_{min(i, j)}_{max(i, j)}"]
        m = np.array([[value(i, j) if value(i, j) is not None else np.nan for j in range(4)] for i in range(4)], dtype=float)
        out.append((float(m[0, 0]), m[1:, 1:], m[1:, 0]))
    return out
