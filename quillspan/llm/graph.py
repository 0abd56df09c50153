"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, durable, measured, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    rewired = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rewired.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def _joined(edges: DataFrame) -> DataFrame:
    """(node, component) by union-find in the one task that reads all edges."""
    arrow = pa.schema([("node", pa.int64()), ("component", pa.int64())])

    def run(batches):
        above: dict[int, int] = {}

        def root(x):
            top = x
            while above[top] != top:
                top = above[top]
            while above[x] != top:
                above[x], x = top, above[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                above.setdefault(a, a)
                above.setdefault(b, b)
                x, y = root(a), root(b)
                above[max(x, y)] = min(x, y)
        nodes = list(above)
        for at in range(0, len(nodes), 10_000):
            part = nodes[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], schema=arrow)

    return edges.mapInArrow(run, "node long, component long")


def components(edges: DataFrame, in_task: int = BROADCAST_BYTES) -> DataFrame:
    """(node, component) for every node of ``edges`` (long columns a, b; a <> b).

    The component is the smallest node reachable. Steps alternate until the edge set, compared by
    count and hash sum, is a set of stars; that takes a number of rounds logarithmic in the size of a
    component. Each round is checkpointed and replaces the one before; nothing but the two numbers
    reaches the driver. An edge table of at most ``in_task`` measured bytes is finished by union-find in one
    task instead, with the same result. Edges with a null end are left out; without edges there are no rows.
    The result reads the last round's checkpoint.
    """
    edges = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        if measured(edges) <= in_task:
            return _joined(edges.coalesce(1))
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        now = (seen["n"], seen["h"])
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select("b", "b").distinct().toDF("node", "component"))
        before = now
        after = durable(_small_star(_large_star(edges)))
        release(edges)
        edges = after
