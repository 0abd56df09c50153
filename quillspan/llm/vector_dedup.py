"""Near-duplicate vectors: exact threshold pairs by dual traversal of cover trees.

Equal vectors collapse to one with a multiplicity. The rest are laid out by their nearest pivot
(a bounded sample; it only decides which rows sit together) and cut into blocks of bounded size,
so a family of any size spreads over as many blocks as it needs. Each block gets a cover tree:
nested nets whose radii halve from level to level, each node with the true distance to its
farthest point. Two trees are traversed together, level by level. With t the distance that
belongs to the cosine limit, a pair of nodes whose centres are farther apart than both covering
radii plus t is dropped; a pair whose farthest points are within t counts as a whole, without
naming its links; only what is left at the leaves is compared point by point in double precision.
A task returns link counts and a spanning set of edges, never a list of all pairs.

Vectors that are null or empty, zero, or hold null or non-finite components link with nothing.
Vectors of different lengths do not link. Repeated rows are vectors of their own. An empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, global_rank
from .graph import components

COSINE = 0.9
#: Most rows and bytes (of doubles) of a block. Two blocks and their distances must fit a worker.
BLOCK = 8192
BLOCK_BYTES = 16 << 20
#: Vectors sampled as pivots for the layout.
PIVOTS = 128
#: Node pairs expanded at once.
CHUNK = 1 << 20
#: Margin for rounding in bounds; pairs within it are compared exactly.
EPS = 1e-6
#: Margin for products in single precision.
COARSE = 1e-5
LEVELS = 7
#: Radius of the first net below the root: near the link distance, so its nodes tell apart what may link.
TOP_RADIUS = 0.5


def parse_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, dim (0 if the vector takes no part), digest h1, h2, raw (components as bytes, see ``compact``)."""
    arrow = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("raw", pa.binary())])

    def run(batches):
        import xxhash

        for batch in batches:
            dims, h1, h2, raws = [], [], [], []
            for value in batch.column(1):
                x = np.empty(0)
                if value.is_valid and len(value) and value.values.null_count == 0:
                    x = value.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                    if not np.isfinite(x).all() or not x.any():
                        x = np.empty(0)
                raw = compact(x)
                digest = np.frombuffer(xxhash.xxh3_128_digest(raw), dtype=np.int64)
                dims.append(len(x))
                h1.append(int(digest[0]))
                h2.append(int(digest[1]))
                raws.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(v, f.type) for v, f in zip((dims, h1, h2, raws), list(arrow)[1:]))], schema=arrow)

    return df.select(F.col(id_col).cast("long").alias("vec_id"), vec_col).mapInArrow(run, "vec_id long, dim int, h1 long, h2 long, raw binary")


def compact(x: np.ndarray) -> bytes:
    """Components as single-precision bytes where that loses nothing, else as doubles."""
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    return small.tobytes() if (small == x).all() else x.tobytes()


def components_of(raw: bytes, n: int) -> np.ndarray:
    """The n components that ``compact`` wrote."""
    return np.frombuffer(raw, dtype=np.float64 if len(raw) == 8 * n else np.float32).astype(np.float64)


def stack(raws: list[bytes], dim: int) -> np.ndarray:
    return np.stack([components_of(raw, dim) for raw in raws])


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distance(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos))


def net(x: np.ndarray, radius: float) -> np.ndarray:
    """Greedy net: for each row the row number of its centre, within ``radius``; the first row is a centre."""
    owner = np.full(len(x), -1, dtype=np.int64)
    limit = 1 - radius * radius / 2
    centres: list[int] = []
    for at in range(0, len(x), 1024):
        rows = np.arange(at, min(at + 1024, len(x)))
        if centres:
            cos = x[rows] @ x[centres].T
            near = np.flatnonzero(cos.max(axis=1) >= limit)
            owner[rows[near]] = np.array(centres)[cos[near].argmax(axis=1)]
        rest = rows[owner[rows] < 0]
        if len(rest):
            cos = x[rest] @ x[rest].T
            free = np.ones(len(rest), dtype=bool)
            for i in range(len(rest)):
                if free[i]:
                    took = free & (cos[i] >= limit)
                    took[i] = True
                    owner[rest[took]] = rest[i]
                    free &= ~took
                    centres.append(int(rest[i]))
    return owner


class CoverTree:
    """Nested nets over unit vectors. Level 0 is one root; the last level has every point by itself."""

    def __init__(self, x: np.ndarray, weight: np.ndarray):
        self.x, self.x32 = x, x.astype(np.float32)
        n = len(x)
        owners = [np.zeros(n, dtype=np.int64)]
        radius = TOP_RADIUS
        for _ in range(LEVELS - 2):
            before, own = owners[-1], np.arange(n)
            order = np.argsort(before, kind="stable")
            cuts = np.flatnonzero(np.diff(before[order])) + 1
            for group in np.split(order, cuts):
                if len(group) > 1:
                    centre = before[group[0]]
                    group = np.concatenate([[centre], group[group != centre]])
                    own[group] = group[net(self.x32[group], radius)]
            owners.append(own)
            radius /= 2
        owners.append(np.arange(n))
        self.node_of, self.centre, self.radius, self.weight, self.children = [], [], [], [], []
        for own in owners:
            centre, node = np.unique(own, return_inverse=True)
            reach = np.zeros(len(centre))
            np.maximum.at(reach, node, _distance(np.einsum("ij,ij->i", x, x[own])))
            reach[np.bincount(node, minlength=len(centre)) == 1] = 0.0
            self.node_of.append(node)
            self.centre.append(centre)
            self.radius.append(reach)
            self.weight.append(np.bincount(node, weights=weight, minlength=len(centre)).astype(np.int64))
        for upper, lower, centre in zip(self.node_of, self.node_of[1:], self.centre[1:]):
            parent = upper[centre]
            order = np.argsort(parent, kind="stable")
            starts = np.searchsorted(parent[order], np.arange(upper.max() + 2))
            self.children.append((order, starts))


class Join:
    """Dual traversal of two trees (or one with itself): counts per point and edges that span the links."""

    def __init__(self, a: CoverTree, b: CoverTree, cosine: float = COSINE):
        self.a, self.b, self.same, self.cosine = a, b, a is b, cosine
        self.t = float(np.sqrt(2 - 2 * cosine))
        self.count_a = [np.zeros(len(c), dtype=np.int64) for c in a.centre]
        self.count_b = [np.zeros(len(c), dtype=np.int64) for c in b.centre]
        self.whole_a = [np.zeros(len(c), dtype=bool) for c in a.centre]
        self.whole_b = [np.zeros(len(c), dtype=bool) for c in b.centre]
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self._visit(0, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))

    def _visit(self, level: int, p: np.ndarray, q: np.ndarray) -> None:
        a, b = self.a, self.b
        ca, cb = a.centre[level][p], b.centre[level][q]
        cos = np.einsum("ij,ij->i", a.x[ca], b.x[cb])
        self._settle(level, p, q, cos)

    def _settle(self, level: int, p: np.ndarray, q: np.ndarray, cos: np.ndarray) -> None:
        a, b = self.a, self.b
        last = level == len(a.centre) - 1
        reach = a.radius[level][p] + b.radius[level][q]
        if last:
            whole = cos >= self.cosine
            more = np.zeros(len(p), dtype=bool)
        else:
            d = _distance(cos)
            whole = d + reach <= self.t - EPS
            more = ~whole & (d <= reach + self.t + EPS)
        if whole.any():
            u, v = p[whole], q[whole]
            np.add.at(self.count_a[level], u, b.weight[level][v])
            if not self.same:
                np.add.at(self.count_b[level], v, a.weight[level][u])
            self.whole_a[level][u] = True
            self.whole_b[level][v] = True
            self.edges.append((a.centre[level][u], b.centre[level][v]))
        if more.any():
            self._expand(level, p[more], q[more])

    def _expand(self, level: int, p: np.ndarray, q: np.ndarray) -> None:
        (oa, sa), (ob, sb) = self.a.children[level], self.b.children[level]
        na, nb = sa[p + 1] - sa[p], sb[q + 1] - sb[q]
        if len(p) == 1 and na[0] * nb[0] > 64:
            left, right = oa[sa[p[0]] : sa[p[0] + 1]], ob[sb[q[0]] : sb[q[0] + 1]]
            step = max(1, CHUNK // len(right))
            for at in range(0, len(left), step):
                self._grid(level + 1, left[at : at + step], right)
            return
        large = na * nb > 64
        for i in np.flatnonzero(large):
            self._expand(level, p[i : i + 1], q[i : i + 1])
        p, q, na, nb = p[~large], q[~large], na[~large], nb[~large]
        total = na * nb
        ends = np.cumsum(total)
        at = 0
        while at < len(p):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
            owner = np.repeat(np.arange(at, to), total[at:to])
            turn = np.arange(len(owner)) - np.repeat(ends[at:to] - total[at:to] - (ends[at - 1] if at else 0), total[at:to])
            self._visit(level + 1, oa[sa[p[owner]] + turn // nb[owner]], ob[sb[q[owner]] + turn % nb[owner]])
            at = to

    def _grid(self, level: int, left: np.ndarray, right: np.ndarray) -> None:
        """All pairs of two lists of nodes: single-precision products find those that a bound may keep.

        Points and wide nodes go apart, so nearly all pairs are compared with one number.
        """
        a, b = self.a, self.b
        for p in (left[a.radius[level][left] == 0], left[a.radius[level][left] > 0]):
            for q in (right[b.radius[level][right] == 0], right[b.radius[level][right] > 0]):
                if not len(p) or not len(q):
                    continue
                cos = a.x32[a.centre[level][p]] @ b.x32[b.centre[level][q]].T
                far = np.minimum(a.radius[level][p].max() + b.radius[level][q] + self.t + EPS, 2.0)
                at_least = (1 - far * far / 2 - COARSE).astype(np.float32)
                i, j = np.nonzero(cos >= (at_least[0] if (at_least == at_least[0]).all() else at_least[None, :]))
                for lo in range(0, len(i), CHUNK):
                    self._visit(level, p[i[lo : lo + CHUNK]], q[j[lo : lo + CHUNK]])

    def counts(self, which: str) -> np.ndarray:
        tree, counts = (self.a, self.count_a) if which == "a" else (self.b, self.count_b)
        return sum(c[node] for c, node in zip(counts, tree.node_of))

    def spanning(self, n_a: int) -> tuple[np.ndarray, np.ndarray]:
        """(point, root) for every point that has a link; points of b are numbered from ``n_a`` on (0 if the trees are one)."""
        shift = 0 if self.same else n_a
        u, v = [e[0] for e in self.edges], [e[1] + shift for e in self.edges]
        for tree, whole, add in ((self.a, self.whole_a, 0), (self.b, self.whole_b, shift)):
            for level in range(len(tree.centre)):
                if whole[level].any():
                    points = np.flatnonzero(whole[level][tree.node_of[level]])
                    u.append(points + add)
                    v.append(tree.centre[level][tree.node_of[level][points]] + add)
        if not u:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        u, v = np.concatenate(u), np.concatenate(v)
        size = n_a if self.same else n_a + len(self.b.x)
        root = np.arange(size)
        while True:
            least = np.minimum(root[u], root[v])
            new = root.copy()
            np.minimum.at(new, root[u], least)
            np.minimum.at(new, root[v], least)
            new = new[new]
            if (new == root).all():
                break
            root = new
        points = np.unique(np.concatenate([u, v]))
        return points, root[points]


def _packed(reps: DataFrame) -> DataFrame:
    """One row per block: dim, blk, ids, weights, raw, and a centre with its covering radius."""
    pivots = reps.orderBy(F.xxhash64("node"), "node").limit(PIVOTS).select("dim", "raw").collect()
    by_dim: dict[int, np.ndarray] = {d: unit(stack([bytes(r["raw"]) for r in pivots if r["dim"] == d], d)) for d in {r["dim"] for r in pivots}}

    @F.pandas_udf("int")
    def cell(dim: pd.Series, raw: pd.Series) -> pd.Series:
        out = np.zeros(len(dim), dtype=np.int32)
        for d, own in by_dim.items():
            at = np.flatnonzero(dim.to_numpy() == d)
            if len(at):
                out[at] = (unit(stack([raw.iloc[i] for i in at], d)) @ own.T).argmax(axis=1)
        return pd.Series(out)

    ranked, _ = global_rank(reps.withColumn("cell", cell("dim", "raw")).select("dim", "cell", "node", "weight", "raw"), ["dim", "cell", "node"])
    blocked = ranked.withColumn("blk", F.expr(f"cast(rank div greatest(1, least({BLOCK}, {BLOCK_BYTES} div (8 * dim))) as int)"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        rows = stack(list(pdf.raw), int(key[0]))
        x = unit(rows)
        centre = x.mean(axis=0)
        reach = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())
        ids, weights = pdf.node.to_numpy(np.int64).tobytes(), pdf.weight.to_numpy(np.int64).tobytes()
        return pd.DataFrame([(key[0], key[1], ids, weights, compact(rows), centre.tolist(), reach)], columns=["dim", "blk", "ids", "weights", "raw", "centre", "reach"])

    return durable(blocked.groupBy("dim", "blk").applyInPandas(pack, "dim int, blk int, ids binary, weights binary, raw binary, centre array<double>, reach double"))


def threshold_links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for parsed vectors (``parse_vectors``)."""
    vectors = durable(vectors)
    classes = durable(vectors.where("dim > 0").groupBy("dim", "h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")))
    named = classes.select("dim", "h1", "h2", "weight", "node", F.col("node").alias("vec_id"))
    reps = durable(vectors.join(named, ["dim", "h1", "h2", "vec_id"]).dropDuplicates(["node"]).select("dim", "node", "weight", "raw"))
    blocks = _packed(reps)
    t = float(np.sqrt(2 - 2 * cosine))
    left = blocks.select("dim", F.col("blk").alias("i"), F.col("centre").alias("c_i"), F.col("reach").alias("r_i"))
    right = blocks.select("dim", F.col("blk").alias("j"), F.col("centre").alias("c_j"), F.col("reach").alias("r_j"))
    gap = F.sqrt(F.aggregate(F.zip_with("c_i", "c_j", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    pairs = left.join(right, "dim").where("i <= j").where(gap <= F.col("r_i") + F.col("r_j") + F.lit(t + EPS)).select("dim", "i", "j")
    load = blocks.select("dim", "blk", "ids", "weights", "raw")
    both = pairs.join(load.toDF("dim", "i", "ids_i", "weights_i", "raw_i"), ["dim", "i"]).join(load.toDF("dim", "j", "ids_j", "weights_j", "raw_j"), ["dim", "j"])
    arrow = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def tree(dim: int, weights: bytes, raw: bytes) -> CoverTree:
        own = np.frombuffer(weights, dtype=np.int64)
        return CoverTree(unit(components_of(raw, dim * len(own)).reshape(-1, dim)), own)

    def join(batches):
        kept: dict[tuple, CoverTree] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if len(kept) > 2:
                    kept.clear()
                for k in ("i", "j"):
                    if (r["dim"], r[k]) not in kept:
                        kept[r["dim"], r[k]] = tree(r["dim"], r[f"weights_{k}"], r[f"raw_{k}"])
                a, b = kept[r["dim"], r["i"]], kept[r["dim"], r["j"]]
                ids_a, ids_b = (np.frombuffer(r[k], dtype=np.int64) for k in ("ids_i", "ids_j"))
                found = Join(a, b, cosine)
                ids = ids_a if a is b else np.concatenate([ids_a, ids_b])
                links = found.counts("a") if a is b else np.concatenate([found.counts("a"), found.counts("b")])
                points, root = found.spanning(len(ids_a))
                roots = ids.copy()
                roots[points] = ids[root]
                keep = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(links[keep]), pa.array(roots[keep])], schema=arrow)

    found = durable(both.repartition("dim", "i", "j").mapInArrow(join, "node long, links long, root long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    per_class = classes.join(counts, "node", "left").join(comp, "node", "left")
    per_class = per_class.select("dim", "h1", "h2", (F.coalesce("links", F.lit(1)) - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    out = vectors.select("vec_id", "dim", "h1", "h2").join(per_class, ["dim", "h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
