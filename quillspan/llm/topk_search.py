"""Exact top-k by inner product with multi-resolution segment statistics.

Vectors are cut into equal segments at a coarse and a fine resolution; per segment only mean and
deviation are kept. With |q - x|^2 >= sum over segments of L * ((mq - mx)^2 + (sq - sx)^2) they give
a lower bound of the distance, hence - norms being known - an upper bound of the inner product. For
a block of queries against a block of rows the pairs with the best coarse bounds are computed
exactly and give each query a running k-th score; coarse bounds, then fine bounds, discard what
cannot reach it, and the survivors get exact scores. Ties go to the smaller id.

Blocks of bounded size meet in pairs; each returns k rows per query, and one ranking per query
merges them. The stated queries meet every row, as an exact search must.

Components become floor(scale * x). Vectors that are null or empty or hold null or non-finite
components, and rows without id, take no part. Vectors of different lengths are not compared. Rows
that share a query's id are not its candidates; of rows that share an id one serves as query. Scores
beyond 64 bits are ranked by their exact values and shown as the nearest long. Columns other than the id and the vector are not read. An empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, global_rank

SCALE = 256
K = 5
#: Most rows and bytes of a block of candidates and of a block of queries.
ROWS, QUERIES = 16_384, 32_768
BLOCK_BYTES = 8 << 20
#: Segments at each resolution, coarse to fine.
LEVELS = (4, 16)
#: Components below this are multiplied as doubles without rounding (up to 4096 of them).
EXACT = float(1 << 20)
#: Relative margin of the bounds for rounding.
SLACK = 1e-9
_NINES = str.maketrans("0123456789", "9876543210")


def quantise(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """vec_id, dim, raw (floor(scale * x) as doubles) of the rows that take part."""
    arrow = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("raw", pa.binary())])

    def run(batches):
        for batch in batches:
            ids, dims, raws = [], [], []
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i is None or not value.is_valid or not len(value) or value.values.null_count:
                    continue
                x = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    q = np.floor(scale * x)
                    if np.isfinite(q).all():
                        ids.append(i)
                        dims.append(len(q))
                        raws.append(q.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], schema=arrow)

    return df.select(F.col(id_col).cast("long").alias("vec_id"), vec_col).mapInArrow(run, "vec_id long, dim int, raw binary")


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """One row per block of at most ``size`` vectors of one length: dim, blk, ids, raw."""
    ranked, _ = global_rank(rows.select("dim", "vec_id", "raw"), ["dim", "vec_id", "raw"])
    blocked = ranked.withColumn("blk", F.expr(f"cast(rank div greatest(1, least({size}, {BLOCK_BYTES} div (8 * dim))) as int)"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], key[1], pdf.vec_id.to_numpy(np.int64).tobytes(), b"".join(pdf.raw))], columns=["dim", "blk", "ids", "raw"])

    return durable(blocked.groupBy("dim", "blk").applyInPandas(pack, "dim int, blk int, ids binary, raw binary"))


def segment_stats(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments, each times the root of the segment's length."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    length = np.diff(cuts)
    total = np.add.reduceat(x, cuts[:-1], axis=1)
    square = np.add.reduceat(x * x, cuts[:-1], axis=1)
    deviation = np.sqrt(np.maximum(0.0, square - total * total / length))
    return total / np.sqrt(length), deviation


def upper_bounds(q: tuple[np.ndarray, np.ndarray], x: tuple[np.ndarray, np.ndarray], q_norm: np.ndarray, x_norm: np.ndarray) -> np.ndarray:
    """Upper bounds of all inner products, from the lower bounds of the distances."""
    qs, xs = np.hstack(q), np.hstack(x)
    lower = (qs * qs).sum(axis=1)[:, None] + (xs * xs).sum(axis=1)[None, :] - 2 * (qs @ xs.T)
    bound = (q_norm[:, None] + x_norm[None, :] - lower) / 2
    return bound + SLACK * (q_norm[:, None] + x_norm[None, :])


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def search_block(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int = K) -> list[tuple[int, int, int]]:
    """(query id, row id, score) of the k best rows of a block for every query, scores as longs."""
    return [(i, j, as_long(s)) for i, j, s in exact_block(q, q_ids, x, x_ids, k)]


def as_long(score: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, score))


def beyond(score: int) -> str:
    """Text that sorts scores beyond 64 bits as their values do; empty within."""
    if as_long(score) == score:
        return ""
    digits = str(abs(score))
    if score < 0:
        return f"{99_999 - len(digits):05d}" + digits.translate(_NINES)
    return f"{len(digits):05d}{digits}"


def exact_block(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int = K) -> list[tuple[int, int, int]]:
    """(query id, row id, score) of the k best rows of a block for every query, scores as whole numbers."""
    out = []
    if max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) >= EXACT or q.shape[1] > 4096:
        whole = [[int(v) for v in row] for row in x]
        for i, row in zip(q_ids, q):
            own = [int(v) for v in row]
            found = sorted((-sum(a * b for a, b in zip(own, y)), int(j)) for j, y in zip(x_ids, whole) if j != i)[:k]
            out += [(int(i), j, -s) for s, j in found]
        return out
    q_norm, x_norm = (q * q).sum(axis=1), (x * x).sum(axis=1)
    stats = [(segment_stats(q, s), segment_stats(x, s)) for s in LEVELS]
    for at in range(0, len(q), 128):
        part = slice(at, at + 128)
        own = q_ids[part, None] == x_ids[None, :]
        coarse = upper_bounds(tuple(s[part] for s in stats[0][0]), stats[0][1], q_norm[part], x_norm)
        coarse[own] = -np.inf
        m = min(len(x), 4 * k)
        seeds = np.argpartition(-coarse, m - 1, axis=1)[:, :m]
        exact = np.einsum("id,ijd->ij", q[part], x[seeds])
        exact[np.take_along_axis(own, seeds, axis=1)] = -np.inf
        kth = -np.sort(-exact, axis=1)[:, min(k, m) - 1]
        if m < k:
            kth[:] = -np.inf
        i, j = np.nonzero((coarse >= kth[:, None]) & ~own)
        for level in stats[1:]:
            (mq, sq), (mx, sx) = level
            keep = np.zeros(len(i), dtype=bool)
            for lo in range(0, len(i), 1 << 18):
                r, c = i[lo : lo + (1 << 18)], j[lo : lo + (1 << 18)]
                dist = ((mq[part][r] - mx[c]) ** 2).sum(axis=1) + ((sq[part][r] - sx[c]) ** 2).sum(axis=1)
                norms = q_norm[part][r] + x_norm[c]
                keep[lo : lo + (1 << 18)] = (norms - dist) / 2 + SLACK * norms >= kth[r]
            i, j = i[keep], j[keep]
        score = np.empty(len(i), dtype=np.int64)
        for lo in range(0, len(i), 1 << 18):
            r, c = i[lo : lo + (1 << 18)], j[lo : lo + (1 << 18)]
            score[lo : lo + (1 << 18)] = np.einsum("ij,ij->i", q[part][r], x[c]).astype(np.int64)
        ends = np.searchsorted(i, np.arange(own.shape[0] + 1))
        for r in range(own.shape[0]):
            s, ids = score[ends[r] : ends[r + 1]], x_ids[j[ends[r] : ends[r + 1]]]
            out += [(int(q_ids[at + r]), int(ids[b]), int(s[b])) for b in _best(s, ids, k)]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for every query among quantised vectors."""
    vectors = durable(vectors)
    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min(F.struct("raw", "dim")).alias("v")).select("v.dim", "vec_id", "v.raw")
    q = _packed(queries, QUERIES).toDF("dim", "q_blk", "q_ids", "q_raw")
    x = _packed(vectors, ROWS)
    pairs = q.select("dim", "q_blk").join(x.select("dim", "blk"), "dim")
    both = pairs.join(q, ["dim", "q_blk"]).join(x, ["dim", "blk"]).repartition("dim", "q_blk", "blk")
    arrow = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("side", pa.int32()), ("beyond", pa.string())])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a, b = (np.frombuffer(r[n], dtype=np.float64).reshape(-1, r["dim"]) for n in ("q_raw", "raw"))
                found = exact_block(a, np.frombuffer(r["q_ids"], dtype=np.int64), b, np.frombuffer(r["ids"], dtype=np.int64), k)
                rows = [(i, j, as_long(s), (s > as_long(s)) - (s < as_long(s)), beyond(s)) for i, j, s in found]
                columns = zip(*rows) if rows else [()] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    found = both.mapInArrow(run, "query_id long, vec_id long, score long, side int, beyond string")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("side"), F.desc("beyond"), F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
