"""Hilbert-curve sharding.

Metadata columns are quantised to a common number of bits, every row gets its index on the
Hilbert curve through that grid, rows are sorted by (index, id) and the sorted sequence is cut
into runs. Rows of one shard are near each other in every dimension, so per-file minima and
maxima of all dimensions prune, not only those of one sort key. Cells are quantiles, so an outlying
value or a skewed dimension does not crowd the other rows into one cell.

Equal texts take the curve index of their smallest row and follow each other there, so only a cut between two
shards - which equal row counts force - can part them.

Nulls quantise to cell 0. Ties on the curve are broken by size, checksum and id, so repeated rows are
legal and spread over a cut if they must. Texts of any length count by their bytes. An empty table gives no
rows. Columns other than doc_id, text, source and lang are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, global_rank, small_side

SHARDS = 24
BITS = 8


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Index of each row of ``axes`` (rows x dimensions, cells below 2**bits) on the Hilbert curve.

    Skilling's transposition ("Programming the Hilbert curve", 2004), vectorised over rows.
    """
    x = axes.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


#: Accuracy of the quantiles: ranks are off by at most one in so many.
ACCURACY = 10_000


def _code(df: DataFrame, name: str, skip: int) -> Column:
    """A column as a number that keeps its order: strings by the six bytes after a common prefix."""
    if not isinstance(df.schema[name].dataType, T.StringType):
        return F.col(name).cast("double")
    rest = F.rpad(F.hex(F.substring(F.encode(name, "UTF-8"), skip + 1, 6)), 12, "0")
    return F.conv(rest, 16, 10).cast("double")


def hilbert_order(df: DataFrame, dims: Sequence[str], bits: int = BITS) -> DataFrame:
    """Add ``hilbert`` (long): the curve index of the row over ``dims``.

    Cells are approximate quantiles of each dimension; one aggregate over the compact input finds the ends of
    the strings and one the quantiles, 2**bits numbers a dimension.
    """
    if len(dims) * bits > 62:
        raise ValueError("dimensions x bits must stay within 62")
    if not dims:
        return df.withColumn("hilbert", F.lit(0).cast("long"))
    strings = [d for d in dims if isinstance(df.schema[d].dataType, T.StringType)]
    skips = {}
    if strings:
        ends = df.agg(*[f(F.encode(d, "UTF-8")).alias(f"{k}_{i}") for i, d in enumerate(strings) for k, f in (("lo", F.min), ("hi", F.max))]).first()
        for i, d in enumerate(strings):
            lo, hi = bytes(ends[f"lo_{i}"] or b""), bytes(ends[f"hi_{i}"] or b"")
            skips[d] = next((k for k, (a, b) in enumerate(zip(lo, hi)) if a != b), min(len(lo), len(hi)))
    codes = [_code(df, d, skips.get(d, 0)) for d in dims]
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = df.agg(*[F.percentile_approx(c, shares, ACCURACY).alias(f"q{i}") for i, c in enumerate(codes)]).first()
    cuts = [np.array(found[f"q{i}"] or []) for i in range(len(dims))]

    @F.pandas_udf("long")
    def index(*parts: pd.Series) -> pd.Series:
        cells = [np.where(p.isna(), 0, np.searchsorted(own, p.to_numpy(dtype=float), side="right")) for own, p in zip(cuts, parts)]
        return pd.Series(hilbert_index(np.minimum(np.stack(cells, axis=1), (1 << bits) - 1), bits))

    return df.withColumn("hilbert", index(*codes))


def cut_runs(df: DataFrame, order: Sequence[str], shards: int) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long): the globally sorted rows cut into runs of equal count.

    Shard k holds the ranks from k * n div shards on, so counts differ by one at most.
    """
    ranked, total = global_rank(df, order)
    if not total:
        return df.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    shard = F.expr(f"((rank + 1) * {shards} - 1) div {total}")
    placed = ranked.withColumn("shard", shard.cast("int"))
    return placed.withColumn("slot", F.col("rank") - F.expr(f"(shard * {total}L) div {shards}")).drop("rank")


def _gathered(placed: DataFrame) -> DataFrame:
    """``placed`` with equal texts (of one digest, checksum and size) on the curve index of their smallest row."""
    key = ["digest", "text_crc32", "size"]
    groups = placed.groupBy(*key).agg(F.min("hilbert").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = placed.join(small_side(groups), key, "left")
    return joined.withColumn("hilbert", F.coalesce("first", "hilbert")).drop("first")


def shard_documents(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Shards of documents by Hilbert runs over (doc_id, size, source, lang), whichever exist.

    Only ids, sizes, checksums and metadata are shuffled, never a text. Null texts count as empty.
    """
    whole = F.coalesce(F.col("text"), F.lit(""))
    extra = [c for c in ("source", "lang") if c in docs.columns]
    size = (F.octet_length(whole) + 8).cast("long")
    compact = docs.select("doc_id", size.alias("size"), F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"), F.xxhash64(whole).alias("digest"), *extra)
    compact = durable(compact.withColumn("log_size", F.log2(F.col("size").cast("double"))))
    ordered = _gathered(durable(hilbert_order(compact, ["doc_id", "log_size", *extra], bits)))
    return cut_runs(ordered.drop("log_size"), ["hilbert", "size", "text_crc32", "digest", "doc_id", *extra], shards).drop("digest")
