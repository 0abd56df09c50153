"""Ranked retrieval: BM25 over a segmented index, reading only blocks that can hold one of the best.

A document's score is the sum over the query's distinct terms of

    floor(10**6 * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length)) + 0.5),
    idf = ln(1 + (N - df + 0.5) / (df + 0.5)),

in whole millionths, so that sums do not depend on their order. A term contributes more the more often it occurs and the
shorter the document is, so a block's greatest frequency and least length bound what it can contribute, whatever the mean length has
become since the block was written. The plan has three steps:

1. bounds of all blocks of the terms, from the small columns of the postings only;
2. exact scores in the few blocks of highest bound: the k-th best is a threshold;
3. exact scores in the blocks whose bound reaches the threshold - no other can hold one of the k best.

The driver sees document frequencies, thresholds and, where few blocks survive, their numbers, which then
reach the scan as a filter; otherwise the survivors are joined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stemmer import stem_word
from ..functions.text import SEPARATORS, fold_word
from .segments import SegmentIndex

K1, B = 1.2, 0.75
UNIT = 10**6
#: Blocks of highest bound that give the threshold, for each query.
SEEDS = 16
#: Blocks up to which their numbers are a filter of the scan.
LISTED = 1000


def query_words(text: str, mode: str = "reference") -> list[str]:
    """Tokens of a text on the driver, folded and stemmed, in order."""
    parts = fold_word(text, mode).translate(str.maketrans(dict.fromkeys(SEPARATORS, " "))).split(" ")
    return [stem_word(w) for w in parts if w]


def idf(n_docs: int, doc_freq: int) -> float:
    return math.log(1 + (n_docs - doc_freq + 0.5) / (doc_freq + 0.5))


def contribution(weight: Column, tf: Column, length: Column, mean: float) -> Column:
    """Millionths that a term with idf ``weight`` adds to a document."""
    return F.floor(UNIT * weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)) + 0.5).cast("long")


class Ranker:
    """BM25 search over an index."""

    def __init__(self, index: SegmentIndex):
        self.index = index
        self.mean = index.n_tokens / index.n_docs if index.n_tokens else 1.0

    def query_terms(self, queries: dict[int, str]) -> DataFrame | None:
        """(query_id, term, weight) of the queries' distinct terms that some live document has; None if there are none."""
        asked = {q: list(dict.fromkeys(query_words(t, self.index.mode))) for q, t in queries.items()}
        terms = sorted({t for words in asked.values() for t in words})
        if not terms:
            return None
        freq = {r["term"]: r["doc_freq"] for r in self.index.dictionary(F.col("term").isin(terms)).collect()}
        rows = [(q, t, idf(self.index.n_docs, freq[t])) for q, words in asked.items() for t in words if t in freq]
        self._terms = sorted({r[1] for r in rows})
        return self.index.spark.createDataFrame(rows, "query_id long, term string, weight double") if rows else None

    def _blocks(self) -> DataFrame:
        return self.index.blocks().where(F.col("term").isin(self._terms))

    def bounds(self, asked: DataFrame) -> DataFrame:
        """(query_id, segment, block, bound): the most that a document of the block can score."""
        most = contribution(F.col("weight"), F.col("max_tf"), F.col("min_length"), self.mean)
        # As many rows as the queries have terms.
        rows = self._blocks().select("segment", "term", "block", "max_tf", "min_length").join(F.broadcast(asked), "term")
        return rows.groupBy("query_id", "segment", "block").agg(F.sum(most).alias("bound"))

    def scores(self, asked: DataFrame, units: DataFrame, within: DataFrame | None = None) -> DataFrame:
        """(query_id, doc_id, score) of the live documents in some blocks (segment, block), or of those ``within`` a table of ids.

        Where the blocks are few, their numbers are a filter of the scan; otherwise they are joined.
        """
        known = units.select("segment", "block").distinct()
        rows = known.limit(LISTED + 1).collect()
        blocks = self._blocks()
        if len(rows) <= LISTED:
            known = F.broadcast(self.index.spark.createDataFrame([tuple(r) for r in rows], "segment string, block long"))
            blocks = blocks.where(F.col("block").isin([r["block"] for r in rows]))
        wanted = blocks.join(known, ["segment", "block"], "left_semi")
        found = self.index.matches(wanted, "tf", "length")
        if within is not None:
            found = found.join(within.select("doc_id"), "doc_id", "left_semi")
        found = found.join(F.broadcast(asked), "term")
        return found.groupBy("query_id", "doc_id").agg(F.sum(contribution(F.col("weight"), F.col("tf"), F.col("length"), self.mean)).alias("score"))

    def survivors(self, asked: DataFrame, k: int, within: DataFrame | None = None) -> DataFrame:
        """(query_id, segment, block, bound) of the blocks that can hold one of the k best."""
        bounds = self.bounds(asked)
        order = W.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "block")
        seeds = bounds.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SEEDS).select("query_id", "segment", "block")
        best = W.partitionBy("query_id").orderBy(F.desc("score"))
        scored = self.scores(asked, seeds, within)
        least = scored.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("query_id", F.col("score").alias("least"))
        # One row for each query; the plan below does not repeat the work for it.
        known = self.index.spark.createDataFrame([tuple(r) for r in least.collect()], "query_id long, least long")
        return bounds.join(F.broadcast(known), "query_id", "left").where(F.col("bound") >= F.coalesce("least", F.lit(1))).drop("least")

    def search_batch(self, queries: dict[int, str], k: int = 10, within: DataFrame | None = None) -> DataFrame:
        """(query_id, rank, doc_id, score): the k best documents of every query, equal scores by id.

        ``within`` (doc_id) restricts them, say to the hits of a boolean query; weights stay those of the whole corpus.
        """
        asked = self.query_terms(queries)
        if asked is None:
            return self.index.spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
        scored = self.scores(asked, self.survivors(asked, k, within), within)
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        ranked = scored.where(F.col("score") > 0).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select("query_id", "rank", "doc_id", (F.col("score") / UNIT).alias("score"))

    def search(self, query: str, k: int = 10, within: DataFrame | None = None) -> DataFrame:
        """(rank, doc_id, score) of one query."""
        return self.search_batch({0: query}, k, within).drop("query_id")
