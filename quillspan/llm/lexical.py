"""Ranked lexical search as a blocked sparse matrix product.

The queries form a sparse matrix (item by term: how often a term counts), each block of documents
another (term by document: int64 impacts). A block of the product is made row by row after Gustavson: for an
item, the impact rows of its terms are merged into one int64 accumulator over the block's documents.
Of every row a task keeps the ``k`` best documents over all its blocks; those of all tasks are
ranked in two levels, so no task meets more than ``k`` rows for each of ``GATHER`` others.

A first pass counts what the weights need over all documents: documents with a term, terms with repeats, and for
the queries' terms the documents that hold them. Only these counts reach the driver. The texts are split again in the second
pass; nothing is written in between and documents are never joined with items.

Items are taken in blocks of ``BLOCK_WORDS`` words, whose matrix travels to the workers; each block makes its own two passes. Words are
compared whole, arithmetic is in 64-bit integers but for the logarithm of a weight.

Null and empty texts have no terms: such documents do not count and are never found, such items have no rows. Repeated document rows
are documents of their own and repeated item rows items of their own. Equal scores go by doc_id, a missing one last; an item
without matches has no rows, nor has an empty table. Texts of any length are read whole; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, prepare, to_arrow
from .words import Words, batches_of, ids_of, item_blocks

K = 10
BLOCK_WORDS = 1 << 18
#: Documents of one block of the product.
BLOCK_DOCS = 4096
#: Tasks whose best rows are ranked together first.
GATHER = 256

_I = np.int64


class Items:
    """The item by term matrix of a block: for item i, terms ``term[ptr[i] : ptr[i + 1]]`` with multiplicities ``times``."""

    def __init__(self, items: Sequence[tuple[Any, list[bytes]]], repeats: bool):
        counts = [Counter(words) for _, words in items]
        known = {w: k for k, w in enumerate(dict.fromkeys(w for c in counts for w in c))}
        self.ids = [i for i, _ in items]
        self.vocabulary = pa.array(list(known), pa.large_binary())
        self.ptr = np.cumsum([0, *map(len, counts)])
        self.term = np.array([known[w] for c in counts for w in c], dtype=_I)
        self.times = np.array([n if repeats else 1 for c in counts for n in c.values()], dtype=_I)


def term_counts(words: Words, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, occurrences) of a batch's words that are in the vocabulary, by term, then by text."""
    ids = ids_of(words.words, vocabulary)
    texts = len(words.first) - 1
    text = np.repeat(np.arange(texts, dtype=_I), np.diff(words.first))
    there = ids >= 0
    cell, tf = np.unique(ids[there] * texts + text[there], return_counts=True)
    return cell % max(texts, 1), cell // max(texts, 1), tf.astype(_I)


def corpus_counts(docs: DataFrame, vocabulary: pa.Array) -> tuple[int, int, np.ndarray]:
    """(documents with a term, terms with repeats, documents that hold each term of the vocabulary) over all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(sent.value), dtype=_I)
        n = total = 0
        for _, words in batches_of("text", batches):
            sizes = np.diff(words.first)
            n += int(np.count_nonzero(sizes))
            total += int(sizes.sum())
            held += np.bincount(term_counts(words, sent.value)[1], minlength=len(held))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"term": np.concatenate([[-1, -2], some]).astype(_I), "n": np.concatenate([[n, total], held[some]]).astype(_I)})
        give_back()

    counted = {r["term"]: r["n"] for r in docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return counted.get(-1, 0), counted.get(-2, 0), np.array([counted.get(t, 0) for t in range(len(vocabulary))], dtype=_I)


def weights(n_docs: int, held: np.ndarray) -> np.ndarray:
    """Weight of each term; one that no document holds has no use for one."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in held], dtype=_I)


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """Impact of a term that occurs ``tf`` times among a document's ``n`` terms, before its weight."""
    if 90 * n_docs * int(n.max(initial=0)) >= 1 << 63:  # beyond 64 bits the one product is made of Python integers
        scale = np.array([10 + 90 * int(x) * n_docs // total for x in n], dtype=_I)
    else:
        scale = 10 + 90 * n * n_docs // max(total, 1)
    return 10**9 * tf // (1000 * tf + 8 * scale)


class _Best:
    """The best documents of every item so far: by score, then by id, a missing id last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.rows = [(np.zeros(0, _I), np.zeros(0, bool), np.zeros(0, _I)) for _ in range(items)]
        self.least = [1] * items

    def add(self, item: int, score: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> None:
        """Scores of a block's documents; those below the k-th best so far cannot enter."""
        at = np.flatnonzero(score >= self.least[item])
        if len(at) > self.k:  # equals of the k-th stay: ids decide
            at = at[score[at] >= np.partition(score[at], -self.k)[-self.k]]
        if len(at):
            s, m, i = (np.concatenate(x) for x in zip(self.rows[item], (score[at], missing[at], ids[at])))
            first = np.lexsort((i, m, -s))[: self.k]
            self.rows[item] = s[first], m[first], i[first]
            if len(first) == self.k:
                self.least[item] = int(s[first[-1]])


def _multiply(items: Items, weight: np.ndarray, text: np.ndarray, term: np.ndarray, impact: np.ndarray, missing: np.ndarray, ids: np.ndarray, best: _Best) -> None:
    """One block of the product: rows of the term by document matrix are merged item by item."""
    order = np.argsort(term, kind="stable")
    column, value = text[order], (weight[term] * impact)[order]
    row = np.searchsorted(term[order], np.arange(len(weight) + 1))
    score = np.zeros(len(ids), dtype=_I)
    for item in range(len(items.ids)):
        score[:] = 0
        for t in range(items.ptr[item], items.ptr[item + 1]):
            a, b = row[items.term[t]], row[items.term[t] + 1]
            if a < b:  # a document stands once in a row
                score[column[a:b]] += items.times[t] * value[a:b]
        best.add(item, score, missing, ids)


_RANKED = "part int, item int, doc_id long, score long"


def _search(docs: DataFrame, items: Items, kind: T.DataType, k: int) -> DataFrame:
    n_docs, total, held = corpus_counts(docs, items.vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast((items, weights(n_docs, held)))
    schema = T.StructType([T.StructField("item_id", kind), *T._parse_datatype_string(_RANKED)])
    arrow = to_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight = sent.value
        best = _Best(len(own.ids), k)
        block: list[list[np.ndarray]] = []
        size = 0

        def flush() -> None:
            nonlocal block, size
            if block:
                _multiply(own, weight, *map(np.concatenate, zip(*block)), best)
            block, size = [], 0

        for batch, words in batches_of("text", batches):
            text, term, tf = term_counts(words, own.vocabulary)
            impact = impacts(tf, np.diff(words.first)[text], n_docs, total)
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            block.append([text + size, term, impact, missing, ids.fill_null(0).to_numpy(zero_copy_only=False).astype(_I)])
            size += batch.num_rows
            if size >= BLOCK_DOCS:
                flush()
        flush()
        part = TaskContext.get().partitionId()
        for item, (score, missing, ids) in enumerate(best.rows):
            if len(score):
                n = len(score)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([own.ids[item]] * n, [part] * n, [item] * n, pa.array(ids, mask=missing), score), arrow)], schema=arrow)
        give_back()

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    order = F.desc("score"), F.asc_nulls_last("doc_id")
    near = F.row_number().over(W.partitionBy("item", F.floor(F.col("part") / GATHER)).orderBy(*order))
    last = F.row_number().over(W.partitionBy("item").orderBy(*order))
    few = found.withColumn("rank", near).where(F.col("rank") <= k)
    return few.withColumn("rank", last).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K, repeats: bool = False, block_words: int = BLOCK_WORDS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents of every item with a score above 0.

    ``repeats`` counts a term as often as the item has it, otherwise once.
    """
    prepare(docs.sparkSession)
    kind = items.schema["item_id"].dataType
    parts = [_search(docs, Items(block, repeats), kind, k) for block in item_blocks(items, "item_id", "text", block_words)] or [_search(docs, Items([], repeats), kind, k)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    return found
