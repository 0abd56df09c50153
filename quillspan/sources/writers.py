"""Writers: corpus, index, frequency files, search results, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_corpus(corpus: DataFrame, path: str) -> None:
    """One row per kept document."""
    corpus.write.mode("overwrite").parquet(path)


def write_index(docs: DataFrame, postings: DataFrame, path: str, files: int | None = None) -> None:
    """Forward and inverted index as parquet.

    Postings stay flat and are dealt out by ranges of (term, doc_id): a term as frequent as it may be
    spreads over files, and sorted row groups let a search read only those that may hold its terms.
    """
    order = ("term", "doc_id")
    dealt = postings.repartitionByRange(files, *order) if files else postings.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/postings")
    docs.write.mode("overwrite").parquet(f"{path}/docs")


def write_frequencies(frequencies: DataFrame, path: str) -> None:
    frequencies.select("word", "frequency").write.mode("overwrite").option("header", True).csv(path)


def results_json(hits: DataFrame) -> DataFrame:
    """One row with ``json``: the number of hits and all of them in ascending id."""
    listed = F.sort_array(F.collect_list(F.struct(F.col("doc_id").alias("id"), F.coalesce("title", F.lit("")).alias("title"))))
    return hits.agg(F.to_json(F.struct(F.count("*").alias("count"), listed.alias("results"))).alias("json"))


def results_pages(placed: DataFrame, size: int = 20) -> DataFrame:
    """(page, json) for hits with title and ``place``: pages from 0, each with its number of hits and these in ascending id."""
    listed = F.sort_array(F.collect_list(F.struct(F.col("doc_id").alias("id"), F.coalesce("title", F.lit("")).alias("title"))))
    page = F.floor(F.col("place") / size).cast("long").alias("page")
    return placed.groupBy(page).agg(F.to_json(F.struct(F.count("*").alias("count"), listed.alias("results"))).alias("json"))


def error_json(error: Exception) -> str:
    return json.dumps({"error": str(error)}, ensure_ascii=False)


def corpus_report(stats: DataFrame) -> str:
    """Readable report of the one row that ``corpus_stats`` returns."""
    r = stats.first()
    mb, kb = 1024 * 1024, 1024
    mean = lambda total: (total or 0) / r["docs"] if r["docs"] else 0.0
    ratio = 100 * r["text_bytes"] / r["raw_bytes"] if r["raw_bytes"] else 0.0
    return "\n".join(
        [
            f"Documents: {r['docs']} ({r['docs_a']} / {r['docs_b']})",
            f"Raw size: {(r['raw_bytes'] or 0) / mb:.2f} MB, mean {mean(r['raw_bytes']) / kb:.2f} KB",
            f"Text size: {(r['text_bytes'] or 0) / mb:.2f} MB, mean {mean(r['text_bytes']) / kb:.2f} KB",
            f"Text share: {ratio:.2f} %",
        ]
    )


def index_report(stats: DataFrame, n_docs: int, n_bytes: int, seconds: float) -> str:
    """Readable report of an index build."""
    r = stats.first()
    return "\n".join(
        [
            f"Indexed {n_docs} documents in {seconds:.2f} s",
            f"Speed: {n_bytes / 1024 / 1024 / seconds if seconds else 0:.2f} MB/s, {1000 * seconds / n_docs if n_docs else 0:.3f} ms per document",
            f"Terms: {r['n_terms']}, mean length {r['mean_term_bytes'] or 0:.2f} bytes",
        ]
    )
