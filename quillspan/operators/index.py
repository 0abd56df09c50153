"""Tokens, vocabulary, postings and their statistics.

Stems are never computed per occurrence: frequencies stem the vocabulary, after counting, and
postings stem the distinct tokens of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stemmer import stem, with_stem
from ..functions.text import SEPARATOR_PATTERN, fold, spread, title, token_array


def tokens(docs: DataFrame, mode: str = "reference") -> DataFrame:
    """(doc_id, token), one row per occurrence. Empty parts go after the explode, where the filter is compiled."""
    parts = F.split(fold("text", mode), SEPARATOR_PATTERN)
    return spread(docs.select("doc_id", "text")).select("doc_id", F.explode(parts).alias("token")).where("token <> ''")


def positioned_tokens(docs: DataFrame, mode: str = "reference") -> DataFrame:
    """(doc_id, place, token): the tokens of every document in order, places from 0. Nothing is shuffled."""
    return spread(docs.select("doc_id", "text")).select("doc_id", F.posexplode(token_array("text", mode)).alias("place", "token"))


def vocabulary(occurrences: DataFrame) -> DataFrame:
    """(token, frequency, term): distinct tokens with counts and stems."""
    return with_stem(occurrences.groupBy("token").agg(F.count("*").alias("frequency")), "token", "term")


def term_frequencies(docs: DataFrame, mode: str = "reference") -> DataFrame:
    """(term, frequency) over the corpus; absent terms have no row."""
    return vocabulary(tokens(docs, mode)).groupBy("term").agg(F.sum("frequency").alias("frequency"))


def frequency_of(frequencies: DataFrame, terms: list[str]) -> DataFrame:
    """Frequency of each asked term, 0 where it is absent."""
    # As many rows as the caller names; the planner broadcasts them where they are few.
    asked = frequencies.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    return asked.join(frequencies.where(F.col("term").isin(terms)), "term", "left").select("term", F.coalesce("frequency", F.lit(0)).cast("long").alias("frequency"))


def postings_flat(docs: DataFrame, mode: str = "reference") -> DataFrame:
    """(term, doc_id), distinct, without any shuffle.

    A document's distinct tokens are stemmed and made distinct again inside its row. Joining a stemmed
    vocabulary instead would stem less, but shuffle every pair twice (measured when a stem cost several
    times as much as now: the same time on Cyrillic text, three times as long on Latin text).
    """
    terms = F.array_distinct(F.transform(F.array_distinct(token_array("text", mode)), stem))
    return spread(docs.select("doc_id", "text")).select(F.explode(terms).alias("term"), "doc_id")


def postings_for(docs: DataFrame, terms: list[str], mode: str = "reference") -> DataFrame:
    """(term, doc_id) of a few terms straight from texts.

    Stemming only removes endings, so a token can become a term only if it begins with it: that test
    discards nearly all tokens before any stemming. The rest is stemmed and made distinct inside the
    row, so a document has each term once and nothing is shuffled.
    """
    if not terms:
        return docs.sparkSession.createDataFrame([], "term string, doc_id long")
    begins = lambda t: F.exists(F.array(*map(F.lit, terms)), lambda p: t.startswith(p))
    found = F.transform(F.filter(F.array_distinct(token_array("text", mode)), begins), stem)
    asked = F.array_intersect(found, F.array(*map(F.lit, terms)))
    return spread(docs.select("doc_id", "text")).select(F.explode(asked).alias("term"), "doc_id")


#: Width of the range of ids that one row of a list-shaped index covers.
ID_BLOCK = 1 << 16


def inverted_index(postings: DataFrame, width: int = ID_BLOCK) -> DataFrame:
    """(term, block, doc_freq, postings): ascending document lists, cut at multiples of ``width`` ids.

    Blocks in order make a term's whole list, and their frequencies its document frequency. A row holds at
    most ``width`` ids, and a term that every document has spreads over as many rows and tasks as there are blocks.
    """
    block = F.floor(F.col("doc_id") / F.lit(width)).cast("long")
    return postings.groupBy("term", block.alias("block")).agg(F.count("*").alias("doc_freq"), F.sort_array(F.collect_list("doc_id")).alias("postings"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("doc_freq"))


def index_stats(postings: DataFrame) -> DataFrame:
    """One row: distinct terms and their mean length in bytes."""
    terms = postings.groupBy("term").agg(F.count("*").alias("n"))
    return terms.agg(F.count("*").alias("n_terms"), F.avg(F.octet_length("term")).alias("mean_term_bytes"))


def token_stats(docs: DataFrame, mode: str = "reference") -> DataFrame:
    """One row: documents, bytes, tokens, distinct terms, and mean term bytes by occurrence."""
    size = docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("n_bytes"))
    freq = term_frequencies(docs, mode).agg(
        F.coalesce(F.sum("frequency"), F.lit(0)).cast("long").alias("n_tokens"),
        F.count("*").alias("n_terms"),
        (F.sum(F.col("frequency") * F.octet_length("term")).cast("double") / F.sum("frequency")).alias("mean_token_bytes"),
    )
    # One row each: nothing to shuffle or to bound.
    return size.withColumn("k", F.lit(1)).join(freq.withColumn("k", F.lit(1)), "k").drop("k")


def titles(docs: DataFrame) -> DataFrame:
    """(doc_id, title)."""
    return docs.select("doc_id", title("text").alias("title"))


def build_index(docs: DataFrame, path: str, mode: str = "reference") -> None:
    """Write forward and inverted index of a corpus."""
    from ..sources.writers import write_index

    write_index(titles(docs), postings_flat(docs, mode), path)
