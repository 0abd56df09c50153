"""Boolean search.

The preferred plan reads the postings of all terms once, turns them into one flag per term and
document, and applies the query as a boolean column to the document universe: one scan of postings,
one aggregation, one join, however deep the query nests. NOT is the complement in the universe, so
documents without terms count; where no document without the query's terms can be a hit, which the query itself tells,
there is no join and only the postings are read. The set plan evaluates operator by operator with semi and anti joins.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stemmer import stem_word
from ..functions.text import fold_word
from ..plans.query_language import evaluate, terms_of, to_rpn
from .index import ID_BLOCK, postings_for, titles


def normalize_term(term: str, mode: str = "reference") -> str:
    """Query terms are folded and stemmed, but not cut at separators."""
    return stem_word(fold_word(term, mode))


def matches_nothing(queries: Iterable[str], strict: bool = False, extended: bool = False) -> bool:
    """Whether one of the queries is met by a document that has none of its terms, as by a NOT alone."""
    return any(evaluate(to_rpn(q, strict, extended), lambda _: False, lambda a, b: a and b, lambda a, b: a or b, lambda a: not a, False) for q in queries)


class Searcher:
    """Search over stored postings, or over texts when there is no index yet."""

    def __init__(self, docs: DataFrame, postings: DataFrame | None = None, mode: str = "reference"):
        """``docs`` has doc_id and text, or doc_id and title when ``postings`` (term, doc_id) are given."""
        self.docs, self.postings, self.mode = docs, postings, mode

    def lookup(self, terms: list[str]) -> DataFrame:
        """(term, doc_id) of normalised terms; the filter reaches the scan of stored postings."""
        if self.postings is None:
            return postings_for(self.docs, terms, self.mode)
        return self.postings.where(F.col("term").isin(terms)).select("term", "doc_id")

    def flags(self, terms: list[str], *keep: str, whole: bool = True) -> DataFrame:
        """Every document with one boolean column per term, f0, f1, ..., and the columns ``keep`` of its row.

        Unless ``whole``, documents without any of the terms are left out, and the document table is not read.
        """
        if not whole:
            found = self.lookup(terms).groupBy("doc_id").agg(*[F.max(F.col("term") == t).alias(f"f{k}") for k, t in enumerate(terms)])
            return found.select("doc_id", *[f"f{k}" for k in range(len(terms))])
        universe = self.docs.select("doc_id", *keep) if keep else self.docs.select("doc_id").distinct()
        found = self.lookup(terms).groupBy("doc_id").agg(*[F.max(F.col("term") == t).alias(f"f{k}") for k, t in enumerate(terms)], F.lit(1).alias("any"))
        both = universe.join(found, "doc_id", "left")
        return both.select("doc_id", *keep, *[F.coalesce(f"f{k}", F.lit(False)).alias(f"f{k}") for k in range(len(terms))])

    def _compile(self, query: str, at: dict[str, Column], strict: bool) -> Column:
        return evaluate(
            to_rpn(query, strict), lambda t: at[normalize_term(t, self.mode)], lambda a, b: a & b, lambda a, b: a | b, lambda a: ~a, F.lit(False)
        )

    def _terms(self, queries: list[str]) -> list[str]:
        return list(dict.fromkeys(normalize_term(t, self.mode) for q in queries for t in terms_of(to_rpn(q))))

    def search(self, query: str, strict: bool = False) -> DataFrame:
        """doc_id of the hits."""
        terms = self._terms([query])
        at = {t: F.col(f"f{k}") for k, t in enumerate(terms)}
        return self.flags(terms, whole=not terms or matches_nothing([query], strict)).where(self._compile(query, at, strict)).select("doc_id")

    def facets(self, query: str, by: list[str], strict: bool = False) -> DataFrame:
        """(facet, value, n_hits): hits in all and by each of the columns ``by`` of the documents, in the pass that finds them.

        A hit without a value counts for a null value; ``facet`` is 'all' for the total. Without hits there is the total only.
        """
        terms = self._terms([query])
        at = {t: F.col(f"f{k}") for k, t in enumerate(terms)}
        hits = self.flags(terms, *by).where(self._compile(query, at, strict)).select(*by)
        sets = hits.groupingSets([[F.col(c)] for c in by] + [[]], *by).agg(F.count("*").alias("n_hits"), *[F.grouping(c).alias(f"_{c}") for c in by])
        facet = F.coalesce(*[F.when(F.col(f"_{c}") == 0, F.lit(c)) for c in by], F.lit("all"))
        value = F.coalesce(*[F.when(F.col(f"_{c}") == 0, F.col(c).cast("string")) for c in by])
        return sets.select(facet.alias("facet"), value.alias("value"), "n_hits")

    def search_batch(self, queries: dict[int, str], strict: bool = False) -> DataFrame:
        """(query_id, doc_id) of many queries in one pass over the postings of all their terms."""
        terms = self._terms(list(queries.values()))
        at = {t: F.col(f"f{k}") for k, t in enumerate(terms)}
        met = [F.when(self._compile(q, at, strict), F.lit(i)) for i, q in queries.items()]
        hits = self.flags(terms, whole=not terms or matches_nothing(queries.values(), strict)).select("doc_id", F.explode(F.array_compact(F.array(*met))).alias("query_id"))
        return hits.select(F.col("query_id").cast("long").alias("query_id"), "doc_id")

    def search_sets(self, query: str, strict: bool = False) -> DataFrame:
        """The same answer by set operators on document lists."""
        universe = self.docs.select("doc_id").distinct()
        return evaluate(
            to_rpn(query, strict),
            lambda t: self.lookup([normalize_term(t, self.mode)]).select("doc_id").distinct(),
            intersection,
            union,
            lambda a: difference(universe, a),
            universe.limit(0),
        )

    def with_titles(self, hits: DataFrame) -> DataFrame:
        named = self.docs.select("doc_id", "title") if "title" in self.docs.columns else titles(self.docs)
        return hits.join(named, "doc_id")

    def total_docs(self) -> DataFrame:
        return self.docs.select("doc_id").distinct().agg(F.count("*").alias("n_docs"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "doc_id", "left_semi")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionAll(b).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "doc_id", "left_anti")


def page(hits: DataFrame, number: int, size: int = 20) -> DataFrame:
    """One page (from 0) of hits in ascending id."""
    return hits.orderBy("doc_id").offset(size * number).limit(size)


def page_after(hits: DataFrame, last_id: int | None, size: int = 20) -> DataFrame:
    """The page that follows the one whose last id is ``last_id`` (None: the first), however deep: no task gets more than ``size`` rows of others."""
    later = hits if last_id is None else hits.where(F.col("doc_id") > last_id)
    return later.orderBy("doc_id").limit(size)


def numbered(hits: DataFrame, width: int = ID_BLOCK) -> DataFrame:
    """Hits with ``place``, their number from 0 in ascending id.

    No task sees all hits: they are numbered within blocks of ``width`` ids, and the hits of earlier blocks come from a table with one row for each block.
    """
    blocks = hits.withColumn("_block", F.floor(F.col("doc_id") / F.lit(width)))
    before = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    counts = blocks.groupBy("_block").agg(F.count("*").alias("n")).select("_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("_block").orderBy("doc_id")) - 1
    return blocks.withColumn("_own", own).join(counts, "_block").withColumn("place", (F.col("_before") + F.col("_own")).cast("long")).drop("_block", "_own", "_before")


def page_count(hits: DataFrame, size: int = 20) -> DataFrame:
    return hits.agg(F.count("*").alias("n_hits"), F.ceil(F.count("*") / size).cast("long").alias("n_pages"))


def first_hits(hits: DataFrame, n: int = 10) -> DataFrame:
    return hits.orderBy("doc_id").limit(n)
