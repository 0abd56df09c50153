"""Search in the extended query language over a segmented index.

All atoms of a query are answered from one scan of postings: patterns and fuzzy terms become lists of
terms by the dictionary first, the scan reads the rows of all terms that any atom names, one aggregation by document
makes a flag for each atom, and the query is one boolean column over flags. It is applied to all live documents only if one without
any of the terms can be a hit. Places are read only
if the query has a phrase, the title flag only if it has a title atom.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.query_language import Atom, atom, evaluate, terms_of, to_rpn
from . import dictionary
from .positions import best_window, has_near, has_phrase
from .ranking import query_words
from .search import matches_nothing, normalize_term
from .segments import SegmentIndex

#: Terms up to which a pattern's terms are a list in the plan; more are joined.
LISTED = 1000


class IndexSearcher:
    def __init__(self, index: SegmentIndex):
        self.index = index

    def _read(self, query: str, strict: bool) -> tuple[list, dict[str, Atom]]:
        rpn = to_rpn(query, strict, extended=True)
        words = lambda text: query_words(text, self.index.mode)
        atoms = {}
        for value in terms_of(rpn):
            a = atom(value, words)
            if a.kind in ("phrase", "near") and len(a.words) == 1 and not a.slack:
                a = Atom("term", a.words)
            elif a.kind in ("term", "title", "fuzzy"):
                a = Atom(a.kind, (normalize_term(a.words[0], self.index.mode),), a.slack)
            elif a.kind == "pattern":
                a = Atom("pattern", (dictionary.fold_pattern(a.words[0], self.index.mode),))
            atoms[value] = a
        return rpn, atoms

    def flags(self, atoms: list[Atom], whole: bool = True) -> DataFrame:
        """Every live document with one boolean column per atom, f0, f1, ...; unless ``whole``, only those with one of the atoms' terms."""
        plain = sorted({w for a in atoms if a.kind in ("term", "title", "phrase", "near") for w in a.words})
        placed = sorted({w for a in atoms if a.kind in ("phrase", "near") for w in a.words})
        titled = any(a.kind == "title" for a in atoms)
        open_ = {k: dictionary.resolve(self.index, a) for k, a in enumerate(atoms) if a.kind in ("pattern", "fuzzy")}
        listed = {k: [r["term"] for r in terms.limit(LISTED + 1).collect()] for k, terms in open_.items()}
        large = [k for k, terms in listed.items() if len(terms) > LISTED]
        named = sorted({*plain, *(t for k, terms in listed.items() if k not in large for t in terms)})

        blocks = self.index.blocks()
        groups = "array<int>"
        if large:  # too many terms for a list: which open atoms each term answers is joined
            met = None
            for k in large:
                rows = open_[k].select("term", F.lit(k).alias("k"))
                met = rows if met is None else met.unionAll(rows)
            met = met.groupBy("term").agg(F.collect_set("k").alias("open"))
            rows = blocks.join(met, "term", "left")
            rows = rows.where(F.col("open").isNotNull() | F.col("term").isin(named))
            opened = rows.select("segment", "term", "block", "open").groupBy("term").agg(F.first("open").alias("open"))
            found = self.index.matches(rows, *["title"] * titled, *["places"] * bool(placed)).join(opened, "term")
        else:
            rows = blocks.where(F.col("term").isin(named))
            found = self.index.matches(rows, *["title"] * titled, *["places"] * bool(placed)).withColumn("open", F.lit(None).cast(groups))

        def flag(k: int, a: Atom) -> Column:
            if k in large:
                return F.max(F.array_contains("open", k))
            if k in listed:
                return F.max(F.col("term").isin(listed[k]))
            if a.kind == "title":
                return F.max((F.col("term") == a.words[0]) & F.col("title"))
            if a.kind == "term":
                return F.max(F.col("term") == a.words[0])
            return F.lit(None).cast("boolean")

        at = [F.map_from_entries(F.collect_list(F.when(F.col("term").isin(placed), F.struct("term", "places")))).alias("at")] * bool(placed)
        grouped = found.groupBy("doc_id").agg(F.lit(1).alias("any"), *[flag(k, a).alias(f"f{k}") for k, a in enumerate(atoms)], *at)
        for k, a in enumerate(atoms):
            if a.kind == "phrase":
                grouped = grouped.withColumn(f"f{k}", has_phrase(F.col("at"), a.words))
            elif a.kind == "near":
                grouped = grouped.withColumn(f"f{k}", has_near(F.col("at"), a.words, a.slack))
        both = self.index.docs().select("doc_id").join(grouped, "doc_id", "left") if whole else grouped
        return both.select("doc_id", *[F.coalesce(f"f{k}", F.lit(False)).alias(f"f{k}") for k in range(len(atoms))])

    def search_batch(self, queries: dict[int, str], strict: bool = False) -> DataFrame:
        """(query_id, doc_id) of the hits of many queries in one pass."""
        read = {q: self._read(text, strict) for q, text in queries.items()}
        distinct = list(dict.fromkeys(a for _, atoms in read.values() for a in atoms.values()))
        column = {a: F.col(f"f{k}") for k, a in enumerate(distinct)}
        met = [
            F.when(evaluate(rpn, lambda v, atoms=atoms: column[atoms[v]], lambda a, b: a & b, lambda a, b: a | b, lambda a: ~a, F.lit(False)), F.lit(q).cast("long"))
            for q, (rpn, atoms) in read.items()
        ]
        return self.flags(distinct, matches_nothing(queries.values(), strict, extended=True)).select(F.explode(F.array_compact(F.array(*met))).alias("query_id"), "doc_id")

    def search(self, query: str, strict: bool = False) -> DataFrame:
        """doc_id of the hits."""
        return self.search_batch({0: query}, strict).select("doc_id")

    def highlight(self, ids: list[int], query: str, texts: DataFrame, width: int = 12) -> DataFrame:
        """(doc_id, begin, snippet): the best ``width`` tokens of each document of a page of hits.

        Only the texts of ``ids`` are read and cut into tokens; where the window lies comes from the index. ``texts`` has doc_id and text.
        """
        from ..functions.text import token_array

        _, atoms = self._read(query, False)
        terms = sorted({w for a in atoms.values() if a.kind not in ("pattern", "fuzzy") for w in a.words})
        here = F.col("doc_id").isin(ids)
        page = texts.where(here).select("doc_id", token_array("text", self.index.mode).alias("tokens"))
        if not terms:
            return page.select("doc_id", F.lit(0).alias("begin"), F.array_join(F.slice("tokens", 1, width), " ").alias("snippet"))
        numbers = sorted({i // self.index.width for i in ids})
        rows = self.index.blocks().where(F.col("term").isin(terms) & F.col("block").isin(numbers))
        found = self.index.matches(rows, "places").where(here).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at"))
        both = page.join(F.broadcast(found), "doc_id", "left")  # a page of hits
        begin = F.when(F.col("at").isNull(), F.lit(0)).otherwise(best_window(F.col("at"), terms, width))
        return both.withColumn("begin", begin).select("doc_id", "begin", F.array_join(F.slice("tokens", F.col("begin") + 1, F.lit(width)), " ").alias("snippet"))
