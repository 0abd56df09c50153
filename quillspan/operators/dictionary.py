"""Patterns and fuzzy terms over the index's dictionary.

A pattern's first letters are a range of the sorted dictionary, which reaches the scan; a pattern that begins with a star is
looked up by the three-letter grams of its other parts. Many words at once meet the dictionary by what is left of both after up to
``edits`` deletions - two words within that distance always share such a rest - and Levenshtein's distance confirms.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_word
from ..plans.query_language import Atom
from .segments import BEGIN, END, GRAM, SegmentIndex

#: The greatest character.
_LAST = chr(0x10FFFF)


def fold_pattern(pattern: str, mode: str) -> str:
    """Patterns are folded like tokens, but not stemmed: they are compared with stems as they are written."""
    return re.sub(r"\*+", "*", fold_word(pattern, mode))


def pattern_condition(pattern: str, term: Column | str = "term") -> Column:
    """Whether a term fits a pattern: its first letters as a range, the rest as a regular expression."""
    term = F.col(term) if isinstance(term, str) else term
    head = pattern.split("*")[0]
    fits = term.rlike(r"\A(?s:" + ".*".join(re.escape(p) for p in pattern.split("*")) + r")\z")
    return (term >= head) & (term <= head + _LAST * 4) & fits if head else fits


def pattern_grams(pattern: str) -> list[str]:
    """Grams that every fitting term has."""
    parts = (BEGIN + pattern + END).split("*")
    return sorted({p[k : k + GRAM] for p in parts for k in range(len(p) - GRAM + 1)})


def pattern_terms(index: SegmentIndex, pattern: str) -> DataFrame:
    """(term) of the dictionary that fit a pattern."""
    asked = pattern_grams(pattern)
    if pattern.startswith("*") and asked:
        return index.terms_with_grams(asked).where(pattern_condition(pattern)).select("term")
    return index.dictionary(pattern_condition(pattern)).select("term")


def deletions(word: str, edits: int) -> list[str]:
    """What is left of a word after at most ``edits`` deletions."""
    known = {word}
    for _ in range(edits):
        known |= {w[:k] + w[k + 1 :] for w in known for k in range(len(w))}
    return sorted(known)


def deletions_of(term: Column, edits: int) -> Column:
    """``deletions`` as a column."""

    def once(words: Column) -> Column:
        shorter = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(w), F.lit(1))), lambda k: F.concat(F.substring(w, F.lit(1), k - 1), F.substring(w, k + 1, F.char_length(w))))
        return F.array_distinct(F.concat(words, F.flatten(F.transform(words, shorter))))

    words = F.array(term)
    for _ in range(edits):
        words = once(words)
    return words


def fuzzy_join(asked: DataFrame, terms: DataFrame, edits: int) -> DataFrame:
    """(word, term, distance): all pairs of ``asked`` (word) and ``terms`` (term) within ``edits`` edits.

    An equality join on rests; a pair that shares several is made once. Lengths differ by at most ``edits``, which is
    tested before the pairs are made distinct. Rests of a long common word are as many as its letters (or their square for two edits),
    whatever the size of the dictionary.
    """
    left = asked.select("word", F.explode(deletions_of(F.col("word"), edits)).alias("rest"))
    right = terms.select("term", F.explode(deletions_of(F.col("term"), edits)).alias("rest"))
    near = F.abs(F.char_length("word") - F.char_length("term")) <= edits
    pairs = left.join(right, "rest").where(near).select("word", "term").distinct()
    return pairs.withColumn("distance", F.levenshtein("word", "term")).where(F.col("distance") <= edits)


def fuzzy_terms(index: SegmentIndex, word: str, edits: int) -> DataFrame:
    """(term) of the dictionary within ``edits`` edits of one word: the distance is tested for terms of about its length."""
    size, distance = F.char_length("term"), F.levenshtein(F.col("term"), F.lit(word), edits)
    return index.dictionary(size.between(len(word) - edits, len(word) + edits) & (distance >= 0)).select("term")


def resolve(index: SegmentIndex, atom: Atom) -> DataFrame:
    """(term) that an open atom stands for."""
    return pattern_terms(index, atom.words[0]) if atom.kind == "pattern" else fuzzy_terms(index, atom.words[0], atom.slack)
