"""Phrases, proximity and highlighting on the places of terms inside one document, as column expressions.

A document's places are a map from term to ascending token numbers. All work is linear in the places of the words asked for.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _places(at: Column, word: str) -> Column:
    return F.coalesce(F.try_element_at(at, F.lit(word)), F.array().cast("array<int>"))


def _back(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - F.lit(by))


def _tagged(places: Column, **tags: int) -> Column:
    """Places as structs with constant fields."""
    return F.transform(places, lambda x: F.struct(x.alias("x"), *[F.lit(v).alias(n) for n, v in tags.items()]))


def phrase_places(at: Column, words: Sequence[str]) -> Column:
    """Places where the words follow one another; repeated words are words of their own."""
    if not words:
        return F.array().cast("array<int>")
    return reduce(F.array_intersect, [_back(_places(at, w), k) for k, w in enumerate(words)])


def has_phrase(at: Column, words: Sequence[str]) -> Column:
    return F.size(phrase_places(at, words)) > 0


def has_near(at: Column, words: Sequence[str], slack: int) -> Column:
    """Whether all words, each as often as it is named, lie within ``len(words) + slack`` tokens, in any order.

    One pass over the places of all words in order: for each word that is named c times its last c places are kept, and the words lie
    close enough where the first of all kept places is not too far back.
    """
    if not words:
        return F.lit(False)
    counts = Counter(words)
    offset, slots = {}, 0
    for w, c in counts.items():
        offset[w] = slots
        slots += c
    reach = len(words) + slack
    events = F.array_sort(F.concat(*[_tagged(_places(at, w), a=offset[w], b=offset[w] + counts[w]) for w in counts]))
    far = F.lit(-(1 << 30))

    def step(state: Column, e: Column) -> Column:
        moved = lambda last: F.transform(last, lambda v, k: F.when((k < e.a) | (k >= e.b), v).when(k == e.b - 1, e.x).otherwise(F.coalesce(F.get(last, k + 1), far)))
        return F.when(state.hit, state).otherwise(
            _let(moved(state.last), lambda last: F.struct(last.alias("last"), (F.array_min(last) > e.x - reach).alias("hit")))
        )

    start = F.struct(F.array_repeat(far, slots).alias("last"), F.lit(False).alias("hit"))
    return F.aggregate(events, start, step, lambda s: s.hit)


def best_window(at: Column, terms: Sequence[str], width: int) -> Column:
    """First token of the window of ``width`` tokens with the most different terms, then the most occurrences, then the earliest.

    A window begins at an occurrence; without any it is 0. Occurrences are taken in order, and each is compared with those at
    most ``width`` tokens before it only, so the work is linear in the occurrences times ``width``.
    """
    events = F.array_sort(F.concat(*[_tagged(_places(at, t), k=k) for k, t in enumerate(terms)]))

    def rated(all_: Column) -> Column:
        def rate(e: Column, i: Column) -> Column:
            inside = F.filter(F.slice(all_, i + 1, F.lit(width * len(terms))), lambda o: o.x < e.x + width)
            return F.struct(F.size(F.array_distinct(F.transform(inside, lambda o: o.k))).alias("different"), F.size(inside).alias("n"), (-e.x).alias("x"))

        return F.transform(all_, rate)

    return F.coalesce(-F.array_max(_let(events, rated)).x, F.lit(0))
