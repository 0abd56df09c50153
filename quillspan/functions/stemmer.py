"""Suffix stripping for Russian, as Catalyst expressions and as a scalar twin for query terms.

``strip(S)`` finds the longest suffix in S and removes it if more than four bytes remain. If it is
blocked, shorter members are not tried. Order: reflexive; adjective and then participle, or else
verb, or else noun; a final и; ость after a consonant (without guard); superlative.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The suffix lists of the rule set that results must match, in its order.
REFLEXIVE = "ся сь".split()
ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ому ему их ых ую юю ая яя ою ею".split()
PARTICIPLE = "ивш ывш ующ ем нн вш ющ щ".split()
VERB = (
    "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю "
    "ала яла ела али яли ели ало яло ело ал ял ел"
).split()
NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()
SUPERLATIVE = "ейш ейше".split()
#: Bytes that must remain, plus one.
GUARD = 4


def suffix_pattern(suffixes: list[str]) -> str:
    return "(" + "|".join(sorted(suffixes, key=len, reverse=True)) + ")"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often the body names it, so expressions stay small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _tail(word: Column, size: int) -> Column:
    return F.substring(word, -size, size)


def _by_suffix(word: Column, suffixes: list[str], found: Callable[[int], Column], none: Column) -> Column:
    """``found`` of the size of the longest suffix that the word has, or ``none``.

    Ends are looked up in sets, most words are told apart by their last letter. A pattern would be tried at every letter of the word.
    """
    sizes = sorted({len(s) for s in suffixes}, reverse=True)
    out = F
    for size in sizes:
        out = out.when(_tail(word, size).isin([s for s in suffixes if len(s) == size]), found(size))
    out = out.otherwise(none)
    return F.when(_tail(word, 1).isin(_last_letters(suffixes)), out).otherwise(none) if len(sizes) > 1 else out


def _last_letters(suffixes: list[str]) -> list[str]:
    return sorted({s[-1] for s in suffixes})


def _free(word: Column, size: int) -> Column:
    """Whether a suffix may go; each of its letters has two bytes."""
    return F.octet_length(word) > GUARD + 2 * size


def _hit(word: Column, suffixes: list[str]) -> Column:
    """The size of the suffix to strip, or 0."""
    return _by_suffix(word, suffixes, lambda size: F.when(_free(word, size), size).otherwise(0), F.lit(0))


def _cut(word: Column, size: Column | int) -> Column:
    return F.substring(word, F.lit(1), F.char_length(word) - size)


def _strip(word: Column, suffixes: list[str]) -> Column:
    return _by_suffix(word, suffixes, lambda size: F.when(_free(word, size), _cut(word, size)).otherwise(word), word)


def _main(word: Column) -> Column:
    """Adjective and participle, or else verb, or else noun."""

    def by_verb(verb: Column) -> Column:
        return F.when(verb > 0, _cut(word, verb)).otherwise(_strip(word, NOUN))

    def by_adjective(adjective: Column) -> Column:
        participle = _let(_cut(word, adjective), lambda w: _strip(w, PARTICIPLE))
        return F.when(adjective > 0, participle).otherwise(_let(_hit(word, VERB), by_verb))

    return _let(_hit(word, ADJECTIVE), by_adjective)


def _without_ost(word: Column) -> Column:
    return F.when(word.endswith("ость"), F.regexp_replace(word, r"(?<=[^аеиоуыэюя])ость\z", "")).otherwise(word)


#: Letters that a word must end in to be changed.
_ENDS = _last_letters([*REFLEXIVE, *ADJECTIVE, *VERB, *NOUN, "и", "ость", *SUPERLATIVE])


def stem(word: Column | str) -> Column:
    """Stem of a folded token. Tokens that do not end in a letter of any suffix are their own stems at the cost of one test."""
    word = F.col(word) if isinstance(word, str) else word
    out = _let(word, lambda w: _strip(w, REFLEXIVE))
    out = _let(out, _main)
    out = _let(out, lambda w: _strip(w, ["и"]))
    out = _let(out, _without_ost)
    out = _let(out, lambda w: _strip(w, SUPERLATIVE))
    return F.when(_tail(word, 1).isin(_ENDS), out).otherwise(word)


def with_stem(df: DataFrame, token: str, out: str) -> DataFrame:
    """Add ``out``: the stem of ``token``."""
    return df.withColumn(out, stem(token))


def stem_word(word: str) -> str:
    """Stem of one word, outside of Spark's expressions. Without a Russian letter at its end it is its own stem."""
    if not ("а" <= word[-1:] <= "я" or word[-1:] == "ё"):
        return word

    def strip(w: str, suffixes: list[str]) -> tuple[str, bool]:
        found = re.search(suffix_pattern(suffixes) + r"\Z", w)
        if found and len(w[: found.start()].encode()) > GUARD:
            return w[: found.start()], True
        return w, False

    word, _ = strip(word, REFLEXIVE)
    word, done = strip(word, ADJECTIVE)
    if done:
        word, _ = strip(word, PARTICIPLE)
    else:
        word, done = strip(word, VERB)
        if not done:
            word, _ = strip(word, NOUN)
    word, _ = strip(word, ["и"])
    word = re.sub(r"(?<=[^аеиоуыэюя])ость\Z", "", word)
    return strip(word, SUPERLATIVE)[0]
