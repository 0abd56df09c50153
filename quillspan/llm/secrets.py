"""Secret scan: fixed patterns plus a randomness test battery on other long tokens.

Base spans come from three patterns (assignments, access keys, hex runs). Beside them every long
token whose characters fit an encoding is tested against the hypothesis that it was drawn
uniformly from that encoding's alphabet: chi-squared uniformity (over all characters, and over
classes of them so that short tokens have power), a runs test and a lag-1 serial correlation.
The smallest p-value is the statistic. Its law under the hypothesis is simulated for every encoding
and length (a fixed seed, ``DRAWS`` tokens of that inferred encoding; from ``FAR`` characters on the law
of that length), and the rank of a token in it is its p. So random tokens have uniform p, and written
language has p near 0.

False-discovery control is by (encoding, length class), over the distinct tokens of all
documents: the number of p-values above ``SURE``, over 1 - ``SURE``, estimates how many tokens of a class
are random, and with it how many of those above any threshold are not. A class gets the smallest threshold
from ``ACCEPT`` on at which the estimated share of false finds is at most ``FDR``. Classes of fewer than
``LEAST`` tokens are judged together. Only the table of counts (encodings x length classes x bins)
reaches the driver.

Null texts count as empty and have no spans; repeated rows are scanned each and equal tokens count once
in the control; texts are scanned whole, whatever their length. Columns other than doc_id and text are
not read by the scan and pass through redaction. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_batches, scratch

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Tokens for the battery. Shorter ones, or those of fewer bits, leave the tests without power.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])")
MIN_BITS = 80.0
ACCEPT = 0.01
FDR = 0.1
#: Cells of the histogram of p; ``ACCEPT`` is the edge of the first.
BINS = 100
#: Distinct tokens below which a class is judged together with the other small ones.
LEAST = 40
#: p-values above this are taken for those of random tokens.
SURE = 0.25
#: Simulated tokens of a null law, and the length from which on laws no longer change.
DRAWS = 10_000
FAR = 512

_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings from the narrowest to the widest alphabet; a token gets the first that holds all its characters.
ENCODINGS = {
    "hex": _DIGIT + "abcdef",
    "HEX": _DIGIT + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGIT + _LOWER,
    "BASE36": _DIGIT + _UPPER,
    "base62": _UPPER + _LOWER + _DIGIT,
    "base64": _UPPER + _LOWER + _DIGIT + "+/",
    "base64url": _UPPER + _LOWER + _DIGIT + "-_",
}
_FREQUENT = set("etaoinsrhldcu")


def _character_class(ch: str) -> int:
    """Digits, frequent and rare letters by case, and the rest: the cells of the grouped test."""
    if ch in _DIGIT:
        return 0
    if ch.isalpha():
        return 1 + 2 * ch.isupper() + (ch.lower() in _FREQUENT)
    return 5


_INDEX = {name: {ch: i for i, ch in enumerate(alphabet)} for name, alphabet in ENCODINGS.items()}
_SETS = {name: frozenset(alphabet) for name, alphabet in ENCODINGS.items()}
#: Rows of the alphabet by class of character.
_CELLS = {name: np.array([[_character_class(ch) == k for ch in alphabet] for k in sorted(set(map(_character_class, alphabet)))], dtype=float) for name, alphabet in ENCODINGS.items()}


def infer_encoding(token: str) -> str | None:
    """The narrowest encoding that fits; none for tokens without both letters and digits (words, numbers)."""
    used = set(token)
    if not used & set(_DIGIT) or not used & set(_LOWER + _UPPER):
        return None
    return next((name for name, chars in _SETS.items() if used <= chars), None)


_erfc = np.vectorize(math.erfc, otypes=[float])


def _chi2_tail(x: np.ndarray, df: float) -> np.ndarray:
    """Upper tail of chi-squared by the Wilson-Hilferty approximation."""
    z = (np.cbrt(np.maximum(x, 0) / df) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * _erfc(z / math.sqrt(2))


def battery(x: np.ndarray, encoding: str) -> np.ndarray:
    """Smallest p of the four tests for each row of alphabet positions; comparable between tokens of one length."""
    k, n = x.shape
    m, cells = len(ENCODINGS[encoding]), _CELLS[encoding]
    counts = np.bincount((np.arange(k)[:, None] * m + x).ravel(), minlength=k * m).reshape(k, m)
    uniform = _chi2_tail(m / n * (counts**2).sum(axis=1) - n, m - 1)
    expected = n * cells.sum(axis=1) / m
    classes = _chi2_tail((((counts @ cells.T) - expected) ** 2 / expected).sum(axis=1), len(cells) - 1)
    high = x >= m / 2
    a = high.sum(axis=1)
    b = n - a
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
    mean = 1 + 2 * a * b / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    z = np.where(var > 0, (runs - mean) / np.sqrt(np.where(var > 0, var, 1)), 0)
    run_test = np.where((a > 0) & (b > 0), _erfc(np.abs(z) / math.sqrt(2)), 2.0 ** (1 - min(n, 1000)))
    d = x - x.mean(axis=1, keepdims=True)
    total = (d * d).sum(axis=1)
    lag = (d[:, 1:] * d[:, :-1]).sum(axis=1)
    serial = np.where(total > 0, _erfc(np.abs(lag / np.where(total > 0, total, 1) + 1 / n) * math.sqrt(n / 2)), 0)
    return np.minimum(np.minimum(uniform, classes), np.minimum(run_test, serial))


@lru_cache(maxsize=4096)
def null_law(encoding: str, length: int) -> np.ndarray:
    """Sorted statistics of ``DRAWS`` random tokens whose inferred encoding is this one."""
    alphabet, names = ENCODINGS[encoding], list(ENCODINGS)
    rng = np.random.default_rng([names.index(encoding), length])
    digit = np.array([ch in _DIGIT for ch in alphabet])
    narrower = [np.array([ch in _SETS[name] for ch in alphabet]) for name in names[: names.index(encoding)]]
    got, n = [], 0
    while n < DRAWS:
        x = rng.integers(0, len(alphabet), (1000, length))
        fits = digit[x].any(axis=1) & (np.array([ch.isalpha() for ch in alphabet])[x]).any(axis=1)
        for inside in narrower:
            fits &= ~inside[x].all(axis=1)
        got.append(battery(x[fits], encoding))
        n += int(fits.sum())
    return np.sort(np.concatenate(got)[:DRAWS])


def randomness_p(token: str, encoding: str) -> float:
    """p of the battery under uniform draws from the encoding's alphabet: uniform for random tokens."""
    index = _INDEX[encoding]
    law = null_law(encoding, min(len(token), FAR))
    value = battery(np.array([[index[ch] for ch in token]]), encoding)[0]
    low, high = np.searchsorted(law, value, side="left"), np.searchsorted(law, value, side="right")
    # Statistics of short tokens tie; the checksum of the token places it within its tie.
    return float(low + (zlib.crc32(token.encode()) / (1 << 32)) * (high - low + 1)) / (len(law) + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns: leftmost, non-overlapping within a kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def length_class(token: str) -> int:
    """Half octaves of the length: tokens of a class have tests of like power."""
    return int(2 * math.log2(len(token)))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
    """(start, end, class, p) of the tokens outside base spans that fit an encoding."""
    found = []
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))  # base spans are sorted by start
    for m in TOKEN.finditer(text):
        encoding = infer_encoding(m[0])
        if encoding is None or len(m[0]) * math.log2(len(ENCODINGS[encoding])) < MIN_BITS:
            continue
        before = bisect_left(starts, m.end())
        if not before or reach[before - 1] <= m.start():
            found.append((m.start(), m.end(), f"{encoding}:{length_class(m[0])}", randomness_p(m[0], encoding)))
    return found


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _scan(cols: dict[str, list]) -> dict[str, list]:
    out = {k: [] for k in ("doc_id", "base", "starts", "ends", "classes", "p", "hashes")}
    for doc, text in zip(cols["doc_id"], cols["text"]):
        text = text or ""
        base = base_spans(text)
        more = candidates(text, base)
        row = (doc, join_spans(base), *([c[i] for c in more] for i in range(4)), [hashlib.md5(text[c[0] : c[1]].encode()).hexdigest() for c in more])
        for name, value in zip(out, row):
            out[name].append(value)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Per document: its base spans and its candidates with their p-values. Compact, and checkpointed."""
    schema = "doc_id long, base string, starts array<int>, ends array<int>, classes array<string>, p array<double>, hashes array<string>"
    return durable(map_batches(docs.select("doc_id", "text"), _scan, schema))


def thresholds(scanned: DataFrame) -> dict[str, float]:
    """Smallest accepted p by class, from the counts of distinct tokens over all documents."""
    one = scanned.where(F.size("hashes") > 0).select(F.explode(F.arrays_zip("classes", "p", "hashes")).alias("c"))
    binned = one.select(F.col("c.classes").alias("cls"), F.least(F.floor(F.col("c.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"), F.col("c.hashes").alias("h"))
    counts: dict[str, Counter] = defaultdict(Counter)
    for r in binned.distinct().groupBy("cls", "bin").agg(F.count("*").alias("n")).collect():
        counts[r["cls"]][r["bin"]] = r["n"]
    return class_thresholds(counts)


def class_thresholds(counts: dict[str, Counter]) -> dict[str, float]:
    """Thresholds of all classes from their histograms of p; small classes share one."""
    small = [cls for cls, bins in counts.items() if sum(n for b, n in bins.items() if b) < LEAST]
    together = class_threshold(sum((counts[cls] for cls in small), Counter()))
    return {cls: together if cls in small else class_threshold(bins) for cls, bins in counts.items()}


def class_threshold(bins: Counter) -> float:
    """The smallest edge of the histogram above which the estimated share of false finds is within ``FDR``."""
    random = sum(n for b, n in bins.items() if b >= SURE * BINS) / (1 - SURE)
    for edge in range(round(ACCEPT * BINS), round(SURE * BINS)):
        found = sum(n for b, n in bins.items() if b >= edge)
        if found - random * (1 - edge / BINS) <= FDR * found:
            return edge / BINS
    return SURE


def accept(base: str, starts: list[int], ends: list[int], classes: list[str], p: list[float], at: dict[str, float]) -> list[tuple[int, int, int]]:
    spans = [(int(s), KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in base.split(",") if x)]
    return sorted(spans + [(s, 3, e) for s, e, c, v in zip(starts, ends, classes, p) if v >= at.get(c, ACCEPT)])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for every document."""
    scanned = scan(docs)
    at = thresholds(scanned)

    def finish(cols):
        out = {k: [] for k in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")}
        for doc, base, *rest in zip(*(cols[k] for k in ("doc_id", "base", "starts", "ends", "classes", "p"))):
            spans = accept(base, *rest, at)
            kinds = Counter(k for _, k, _ in spans)
            row = (doc, kinds[0], kinds[1], kinds[2], hashlib.sha256(base.encode()).hexdigest(), join_spans(spans), kinds[3])
            for name, value in zip(out, row):
                out[name].append(value)
        return out

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    return map_batches(scanned.drop("hashes"), finish, schema)


def redact_text(text: str, at: dict[str, float]) -> str:
    """The text with every span replaced by a mark; overlapping spans become one."""
    base = base_spans(text)
    spans = sorted(base + [(s, 3, e) for s, e, c, v in candidates(text, base) if v >= at.get(c, ACCEPT)])
    out, done = [], 0
    for start, kind, end in spans:
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind]} removed]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with its secrets masked; null texts stay null. Thresholds come from all rows."""
    with scratch(docs.sparkSession, collect=False):
        at = thresholds(scan(docs.select("doc_id", F.col(column).alias("text"))))

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t and redact_text(t, at), na_action="ignore")

    return docs.withColumn(column, mask(column))
